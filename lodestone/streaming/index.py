"""A term index that grows with arriving documents and ranks like one built at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import content_words, stem, tokens
from lodestone.operators.retrieve import bm25_scores, top_k


class TermIndex:
    """Postings by bucket of the term, document frequencies and lengths by batch, all appended.

    Every batch has folders of its own and overwrites them, so a batch that is delivered again changes nothing. Frequencies are
    sums over batches. Documents are keyed by doc_id; one that another batch held is left out. The only writer of its folder is the stream.
    """

    def __init__(self, spark: SparkSession, path: str, lang: str | None = None, buckets: int = 32):
        self.spark, self.path, self.lang, self.buckets = spark, path.rstrip("/"), lang, buckets

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def postings(self) -> DataFrame:
        return self._read("postings", "term string, doc_id long, tf long, unit_len long, batch long, bucket int")

    def documents(self) -> DataFrame:
        return self._read("documents", "doc_id long, unit_len long, batch long")

    def frequencies(self) -> DataFrame:
        return self._read("frequencies", "term string, df long, batch long")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """``batch`` (doc_id, text) as batch ``batch_id``; made for ``foreachBatch``."""
        known = self.documents().where(F.col("batch") != batch_id).select("doc_id")
        new = batch.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropDuplicates(["doc_id"]).join(known, "doc_id", "left_anti")
        listed = new.select("doc_id", content_words(F.coalesce("text", F.lit("")), self.lang).alias("words"))
        listed.select("doc_id", F.size("words").cast("long").alias("unit_len")).write.mode("overwrite").parquet(f"{self.path}/documents/batch={batch_id}")
        each = listed.select("doc_id", F.size("words").cast("long").alias("unit_len"), F.explode("words").alias("word"))
        counted = each.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf"), F.first("unit_len").alias("unit_len"))
        terms = counted.groupBy(stem(F.col("word")).alias("term"), "doc_id").agg(F.sum("tf").alias("tf"), F.first("unit_len").alias("unit_len"))
        bucketed = terms.withColumn("bucket", F.pmod(F.hash("term"), F.lit(self.buckets)))
        spread = bucketed.repartition("bucket").sortWithinPartitions("bucket", "term")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch_id}")
        own = self.postings().where(F.col("batch") == batch_id).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        own.write.mode("overwrite").parquet(f"{self.path}/frequencies/batch={batch_id}")

    def search(self, questions: DataFrame, question: str, k: int) -> DataFrame:
        """(question, doc_id, score, rank): the ``k`` best documents of ``questions`` (question, text) so far.

        Only the buckets of the asked terms are read, where the terms fit a broadcast.
        """
        asked = questions.select(F.col(question), F.explode(tokens(F.col("text"), self.lang)).alias("term"))
        asked = asked.groupBy(question, "term").agg(F.count(F.lit(1)).alias("times"))
        wanted = asked.select("term").distinct().withColumn("bucket", F.pmod(F.hash("term"), F.lit(self.buckets)))
        tf = self.postings().join(wanted, ["bucket", "term"]).select("term", "doc_id", "tf", "unit_len")
        df = self.frequencies().join(wanted.select("term"), "term").groupBy("term").agg(F.sum("df").alias("df"))
        size = self.documents().agg(F.count(F.lit(1)).alias("n_units"), F.coalesce(F.avg("unit_len"), F.lit(0.0)).alias("avg_len"))
        return top_k(bm25_scores(asked, tf, df, size, question, "doc_id"), question, "score", k, "doc_id")


def index_stream(documents: DataFrame, index: TermIndex, checkpoint: str):
    """Documents of a stream into ``index`` as they arrive; returns the running query."""
    return documents.writeStream.foreachBatch(index.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
