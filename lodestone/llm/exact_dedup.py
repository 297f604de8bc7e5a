"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per digest
(partial aggregation, so a text that makes up a third of the rows shuffles as one row per task), hashed
into the same buckets, and sort-merge anti-joined with the index; what the index lacks is appended.
The index side of that join is never shuffled.

Defined results: a null text counts as empty; texts are equal when identical after lower-casing A-Z;
the largest doc_id of a group stays (a null doc_id is smaller than any other); of rows that repeat both
doc_id and text exactly one stays; an empty batch gives no rows; a text of any length is
hashed whole; all other columns pass through, also those named like the operator's own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import ascii_lower, forget, scratch, text_or_empty, unused

SCHEMA = T.StructType([T.StructField("digest", T.StringType()), T.StructField("keep_id", T.LongType())])


def text_digest(text: Column | str) -> Column:
    """Lower-case hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(ascii_lower(text_or_empty(text)), 256)


class DigestIndex:
    """Digests seen so far with the doc_id kept for each.

    ``path`` makes the index outlive the session: opening the same path again attaches the table.
    Without it the table is a managed one in the warehouse.
    """

    def __init__(self, spark: SparkSession, table: str, path: str | None = None, buckets: int = 64):
        self.spark, self.table, self.buckets, self.path = spark, table, buckets, path
        where = f"LOCATION '{path}'" if path else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS {where}"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def append(self, digests: DataFrame) -> None:
        """Add (digest, keep_id) rows; a bucket gets one sorted file for each append."""
        writer = (
            digests.select("digest", F.col("keep_id").cast("long").alias("keep_id"))
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
        )
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.table)

    def admit(self, ids: DataFrame) -> DataFrame:
        """Group a batch of (doc_id, digest) and record its new digests.

        Returns a scratch table (digest, keep_id, group_size, repeats): ``keep_id`` is the index's for
        digests it already held, ``group_size`` counts the batch's rows, ``repeats`` how many rows carry
        ``keep_id`` itself (0 if it belongs to an earlier batch).
        """
        each = ids.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
        groups = each.groupBy("digest").agg(
            F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "n")).alias("top"),
            F.sum("n").alias("group_size"),
        )
        groups = scratch(
            groups.select(
                "digest",
                F.col("top.doc_id").alias("batch_id"),
                "group_size",
                F.col("top.n").alias("repeats"),
            ),
            "digest-groups",
        )
        fresh = (
            groups.hint("merge")
            .join(self.rows(), "digest", "left_anti")
            .select("digest", F.col("batch_id").alias("keep_id"))
        )
        fresh = scratch(fresh.withColumn("is_new", F.lit(True)), "digest-new")
        known = self.rows().select("digest", F.col("keep_id").alias("known_id")).hint("merge")
        # The old entries are read before the append; new digests keep the batch's own id.
        out = scratch(
            groups.join(known, "digest", "left").select(
                "digest",
                F.when(F.col("known_id").isNotNull(), F.col("known_id")).otherwise(F.col("batch_id")).alias("keep_id"),
                "group_size",
                F.when(F.col("known_id").isNotNull() & ~F.col("known_id").eqNullSafe(F.col("batch_id")), F.lit(0))
                .otherwise(F.col("repeats"))
                .alias("repeats"),
            ),
            "digest-batch",
        )
        self.append(fresh)
        forget(groups)
        forget(fresh)
        return out


def admit_descending(index: DigestIndex, ids: DataFrame) -> DataFrame:
    """``index.admit`` for a table of (doc_id, digest) in two batches, the upper half of the doc_ids first.

    The digests that the second batch shares with the first are found in the index by the merge join; as ids fall
    from batch to batch, the index holds the largest of each digest. Rows without doc_id belong to the second batch.
    """
    middle = ids.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    if middle is None:
        return index.admit(ids)
    upper = F.coalesce(F.col("doc_id") >= middle, F.lit(False))
    groups = index.admit(ids.where(upper)).unionByName(index.admit(ids.where(~upper)))
    return groups.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.sum("repeats").alias("repeats")
    )


def annotate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """``docs`` with keep_id, group_size, kept, text_sha256 (clashing input columns are replaced)."""
    digest, repeats = unused("text_digest", docs), unused("repeats", docs)
    new = {"keep_id", "group_size", "kept", "text_sha256"}
    docs = docs.select(*[c for c in docs.columns if c.lower() not in new], text_digest("text").alias(digest))
    groups = index.admit(docs.select(F.col("doc_id"), F.col(digest).alias("digest")))
    repeated = not groups.where("repeats > 1").isEmpty()
    out = (
        docs.join(groups.withColumnsRenamed({"digest": digest, "repeats": repeats}), digest)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col(repeats) > 0))
        .withColumnRenamed(digest, "text_sha256")
    )
    if repeated:
        first = Window.partitionBy("text_sha256", "doc_id").orderBy("group_size")
        out = out.withColumn("kept", F.col("kept") & (F.row_number().over(first) == 1))
    return out.drop(repeats)


def distinct_documents(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    own = index or DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}")
    admit = own.admit if index is not None else lambda ids: admit_descending(own, ids)
    digest, keep, repeats = (unused(x, docs) for x in ("own_digest", "own_keep_id", "own_repeats"))
    out = docs.withColumn(digest, text_digest("text"))
    groups = admit(out.select("doc_id", F.col(digest).alias("digest")))
    repeated = not groups.where("repeats > 1").isEmpty()
    if index is None:
        own.drop()
    groups = groups.where("repeats > 0").select(F.col("digest").alias(digest), F.col("keep_id").alias(keep))
    out = out.join(groups, (out[digest] == groups[digest]) & out["doc_id"].eqNullSafe(groups[keep])).drop(groups[digest])
    if repeated:
        first = Window.partitionBy(digest, "doc_id").orderBy(keep)
        out = out.withColumn(repeats, F.row_number().over(first)).where(F.col(repeats) == 1)
    return out.select(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of its group that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # Digests once, from the whole texts; grouping and labelling then move 72 bytes a document.
    ids = scratch(docs.select("doc_id", text_digest("text").alias("digest")), "doc-digests")
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    groups = scratch(admit_descending(index, ids), "digest-merged")
    repeated = not groups.where("repeats > 1").isEmpty()
    index.drop()
    out = ids.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    if repeated:
        first = Window.partitionBy("text_sha256", "doc_id").orderBy("group_size")
        out = out.withColumn("kept", F.col("kept") & (F.row_number().over(first) == 1))
    return out


OP7_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       d.doc_id IS NOT DISTINCT FROM g.keep_id
         AND row_number() OVER (PARTITION BY d.h, d.doc_id) = 1 AS kept,
       d.h AS text_sha256
FROM d JOIN g USING (h)
"""
