"""Bounded training samples from ``labels``, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import held_out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents outside the held-out fifth.

    The sample is the ``most`` labelled ids of smallest hash; its size is a parameter, so it is broadcast
    to the scan of the texts, which never shuffle. Ids with contradictory labels are left out.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
        .where((F.col("label") == F.col("other")) & ~held_out(F.col("doc_id")))
        .select("doc_id", "label")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "doc_id")
