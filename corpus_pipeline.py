"""From raw documents to packed training sequences: toxicity, exact copies, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame;
all but the last return the columns of ``documents``. ``run`` writes every stage's result as Parquet in the
shared folder and reads it again, so an executor lost later costs no earlier stage.

Defined results: null and empty texts are documents (equal ones are exact copies; of size 0,
they follow the epochs of their source in the mix; packed, they are one token); a null doc_id or source is a value of its own; texts of any length are taken whole;
an empty table gives no rows; columns that are not of ``documents`` pass through all but the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import forget, scratch
from lodestone.llm.exact_dedup import distinct_documents
from lodestone.llm.mixing import mixed_documents
from lodestone.llm.ngram_join import one_per_component
from lodestone.llm.packing import pack_documents
from lodestone.llm.toxicity import reject_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more by the toxicity model go."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the smallest doc_id stays."""
    return one_per_component(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated or left out so that sources meet their targets."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Model scores and tokenisation are beyond SQL; the tests compare ``run`` with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
