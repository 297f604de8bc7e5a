"""Benchmark metrics over matched pairs of cases, counterfactual variants and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ledger import share
from lodestone.operators.verify import overlap

HIT = 0.30


def best_coverage(cases: DataFrame, citations: DataFrame) -> DataFrame:
    """(id, coverage, hit): the best overlap of any citation with a case's gold span, over the span's length.

    ``cases``: (id, doc_id, start, end); ``citations``: (id, doc_id, start, end).
    """
    c = citations.select("id", "doc_id", F.col("start").alias("b1"), F.col("end").alias("b2"))
    best = cases.join(c, ["id", "doc_id"], "left").groupBy("id").agg(
        (
            F.coalesce(F.max(overlap(F.col("start"), F.col("end"), F.col("b1"), F.col("b2"))), F.lit(0)).cast("double")
            / F.greatest(F.first(F.col("end") - F.col("start")), F.lit(1))
        ).alias("coverage")
    )
    return best.withColumn("hit", F.col("coverage") >= HIT)


def index_percentiles(rows: DataFrame, by: str, value: Column, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each of ``shares``, longest): the element at index min(n - 1, floor(n * share)) of the sorted values.

    Null values do not count; a share is 0 and ``longest`` null where a group has none. Values are counted before they are put
    in order, so a group costs its distinct values, and no list of them is built.
    """
    counted = rows.groupBy(by, value.alias("value")).agg(F.count(value).alias("n"))
    group = Window.partitionBy(by)
    placed = counted.withColumn("upto", F.sum("n").over(group.orderBy("value"))).withColumn("all", F.sum("n").over(group))
    at = lambda p: F.least(F.col("all") - 1, F.floor(F.col("all") * F.lit(p)))
    found = [F.coalesce(F.min(F.when(F.col("upto") > at(p), F.col("value"))), F.lit(0.0)).alias(name) for name, p in shares.items()]
    return placed.groupBy(by).agg(*found, F.max("value").alias("longest"))


def pairs(scored: DataFrame) -> DataFrame:
    """Answerable cases beside their unanswerable twins: (id, lang, hit, refused, twin_refused)."""
    twin = scored.select(F.col("id").alias("twin_id"), F.col("refused").alias("twin_refused"))
    asked = scored.where("answerable and pair_id is not null")
    return asked.join(twin, asked["pair_id"] == twin["twin_id"]).drop("twin_id")


def pair_metrics(scored: DataFrame) -> DataFrame:
    """One row: how many pairs are told apart, and how many get the same treatment twice."""
    told, both_no = F.col("hit") & F.col("twin_refused"), F.col("refused") & F.col("twin_refused")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    n = F.count(F.lit(1))
    return pairs(scored).agg(
        n.alias("pairs"),
        count(told).alias("told_apart"),
        count(~told & both_no).alias("always_refused"),
        count(~told & ~F.col("refused") & ~F.col("twin_refused")).alias("always_answered"),
        F.round(share(count(told), n), 6).alias("discrimination"),
    )


def case_aggregates() -> list[Column]:
    """Aggregates over scored cases (answerable, refused, hit, coverage): the gate metrics."""
    count = lambda c: F.sum(c.cast("long"))
    asked, unasked = F.col("answerable"), ~F.col("answerable")
    j3 = share(count(unasked & F.col("refused")), count(unasked))
    hit = share(count(asked & F.col("hit")), count(asked))
    return [
        F.count(F.lit(1)).alias("cases"),
        F.round(j3, 6).alias("j3_right_refusal"),
        F.round(share(count(asked & F.col("refused")), count(asked)), 6).alias("j4_false_refusal"),
        F.round(hit, 6).alias("anchored_hit_rate"),
        F.round(share(F.sum(F.when(asked, F.col("coverage")).otherwise(0.0)), count(asked)), 6).alias("mean_coverage"),
        F.round(hit + j3 - 1.0, 6).alias("youden_j"),
    ]


def summary(cases: DataFrame) -> DataFrame:
    """One row over ``cases`` (answerable, hit, stage, reached, occurrences).

    A refusal of an answerable case and an answer that misses are counted apart: the first costs, the second misleads.
    """
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    asked, unasked, answered = F.col("answerable"), ~F.col("answerable"), F.col("stage") == "answer"
    missed = asked & ~F.col("hit")
    part = lambda c, whole: F.round(share(count(c), count(whole)), 6)
    return cases.agg(
        F.count(F.lit(1)).alias("cases"),
        count((asked & F.col("hit")) | (unasked & ~answered)).alias("correct"),
        part(asked & F.col("hit"), asked).alias("hit_rate"),
        part(unasked & ~answered, unasked).alias("j3_right_refusal"),
        count(unasked).alias("uncovered"),
        count(unasked & answered).alias("false_answers"),
        count(missed & ~answered).alias("false_refusals"),
        count(missed & answered).alias("wrong_answers"),
        part(asked & F.col("reached"), asked).alias("retrieval_recall"),
        F.round(share(F.coalesce(F.sum(F.when(asked, F.col("occurrences"))), F.lit(0)), count(asked)), 6).alias("mean_occurrences"),
        count(asked & (F.col("occurrences") == 0)).alias("without_occurrences"),
    )


def stage_histograms(cases: DataFrame) -> DataFrame:
    """(of, stage, cases): where cases ended, of all and of the answerable ones that were refused."""
    refused = F.col("answerable") & ~F.col("hit") & (F.col("stage") != "answer")
    of = F.array_compact(F.array(F.lit("all"), F.when(refused, F.lit("false_refusals"))))
    return cases.select(F.explode(of).alias("of"), "stage").groupBy("of", "stage").agg(F.count(F.lit(1)).alias("cases"))


def harmful_anchors(rejections: DataFrame, most: int = 15) -> DataFrame:
    """(anchor, rejections): the anchors missed most often where the rejected quotation was a true one.

    ``rejections``: (harmful, missing); ties go by the anchor.
    """
    each = rejections.where("harmful").select(F.explode("missing").alias("anchor"))
    return each.groupBy("anchor").agg(F.count(F.lit(1)).alias("rejections")).orderBy(F.desc("rejections"), "anchor").limit(most)


#: metric, direction, threshold (fixed values)
GATES = (
    ("j3_right_refusal", ">=", 0.66),
    ("j4_false_refusal", "<=", 0.10),
    ("discrimination", ">=", 0.45),
    ("anchored_hit_rate", ">=", 0.66),
    ("false_answers", "<=", 14.0),
    ("cases", ">=", 100.0),
)


def gates(row: DataFrame) -> DataFrame:
    """(gate, value, threshold, passed) from a one-row metrics frame; a missing value never passes."""
    each = [
        F.struct(
            F.lit(name).alias("gate"),
            F.col(name).cast("double").alias("value"),
            F.lit(limit).alias("threshold"),
            F.coalesce((F.col(name) >= limit) if way == ">=" else (F.col(name) <= limit), F.lit(False)).alias("passed"),
        )
        for name, way, limit in GATES
    ]
    return row.select(F.inline(F.array(*each)))
