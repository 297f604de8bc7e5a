"""Verification of citations and claims, support scoring, voting and stage attribution.

Model output is a table of picks or claims; nothing here trusts it. A failure is never consent: what
cannot be checked is marked, not passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import anchors
from lodestone.functions.text import citation_form, tokens

CONFIRMED, NO_DOCUMENT, OUT_OF_RANGE, DIFFERENT, NO_CITATION = (
    "confirmed", "no_document", "out_of_range", "different_text", "no_citation",
)
STRONG, WEAK = 0.60, 0.15


def citation_verdict(source: Column, start: Column, end: Column, quoted: Column) -> Column:
    """The verdict on one citation, given the source text (null: no such document in the scope)."""
    there = F.substring(source, start + 1, end - start)
    return (
        F.when(source.isNull(), NO_DOCUMENT)
        .when(~((start >= 0) & (start < end) & (end <= F.length(source))), OUT_OF_RANGE)
        .when(citation_form(there) != citation_form(quoted), DIFFERENT)
        .otherwise(CONFIRMED)
    )


def verify_citations(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """``citations`` (doc_id, start, end, quoted, ...) with a verdict; a missing document is a verdict too."""
    sources = documents.select("doc_id", F.col("text").alias("source_text"))
    checked = citations.join(sources, "doc_id", "left")
    verdict = citation_verdict(F.col("source_text"), F.col("start"), F.col("end"), F.col("quoted"))
    return checked.withColumn("verdict", verdict).drop("source_text")


def verify_claims(claims: DataFrame, checked: DataFrame) -> DataFrame:
    """(claim_id, verdict): no citation rejects a claim, and so does its first bad one.

    ``checked``: citations with (claim_id, idx, verdict).
    """
    worst = checked.groupBy("claim_id").agg(
        F.min(F.when(F.col("verdict") != CONFIRMED, F.struct("idx", "verdict"))).alias("first_bad")
    ).withColumn("cited", F.lit(True))
    return claims.join(worst, "claim_id", "left").select(
        "claim_id",
        F.when(F.col("cited").isNull(), NO_CITATION).otherwise(F.coalesce("first_bad.verdict", F.lit(CONFIRMED))).alias("verdict"),
    )


def locate_tolerant(source: Column, fragment: Column) -> Column:
    """struct(start, end) of a fragment in the original source, by white space, case, quotes and dashes alike.

    The exact place comes first; otherwise the fragment becomes a pattern of its own words.
    """
    exact = F.instr(source, fragment)
    quoted = F.regexp_replace(F.trim(fragment), r"([\\.\[\]{}()*+?^$|#&~])", r"\\$1")
    pattern = F.regexp_replace(quoted, "[\"„”»«“]", "[\"„”»«“]")
    pattern = F.regexp_replace(pattern, "['’‘]", "['’‘]")
    pattern = F.regexp_replace(pattern, "[-–—−]", "[-–—−]")
    pattern = F.concat(F.lit("(?iuU)"), F.regexp_replace(pattern, r"[\s ]+", r"\\s+"))
    at = F.regexp_instr(source, pattern)
    size = F.length(F.regexp_substr(source, pattern))
    return (
        F.when(F.length(F.trim(fragment)) == 0, None)
        .when(exact > 0, F.struct((exact - 1).alias("start"), (exact - 1 + F.length(fragment)).alias("end")))
        .when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + size).alias("end")))
    )


def support(claim: Column, quoted: Column, question: Column, lang: str | None = None) -> Column:
    """struct(degree, coverage, missing): how far the quoted material carries a claim.

    A hard anchor of the claim that neither the material nor the question has means none; a bare number
    likewise means weak; otherwise the share of the claim's terms found in the material decides.
    """
    missing = F.array_sort(
        F.array_except(F.array_except(anchors.compound(claim), anchors.compound(quoted)), anchors.compound(question))
    )
    number = r"\b\d{1,9}(?:[.,]\d{1,2})?\b"
    bare = lambda c: F.regexp_extract_all(anchors.erase(c), F.lit(number), F.lit(0))
    numbers = F.array_sort(F.array_distinct(F.array_except(F.array_except(bare(claim), bare(quoted)), bare(question))))
    ours, theirs = F.array_distinct(tokens(claim, lang)), tokens(quoted, lang)
    share = F.size(F.array_intersect(ours, theirs)).cast("double") / F.greatest(F.size(ours), F.lit(1))
    none = F.array().cast("array<string>")
    degree = lambda d, c, m: F.struct(F.lit(d).alias("degree"), c.alias("coverage"), m.alias("missing"))
    return (
        F.when((F.trim(F.coalesce(claim, F.lit(""))) == "") | (F.coalesce(quoted, F.lit("")) == ""), degree("none", F.lit(0.0), none))
        .when(F.size(missing) > 0, degree("none", F.lit(0.0), missing))
        .when(F.size(numbers) > 0, degree("weak", F.lit(0.0), numbers))
        .when(F.size(ours) == 0, degree("weak", F.lit(0.0), none))
        .when(share >= STRONG, degree("strong", share, none))
        .when(share >= WEAK, degree("weak", share, none))
        .otherwise(degree("none", share, none))
    )


def majority(draws: Column) -> Column:
    return F.ceil(draws / 2)


def count_votes(picks: DataFrame, threshold: int | None = None) -> DataFrame:
    """(question_id, sent_no, votes, share, passed) from picks (question_id, draw, sent_no).

    A number repeated within a draw has one vote.
    """
    once = picks.distinct()
    draws = picks.groupBy("question_id").agg(F.countDistinct("draw").alias("draws"))
    votes = once.groupBy("question_id", "sent_no").agg(F.count(F.lit(1)).alias("votes")).join(draws, "question_id")
    need = F.lit(threshold) if threshold is not None else majority(F.col("draws"))
    return votes.select(
        "question_id", "sent_no", "votes", F.round(F.col("votes") / F.col("draws"), 2).alias("share"), (F.col("votes") >= need).alias("passed")
    )


#: Stages in pipeline order; a case belongs to the earliest that stopped it.
STAGES = ("verification", "anchoring", "support", "control", "vote")


def stopped_at(error: Column, answered: Column, retrieved: Column, reasons: Column) -> Column:
    """The stage at which a case ended; ``reasons`` are the stages of its rejections."""
    first = F.filter(F.array(*[F.lit(s) for s in STAGES]), lambda s: F.array_contains(reasons, s))
    return (
        F.when(error.isNotNull(), "generation")
        .when(answered, "answer")
        .when(~retrieved, "retrieval")
        .when(F.size(first) > 0, F.get(first, F.lit(0)))
        .otherwise("generation")
    )


def overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Length of the common part of two spans."""
    return F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1))
