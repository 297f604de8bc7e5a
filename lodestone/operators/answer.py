"""From a model's picks to an answer: parsing, reconstruction, control, votes, assembly.

What a language model said is an input table; these operators decide which of it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Polish letters and the plain ones that field names fold to (fixed values).
FOLD = ("ąćęłńóśźż", "acelnoszz")


def parse_claims(raw: Column) -> Column:
    """array<struct<text, numbers>> of a model's JSON answer.

    Anything but an object with a list of claims gives an empty array; claims that are no objects or have no text fall
    out, and so do numbers that are not whole.
    """
    listed = F.coalesce(F.from_json(raw, "claims array<string>")["claims"], F.array().cast("array<string>"))
    shape = "text string, numbers string"

    def numbers(claim: Column) -> Column:
        pieces = F.split(F.regexp_replace(F.coalesce(claim["numbers"], F.lit("")), r"^\[|\]$", ""), ",")
        return F.transform(F.filter(pieces, lambda x: x.rlike(r"^\s*-?[0-9]{1,9}\s*$")), lambda x: F.trim(x).cast("int"))

    parsed = F.transform(F.filter(listed, lambda c: c.startswith("{")), lambda c: F.from_json(c, shape))
    good = F.filter(parsed, lambda c: F.coalesce(c["text"], F.lit("")) != "")
    return F.transform(good, lambda c: F.struct(c["text"].alias("text"), numbers(c).alias("numbers")))


def folded_keys(raw: Column) -> Column:
    """A JSON object as a map whose keys are lower-case, without diacritics, blanks and hyphens as underscores."""
    read = F.from_json(raw, "map<string,string>")
    return F.transform_keys(read, lambda k, _: F.translate(F.translate(F.lower(k), *FOLD), " -", "__"))


def field(fields: Column, *names: str) -> Column:
    """The first value under one of ``names`` that is not empty."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(fields, F.lit(n))), F.lit("")) for n in names])


def reconstruct(picks: DataFrame, spans: DataFrame, documents: DataFrame) -> DataFrame:
    """(question_id, doc_id, number, start, end, fragment): the source's own text for every number that was shown.

    ``picks``: (question_id, number), ``spans``: (question_id, number, doc_id, start, end), ``documents``: (doc_id, text).
    """
    found = picks.join(spans, ["question_id", "number"]).join(documents.select("doc_id", "text"), "doc_id")
    fragment = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return found.select("question_id", "doc_id", "number", "start", "end", fragment.alias("fragment"))


def controlled(claims: DataFrame, mechanical: bool, model: bool, shadow: bool) -> DataFrame:
    """``claims`` (degree: strong, weak or none; verdict: true, false or unverified) with kept, reason, note.

    ``mechanical`` rejects claims without support, ``model`` those the checker calls false; ``shadow`` only notes what
    either would have rejected, and counts only where both are off.
    """
    none, false = F.col("degree") == "none", F.col("verdict") == "false"
    only_noted = shadow and not (mechanical or model)
    reason = F.lit(None).cast("string")
    if model:
        reason = F.when(false, "control").otherwise(reason)
    if mechanical:
        reason = F.when(none, "support").otherwise(reason)
    note = F.when(F.col("degree") == "weak", "weak")
    if model:
        note = F.when(F.col("verdict") == "unverified", "unverified").otherwise(note)
    if only_noted:
        note = F.when(none, "would reject: support").when(false, "would reject: control")
    return claims.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull()).withColumn("note", F.when(F.col("kept"), note))


def deep_controlled(claims: DataFrame, mechanical: bool, model: bool) -> DataFrame:
    """``claims`` (degree, verdict) of the deep path with reason, kept and note.

    Unlike ``controlled``, one switch stands before both checks: without the mechanical one nothing is checked or noted. A claim
    without support goes before the model is asked; missing verification is noted only where the model was to check.
    """
    nothing = F.lit(None).cast("string")
    if not mechanical:
        return claims.withColumns({"reason": nothing, "kept": F.lit(True), "note": nothing})
    reason = F.when(F.col("degree") == "none", "support")
    note = F.when(F.col("degree") == "weak", "weak")
    if model:
        reason = reason.when(F.col("verdict") == "false", "control")
        note = F.when(F.col("verdict") == "unverified", "unverified").otherwise(note)
    judged = claims.withColumn("reason", reason)
    return judged.withColumn("kept", F.col("reason").isNull()).withColumn("note", F.when(F.col("kept"), note))


def vote_filter(claims: DataFrame, votes: DataFrame, draws: int) -> DataFrame:
    """``claims`` (question_id, claim_no, numbers) with kept and support, by a majority of ``draws``.

    ``votes``: (question_id, number, votes). A claim stays if any of its numbers has a majority; its support is the share
    of its best number, to two places. Claims without numbers go.
    """
    majority = draws // 2 + 1
    each = claims.select("question_id", "claim_no", F.explode_outer("numbers").alias("number"))
    voted = each.join(votes, ["question_id", "number"], "left").groupBy("question_id", "claim_no").agg(
        F.count("number").alias("named"), F.max(F.coalesce("votes", F.lit(0))).alias("best")
    )
    kept = (F.col("named") > 0) & (F.col("best") >= majority)
    return voted.select("question_id", "claim_no", kept.alias("kept"), F.when(F.col("named") > 0, F.round(F.col("best") / draws, 2)).alias("support"))


def assemble(claims: DataFrame) -> DataFrame:
    """One answer per question from ``claims`` (question_id, claim_no, text, voted, verified, anchored, controlled).

    A claim's reason is the first stage that stopped it; a question whose claims are all stopped is refused.
    """
    reason = (
        F.when(~F.col("voted"), "vote").when(~F.col("verified"), "verification").when(~F.col("anchored"), "anchoring").when(~F.col("controlled"), "control")
    )
    staged = claims.withColumn("reason", reason)
    texts = F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), F.struct("claim_no", "text"))))
    reasons = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat_ws(":", F.col("claim_no").cast("string"), "reason"))))
    out = staged.groupBy("question_id").agg(texts.alias("texts"), reasons.alias("reasons"))
    return out.select(
        "question_id", (F.size("texts") == 0).alias("refused"), F.array_join(F.transform("texts", lambda t: t["text"]), " ").alias("answer"),
        F.size("texts").cast("long").alias("citations"), F.array_join("reasons", " ").alias("rejected"),
    )


def narrowed(ranked: DataFrame, k: int) -> DataFrame:
    """The ``k`` best documents of every question, or all of them where the user chose the set (``chosen``)."""
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")
    return ranked.withColumn("rank", F.row_number().over(best)).where(F.col("chosen") | (F.col("rank") <= k)).drop("rank")


def chosen_documents(by_value: DataFrame, by_score: DataFrame, k: int) -> DataFrame:
    """(question_id, doc_id, rank): documents that hold the question's value first, in corpus order, then the best scored.

    ``by_value``: (question_id, doc_id, position), ``by_score``: (question_id, doc_id, score, position); both may name a
    document several times.
    """
    first = by_value.groupBy("question_id", "doc_id").agg(F.min("position").alias("position"))
    early = first.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("position"))).where(F.col("place") <= k)
    scored = by_score.groupBy("question_id", "doc_id").agg(F.min(F.struct(-F.col("score"), "position")).alias("best"))
    late = scored.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("best")))
    both = early.select("question_id", "doc_id", F.lit(0).alias("phase"), "place").unionByName(
        late.where(F.col("place") <= 2 * k).select("question_id", "doc_id", F.lit(1).alias("phase"), "place")
    )
    once = both.groupBy("question_id", "doc_id").agg(F.min(F.struct("phase", "place")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("at"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "doc_id", "rank")


def renumbered(calls: DataFrame) -> DataFrame:
    """Numbers of single calls as numbers of the whole: (question_id, call, number) plus the calls' counts so far.

    ``calls``: (question_id, call, shown, number).
    """
    before = Window.partitionBy("question_id").orderBy("call").rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("number", (F.col("number") + F.coalesce(F.sum("shown").over(before), F.lit(0))).cast("long")).drop("shown")


def grounded_conclusions(conclusions: DataFrame, findings: DataFrame) -> DataFrame:
    """``conclusions`` (case_id, based_on) with the numbers that verified findings have; without any they are rejected.

    ``findings``: (case_id, verified); verified ones are numbered from 1 in each case.
    """
    counted = findings.groupBy("case_id").agg(F.count_if("verified").alias("allowed"))
    known = conclusions.join(counted, "case_id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(0)))
    kept = F.filter("based_on", lambda n: (n >= 1) & (n <= F.col("allowed")))
    return known.withColumn("based_on", kept).withColumn("rejected", F.size("based_on") == 0).drop("allowed")
