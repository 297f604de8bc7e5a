"""Benchmark metrics over scored cases made from ``labels``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import metrics, verify
from lodestone.registry import query
from lodestone.session import table

# A label is a case: quality says whether it can be answered, the remainders of its id how it went.
SQL_CASES = """
s AS (SELECT l.doc_id AS id, d.lang, l.quality = 1 AS answerable, (l.doc_id * 7) % 5 = 0 AS refused,
        ((l.doc_id * 13) % 100) / 100.0::DOUBLE AS coverage, ((l.doc_id * 13) % 100) / 100.0::DOUBLE >= 0.3::DOUBLE AND (l.doc_id * 7) % 5 <> 0 AS hit,
        CASE WHEN l.quality = 1 THEN (l.doc_id // 7) * 7 + (l.doc_id + 3) % 7 END AS pair_id, (l.doc_id * 31) % 997 / 10.0::DOUBLE AS seconds, l.toxic
      FROM labels l JOIN documents d USING (doc_id))
"""
SQL_SHARE = "round(CASE WHEN {d} > 0 THEN ({n})::DOUBLE / {d} ELSE 0 END, 6)"


def _share(n: str, d: str) -> str:
    return SQL_SHARE.format(n=n, d=d)


_COUNT = "count(*) FILTER (WHERE {})".format
SQL_METRICS = f"""CAST(count(*) AS BIGINT) AS cases, {_share(_COUNT('NOT answerable AND refused'), _COUNT('NOT answerable'))} AS j3_right_refusal,
  {_share(_COUNT('answerable AND refused'), _COUNT('answerable'))} AS j4_false_refusal,
  {_share(_COUNT('answerable AND hit'), _COUNT('answerable'))} AS anchored_hit_rate,
  {_share('sum(CASE WHEN answerable THEN coverage ELSE 0 END)', _COUNT('answerable'))} AS mean_coverage,
  round(CASE WHEN {_COUNT('answerable')} > 0 THEN {_COUNT('answerable AND hit')}::DOUBLE / {_COUNT('answerable')} ELSE 0 END
    + CASE WHEN {_COUNT('NOT answerable')} > 0 THEN {_COUNT('NOT answerable AND refused')}::DOUBLE / {_COUNT('NOT answerable')} ELSE 0 END - 1, 6) AS youden_j"""


def _cases(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    i = F.col("doc_id")
    coverage = (i * 13 % 100) / F.lit(100.0)
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        i.alias("id"), "lang", (F.col("quality") == 1).alias("answerable"), (i * 7 % 5 == 0).alias("refused"), coverage.alias("coverage"),
        ((coverage >= 0.3) & (i * 7 % 5 != 0)).alias("hit"),
        F.when(F.col("quality") == 1, F.floor(i / 7) * 7 + (i + 3) % 7).alias("pair_id"),
        (i * 31 % 997 / F.lit(10.0)).alias("seconds"), "toxic",
    )


@query("gate_metrics", f"WITH {SQL_CASES} SELECT {SQL_METRICS} FROM s")
def gate_metrics(spark, sf_dir):
    return _cases(spark, sf_dir).agg(*metrics.case_aggregates())


@query("metrics_rollup", f"WITH {SQL_CASES} SELECT coalesce(lang, 'all') AS lang, {SQL_METRICS} FROM s GROUP BY ROLLUP (lang)")
def metrics_rollup(spark, sf_dir):
    """The metrics of every language and overall, in one pass."""
    out = _cases(spark, sf_dir).rollup("lang").agg(*metrics.case_aggregates())
    return out.withColumn("lang", F.coalesce("lang", F.lit("all")))


@query(
    "language_parity",
    f"WITH {SQL_CASES}, m AS (SELECT lang, {SQL_METRICS} FROM s GROUP BY lang) SELECT round(CASE WHEN count(*) > 1 THEN max(anchored_hit_rate) - min(anchored_hit_rate) ELSE 0 END, 6) AS gap FROM m",
)
def language_parity(spark, sf_dir):
    by_lang = _cases(spark, sf_dir).groupBy("lang").agg(*metrics.case_aggregates())
    gap = F.when(F.count(F.lit(1)) > 1, F.max("anchored_hit_rate") - F.min("anchored_hit_rate")).otherwise(0.0)
    return by_lang.agg(F.round(gap, 6).alias("gap"))


SQL_PAIRS = "p AS (SELECT a.*, b.refused AS twin_refused FROM s a JOIN s b ON a.pair_id = b.id WHERE a.answerable)"
SQL_PAIR_METRICS = f"""CAST(count(*) AS BIGINT) AS pairs, CAST({_COUNT('hit AND twin_refused')} AS BIGINT) AS told_apart,
  CAST({_COUNT('NOT (hit AND twin_refused) AND refused AND twin_refused')} AS BIGINT) AS always_refused,
  CAST({_COUNT('NOT (hit AND twin_refused) AND NOT refused AND NOT twin_refused')} AS BIGINT) AS always_answered,
  {_share(_COUNT('hit AND twin_refused'), 'count(*)')} AS discrimination"""


@query("pair_discrimination", f"WITH {SQL_CASES}, {SQL_PAIRS} SELECT {SQL_PAIR_METRICS} FROM p")
def pair_discrimination(spark, sf_dir):
    """How many answerable cases are told apart from their unanswerable twins."""
    return metrics.pair_metrics(_cases(spark, sf_dir))


@query(
    "quality_gates",
    f"""WITH {SQL_CASES}, {SQL_PAIRS}, m AS (SELECT {SQL_METRICS}, {_COUNT('NOT answerable AND NOT refused')} AS false_answers FROM s), d AS (SELECT {SQL_PAIR_METRICS} FROM p),
    g AS (SELECT unnest([{{'gate': 'j3_right_refusal', 'value': j3_right_refusal, 'threshold': 0.66::DOUBLE, 'passed': j3_right_refusal >= 0.66::DOUBLE}},
      {{'gate': 'j4_false_refusal', 'value': j4_false_refusal, 'threshold': 0.1::DOUBLE, 'passed': j4_false_refusal <= 0.1::DOUBLE}},
      {{'gate': 'discrimination', 'value': discrimination, 'threshold': 0.45::DOUBLE, 'passed': discrimination >= 0.45::DOUBLE}},
      {{'gate': 'anchored_hit_rate', 'value': anchored_hit_rate, 'threshold': 0.66::DOUBLE, 'passed': anchored_hit_rate >= 0.66::DOUBLE}},
      {{'gate': 'false_answers', 'value': false_answers::DOUBLE, 'threshold': 14.0::DOUBLE, 'passed': false_answers <= 14}},
      {{'gate': 'cases', 'value': cases::DOUBLE, 'threshold': 100.0::DOUBLE, 'passed': cases >= 100}}]) AS r FROM m, d)
    SELECT r.gate AS gate, r.value AS value, r.threshold AS threshold, r.passed AS passed FROM g""",
)
def quality_gates(spark, sf_dir):
    """Every gate with its value, threshold and verdict."""
    cases = _cases(spark, sf_dir)
    false_answers = F.sum((~F.col("answerable") & ~F.col("refused")).cast("long")).alias("false_answers")
    whole = cases.agg(*metrics.case_aggregates(), false_answers)
    return metrics.gates(whole.join(F.broadcast(metrics.pair_metrics(cases))))  # one row each


@query(
    "percentile_index",
    f"""WITH {SQL_CASES}, l AS (SELECT lang, list_sort(list(seconds) FILTER (WHERE seconds > 0)) AS v FROM s GROUP BY lang)
    SELECT lang, v[CAST(least(len(v) - 1, floor(len(v) * 0.5::DOUBLE)) AS BIGINT) + 1] AS p50, v[CAST(least(len(v) - 1, floor(len(v) * 0.9::DOUBLE)) AS BIGINT) + 1] AS p90,
      v[len(v)] AS longest FROM l""",
)
def percentile_index(spark, sf_dir):
    """Percentiles by index into the sorted times, which differ from the SQL ones."""
    taken = F.when(F.col("seconds") > 0, F.col("seconds"))
    return metrics.index_percentiles(_cases(spark, sf_dir), "lang", taken, {"p50": 0.5, "p90": 0.9})


@query(
    "shadow_variants",
    f"""WITH {SQL_CASES}, v AS (SELECT *, unnest(['none', 'mechanical', 'checker', 'both']) AS variant FROM s),
    k AS (SELECT *, NOT refused AND NOT (variant IN ('mechanical', 'both') AND id % 4 = 0) AND NOT (variant IN ('checker', 'both') AND id % 6 = 0) AS answers FROM v)
    SELECT variant, {_share(_COUNT('answerable AND hit AND answers'), _COUNT('answerable'))} AS hit_rate,
      {_share(_COUNT('NOT answerable AND NOT answers'), _COUNT('NOT answerable'))} AS j3, CAST({_COUNT('NOT answerable AND answers')} AS BIGINT) AS false_answers,
      CAST({_COUNT('(answerable AND hit AND answers) OR (NOT answerable AND NOT answers)')} AS BIGINT) AS correct FROM k GROUP BY variant""",
)
def shadow_variants(spark, sf_dir):
    """What each combination of checks would have done, from one run."""
    names = ("none", "mechanical", "checker", "both")
    rows = _cases(spark, sf_dir).withColumn("variant", F.explode(F.array(*[F.lit(n) for n in names])))
    v, i = F.col("variant"), F.col("id")
    answers = ~F.col("refused") & ~(v.isin("mechanical", "both") & (i % 4 == 0)) & ~(v.isin("checker", "both") & (i % 6 == 0))
    rows = rows.withColumn("answers", answers)
    count = lambda c: F.sum(c.cast("long"))
    asked, a = F.col("answerable"), F.col("answers")
    right = asked & F.col("hit") & a
    return rows.groupBy("variant").agg(
        F.round(metrics.share(count(right), count(asked)), 6).alias("hit_rate"),
        F.round(metrics.share(count(~asked & ~a), count(~asked)), 6).alias("j3"),
        count(~asked & a).alias("false_answers"),
        count(right | (~asked & ~a)).alias("correct"),
    )


@query(
    "overlap_coverage",
    """WITH g AS (SELECT doc_id AS id, n_chars // 4 AS a1, n_chars // 2 + 1 AS a2 FROM documents),
    c AS (SELECT id, a1, a2, (id % 3) * (a2 - a1) // 3 + a1 - 5 AS b1, (id % 5) * (a2 - a1) // 4 + a1 AS b2 FROM g)
    SELECT id, round(greatest(0, least(a2, b2) - greatest(a1, b1))::DOUBLE / greatest(a2 - a1, 1), 6) AS coverage,
      greatest(0, least(a2, b2) - greatest(a1, b1))::DOUBLE / greatest(a2 - a1, 1) >= 0.3::DOUBLE AS hit FROM c""",
)
def overlap_coverage(spark, sf_dir):
    """How much of a gold span the best citation covers."""
    docs = table(spark, sf_dir, "documents")
    gold = docs.select(F.col("doc_id").alias("id"), "doc_id", F.expr("n_chars div 4").alias("start"), F.expr("n_chars div 2 + 1").alias("end"))
    cited = gold.select(
        "id", "doc_id", F.expr("(id % 3) * (`end` - start) div 3 + start - 5").alias("b1"), F.expr("(id % 5) * (`end` - start) div 4 + start").alias("b2")
    ).select("id", "doc_id", F.col("b1").alias("start"), F.col("b2").alias("end"))
    return metrics.best_coverage(gold, cited).select("id", F.round("coverage", 6).alias("coverage"), "hit")


@query(
    "rejection_causes",
    """WITH r AS (SELECT event_type AS cause, value, user_id % 4 = 0 AS harmful FROM events)
    SELECT cause, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE harmful) AS BIGINT) AS harmful, min(value) AS least, max(value) AS most FROM r GROUP BY cause""",
)
def rejection_causes(spark, sf_dir):
    harmful = (F.col("user_id") % 4 == 0).cast("long")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("cause")).agg(
        F.count(F.lit(1)).alias("total"), F.sum(harmful).alias("harmful"), F.min("value").alias("least"), F.max("value").alias("most")
    )


@query(
    "case_distribution",
    f"""WITH {SQL_CASES} SELECT coalesce(lang, '*') AS lang, coalesce(CAST(toxic AS VARCHAR), '*') AS category, CAST(count(*) AS BIGINT) AS cases
    FROM s GROUP BY GROUPING SETS ((lang), (toxic))""",
)
def case_distribution(spark, sf_dir):
    """Cases by language and by category, as grouping sets."""
    _cases(spark, sf_dir).createOrReplaceTempView("lodestone_cases")
    return spark.sql(
        "SELECT coalesce(lang, '*') AS lang, coalesce(CAST(toxic AS STRING), '*') AS category, count(*) AS cases "
        "FROM lodestone_cases GROUP BY GROUPING SETS ((lang), (toxic))"
    )


@query(
    "false_refusal_breakdown",
    f"WITH {SQL_CASES} SELECT lang, toxic, CAST(count(*) AS BIGINT) AS false_refusals FROM s WHERE answerable AND refused GROUP BY ALL",
)
def false_refusal_breakdown(spark, sf_dir):
    return _cases(spark, sf_dir).where("answerable and refused").groupBy("lang", "toxic").agg(F.count(F.lit(1)).alias("false_refusals"))


@query(
    "control_matrix",
    f"WITH {SQL_CASES} SELECT answerable, CAST(count(*) FILTER (WHERE coverage >= 0.6::DOUBLE) AS BIGINT) AS strong, CAST(count(*) FILTER (WHERE coverage >= 0.15::DOUBLE AND coverage < 0.6::DOUBLE) AS BIGINT) AS weak, CAST(count(*) FILTER (WHERE coverage < 0.15::DOUBLE) AS BIGINT) AS none FROM s GROUP BY answerable",
)
def control_matrix(spark, sf_dir):
    """Good and bad classes against degrees of support."""
    degree = F.when(F.col("coverage") >= 0.6, "strong").when(F.col("coverage") >= 0.15, "weak").otherwise("none")
    out = _cases(spark, sf_dir).withColumn("degree", degree).groupBy("answerable").pivot("degree", ["strong", "weak", "none"]).count()
    return out.na.fill(0)


# A labelled document is a case whose true places are the documents of the same text; its id says where it was stopped.
SQL_ENDED = """
x AS (SELECT doc_id AS id, count(*) OVER (PARTITION BY text) - 1 AS occurrences FROM documents),
c AS (SELECT l.doc_id AS id, l.quality = 1 AS answerable, l.doc_id % 4 <> 0 AS reached, CASE WHEN l.doc_id % 11 = 0 THEN 'generation' WHEN l.doc_id % 2 = 1 THEN 'answer'
    WHEN l.doc_id % 4 = 0 THEN 'retrieval' WHEN l.doc_id % 3 = 0 THEN 'anchoring' WHEN l.doc_id % 7 = 0 THEN 'vote' ELSE 'generation' END AS stage, occurrences FROM labels l JOIN x ON id = l.doc_id),
e AS (SELECT *, stage = 'answer' AND reached AND id % 5 <> 0 AS hit FROM c)
"""


def _ended(spark, sf_dir):
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    digest = F.coalesce(F.sha2("text", 256), F.lit("")).alias("digest")
    copies = docs.groupBy(digest).agg((F.count(F.lit(1)) - 1).alias("occurrences"))
    cases = table(spark, sf_dir, "labels").join(docs.select("doc_id", digest), "doc_id").join(copies, "digest")
    reasons = F.array_compact(F.array(F.when(i % 3 == 0, "anchoring"), F.when(i % 7 == 0, "vote")))
    stage = verify.stopped_at(F.when(i % 11 == 0, F.lit("failed")), i % 2 == 1, i % 4 != 0, reasons)
    ended = cases.select((F.col("quality") == 1).alias("answerable"), (i % 4 != 0).alias("reached"), stage.alias("stage"), "occurrences", "doc_id")
    return ended.withColumn("hit", (F.col("stage") == "answer") & F.col("reached") & (i % 5 != 0))


@query(
    "benchmark_summary",
    f"""WITH {SQL_ENDED} SELECT count(*) AS cases, {_COUNT("(answerable AND hit) OR (NOT answerable AND stage <> 'answer')")} AS correct, {_share(_COUNT('answerable AND hit'), _COUNT('answerable'))} AS hit_rate,
      {_share(_COUNT("NOT answerable AND stage <> 'answer'"), _COUNT('NOT answerable'))} AS j3_right_refusal, {_COUNT('NOT answerable')} AS uncovered, {_COUNT("NOT answerable AND stage = 'answer'")} AS false_answers,
      {_COUNT("answerable AND NOT hit AND stage <> 'answer'")} AS false_refusals, {_COUNT("answerable AND NOT hit AND stage = 'answer'")} AS wrong_answers,
      {_share(_COUNT('answerable AND reached'), _COUNT('answerable'))} AS retrieval_recall, {_share('coalesce(sum(occurrences) FILTER (WHERE answerable), 0)', _COUNT('answerable'))} AS mean_occurrences,
      {_COUNT('answerable AND occurrences = 0')} AS without_occurrences FROM e""",
)
def benchmark_summary(spark, sf_dir):
    """The whole benchmark in one row, false refusals and wrong answers apart."""
    return metrics.summary(_ended(spark, sf_dir))


@query(
    "stage_histograms",
    f"""WITH {SQL_ENDED} SELECT 'all' AS "of", stage, count(*) AS cases FROM e GROUP BY stage
    UNION ALL SELECT 'false_refusals', stage, count(*) FROM e WHERE answerable AND NOT hit AND stage <> 'answer' GROUP BY stage""",
)
def stage_histograms(spark, sf_dir):
    return metrics.stage_histograms(_ended(spark, sf_dir))
