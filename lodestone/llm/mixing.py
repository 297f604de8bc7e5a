"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: the total size is shared out by source weight, but no source may exceed ``max_epochs`` times its
own size; what a source cannot take is reshared by weight. That fixed point is a water level: with sources
sorted by cap/weight, level(i) = (total - caps before i) / (weights from i on) rises while sources are
being capped and falls afterwards, so the level is its maximum. Two running sums over the source table.

Selection: a source first takes every document whole ``floor(target / size)`` times. The rest of its budget
goes to a weighted sample without replacement: each document draws key = -ln(u) / quality (an exponential
with the quality weight as its rate; u is a hash of doc_id and text length, so reruns agree), documents are
taken in key order and prefix-summed to the budget. The document that straddles the budget is taken when
that ends nearer to the target. No document exceeds ceil(max_epochs) times its size.

The prefix sum is two-level: keys are cut into ``SLICES`` quantile-like slices, slice totals are prefix-
summed per source, and rows are ordered only inside a (source, slice), so a source holding a third of all
rows is spread over ``SLICES`` groups.

Defined results: null text has size 0 and takes 0; a null source is one source of its own, last; source
weights repeat 1, 2, 3 by code point order; repeated rows are sampled each on its own key order; an empty
table gives no rows; a text of any length is read whole (its size is the number of its words); other columns pass through
``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import scratch, text_or_empty, unused, word_count

MAX_EPOCHS = 3
SLICES = 512
#: A word with any of these characters counts against a document's quality weight.
JUNK_WORD = r"[^\x20\x09-\x0D]*[|*#$%&][^\x20\x09-\x0D]*"


def quality_weight(text: Column) -> Column:
    """Between 0.25 (every word holds a symbol) and 1 (none does); 1 for a text without words."""
    words, junk = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.regexp_count(text, F.lit(JUNK_WORD))
    return F.lit(1.0) - F.lit(0.75) * junk.cast("double") / F.greatest(words, F.lit(1)).cast("double")


def exponential_key(doc_id: Column, size: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from the first 13 hex digits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with rank, weight and target.

    One row per source: the two ordered windows here run over the source table only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", (F.pmod(F.col("rank") - 1, F.lit(3)) + 1).cast("double")
    )
    cap = (F.lit(max_epochs) * F.col("source_size")).cast("double")
    by_ratio = Window.orderBy(cap / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, weights = F.sum("source_size").over(whole).cast("double"), F.sum("weight").over(whole)
    level = (total - F.coalesce(F.sum(cap).over(by_ratio), F.lit(0.0))) / (
        weights - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    )
    return (
        ranked.withColumn("level_here", level)
        .withColumn("level", F.max("level_here").over(whole))
        .select("source", "source_size", "weight", F.least(cap, F.col("level") * F.col("weight")).alias("target"))
    )


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, slices: int = SLICES) -> DataFrame:
    """Slim table (doc_id, source, size, draw, source_size, target, taken) for every row of ``docs``."""
    text = text_or_empty("text")
    slim = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"), quality_weight(text).alias("quality")
    ).withColumn("draw", exponential_key(F.col("doc_id"), F.col("size"), F.col("quality")))
    # exp(-key) lies in (0, 1) and falls with the key: equal steps of it slice a source evenly.
    slim = scratch(
        slim.drop("quality").withColumn(
            "slice", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("draw"))) * slices), F.lit(slices - 1)).cast("int")
        ),
        "mix-sizes",
    )
    cells = slim.groupBy("source", "slice").agg(F.sum("size").alias("cell_size"))
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), max_epochs)
    up_to = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        cells.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(up_to), F.lit(0)))
        .alias("c")
        .join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
        .select(
            F.col("c.source").alias("cell_source"),
            F.col("c.slice").alias("cell_slice"),
            "cell_start",
            "source_size",
            "target",
            F.when(F.col("source_size") == 0, F.lit(0))
            .otherwise(F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs)))
            .cast("long")
            .alias("epochs"),
        )
        .withColumn(
            "budget",
            F.when(F.col("epochs") >= max_epochs, F.lit(0.0)).otherwise(
                F.col("target") - (F.col("epochs") * F.col("source_size")).cast("double")
            ),
        )
    )
    inside = Window.partitionBy("source", "slice").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    # How far the budget reaches past the document's start: it is taken if at least half of it fits.
    start = F.col("cell_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return (
        slim.join(cells, slim["source"].eqNullSafe(cells["cell_source"]) & (slim["slice"] == cells["cell_slice"]))
        .withColumn("start", start)
        .withColumn(
            "extra",
            (F.col("start").cast("double") + F.col("size").cast("double") / 2 <= F.col("budget")).cast("long"),
        )
        .select(
            "doc_id", "source", "size", "draw", "source_size", "target",
            (F.col("size") * (F.col("epochs") + F.col("extra"))).alias("taken"),
            F.least(F.col("epochs") + F.col("extra"), F.lit(max_epochs)).alias("copies"),
        )
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (not at all: the row goes)."""
    copies, one = unused("own_copies", docs), unused("own_copy", docs)
    # A document's copies follow from its id and size; rows that repeat both share them in draw order.
    taken = mix(docs).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(one))
    taken = scratch(taken.where(F.col(copies) > 0), "mix-copies")
    size = unused("own_size", docs)
    out = docs.withColumn(size, word_count(text_or_empty("text"))).alias("d").join(
        taken.alias("t"),
        F.col("d.doc_id").eqNullSafe(F.col("t.doc_id"))
        & F.col("d.source").cast("string").eqNullSafe(F.col("t.source"))
        & (F.col(f"d.{size}") == F.col("t.size")),
    )
    mine = F.col(copies)
    if not taken.where(F.col(one) > 1).isEmpty():
        # Rows that repeat id, source and size: the group's copies are dealt to them in turn, by their texts, so that
        # a task that runs again deals alike.
        turn = Window.partitionBy("d.doc_id", "d.source", f"d.{size}").orderBy(F.xxhash64("d.text"))
        mine = F.floor(F.col(copies) / F.col(one)) + (F.row_number().over(turn) <= F.pmod(F.col(copies), F.col(one))).cast("long")
    turns = unused("own_turns", docs)
    out = out.select(*[F.col(f"d.{c}") for c in docs.columns], mine.cast("int").alias(turns)).where(F.col(turns) > 0)
    return out.withColumn(unused("own_turn", out), F.explode(F.sequence(F.lit(1), F.col(turns)))).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[^w]', '', 'g')) AS BIGINT) AS size,
    CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]*[|*#$%&][^\x20\x09-\x0D]*', chr(1), 'g'), '[^\x01]', '', 'g')) AS BIGINT) AS junk
  FROM documents),
k AS (
  SELECT *, 1.0::DOUBLE - 0.75::DOUBLE * junk::DOUBLE / greatest(size, 1)::DOUBLE AS quality,
    (CAST(CAST('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), size::VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE)
      / 4503599627370496.0::DOUBLE AS u
  FROM d),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY -ln(u) / quality, doc_id
        ROWS UNBOUNDED PRECEDING) - size AS start FROM k),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
      FROM d GROUP BY source),
w AS (SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level_here FROM w
      WINDOW f AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(cap, max(level_here) OVER () * weight) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 3) END AS epochs FROM t)
SELECT o.doc_id, o.size, CAST(e.source_size AS BIGINT) AS source_size, e.target,
  CAST(o.size * (e.epochs + CASE WHEN o.start + o.size / 2.0::DOUBLE
      <= CASE WHEN e.epochs >= 3 THEN 0 ELSE e.target - e.epochs * e.source_size END THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o JOIN e ON o.source IS NOT DISTINCT FROM e.source
"""
