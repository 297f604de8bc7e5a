"""Threshold-scaled sketches of whole texts.

A text's sketch keeps every distinct five-word shingle hash below a fixed fraction of the hash range; a text of
at most ``WHOLE`` shingles keeps the others too. The hashes under the fraction make sketches of very unequal texts
comparable, and those of a union of texts are the union of theirs. Likeness is the estimated containment of the
smaller sketch in the larger: shared hashes / hashes of the smaller, over all hashes where both texts keep them
all and over those under the fraction otherwise. Where a short text has none under it, its containment in a long
text is unknown and given as 0 (of n shingles none is under it with probability 0.5 ** n: 3 in 100 for a passage of
nine words, 1 in 1000 for one of fourteen).

Everything is a DataFrame expression. Neighbours in doc_id order are found on a slim table (id, hash, length)
that is range-partitioned; only then do texts meet: each text is shuffled once by its id, and the beginning
that its predecessor needs travels to that predecessor.

Defined results: a null text is empty; an empty or white-space text has the empty fingerprint, which is
like another empty one (1) and unlike all others (0); a text of any length is read whole; a text under five words is one
shingle; an empty table gives no rows; other columns are not read, so their names cannot clash; identical rows
count as one document in the order of neighbours and each get a row; rows of equal doc_id follow each
other by text hash; a null doc_id comes first; the only document's next is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, ascii_lower, let, scratch, text_or_empty

WIDTH = 5
#: One hash in this many is kept.
KEEP_ONE_IN = 2
_CEILING = -(2**63) + 2**64 // KEEP_ONE_IN
#: Texts of up to this many shingles (with repeats) keep all their hashes.
WHOLE = 64


def shingle_hashes(text: Column) -> Column:
    """64-bit hashes of the five-word shingles (with repeats); of the whole sequence under five words."""
    words = F.transform(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    return let(
        words,
        lambda w: F.when(
            F.size(w) >= WIDTH,
            F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WIDTH)])),
        )
        .when(F.size(w) > 0, F.array(F.xxhash64(w)))
        .otherwise(F.array().cast("array<bigint>")),
    )


def sketch(text: Column) -> Column:
    """(whole, hashes): whether every hash is kept, and the sorted upper 32 bits of the kept ones."""
    return let(
        shingle_hashes(text),
        lambda h: F.struct(
            (F.size(h) <= WHOLE).alias("whole"),
            F.sort_array(
                F.array_distinct(
                    F.transform(
                        F.when(F.size(h) <= WHOLE, h).otherwise(F.filter(h, lambda x: x < F.lit(_CEILING))),
                        lambda x: F.shiftright(x, 32).cast("int"),
                    )
                )
            ).alias("hashes"),
        ),
    )


def as_text(hashes: Column) -> Column:
    """A sketch's hashes as a string: eight hex digits for each."""
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.lpad(F.hex(x.cast("long") + F.lit(2**31)), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger one, 0 to 1."""
    whole = a["whole"] & b["whole"]

    def part(x: Column) -> Column:
        return F.when(whole | ~x["whole"], x["hashes"]).otherwise(F.filter(x["hashes"], lambda h: h < F.lit(_CEILING >> 32)))

    def shared(both: Column) -> Column:
        smaller = F.least(F.size(both["a"]), F.size(both["b"]))
        return F.when(smaller > 0, F.size(F.array_intersect(both["a"], both["b"])).cast("double") / smaller).otherwise(
            (F.greatest(F.size(a["hashes"]), F.size(b["hashes"])) == 0).cast("double")
        )

    return let(F.struct(part(a).alias("a"), part(b).alias("b")), shared)


def neighbours(slim: DataFrame) -> DataFrame:
    """Distinct (id, h, n) -> (id, h, prev_id, prev_h, prev_n) in ascending order of (id, h), cyclically.

    A range partition orders the rows; windows run inside a partition, and over one row per partition for
    the seams.
    """
    spark = slim.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("id").asc_nulls_first(), F.col("h")]
    placed = scratch(slim.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "order")
    last = placed.groupBy("part").agg(F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "h", "n")).alias("last"))
    seam = Window.orderBy("part")
    whole = seam.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seams = last.select("part", F.coalesce(F.lag("last").over(seam), F.last("last").over(whole)).alias("seam"))
    inside = Window.partitionBy("part").orderBy(*order)
    return (
        placed.join(seams, "part")
        .withColumn("before", F.lag(F.struct(F.col("id").isNotNull().alias("known"), "id", "h", "n")).over(inside))
        .withColumn("before", F.coalesce("before", "seam"))
        .select("id", "h", F.col("before.id").alias("prev_id"), F.col("before.h").alias("prev_h"), F.col("before.n").alias("prev_n"))
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """The result of ``op4_fingerprints`` for any ``docs`` (doc_id, text)."""
    base = docs.select("doc_id", text_or_empty(F.col("text").cast("string")).alias("text"))
    base = base.withColumn("h", F.xxhash64("text"))
    slim = base.groupBy(F.col("doc_id").alias("id"), "h").agg(F.max(F.length("text")).alias("n"), F.count(F.lit(1)).alias("rows"))
    slim = scratch(slim, "text-lengths")
    repeated = not slim.where("rows > 1").isEmpty()
    before = scratch(neighbours(slim.drop("rows")), "neighbours")
    # A key pair without nulls, from which the id can be had again: both joins below then ask for the very same
    # exchange (columns included), and the texts are shuffled once. Sketches are made after it, so that none travels along.
    full = base.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k"), "h", "text")
    key = F.coalesce(F.col("id").cast("string"), F.lit("")).alias("k")
    donors = full.join(before.select(key, "h", "prev_id", "prev_h", "prev_n"), ["k", "h"]).select(
        F.coalesce(F.col("prev_id").cast("string"), F.lit("")).alias("k"),
        F.col("prev_h").alias("h"),
        F.expr("substring(text, 1, cast(prev_n div 4 as int))").alias("donor"),
        sketch(F.col("text")).alias("next_own"),
    )
    if repeated:
        donors = donors.dropDuplicates(["k", "h"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("donor", F.lit(1), quarter))
    out = full.join(donors, ["k", "h"]).select(F.expr("cast(nullif(k, '') as long)").alias("doc_id"), n.cast("long").alias("n_chars"), edited.alias("edited"), sketch(F.col("text")).alias("own"), "next_own")
    out = out.withColumn("edited_own", sketch(F.col("edited")))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own.hashes")).alias("fingerprint"),
        as_text(F.col("edited_own.hashes")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_own")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likenesses."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
