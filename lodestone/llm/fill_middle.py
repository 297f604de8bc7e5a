"""Fill-in-middle transformation over an index of distinct texts.

A document's cut depends on its id, the places of its code points on its text alone. So the places are an index of
distinct texts: texts are grouped by the SHA-256 of their whole content, and each group gets one list of code point
boundaries (byte offsets in UTF-8) in Elias-Fano form. A task makes the list of a text once, however many copies it
reads, and of the lists of several tasks one is kept. The lists are some two bits a code point and compress to almost
nothing where a text is ASCII. Documents that are cut are then joined to their lists by the digest, which moves each of their
texts once (a plain document has no boundary to look up and stays where it is read); a text that a third of the documents have
is a hot key that adaptive execution splits. Both boundaries of a cut
are selected in the list: a directory holds the place of every 256th one bit, so a selection reads a few bytes.

Hashes, forms and the way back (``restored``) are expressions.

Defined results: a null text is empty and its form plain; a text of any length is cut whole; repeated rows are cut
each, and equal ids and texts alike; a null doc_id counts as the empty id in the seed; an empty table gives no rows;
other columns, whatever their names, play no part. There are no ties to break.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import TEXT_BYTES, by_bytes, scratch, text_or_empty

#: What begins prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares of documents, in percent, that stay plain and that put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: The directory holds the place of every one bit of this distance.
STEP = 256

LISTS = "digest binary, n long, low_bits int, low binary, high binary, marks binary"


def boundaries(text: bytes) -> np.ndarray:
    """Byte offsets of all code points and of the end."""
    data = np.frombuffer(text, np.uint8)
    return np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))


def elias_fano(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """(low bits, low parts, unary high parts, directory) of an ascending list that is not empty."""
    ratio = int(values[-1]) // len(values)
    low_bits = max(ratio.bit_length() - 1, 0)
    places = (values >> low_bits) + np.arange(len(values))
    high = np.zeros(int(places[-1]) + 1, np.uint8)
    high[places] = 1
    low = (values[:, None] >> np.arange(low_bits)) & 1
    return (
        low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(),
        np.packbits(high, bitorder="little").tobytes(), places[::STEP].astype("<i8").tobytes(),
    )


def select(i: int, low_bits: int, low: bytes, high: bytes, marks: bytes) -> int:
    """The i-th value of a list in Elias-Fano form, from the directory and the few bytes after its mark."""
    k = i // STEP
    mark = int.from_bytes(marks[8 * k : 8 * k + 8], "little")
    after = marks[8 * k + 8 : 8 * k + 16]
    end = int.from_bytes(after, "little") if after else 8 * len(high)
    first = mark >> 3
    bits = np.unpackbits(np.frombuffer(high, np.uint8, (end + 7 >> 3) - first, first), bitorder="little")
    place = mark + int(np.flatnonzero(bits[mark & 7 :])[i - k * STEP])
    start = i * low_bits
    window = int.from_bytes(low[start >> 3 : (start + low_bits + 7) >> 3], "little")
    return (place - i) << low_bits | (window >> (start & 7)) & ((1 << low_bits) - 1)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        for part in by_bytes(batch, "text", TEXT_BYTES):
            rows = []
            for digest, text in zip(part.column("digest").to_pylist(), part.column("text").to_pylist(), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    places = boundaries(text)
                    rows.append((digest, len(places) - 1, *elias_fano(places)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "n", "low_bits", "low", "high", "marks"]
            )


def distinct_text_index(docs: DataFrame) -> DataFrame:
    """(digest, n, low_bits, low, high, marks): the boundary list of every distinct text, as a table.

    ``docs``: (digest, text), text as bytes.
    """
    once = docs.select("digest", "text").mapInArrow(_lists, LISTS).dropDuplicates(["digest"])
    return scratch(once, "text-index")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    names = ("text", "form", "first", "second", "low_bits", "low", "high", "marks")
    for batch in batches:
        for part in by_bytes(batch, "text", TEXT_BYTES):
            outputs = []
            for text, form, first, second, *held in zip(*[part.column(c).to_pylist() for c in names], strict=True):
                a, b = select(first, *held), select(second, *held)
                pieces = (p, text[:a], s, text[b:]) if form == "psm" else (s, text[b:], p, text[:a])
                outputs.append(b"".join((*pieces, m, text[a:b])))
            kept = [part.column(c) for c in ("doc_id", "n", "form", "first", "second")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(outputs, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "first", "second", "output"]
            )


def fill_in_middle(docs: DataFrame, seed: str = "1", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs`` (doc_id, text).

    The cut and the form of a document follow from the SHA-256 of ``seed``, a colon and its id.
    """
    text = text_or_empty(F.col("text").cast("string"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    base = base.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("marked", F.col("text").rlike(f"{PREFIX}|{SUFFIX}|{MIDDLE}"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = lambda k: F.conv(F.substring(drawn, 8 * k - 7, 8), 16, 10).cast("long")
    place = lambda k: F.pmod(draw(k), F.col("n") + 1)
    plainly = (F.col("text") == "") | F.col("marked") | (draw(3) % 100 >= 100 - plain)
    kept = base.where(plainly).select(
        "doc_id", F.length("text").cast("long").alias("n"), F.lit("plain").alias("form"), F.lit(None).cast("long").alias("first"),
        F.lit(None).cast("long").alias("second"), F.col("text").alias("output"),
    )
    base = base.where(~plainly).select("doc_id", "digest", F.col("text").cast("binary").alias("text"))
    form = F.when(draw(4) % 100 < suffix_first, "spm").otherwise("psm")
    rows = base.join(distinct_text_index(base), "digest").select(
        "doc_id", "text", "n", form.alias("form"), F.least(place(1), place(2)).alias("first"), F.greatest(place(1), place(2)).alias("second"),
        "low_bits", "low", "high", "marks",
    )
    out = rows.mapInArrow(_cut, "doc_id long, n long, form string, first long, second long, output string").unionByName(kept)
    return out.select("doc_id", "n", "form", F.col("first").alias("prefix_chars"), (F.col("second") - F.col("first")).alias("middle_chars"), "output")


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that ``output`` was made of."""
    output = F.col(output) if isinstance(output, str) else output
    form = F.col(form) if isinstance(form, str) else form
    one = F.when(form == "psm", SUFFIX).otherwise(PREFIX)  # what ends the first part
    at = F.instr(output, one)
    head, rest = F.substring(output, F.lit(4), at - 4), F.substring(output, at + 3, F.length(output))
    cut = F.instr(rest, MIDDLE)
    tail, middle = F.substring(rest, F.lit(1), cut - 1), F.substring(rest, cut + 3, F.length(rest))
    return (
        F.when(form == "psm", F.concat(head, middle, tail))
        .when(form == "spm", F.concat(tail, middle, head))
        .otherwise(output)
    )


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form and cut, with the digests of its output and of the text made of that again."""
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"),
    )


OP11_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
        ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END AS output FROM c),
f AS (SELECT *, strpos(output, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS p FROM o),
g AS (SELECT *, substr(output, 4, p - 4) AS head, substr(output, p + 3) AS rest FROM f),
r AS (SELECT *, substr(rest, 1, strpos(rest, '<M>') - 1) AS tail, substr(rest, strpos(rest, '<M>') + 3) AS middle FROM g)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN head || middle || tail ELSE tail || middle || head END) AS restored_sha256
FROM r
"""
