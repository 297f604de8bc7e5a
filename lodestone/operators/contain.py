"""Where quotations stand in texts: substring containment by a positional q-gram index.

A quotation is tiled with pieces of ``SIZE`` characters (the last one overlaps; a shorter quotation is one piece). Texts are
read once: a rolling hash passes over every position, and only places whose hash some piece may have (a bit table of
fixed size tells) become postings (doc_id, hash, position, start, end). Each quotation's rarest piece gives its
candidates, and the other pieces have to stand at their distances. The joins are equi-joins on hashes and positions:
no text takes part in them, and no pair of a text and a quotation is looked at that shares no piece.

Tolerant matching compares texts with white space, case, quotes and dashes unified, and reports places in the original;
without ``variants`` only runs of ASCII white space and the case of single characters are unified.
Two different pieces agree with a probability of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import VARIANTS
from lodestone.session import materialised

SIZE = 16
#: Strings of up to so many characters are hashed whole where only their number in a text is asked for.
WHOLE = 32
#: Characters of texts looked at together there.
CHUNK = 1 << 18
#: Bits of the table of probable pieces: 4 MB, however many quotations there are.
TABLE_BITS = 1 << 25
_BASE = 0x9E3779B97F4A7C15 | 1
_VARIANTS = str.maketrans(*VARIANTS)
#: The capitals whose lower-case form is longer or depends on what follows, by their simple forms.
_SIMPLE = str.maketrans("İΣ", "iσ")


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            grow = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(2 * n, b, np.uint64)])
            self.up, self.down = grow(_BASE), grow(pow(_BASE, -1, 2**64))
        return self.up[:n], self.down[:n]


def unified(text: str, variants: bool = True) -> tuple[str, np.ndarray]:
    """``text`` in the form that tolerant matching compares, and the place of each of its characters in ``text``."""
    lower = text.translate(_VARIANTS if variants else _SIMPLE).lower()
    if len(lower) != len(text):  # a few capitals have longer lower-case forms
        lower = "".join(low if len(low := c.lower()) == 1 else c for c in text.translate(_VARIANTS))
    blank = np.fromiter(map(str.isspace if variants else " \t\n\f\r".__contains__, lower), bool, len(lower))
    kept = np.flatnonzero(~blank | ~np.r_[True, blank[:-1]])
    if len(kept) and blank[kept[-1]]:
        kept = kept[:-1]
    return "".join(" " if blank[i] else lower[i] for i in kept.tolist()) if blank.any() else lower, kept


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(30))).view(np.int64)


def rolling(text: str, size: int, powers: Powers) -> np.ndarray:
    """64-bit hashes of all stretches of ``size`` characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(points)
    if n < size:
        return np.zeros(0, np.int64)
    up, down = powers.of(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(points * up[:n], out=sums[1:])
        return _mixed((sums[size:] - sums[: n - size + 1]) * down[: n - size + 1] + np.uint64(size))


def _form(text: str, tolerant: bool, variants: bool) -> tuple[str, np.ndarray]:
    return unified(text, variants) if tolerant else (text, np.arange(len(text)))


def _tiles(tolerant: bool, variants: bool):
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            rows = []
            for name, quoted in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                form = _form(quoted or "", tolerant, variants)[0]
                size = min(SIZE, len(form))
                if size:
                    places = sorted({*range(0, len(form) - size + 1, size), len(form) - size})
                    found = rolling(form, size, powers)
                    rows += [(name, size, at, int(found[at]), len(places), at == places[-1]) for at in places]
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["quote", "size", "at", "piece", "pieces", "last"])

    return tiles


def _places(tolerant: bool, variants: bool, sizes: list[int], bits: Broadcast):
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, table = Powers(), np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                form, origin = _form(text or "", tolerant, variants)
                for size in sizes:
                    found = rolling(form, size, powers)
                    place = found & (TABLE_BITS - 1)
                    at = np.flatnonzero(table[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                    for a in range(0, len(at), 50_000):
                        part = at[a : a + 50_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([doc] * len(part), batch.schema.field(0).type), pa.array(found[part]), pa.array(part.astype(np.int32)),
                             pa.array(origin[part].astype(np.int32)), pa.array((origin[part + size - 1] + 1).astype(np.int32))],
                            names=["doc_id", "piece", "at", "start", "end"],
                        )

    return places


def _bits(tiles: DataFrame) -> Broadcast:
    place = F.col("piece").bitwiseAND(F.lit(TABLE_BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    words = tiles.select(F.floor(place / 64).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    table = np.zeros(TABLE_BITS // 64, "<i8")
    for word, bit in words.toLocalIterator():  # at most TABLE_BITS / 64 rows
        table[word] = bit
    return tiles.sparkSession.sparkContext.broadcast(table.tobytes())


def occurrences(documents: DataFrame, quotations: DataFrame, tolerant: bool = True, variants: bool = True) -> DataFrame:
    """(quote_id, doc_id, start, end) for every place of a quotation in a document, in code points of its text.

    ``documents``: (doc_id, text), ``quotations``: (quote_id, quoted), with unique ids. Empty quotations (after unifying, if ``tolerant``)
    stand nowhere.
    """
    quote, doc = quotations.schema["quote_id"].dataType.simpleString(), documents.schema["doc_id"].dataType.simpleString()
    tiles = quotations.select("quote_id", "quoted").mapInArrow(_tiles(tolerant, variants), f"quote {quote}, size int, at int, piece long, pieces int, last boolean")
    tiles = materialised(tiles, "quotation-pieces")
    sizes = [r[0] for r in tiles.select("size").distinct().collect()]  # at most SIZE numbers
    places = documents.select("doc_id", "text").mapInArrow(_places(tolerant, variants, sizes, _bits(tiles)), f"doc_id {doc}, piece long, at int, start int, end int")
    places = materialised(places.join(tiles.select("piece").distinct(), "piece", "left_semi"), "piece-places")
    often = places.groupBy("piece").agg(F.count(F.lit(1)).alias("often"))
    rare = tiles.join(often, "piece").groupBy("quote").agg(F.min(F.struct("often", "at", "piece")).alias("rare"), F.count(F.lit(1)).alias("held"), F.first("pieces").alias("pieces"))
    rare = rare.where("held = pieces").select("quote", F.col("rare.at").alias("offset"), F.col("rare.piece").alias("piece"))
    begun = places.join(rare, "piece").select("quote", "doc_id", (F.col("at") - F.col("offset")).alias("first"))
    wanted = begun.join(tiles.select("quote", F.col("at").alias("offset"), "piece", "pieces", "last"), "quote").withColumn("at", F.col("first") + F.col("offset"))
    met = wanted.join(places, ["doc_id", "piece", "at"])
    whole = met.groupBy("quote", "doc_id", "first").agg(
        F.count(F.lit(1)).alias("met"), F.first("pieces").alias("pieces"), F.min("start").alias("start"), F.max(F.when(F.col("last"), F.col("end"))).alias("end")
    )
    return whole.where("met = pieces").select(F.col("quote").alias("quote_id"), "doc_id", "start", "end")


def first_occurrence(documents: DataFrame, quotations: DataFrame, tolerant: bool = True, variants: bool = True) -> DataFrame:
    """(quote_id, doc_id, start, end): the first place of each quotation in each document that holds it."""
    found = occurrences(documents, quotations, tolerant, variants).groupBy("quote_id", "doc_id").agg(F.min(F.struct("start", "end")).alias("at"))
    return found.select("quote_id", "doc_id", "at.start", "at.end")


# Classes of characters: of two neighbouring ones and the last one of a string, most places of a text are told apart from it.
_CLASS = np.array([5 if c.isspace() else 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else {"$": 3, ":": 4}.get(c, 6) for c in map(chr, range(128))] + [7], np.uint8)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value) -> (value, size, ends, piece): a string's length, the classes of its first two and its last character, its hash."""
    powers = Powers()
    for batch in batches:
        values = batch.column(0).to_pylist()
        kinds = [_CLASS[np.minimum(_points(v), 128)].astype(int).tolist() for v in values]
        ends = [k[0] * 64 + k[min(1, len(k) - 1)] * 8 + k[-1] for k in kinds]
        pieces = [int(rolling(v, len(v), powers)[0]) for v in values]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(list(map(len, values)), pa.int32()), pa.array(ends, pa.int32()), pa.array(pieces, pa.int64())], names=["value", "size", "ends", "piece"]
        )


def _held(shapes: list[tuple[int, int]], bits: Broadcast):
    """(group, text) -> (group, piece) for every place of a text that may hold one of the strings of these ``shapes`` (size, ends)."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, table = Powers(), np.frombuffer(bits.value, np.uint8)
        begins, allowed = np.zeros(64, bool), {}
        for size, ends in shapes:
            allowed.setdefault(size, np.zeros(512, bool))[ends] = True
            begins[np.arange(8) + ends // 64 * 8 if size == 1 else ends // 8] = True
        for batch in batches:
            groups, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            part = (np.cumsum(sizes) - 1) // CHUNK  # a longer text comes alone or ends a part
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if len(texts) else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                points = _points("".join(texts[a:b]))
                n = len(points)
                ends, owner = np.cumsum(sizes[a:b]), np.repeat(np.arange(a, b), sizes[a:b])
                kind = _CLASS[np.minimum(points, 128)]
                at = np.flatnonzero(begins[kind * 8 + np.r_[kind[1:], kind[:1]]])
                room = ends[owner[at] - a] - at
                up, down = powers.of(n + 1)
                with np.errstate(over="ignore"):
                    sums = np.zeros(n + 1, np.uint64)
                    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
                    found, whose = [], []
                    for size, fits in allowed.items():
                        own = at[room >= size]
                        second = kind[own + min(1, size - 1)].astype(np.int64)
                        own = own[fits[kind[own].astype(np.int64) * 64 + second * 8 + kind[own + size - 1]]]
                        piece = _mixed((sums[own + size] - sums[own]) * down[own] + np.uint64(size))
                        place = piece & (TABLE_BITS - 1)
                        own, piece = (x[(table[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)] for x in (own, piece))
                        found.append(piece)
                        whose.append(owner[own])
                yield pa.RecordBatch.from_arrays([groups.take(pa.array(np.concatenate(whose))), pa.array(np.concatenate(found))], names=["group", "piece"])

    return held


def counted(documents: DataFrame, group: str, values: DataFrame) -> DataFrame:
    """(``group``, value, places): how often each of ``values`` (value) stands literally in the texts of each group that holds it.

    ``documents``: (``group``, doc_id, text). No place is kept: hits are counted before they are shuffled. Strings longer than
    ``WHOLE`` are looked up by their pieces. Empty ones stand nowhere.
    """
    kind = documents.schema[group].dataType.simpleString()
    values = values.select("value").where("value <> ''").distinct()
    short = values.where(F.length("value") <= WHOLE).mapInArrow(_wholes, "value string, size int, ends int, piece long")
    short = materialised(short, "whole-strings")
    shapes = [tuple(r) for r in short.select("size", "ends").distinct().collect()]  # at most WHOLE * 512
    hits = documents.select(group, "text").mapInArrow(_held(shapes, _bits(short)), f"`group` {kind}, piece long") if shapes else None
    long = materialised(values.where(F.length("value") > WHOLE).select(F.col("value").alias("quote_id"), F.col("value").alias("quoted")), "long-strings")
    parts = []
    if hits is not None:
        places = hits.groupBy("group", "piece").agg(F.count(F.lit(1)).alias("places"))
        parts.append(places.join(short.select("value", "piece"), "piece").select(F.col("group").alias(group), "value", "places"))
    if hits is None or not long.isEmpty():
        found = occurrences(documents.select("doc_id", "text"), long, tolerant=False).join(documents.select(group, "doc_id"), "doc_id")
        parts.append(found.groupBy(group, F.col("quote_id").alias("value")).agg(F.count(F.lit(1)).alias("places")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
