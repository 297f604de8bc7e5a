"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Lengths are whole numbers up to the capacity, so documents of equal length are interchangeable and
best-fit decreasing can be planned on the histogram of lengths (at most ``capacity`` numbers, however many
documents there are). ``plan_bins`` goes through the lengths downwards; a segment tree over remaining
capacities finds the tightest open bin in logarithmic time, and all equal bins found there take their
documents in one step: a bin with room r takes floor(r / length) of them before the next bin is touched,
exactly as one-by-one best fit would. The plan is a list of runs: the i-th document of a length belongs
to the run that covers i, which gives bin and offset by arithmetic. Documents are numbered within their
length by salted counting, so one length may hold a third of all rows.

Tokenising works on white-space separated chunks with a cache of chunk -> ids, bounded in bytes; the tokenizer drops white space and never merges across it, so this equals encoding the whole text. Texts
with the separators U+001C..U+001F, which Python splits on and the tokenizer does not, are encoded whole.

Defined results: a null text is an empty document (the end id only); documents over the capacity are cut
into full pieces and a rest; a text of any length is taken whole, alone if it is long; repeated rows are packed
each; a null doc_id stays null; an empty table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import scratch

CAPACITY = 4096
END_ID = 1
SALTS = 256
#: Bytes that a Python worker's caches of chunks and their parts hold.
CACHED_BYTES = 96 << 20
TOKENIZER = "word_bpe_49k.json"

#: Python splits on these, the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: ASCII signs other than apostrophes.
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it prints, else one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


_BYTE_CHARACTERS = _byte_characters()

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered(dict):
    """A function's values for the keys seen lately, in two generations of ``most`` bytes or so each."""

    def __init__(self, compute: Callable[[str], bytes], most: int):
        super().__init__()
        self.compute, self.most, self.held, self.old = compute, most, 0, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.compute(key)
        if len(key) <= 64:
            if self.held >= self.most:
                self.old, self.held = dict(self), 0
                self.clear()
            self[key] = found
            self.held += 200 + len(key)  # an entry takes some 200 bytes besides the key's characters
        return found


class Ids:
    """Texts -> their ids as little-endian unsigned 32-bit bytes.

    White-space separated chunks are looked up first, then their parts: a chunk of letters followed by signs
    is a lower-cased word and a run of signs, which the tokenizer treats apart. Such a part is one pre-token and
    goes to the tokenizer's model straight away, its bytes written as the characters that stand for them. Any other
    chunk (digits, apostrophes, marks, letters whose lower case depends on their place) goes to the tokenizer whole.
    A broadcast carries the object, so that what one task of a Python worker learned serves the next, and the
    caches, of ``most`` bytes or so, go with the broadcast.
    """

    def __init__(self, path: str, most: int = CACHED_BYTES):
        self.path, self.most = path, most
        self.tokenizer = None
        self.parts, self.chunks = Remembered(self.part, most // 4), Remembered(self.chunk, most // 4)

    def __reduce__(self):
        return Ids, (self.path, self.most)

    def load(self) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.model = self.tokenizer.model

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, part: str) -> bytes:
        written = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        letters = chunk.rstrip(_SIGNS)
        if letters.isalpha():
            word = letters.lower()
            if chunk.isascii() or (word.isalpha() and "Σ" not in chunk and unicodedata.is_normalized("NFC", chunk)):
                if len(letters) == len(chunk):
                    return self.parts[word]
                return self.parts[word] + self.parts[chunk[len(letters) :]]
        return self.whole(chunk)

    def __call__(self, text: str) -> bytes:
        if self.tokenizer is None:
            self.load()
        if _SEPARATORS.search(text):
            return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))


def _cutter(held: Broadcast, capacity: int, end_id: int):
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = held.value
        for batch in batches:
            doc_ids, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = ids_of(text.as_py() or "") + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    doc_ids.append(doc_id)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return cut


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) -> one row per piece of at most ``capacity`` ids."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _cutter(docs.sparkSession.sparkContext.broadcast(Ids(path)), capacity, end_id), PIECES
    )


class CapacityTree:
    """Segment tree over capacities 0..n: which have open bins, and the smallest such one from x on."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, x: int, is_open: bool) -> None:
        i = x + self.size
        self.any[i] = is_open
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, x: int) -> int | None:
        """The smallest capacity >= x with an open bin."""
        i = x + self.size
        while not self.any[i]:
            while i & 1:  # a right child: the next subtree to the right hangs off an ancestor
                i //= 2
            if i == 0:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


#: (length, first document rank, documents, first bin, documents per bin, offset in each bin)
Run = tuple[int, int, int, int, int, int]


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit-decreasing plan for ``histogram`` (length -> number of documents), as runs."""
    runs: list[Run] = []
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first bin, bins)
    bins = 0

    def add(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in open_bins:
                open_bins[room] = []
                tree.set(room, True)
            open_bins[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left > 0:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    tree.set(room, False)
                each = room // length
            used = min(n, -(-left // each))
            docs = min(left, used * each)
            runs.append((length, rank, docs, first, each, capacity - room))
            full = docs // each
            add(room - each * length, first, full)
            if full < used:  # the last bin takes what is left
                add(room - (docs - full * each) * length, first + full, 1)
            add(room, first + used, n - used)
            left, rank = left - docs, rank + docs
    return runs


def _placer(runs: list[Run]):
    """Rank within a length -> bin and offset; the plan's size depends on the capacity, not on the rows."""
    table = np.asarray(sorted(runs), dtype=np.int64).reshape(-1, 6)
    width = 1 << 48
    starts = table[:, 0].astype(np.uint64) * np.uint64(width) + table[:, 1].astype(np.uint64)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            length, rank = rows["length"].to_numpy(np.int64), rows["rank"].to_numpy(np.int64)
            key = length.astype(np.uint64) * np.uint64(width) + rank.astype(np.uint64)
            run = table[np.searchsorted(starts, key, side="right") - 1]
            i = rank - run[:, 1]
            rows["sequence_id"] = run[:, 3] + i // run[:, 4]
            rows["offset"] = run[:, 5] + i % run[:, 4] * length
            yield rows.drop(columns=["rank"])

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (columns of ``PIECES``)."""
    pieces = scratch(
        pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")),
        "pieces",
    )
    cells = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "salt", "first")
    # At most one row per length up to the capacity comes to the driver.
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.join(cells, ["length", "salt"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.row_number().over(inside) - 1).cast("long").alias("rank"),
    )
    return ranked.mapInPandas(_placer(plan_bins(histogram, capacity)), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text)."""
    return pack(tokenized_pieces(docs, path or tokenizer_path(), capacity), capacity)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
