"""Ranked lexical search by a threshold-seeded join.

Scores are whole numbers. An item's score for a document is the sum, over the item's terms with repeats, of the
impact w * ((10^9 tf) div (1000 tf + 8 m)) of the term in the document.

1. *Postings.* One pass over the texts makes a table with a row for each document: its number of terms and its counts of
   terms that some item may have (a bit table of fixed size passes nearly only those; more only cost space).
2. *Stored impacts.* From the terms' document frequencies come their weights, and from the postings each term's
   largest and k-th largest impact; a task passes on at most ``k`` impacts a term.
3. *Thresholds.* k documents have at least a term's k-th impact, so an item's k-th score is no less than the largest of its
   terms' (repeats times) k-th impacts. That seeds the threshold; a task raises it to the k-th score that it has
   itself found so far, which is a lower bound as well.
4. *Pruning.* An item's terms are ordered by the most they can add, and the sums from each term to the last are known. Where
   such a sum is under the threshold, a document with none of the terms before cannot be among the first k: only the
   terms before generate candidates, and a document whose sum over these, plus all that the pruned terms could add, is
   under the threshold is none.
5. *Rescoring.* Candidates are scored with all terms of the item. Of equal scores all that may count stay in the race until
   ids have decided. A task passes on at most ``k`` documents an item, and a window ranks them.

Items go through steps 3 to 5 in blocks of some ``BLOCK_TERMS`` terms in all, a stated query set against all documents; a block
is the only thing that is broadcast. Items of a benchmark are usually one block.

Defined results: a null text has no terms, a document without terms is no candidate and not in N; a text of any
length counts whole; repeated rows of documents are ranked each; repeated equal items are one, and an id with several
texts is an item for each of them; ties go to the smaller doc_id, a null one last; without documents or items there are
no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import TABLE_BITS, TEXT_BYTES, by_bytes, forget, scratch

#: Terms are runs of ASCII letters, digits and whatever is not ASCII; of letters A-Z only are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms, over all items, that are broadcast at once.
BLOCK_TERMS = 200_000
#: Documents and candidates that a task scores at once.
_DOCS, _PAIRS = 2000, 20_000


def _term_bytes() -> bytes:
    """For each byte what it counts as: itself, its lower case, or a blank between terms."""
    return bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


_BYTES = _term_bytes()


def counted(text: bytes | None) -> Counter:
    """Terms of a text with their numbers."""
    return Counter((text or b"").translate(_BYTES).split())


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (item, term, times)
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True)
            for term, times in counted(text).items()
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[2] for r in rows], pa.int64())],
            names=["item", "term", "times"],
        )


def _postings(bits: Broadcast):
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask, crc = bits.value, TABLE_BITS - 1, zlib.crc32
        for batch in batches:
            for part in by_bytes(batch, "text", TEXT_BYTES):
                sizes, ends, terms, times = [], [0], [], []
                for text in part.column("text").to_pylist():
                    found = counted(text)
                    sizes.append(found.total())
                    for term, tf in found.items():
                        h = crc(term) & mask
                        if table[h >> 3] >> (h & 7) & 1:
                            terms.append(term)
                            times.append(tf)
                    ends.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(terms, pa.binary()).cast(pa.string()), pa.array(times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    return postings


def _bits(spark: SparkSession, terms: DataFrame) -> Broadcast:
    """A bit for each term's checksum: 4 MB, however many terms there are."""
    place = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(TABLE_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    words = terms.select(F.floor(place / 64).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    table = np.zeros(TABLE_BITS // 64, "<i8")
    for word, bit in words.toLocalIterator():  # at most TABLE_BITS / 64 rows
        table[word] = bit
    return spark.sparkContext.broadcast(table.tobytes())


class Items(NamedTuple):
    """A block of items; pairs of items and terms are sorted by item, largest possible gain first."""

    names: pa.Array
    weight: np.ndarray
    documents: int
    words: int
    ids: np.ndarray
    items: int
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray
    suffix: np.ndarray  # the most that a pair and those after it can add
    seed: np.ndarray  # by item


class Postings(NamedTuple):
    """Rows of the postings table as flat arrays: the terms of a block with their impacts, by document."""

    doc: np.ndarray
    no_id: np.ndarray
    row: np.ndarray
    term: np.ndarray
    impact: np.ndarray


def _impacts(batch: pa.RecordBatch, names: pa.Array, weight: np.ndarray, documents: int, words: int) -> Postings:
    lists = batch.column("terms")
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    term = pc.index_in(lists.flatten(), names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    tf = batch.column("times").flatten().to_numpy()
    m = np.asarray([25 + 75 * n * documents // words for n in batch.column("n").to_pylist()], np.int64)
    row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
    known = term >= 0
    row, term, tf = row[known], term[known], tf[known]
    impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
    ids = batch.column("doc_id")
    return Postings(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), row, term, impact)


def _largest(k: int, group: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Places of the first ``k`` of each group; ``order`` from the least to the most significant key."""
    by = np.lexsort((*order, group))
    place = np.arange(len(by)) - np.searchsorted(group[by], group[by])
    return by[place < k]


def _top_impacts(k: int, names: Broadcast):
    """The ``k`` largest impacts of each term among the documents a task reads."""

    def top_impacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, impact = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            found = _impacts(batch, *names.value)
            term, impact = np.append(term, found.term), np.append(impact, found.impact)
            few = _largest(k, term, -impact)
            term, impact = term[few], impact[few]
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(impact)], names=["term", "impact"])

    return top_impacts


class Search:
    """A task's search: documents come in blocks, the best of each item stay."""

    def __init__(self, block: Items, k: int):
        self.block, self.k = block, k
        self.floor = np.maximum(block.seed, 1)
        self.by_term = np.argsort(block.term, kind="stable")
        self.term_ends = np.searchsorted(block.term[self.by_term], np.arange(len(block.weight) + 1))
        self.item_ends = np.searchsorted(block.item, np.arange(block.items + 1))
        self.item, self.doc, self.no_id, self.score = (np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))

    def add(self, rows: Postings) -> None:
        b = self.block
        essential = b.suffix >= self.floor[b.item]
        pruned = np.zeros(b.items, np.int64)  # what the pruned terms of an item can add
        first_out = self.item_ends[:-1] + np.add.reduceat(np.append(essential, False), self.item_ends[:-1]) * (np.diff(self.item_ends) > 0)
        some_out = first_out < self.item_ends[1:]
        pruned[some_out] = b.suffix[first_out[some_out]]
        order = np.argsort(rows.term, kind="stable")
        terms, starts = np.unique(rows.term[order], return_index=True)
        for at in range(0, len(rows.doc), _DOCS):
            size = min(_DOCS, len(rows.doc) - at)
            total = np.zeros((size, b.items), np.int64)
            for t, start, end in zip(terms.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
                pairs = self.by_term[self.term_ends[t] : self.term_ends[t + 1]]
                pairs = pairs[essential[pairs]]
                if len(pairs):
                    held = order[start:end]
                    held = held[(rows.row[held] >= at) & (rows.row[held] < at + size)] if len(rows.doc) > _DOCS else held
                    total[np.ix_(rows.row[held] - at, b.item[pairs])] += rows.impact[held][:, None] * b.times[pairs]
            d, i = np.nonzero(total + pruned >= self.floor)
            for p in range(0, len(d), _PAIRS):
                self.rescore(rows, d[p : p + _PAIRS] + at, i[p : p + _PAIRS])

    def rescore(self, rows: Postings, d: np.ndarray, i: np.ndarray) -> None:
        """Candidates (document, item) with all terms of the item."""
        b = self.block
        key = rows.row * len(b.weight) + rows.term
        order = np.argsort(key)
        lengths = self.item_ends[i + 1] - self.item_ends[i]
        pair = np.repeat(np.arange(len(d)), lengths)
        entry = np.arange(len(pair)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(self.item_ends[i], lengths)
        wanted = d[pair] * len(b.weight) + b.term[entry]
        place = np.minimum(np.searchsorted(key[order], wanted), max(len(key) - 1, 0))
        there = key[order[place]] == wanted
        score = np.zeros(len(d), np.int64)
        np.add.at(score, pair[there], b.times[entry[there]] * rows.impact[order[place[there]]])
        fit = score >= self.floor[i]
        self.item, self.score = np.append(self.item, i[fit]), np.append(self.score, score[fit])
        self.doc, self.no_id = np.append(self.doc, rows.doc[d[fit]]), np.append(self.no_id, rows.no_id[d[fit]])
        best = _largest(self.k, self.item, self.doc, self.no_id, -self.score)
        self.item, self.doc, self.no_id, self.score = self.item[best], self.doc[best], self.no_id[best], self.score[best]
        full = np.flatnonzero(np.bincount(self.item, minlength=b.items) >= self.k)
        last = np.searchsorted(self.item, full, side="right") - 1
        self.floor[full] = np.maximum(self.floor[full], self.score[last])


def _search(k: int, block: Broadcast):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Search(block.value, k)
        b = own.block
        for batch in batches:
            own.add(_impacts(batch, b.names, b.weight, b.documents, b.words))
        yield pa.RecordBatch.from_arrays([pa.array(b.ids[own.item]), pa.array(own.doc, mask=own.no_id), pa.array(own.score)], names=["item", "doc_id", "score"])

    return search


def _block(rows: list[tuple[int, str, int, int, int, int]], documents: int, words: int) -> Items:
    """``rows``: (item, term, times, weight, largest, kth)."""
    items = np.unique([r[0] for r in rows])
    names = sorted({r[1] for r in rows})
    weights = {r[1]: r[3] for r in rows}
    item = np.searchsorted(items, [r[0] for r in rows])
    places = {t: i for i, t in enumerate(names)}
    term = np.asarray([places[r[1]] for r in rows], np.int64)
    times, largest, kth = (np.asarray([r[j] for r in rows], np.int64) for j in (2, 4, 5))
    order = np.lexsort((term, -times * largest, item))
    item, term, times, gain, seeds = item[order], term[order], times[order], (times * largest)[order], (times * kth)[order]
    ends = np.searchsorted(item, np.arange(len(items) + 1))
    running = np.append(0, np.cumsum(gain))
    suffix = running[ends[1:]][item] - running[:-1]
    seed = np.zeros(len(items), np.int64)
    np.maximum.at(seed, item, seeds)
    weight = np.asarray([weights[t] for t in names], np.int64)
    return Items(pa.array(names), weight, documents, words, items, len(items), item, term, times, suffix, seed)


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    own = items.select("item_id", F.col("text").cast("binary").alias("text")).distinct()
    own = scratch(own.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    asked = scratch(own.select("item", "text").mapInArrow(_item_terms, "item long, term string, times long"), "item-terms")
    bits = _bits(spark, asked)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    postings = scratch(texts.mapInArrow(_postings(bits), "doc_id long, n long, terms array<string>, times array<long>"), "postings-by-document")
    bits.unpersist()
    documents, words, terms = (
        *postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first(), asked.count()
    )
    frequency = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked.join(frequency, "term").select("item", "term", "times", weight.alias("weight"))
    blocks = max(1, -(-terms // block_terms))
    weighted = scratch(weighted.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), "weighted-terms")
    found = []
    for number in range(blocks):
        rows = [tuple(r) for r in weighted.where(F.col("block") == number).drop("block").collect()]  # some ``block_terms`` rows
        if not rows:
            continue
        names = sorted({(t, w) for _, t, _, w in rows})
        vocabulary = spark.sparkContext.broadcast((pa.array([t for t, _ in names]), np.asarray([w for _, w in names], np.int64), documents, words))
        tops = postings.mapInArrow(_top_impacts(k, vocabulary), "term long, impact long")
        tops = tops.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))).where(F.col("place") <= k)
        stored = tops.groupBy("term").agg(F.max("impact"), F.max(F.when(F.col("place") == k, F.col("impact")))).collect()  # a row a term
        limits = {names[t][0]: (most, kth or 0) for t, most, kth in stored}
        held = spark.sparkContext.broadcast(_block([(*r, *limits.get(r[1], (0, 0))) for r in rows], documents, words))
        best = postings.mapInArrow(_search(k, held), "item long, doc_id long, score long")
        found.append(scratch(best, "best-documents"))
        for spent in (vocabulary, held):
            spent.unpersist()
    if not found:
        return own.limit(0).select("item_id", F.lit(1).alias("rank"), F.lit(1).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("score"))
    for table in (postings, weighted, asked):
        forget(table)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(own.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranked_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_TERMS = rf"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_words FROM d),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
g AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_words)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, r)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM g WHERE score > 0) WHERE rank <= 10
"""
