"""Quality by nearest-neighbour voting in a latent-semantic space.

Every whole text is a bag of terms: its words (lower-cased, bare) and the outward shapes of its words (letter
case, digits, the run of signs at either end, repeats of the word before), hashed into ``BUCKETS`` columns. Log-entropy weights and a
truncated singular value decomposition, both fitted on the labelled sample, turn that into a unit vector of
``DIMENSIONS`` numbers. The labelled vectors are broadcast (at most ``SAMPLE`` rows, a documented bound, so
their size is fixed: SAMPLE x DIMENSIONS floats and BUCKETS x DIMENSIONS for the projection); every document
is compared with all of them by exact, blocked cosine products, and its ``NEIGHBOURS`` nearest vote with
their labels, weighted by similarity.

Labels of held-out documents, lang, source and doc_id are never inputs.

Defined results: null and empty texts have the zero vector and get the share of good labels, as does any
document when there are no labelled rows of both kinds; ties between neighbours go by sample order; repeated
rows are scored each; a text of any length is read whole; an empty table gives no rows; other columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import TEXT_BYTES, by_bytes, held_out
from lodestone.llm.labelled import training_rows

SAMPLE = 3000
BUCKETS = 1 << 12
DIMENSIONS = 48
NEIGHBOURS = 25
BLOCK = 512
THRESHOLD = 0.3
CACHED_TOKENS = 200_000

_EDGES = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.DOTALL)


#: Columns of tokens that repeat the one before, and of those in texts where a tenth do.
REPEATED, MOSTLY_REPEATED = (zlib.crc32(x) % BUCKETS for x in (b"r\0repeated", b"r\0mostly"))


def terms(token: str) -> tuple[int, ...]:
    """Columns of one white-space separated token: its word, its shape, its trailing signs."""
    before, word, after = _EDGES.match(token).groups()
    case = (
        "empty" if not word else "digits" if word.isdigit() else "upper" if word.isupper() and len(word) > 1
        else "title" if word[:1].isupper() else "lower" if word.isalpha() else "mixed"
    )
    size = min(len(word), 12) // 3
    names = [f"s\0{case}\0{before[:1]}\0{after[:1]}\0{min(len(after), 3)}", f"l\0{case}\0{size}"]
    if word:
        names.append(f"w\0{word.lower()}")
    if after:
        names.append(f"a\0{after[:3]}")
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in names)


class Bags:
    """Texts -> rows of term counts; a bounded cache keeps the columns of tokens seen."""

    def __init__(self):
        self.cache: dict[str, tuple[int, ...]] = {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), BUCKETS), np.float32)
        cache = self.cache
        for row, text in zip(out, texts, strict=True):
            tokens = text.split()
            counts = Counter(tokens)
            again = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
            if len(cache) > CACHED_TOKENS:
                cache.clear()
            at, by = [], []
            if again:
                at, by = [REPEATED, MOSTLY_REPEATED][: 1 + (10 * again > len(tokens))], [again] * (1 + (10 * again > len(tokens)))
            for token, n in counts.items():
                found = cache.get(token)
                if found is None:
                    found = terms(token)
                    if len(token) <= 64:
                        cache[token] = found
                at += found
                by += [n] * len(found)
            if at:
                row += np.bincount(at, weights=by, minlength=BUCKETS)
        return np.log1p(out)


class QualityModel:
    """Projection, labelled vectors and their labels."""

    def __init__(self):
        self.share, self.projection, self.vectors, self.labels = 0.5, None, None, None

    def fit(self, x: np.ndarray, y: np.ndarray) -> QualityModel:
        """``x``: rows of log counts; the decomposition goes through the row Gram matrix."""
        if len(y):
            self.share = float(y.mean())
        if not 0 < y.sum() < len(y):
            return self
        mass = x.sum(axis=0)
        p = x / np.maximum(mass, 1e-9)
        entropy = 1 + (p * np.log(np.maximum(p, 1e-12))).sum(axis=0) / np.log(max(len(y), 2))
        weight = np.where(mass > 0, entropy, 0).astype(np.float32)
        w = x * weight
        w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
        values, left = np.linalg.eigh((w @ w.T).astype(np.float64))
        k = min(DIMENSIONS, len(y))
        values, left = values[::-1][:k], left[:, ::-1][:, :k]
        keep = values > 1e-6
        right = (w.T @ left[:, keep]) / np.sqrt(values[keep])
        self.projection = (weight[:, None] * right).astype(np.float32)
        self.vectors, self.labels = self.embed(x), y.astype(np.float32)
        return self

    def embed(self, x: np.ndarray) -> np.ndarray:
        v = x @ self.projection
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def vote(self, x: np.ndarray) -> np.ndarray:
        if self.projection is None:
            return np.full(len(x), self.share)
        similar = self.embed(x) @ self.vectors.T
        k = min(NEIGHBOURS, similar.shape[1])
        near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(similar, near, axis=1), 0).astype(np.float64) ** 4
        total = weight.sum(axis=1)
        votes = (weight * self.labels[near]).sum(axis=1)
        return np.where(total > 1e-9, votes / np.maximum(total, 1e-9), self.share)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    train = training_rows(docs, labels, "quality", sample)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag = Bags()
        for batch in (part for whole in batches for part in by_bytes(whole, "text", TEXT_BYTES)):
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows = bag(part.column("text").to_pylist())
                cols = [np.flatnonzero(r) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("label"),
                        pa.array([c.astype(np.int16) for c in cols], pa.list_(pa.int16())),
                        pa.array([r[c] for r, c in zip(rows, cols, strict=True)], pa.list_(pa.float32())),
                    ],
                    names=["doc_id", "label", "at", "by"],
                )

    found = train.select("doc_id", "label", "text").mapInArrow(bags, "doc_id long, label int, at array<short>, by array<float>").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    x = np.zeros((found.num_rows, BUCKETS), np.float32)
    at, by = found.column("at").combine_chunks(), found.column("by").combine_chunks()
    for new, old in enumerate(order):
        x[new, at[int(old)].values.to_numpy()] = by[int(old)].values.to_numpy()
    return QualityModel().fit(x, found.column("label").to_numpy()[order].astype(float))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag, fitted = Bags(), QualityModel()
        vars(fitted).update(shared.value)
        for batch in (part for whole in batches for part in by_bytes(whole, "text", TEXT_BYTES)):
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fitted.vote(bag(texts)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
