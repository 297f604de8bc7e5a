"""Approximate nearest neighbours by cross-polytope hashing.

1. *Distinct vectors.* Copies are one vector with its ``k + 1`` smallest ids (no query can need more), cut down in
   each task before they meet, so a vector that a third of the rows have is no hot key. Rows of one id and one
   vector are one row.
2. *Tables.* Unit vectors, padded to a power of two, go through three rounds of random signs and a fast Hadamard
   transform, for each of ``tables`` tables anew, and fall to the nearest of the 2 * D signed axes; with ``hashes`` over 1
   a bucket is the tuple of that many independent axes (for tables so large that one axis in 2 * D is too coarse).
3. *Probes.* A query looks into its nearest buckets in every table, as many as it takes to miss a vector at cosine c with
   a probability of ``1 - recall`` at most. c is the cosine of its k-th nearest of ``SAMPLE`` vectors, a bounded sample (those of
   smallest hash) that all tasks get: no neighbour sought is farther than that, so c errs to the safe side. Hit rates by
   cosine and number of probes are found once by simulation. A far k-th neighbour leads to many probes, up to all
   buckets, where the search is exact: recall holds at any size, and work falls as neighbours come near.
4. *Candidates.* Buckets are cut into slices of ``SLICE`` vectors or so, by their counted sizes, so a crowded bucket is many
   groups; a task holds one slice and lets its queries stream by. Products are exact; each slice returns a query's best.
5. *Rerank.* The best of each query meet their original vectors, and the cosine is computed from these, in double
   precision and a fixed order. Equal cosines are ordered by id.

Vectors of different lengths are not compared. Scaling by a power of two keeps squares of huge or tiny components finite;
it changes no cosine.

Defined results: rows without id, and vectors null, empty, zero, or with a null or non-finite component take no part;
copies are found each, ties by smaller id; an id with several vectors is as many candidates and queries; fewer
candidates than ``k`` are all found; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import forget, scratch

TABLES = 4
RECALL = 0.95
#: Vectors of the sample that tells how near a query's neighbours are at least.
SAMPLE = 4096
#: Vectors that a task holds at once.
SLICE = 4096
#: Kept beyond k for each query and slice, so that rounding of products cannot push a neighbour out.
SPARE = 3
GRID = 50
_QUERIES_AT_ONCE = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of each row; row lengths are powers of two."""
    n, width = x.shape
    step = 1
    while step < width:
        halves = x.reshape(n, -1, 2, step)
        x = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / math.sqrt(width)


def rotated(units: np.ndarray, table: int, part: int) -> np.ndarray:
    """A pseudo-random rotation: three rounds of signs and transform."""
    signs = np.random.default_rng([20_240_601, table, part, units.shape[1]]).choice([-1.0, 1.0], (3, units.shape[1]))
    for row in signs:
        units = hadamard(units * row)
    return units


def axis_scores(units: np.ndarray, table: int, part: int) -> np.ndarray:
    """How near each signed axis is: (rows, 2 * D)."""
    x = rotated(units, table, part)
    return np.concatenate([x, -x], axis=1)


def bucket_scores(units: np.ndarray, table: int, hashes: int) -> np.ndarray:
    """The score of every bucket: the sum of its axes' scores."""
    scores = axis_scores(units, table, 0)
    for part in range(1, hashes):
        more = axis_scores(units, table, part)
        scores = (scores[:, :, None] + more[:, None, :]).reshape(len(units), -1)
    return scores


def own_buckets(units: np.ndarray, table: int, hashes: int) -> np.ndarray:
    own = np.zeros(len(units), np.int64)
    for part in range(hashes):
        scores = axis_scores(units, table, part)
        own = own * scores.shape[1] + scores.argmax(axis=1)
    return own


def probes_by_cosine(width: int, tables: int, hashes: int, recall: float) -> np.ndarray:
    """How many buckets to probe for neighbours at cosine 0, 1 / GRID, ... 1.

    By simulation on random pairs at each cosine: the rank that the neighbour's bucket has for the query.
    """
    buckets = (2 * width) ** hashes
    rng = np.random.default_rng(7)
    trials = int(min(4000, max(400, (1 << 24) // (buckets + width))))
    x, z = rng.standard_normal((2, trials, hashes, width)) / math.sqrt(width)
    need = 1 - (1 - recall) ** (1 / tables)
    out = []
    for c in np.arange(GRID + 1) / GRID:
        y = c * x + math.sqrt(1 - c * c) * z
        scores, best = np.zeros((trials, 1)), np.zeros(trials)
        for part in range(hashes):
            xs, ys = (np.concatenate([v[:, part], -v[:, part]], axis=1) for v in (x, y))
            best = best + xs[np.arange(trials), ys.argmax(axis=1)]
            scores = (scores[:, :, None] + xs[:, None, :]).reshape(trials, -1)
        rank = np.sort((scores > best[:, None] + 1e-12).sum(axis=1))
        out.append(min(buckets, int(rank[min(trials - 1, math.ceil(need * trials))]) + 1))
    return np.maximum.accumulate(np.asarray(out)[::-1])[::-1]


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors of one length as unit rows, padded with zeros to a power of two."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    width = width or 1 << max(x.shape[1] - 1, 0).bit_length()
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _lengths(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """``batch`` by the lengths of its vectors."""
    sizes = np.diff(batch.column("vector").offsets.to_numpy())
    for size in np.unique(sizes):
        yield int(size), batch.filter(pa.array(sizes == size)) if (sizes != size).any() else batch


def _listed(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


def _smallest(keep: int):
    """The ``keep`` smallest ids of each vector of the rows a task reads."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = [(i, np.frombuffer(v)) for (_, v), ids in held.items() for i in ids]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["vec_id", "vector"])

        for batch in batches:
            for size, part in _lengths(batch):
                x = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size) + 0.0
                for i, row in zip(part.column("vec_id").to_pylist(), x, strict=True):
                    ids = held.setdefault((size, row.tobytes()), [])
                    if i not in ids:
                        ids.append(i)
                        ids.sort()
                        del ids[keep:]
            if len(held) > 50_000:
                yield out()
        yield out()

    return smallest


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, vector) of ``vectors`` (vec_id, embedding), as doubles; rows that take no part are left out."""
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id is not null and size(vector) > 0")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    exponent = F.least(F.lit(1000.0), F.greatest(F.lit(-1000.0), F.floor(F.log2(largest))))
    scale = F.when((largest > 1e100) | (largest < 1e-100), F.pow(F.lit(2.0), -exponent)).otherwise(1.0)
    rows = rows.where(fine & F.exists("vector", lambda x: x != 0)).withColumn("scale", scale)
    return rows.select("vec_id", F.when(F.col("scale") == 1, F.col("vector")).otherwise(F.transform("vector", lambda x: x * F.col("scale"))).alias("vector"))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(gid, vector, ids): every distinct vector with its ``keep`` smallest ids, as a table."""
    few = rows.mapInArrow(_smallest(keep), "vec_id long, vector array<double>").distinct()
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = few.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    groups = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return scratch(groups.select(F.monotonically_increasing_id().alias("gid"), "vector", "ids"), "distinct-vectors")


def _hashed(tables: int, hashes: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _lengths(batch):
                units = _matrix(part.column("vector"))
                for table in range(tables):
                    own = own_buckets(units, table, hashes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), size, np.int32)), pa.array(np.full(len(own), table, np.int32)), pa.array(own), part.column("gid"),
                         part.column("least"), _listed(units[:, :size])],
                        names=["width", "bucket_table", "bucket", "gid", "least", "unit"],
                    )

    return hashed


def _probed(tables: int, hashes: int, recall: float, k: int, sample: Broadcast):
    """Queries with the buckets they look into."""

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needed: dict[int, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, _QUERIES_AT_ONCE):
                for size, part in _lengths(whole.slice(at, _QUERIES_AT_ONCE)):
                    units, gid = _matrix(part.column("vector")), part.column("gid").to_numpy()
                    width = units.shape[1]
                    if width not in needed:
                        needed[width] = probes_by_cosine(width, tables, hashes, recall)
                    ids, known = sample.value.get(size, (np.zeros(0, np.int64), np.zeros((0, size))))
                    near = np.where(gid[:, None] == ids, -1.0, units[:, :size] @ known.T)
                    kth = -np.partition(-near, k - 1, axis=1)[:, k - 1] if len(ids) >= k else np.full(len(gid), -1.0)
                    count = needed[width][np.floor(np.clip(kth, 0, 1) * GRID).astype(int)]
                    for table in range(tables):
                        scores = bucket_scores(units, table, hashes)
                        most = min(int(count.max(initial=1)), scores.shape[1])
                        best = np.argpartition(-scores, most - 1, axis=1)[:, :most]
                        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(scores, best, axis=1), axis=1), axis=1)
                        row, rank = np.nonzero(np.arange(most) < count[:, None])
                        for a in range(0, len(row), 20_000):
                            r, b = row[a : a + 20_000], best[row[a : a + 20_000], rank[a : a + 20_000]]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(r), size, np.int32)), pa.array(np.full(len(r), table, np.int32)), pa.array(b), pa.array(gid[r]),
                                 _listed(units[r][:, :size])],
                                names=["width", "bucket_table", "bucket", "gid", "unit"],
                            )

    return probed


HASHED = "width int, bucket_table int, bucket long, gid long, least long, unit array<double>"
PROBED = "width int, bucket_table int, bucket long, gid long, unit array<double>"


def _searched(keep: int):
    """Sorted rows of slices, vectors before queries -> each query's ``keep`` best of a slice."""

    def best(ids: np.ndarray, least: np.ndarray, units: np.ndarray, asked: np.ndarray, queries: np.ndarray) -> pa.RecordBatch:
        score = np.round(queries @ units.T, 12)
        if score.shape[1] > keep:
            worst = -np.partition(-score, keep - 1, axis=1)[:, keep - 1]
            q, v = np.nonzero(score >= worst[:, None])
        else:
            q, v = (x.ravel() for x in np.indices(score.shape))
        order = np.lexsort((least[v], -score[q, v], q))
        q, v = q[order], v[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        q, v = q[place < keep], v[place < keep]
        return pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(ids[v]), pa.array(least[v]), pa.array(score[q, v])], names=["asked", "gid", "least", "score"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("width", "bucket_table", "bucket", "slice", "side")])
            ends = [*(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            start = 0
            for end in ends:
                *group, side = keys[:, start].tolist()
                part = batch.slice(start, end - start)
                start = end
                if group != current:
                    current, held = group, []
                ids, units = part.column("gid").to_numpy(), part.column("unit").flatten().to_numpy().reshape(len(part), -1)
                if side == 0:
                    held.append((ids, part.column("least").to_numpy(zero_copy_only=False), units))
                    continue
                if len(held) > 1:
                    held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                for at in range(0, len(ids), _QUERIES_AT_ONCE):
                    if held:
                        yield best(*held[0], ids[at : at + _QUERIES_AT_ONCE], units[at : at + _QUERIES_AT_ONCE])

    return searched


def cosine(a: Column, b: Column) -> Column:
    """In double precision, component after component."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_vectors(
    vectors: DataFrame, queries: Column, k: int = 5, tables: int = TABLES, hashes: int = 1, recall: float = RECALL, sample: int = SAMPLE
) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows of ``vectors`` (vec_id, embedding) that ``queries`` marks, their ``k`` nearest others.

    ``queries`` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    groups = distinct_vectors(rows, k + 1)
    asked = rows.where(queries).distinct().join(groups.select("vector", "gid"), "vector").select(F.col("vec_id").alias("query_id"), "gid")
    asked = scratch(asked, "queries")
    first = groups.select("gid", "vector").orderBy(F.xxhash64("vector"), "gid").limit(sample).collect()  # at most ``sample`` rows
    by_size: dict[int, list] = {}
    for gid, vector in first:
        by_size.setdefault(len(vector), []).append((gid, vector))
    known = {}
    for size, found in by_size.items():
        x = np.asarray([v for _, v in found])
        known[size] = (np.asarray([g for g, _ in found]), x / np.sqrt((x * x).sum(axis=1, keepdims=True)))
    held = spark.sparkContext.broadcast(known)

    data = groups.select("gid", F.get("ids", F.lit(0)).alias("least"), "vector").mapInArrow(_hashed(tables, hashes), HASHED)
    place = ["width", "bucket_table", "bucket"]
    slices = data.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    slices = scratch(slices, "bucket-slices")  # at most tables * (2 * D) ** hashes rows for each length D
    sought = groups.join(asked.select("gid").distinct(), "gid", "left_semi").select("gid", "vector")
    probes = sought.mapInArrow(_probed(tables, hashes, recall, k, held), PROBED)
    left = data.join(slices, place).select(*place, F.pmod(F.hash("gid"), F.col("slices")).alias("slice"), F.lit(0).alias("side"), "gid", "least", "unit")
    right = probes.join(slices, place).select(
        *place, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(1).alias("side"), "gid", F.lit(None).cast("long").alias("least"), "unit"
    )
    group = [*place, "slice"]
    found = left.unionByName(right).repartition(*group).sortWithinPartitions(*group, "side")
    found = found.mapInArrow(_searched(k + SPARE), "asked long, gid long, least long, score double")
    found = found.groupBy("asked", "gid").agg(F.max("score").alias("score"), F.min("least").alias("least"))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "least")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + SPARE)

    mine = groups.select(F.col("gid").alias("asked"), F.col("vector").alias("own"))
    exact = found.select("asked", "gid").join(groups, "gid").join(mine, "asked")
    exact = exact.select("asked", F.explode("ids").alias("vec_id"), cosine(F.col("own"), F.col("vector")).alias("score"))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    exact = exact.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    lists = exact.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))  # k + 1 each
    lists = scratch(lists, "neighbour-lists")
    out = asked.join(lists.withColumnRenamed("asked", "gid"), "gid")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("at", "x"))
    forget(slices)
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for each vector whose id is divisible by 50."""
    return nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
