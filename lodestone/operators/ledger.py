"""Hash-chained audit logs, quality journals, login throttling, retention and snapshots."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

GENESIS = ""
LOCK_AFTER, LOCK_BASE, LOCK_MOST, IDLE = 5, 60, 900, 1800


def link_hash(prev: Column, ts: Column, case_id: Column, op: Column, detail: Column) -> Column:
    """Hash of an entry and its predecessor's; a missing case prints as None."""
    case = F.coalesce(case_id.cast("string"), F.lit("None"))
    return F.sha2(F.concat_ws("|", prev, ts, case, op, detail), 256)


def in_order(rows: DataFrame, key: str, order: list[str], fold: Callable[[], Callable[[Any, list], tuple]], schema: str) -> DataFrame:
    """A fold over the ordered rows of every ``key``: one output row for each input row.

    ``fold()`` gives a function of (key, values of a row) that holds the state of one key; it gets the rows of a key
    in ``order`` one after the other. Keys run in parallel; a key is streamed, so its length costs no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, last = None, None
        for batch in batches:
            found = []
            for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if step is None or own != last:
                    step, last = fold(), own
                found.append((own, *step(own, row)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), types, strict=True)] if found else [pa.array([], f.type) for f in types], schema=types)

    out = rows.sparkSession.createDataFrame([], schema).schema
    types = to_arrow_schema(out)
    columns = [key, *[c for c in rows.columns if c != key]]
    return rows.select(*columns).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, out)


def _chained(start: str) -> Callable[[], Callable[[Any, list], tuple]]:
    def fold() -> Callable[[Any, list], tuple]:
        prev = start

        def step(_, row: list) -> tuple:
            nonlocal prev
            entry, ts, case_id, op, detail = row
            parts = (prev, ts, "None" if case_id is None else str(case_id), op, detail)
            prev = hashlib.sha256("|".join(x for x in parts if x is not None).encode()).hexdigest()
            return entry, prev

        return step

    return fold


def build_chain(entries: DataFrame, chain: str = "chain", start: str = GENESIS) -> DataFrame:
    """(chain, id, hash) for entries (chain, id, ts, case_id, op, detail); ``start`` is the hash before the first.

    Each hash needs the one before, so a chain is a fold over its ordered entries; chains run in parallel.
    """
    kind = entries.schema[chain].dataType.simpleString()
    rows = entries.select(chain, F.col("id").cast("long").alias("id"), "ts", "case_id", "op", "detail")
    return in_order(rows, chain, ["id"], _chained(start), f"{chain} {kind}, id long, hash string")


def verify_chain(entries: DataFrame, chain: str = "chain") -> DataFrame:
    """(chain, first_broken): the first entry whose stored hash does not follow from the one before, or null.

    Every entry is checked against its predecessor's stored hash, so the check is parallel within a chain.
    """
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(chain).orderBy("id")), F.lit(GENESIS))
    good = link_hash(before, F.col("ts"), F.col("case_id"), F.col("op"), F.col("detail")).eqNullSafe(F.col("hash"))
    return entries.withColumn("good", good).groupBy(chain).agg(F.min(F.when(~F.col("good"), F.col("id"))).alias("first_broken"))


def share(part: Column, whole: Column) -> Column:
    """A share that is 0 for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)


def lockouts(attempts: DataFrame) -> DataFrame:
    """Login throttling: (login, ts, outcome, failed) for attempts (login, ts seconds, ok).

    Failures count while the gap to the last one is at most half an hour; from the fifth on the login is
    locked for 60 s, doubling up to 900 s; attempts during a lock are refused and not counted; a success
    clears the counter. What an attempt does depends on all before it, hence a fold per login.
    """
    kind = attempts.schema["login"].dataType.simpleString()
    rows = attempts.select("login", F.col("ts").cast("long").alias("ts"), "ok")
    return in_order(rows, "login", ["ts", "ok"], _throttled, f"login {kind}, ts long, outcome string, failed int")


def _throttled() -> Callable[[Any, list], tuple]:
    failed, last, until = 0, None, 0

    def step(_, row: list) -> tuple:
        nonlocal failed, last, until
        ts, ok = row
        if ts < until:
            return ts, "refused", failed
        if ok:
            failed, last, until = 0, None, 0
            return ts, "success", failed
        failed = failed + 1 if last is not None and ts - last <= IDLE else 1
        last = ts
        until = ts + min(LOCK_MOST, LOCK_BASE * 2 ** min(failed - LOCK_AFTER, 20)) if failed >= LOCK_AFTER else 0
        return ts, "failure", failed

    return step


def lock_seconds(failed: Column) -> Column:
    """How long a login is locked after so many failures in a row."""
    longer = F.pow(F.lit(2.0), F.least(failed - LOCK_AFTER, F.lit(20)))
    return F.when(failed >= LOCK_AFTER, F.least(F.lit(LOCK_MOST), LOCK_BASE * longer)).otherwise(0).cast("long")


def keep_newest(rows: DataFrame, by: str | None, order: str, n: int) -> DataFrame:
    """Retention: the newest ``n`` rows of every group, or of the table where ``by`` is None (each task then keeps ``n``)."""
    if by is None:
        return rows.orderBy(F.desc(order)).limit(n)
    window = Window.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("age", F.row_number().over(window)).where(F.col("age") <= n).drop("age")


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def compare_snapshot(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> DataFrame:
    """(table, expected, found, same): row counts of live tables against a snapshot's."""
    def counts(label: str, each) -> DataFrame:
        whole = None
        for name in sorted(tables):
            one = each(name).agg(F.count(F.lit(1)).alias(label)).select(F.lit(name).alias("table"), label)
            whole = one if whole is None else whole.unionByName(one)
        return whole

    live, saved = counts("expected", tables.__getitem__), counts("found", lambda n: spark.read.parquet(f"{path}/{n}"))
    return live.join(saved, "table", "full_outer").withColumn("same", F.col("expected").eqNullSafe(F.col("found")))
