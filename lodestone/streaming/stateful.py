"""Structured Streaming twins: document arrival, journal windows, failure sessions, login throttling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.functions import text as txt
from lodestone.operators.ledger import IDLE, LOCK_AFTER, LOCK_BASE, LOCK_MOST


def read_table_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """A directory of Parquet files as a stream with a known schema."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sentence_stream(documents: DataFrame) -> DataFrame:
    """Arriving documents segmented into sentences; stateless, so the output appends."""
    found = documents.select("doc_id", F.explode(txt.sentences(F.col("text"), F.lit("en"))).alias("s"))
    return found.select("doc_id", "s.sent_no", "s.start", "s.end", "s.text")


def journal_windows(events: DataFrame, length: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counters of sliding windows; events later than ``late`` behind the watermark are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", length, step))
        .agg(
            F.count(F.lit(1)).alias("queries"),
            F.sum((F.col("event_type") == "error").cast("long")).alias("errors"),
            F.avg("value").alias("mean_value"),
        )
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "queries", "errors", "mean_value")
    )


def failure_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Failures of a user joined while less than ``gap`` lies between them."""
    failed = events.where("event_type = 'error'").withWatermark("ts", late)
    return (
        failed.groupBy("user_id", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("failures"))
        .select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "failures")
    )


THROTTLED = "login long, ts long, outcome string, failed int"
THROTTLE_STATE = "failed int, last long, until long"


def throttle(attempts: DataFrame) -> DataFrame:
    """Login throttling as in the batch fold, with the counter and the lock kept as state per login.

    ``attempts``: (login, ts seconds, ok). Attempts of one login within a micro-batch are taken in time
    order; the lock runs on event time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed, last, until = state.get if state.exists else (0, -1, 0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for ts, ok in zip(rows["ts"].tolist(), rows["ok"].tolist(), strict=True):
            if ts < until:
                out.append((key[0], ts, "refused", failed))
                continue
            if ok:
                failed, last, until = 0, -1, 0
                out.append((key[0], ts, "success", 0))
                continue
            failed = failed + 1 if 0 <= last and ts - last <= IDLE else 1
            last = ts
            until = ts + min(LOCK_MOST, LOCK_BASE * 2 ** min(failed - LOCK_AFTER, 20)) if failed >= LOCK_AFTER else 0
            out.append((key[0], ts, "failure", failed))
        state.update((failed, last, until))
        yield pd.DataFrame(out, columns=["login", "ts", "outcome", "failed"])

    return attempts.groupBy("login").applyInPandasWithState(step, THROTTLED, THROTTLE_STATE, "append", GroupStateTimeout.NoTimeout)


def append_chain(spark: SparkSession, path: str):
    """A ``foreachBatch`` writer that continues one hash chain: the only writer of its tables.

    Entries lie in ``path/entries`` in a folder for each batch, and the last hash of each batch is one row of ``path/heads``, so
    a batch reads heads and never the chain. A batch's entries are folded in order from the head of the batches before it; one
    that is delivered again, also after it broke off half-way, writes the same rows in the same folder. Empty batches leave none.
    """
    from lodestone.operators.ledger import GENESIS, build_chain

    def head(batch_id: int) -> str:
        try:
            heads = spark.read.schema("batch_id long, hash string").parquet(f"{path}/heads")
        except AnalysisException as e:  # before the first batch
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return GENESIS
        return heads.where(F.col("batch_id") < batch_id).agg(F.max_by("hash", "batch_id")).first()[0] or GENESIS

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        entries = f"{path}/entries/batch_id={batch_id}"
        hashes = build_chain(batch.withColumn("chain", F.lit(0)), start=head(batch_id)).drop("chain")
        batch.join(hashes, "id").write.mode("overwrite").parquet(entries)
        spark.read.parquet(entries).agg(F.max_by("hash", "id").alias("hash")).write.mode("overwrite").parquet(f"{path}/heads/batch_id={batch_id}")

    return write
