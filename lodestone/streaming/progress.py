"""Progress of long work as rows: what streams report of their batches, and stages of batch jobs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

PROGRESS = "job string, stage string, done long, total long, state string, at double"
#: Jobs whose progress is kept (fixed value).
HISTORY = 50


class Progress:
    """A folder of progress rows, one small file a report; a reader sees every report that was finished."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def report(self, job: str, stage: str, done: int, total: int | None, state: str = "running") -> None:
        row = [(job, stage, done, total, state, time.time())]
        self.spark.createDataFrame(row, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def reports(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS).parquet(self.path)

    def newest(self, history: int = HISTORY) -> DataFrame:
        """The last report of each of the ``history`` jobs heard of last."""
        last = F.max(F.struct("at", "stage", "done", "total", "state")).alias("last")
        return self.reports().groupBy("job").agg(last).orderBy(F.desc("last.at"), "job").limit(history).select("job", "last.*")

    @contextmanager
    def stage(self, job: str, stage: str, done: int, total: int) -> Iterator[None]:
        """A stage of a batch job: its Spark jobs carry the name, and its start, end or failure are reported."""
        context = self.spark.sparkContext
        context.setJobGroup(job, stage)
        self.report(job, stage, done, total)
        try:
            yield
        except BaseException:
            self.report(job, stage, done, total, "failed")
            raise
        else:
            self.report(job, stage, done + 1, total, "finished" if done + 1 == total else "running")
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
            context.setLocalProperty("spark.job.description", None)


class StreamProgress(StreamingQueryListener):
    """Reports of streams: rows read so far of every query, by name where it has one."""

    def __init__(self, progress: Progress):
        self.progress, self.rows, self.names = progress, {}, {}

    def _report(self, run: uuid.UUID, stage: str, state: str) -> None:
        self.progress.report(self.names.get(str(run), str(run)), stage, self.rows.get(str(run), 0), None, state)

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name or str(event.id)
        self._report(event.runId, "started", "running")

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self.rows[run] = self.rows.get(run, 0) + event.progress.numInputRows
        self._report(event.progress.runId, f"batch {event.progress.batchId}", "running")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._report(event.runId, "ended", "failed" if event.exception else "finished")
