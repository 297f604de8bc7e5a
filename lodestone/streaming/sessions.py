"""Expiry of log-in sessions on event time, with a timer for each open session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.sessions import VALID

SESSIONS = "login long, opened long, expires long, requests long"


class Expiry(StatefulProcessor):
    """One open session a login: when it was opened and how many requests it saw. Its timer, or a later request, ends it."""

    def __init__(self, valid: int):
        self.valid = valid

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "opened long, requests long")

    def _ended(self, key: tuple, opened: int, requests: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], opened, opened + self.valid, requests)], columns=["login", "opened", "expires", "requests"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        opened, requests = self.open.get() if self.open.exists() else (None, 0)
        for ts in sorted(t for part in rows for t in part["ts"].tolist()):
            if opened is not None and ts > opened + self.valid:
                self.handle.deleteTimer(1000 * (opened + self.valid))
                yield self._ended(key, opened, requests)
                opened, requests = None, 0
            if opened is None:
                opened = ts
                self.handle.registerTimer(1000 * (opened + self.valid))
            requests += 1
        self.open.update((opened, requests))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        opened, requests = self.open.get()
        self.open.clear()
        yield self._ended(key, opened, requests)

    def close(self) -> None:
        pass


def expired_sessions(requests: DataFrame, valid: int = VALID, late: str = "1 hour") -> DataFrame:
    """Sessions as they end; the batch twin is ``operators.sessions.sessions``.

    ``requests``: a stream of (login, at timestamp). A session ends at the first request after its time or when the watermark
    passes it, and leaves no state. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    timed = requests.select("login", "at", F.unix_timestamp("at").alias("ts")).withWatermark("at", late)
    return timed.groupBy("login").transformWithStateInPandas(Expiry(valid), SESSIONS, "Append", "EventTime")
