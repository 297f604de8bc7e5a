"""Log-in sessions that end a fixed time after they were opened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ledger import in_order

VALID = 12 * 3600


def _opened(valid: int):
    def fold():
        opened = None

        def step(_, row: list) -> tuple:
            nonlocal opened
            (ts,) = row
            if opened is None or ts > opened + valid:
                opened = ts
            return ts, opened

        return step

    return fold


def sessions(requests: DataFrame, valid: int = VALID) -> DataFrame:
    """(login, opened, expires, requests) from ``requests`` (login, ts in seconds).

    The first request opens a session; it lasts ``valid`` seconds whatever comes, and the first request after its end
    opens the next. A fold over a login's requests in order.
    """
    kind = requests.schema["login"].dataType.simpleString()
    each = in_order(requests.select("login", "ts"), "login", ["ts"], _opened(valid), f"login {kind}, ts long, opened long")
    return each.groupBy("login", "opened").agg(F.count(F.lit(1)).alias("requests")).select("login", "opened", (F.col("opened") + valid).alias("expires"), "requests")
