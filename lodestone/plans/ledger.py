"""Audit chain, journal, throttling and retention queries over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import ledger
from lodestone.registry import query
from lodestone.session import table

SQL_MATERIAL = "strftime(ts, '%Y-%m-%dT%H:%M:%S'), CASE WHEN event_id % 10 = 0 THEN 'None' ELSE CAST(user_id AS VARCHAR) END, event_type, props"
SQL_CHAIN = f"""WITH RECURSIVE o AS (SELECT event_id % 8 AS chain, event_id AS id, row_number() OVER (PARTITION BY event_id % 8 ORDER BY event_id) AS n,
    concat_ws('|', {SQL_MATERIAL}) AS material FROM events),
  c AS (SELECT chain, id, n, sha256('|' || material) AS hash FROM o WHERE n = 1
    UNION ALL SELECT o.chain, o.id, o.n, sha256(c.hash || '|' || o.material) FROM c JOIN o ON o.chain = c.chain AND o.n = c.n + 1)"""


def _entries(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.pmod("event_id", F.lit(8)).alias("chain"),
        F.col("event_id").alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        F.when(F.col("event_id") % 10 != 0, F.col("user_id")).alias("case_id"),
        F.col("event_type").alias("op"),
        F.col("props").alias("detail"),
    )


@query("audit_chain_build", SQL_CHAIN + " SELECT chain, id, hash FROM c")
def audit_chain_build(spark, sf_dir):
    """Hash chains over all events; a chain is sequential, chains are not."""
    return ledger.build_chain(_entries(spark, sf_dir))


@query(
    "audit_chain_verify",
    SQL_CHAIN
    + """, s AS (SELECT o.chain, o.id, c.hash, lag(c.hash, 1, '') OVER (PARTITION BY o.chain ORDER BY o.id) AS before,
      o.material || CASE WHEN o.id IN (104, 107) THEN 'x' ELSE '' END AS material FROM o JOIN c USING (chain, id))
    SELECT chain, CAST(min(CASE WHEN sha256(before || '|' || material) <> hash THEN id END) AS BIGINT) AS first_broken FROM s GROUP BY chain""",
)
def audit_chain_verify(spark, sf_dir):
    """The first broken entry of every chain, after one entry in two of the chains was changed."""
    entries = _entries(spark, sf_dir)
    stored = entries.join(ledger.build_chain(entries), ["chain", "id"])
    tampered = stored.withColumn("detail", F.when(F.col("id").isin(104, 107), F.concat("detail", F.lit("x"))).otherwise(F.col("detail")))
    return ledger.verify_chain(tampered)


@query(
    "journal_summary",
    """SELECT CAST(count(*) AS BIGINT) AS queries, round(coalesce(avg(value), 0), 4) AS mean_value,
      CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 0) AS BIGINT) AS errors,
      round(CASE WHEN count(*) > 0 THEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::DOUBLE / count(*) ELSE 0 END, 6) AS error_share
    FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""",
)
def journal_summary(spark, sf_dir):
    """Counters of the last seven days, with shares that are 0 for an empty window."""
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("newest"))
    recent = events.join(F.broadcast(newest), F.col("ts") >= F.col("newest") - F.expr("interval 7 days"))
    errors = F.coalesce(F.sum((F.col("event_type") == "error").cast("long")), F.lit(0))
    n = F.count(F.lit(1))
    return recent.agg(
        n.alias("queries"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 4).alias("mean_value"), errors.alias("errors"),
        F.round(ledger.share(errors, n), 6).alias("error_share"),
    )


@query(
    "answer_counters",
    """SELECT user_id, CAST(count(*) AS BIGINT) AS claims, CAST(sum(CASE WHEN value >= 60 THEN 1 ELSE 0 END) AS BIGINT) AS strong,
      CAST(sum(CASE WHEN value >= 15 AND value < 60 THEN 1 ELSE 0 END) AS BIGINT) AS weak,
      CAST(sum(CASE WHEN value < 15 THEN 1 ELSE 0 END) AS BIGINT) AS none FROM events GROUP BY user_id""",
)
def answer_counters(spark, sf_dir):
    """Strong, weak and unsupported items of every user."""
    v, one = F.col("value"), lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("claims"), one(v >= 60).alias("strong"), one((v >= 15) & (v < 60)).alias("weak"), one(v < 15).alias("none")
    )


@query(
    "rolling_window",
    """SELECT CAST(day AS DATE) AS day, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS last_week
    FROM (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL)""",
)
def rolling_window(spark, sf_dir):
    """Events of each day and of the week that ends with it."""
    from pyspark.sql import Window

    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    week = Window.orderBy(F.unix_date("day")).rangeBetween(-6, 0)  # one row per calendar day
    return daily.select("day", "n", F.sum("n").over(week).alias("last_week"))


@query("retention_keep_n", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 14")
def retention_keep_n(spark, sf_dir):
    """The newest fourteen entries of every user."""
    return ledger.keep_newest(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 14)


@query("retention_window", "SELECT CAST(count(*) AS BIGINT) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY")
def retention_window(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("ts")
    newest = events.agg(F.max("ts").alias("newest"))
    return events.join(F.broadcast(newest), F.expr("ts >= newest - interval 14 days")).agg(F.count(F.lit(1)).alias("kept"))


@query(
    "lockouts",
    """WITH RECURSIVE o AS (SELECT user_id AS login, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type = 'purchase' AS ok,
      row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_type = 'purchase') AS n FROM events),
    f AS (SELECT login, n, ts, CASE WHEN ok THEN 'success' ELSE 'failure' END AS outcome, CASE WHEN ok THEN 0 ELSE 1 END AS failed,
        CASE WHEN ok THEN NULL ELSE ts END AS last, CAST(0 AS BIGINT) AS until FROM o WHERE n = 1
      UNION ALL
      SELECT login, n, ts, outcome, failed, CASE outcome WHEN 'refused' THEN last WHEN 'success' THEN NULL ELSE ts END,
        CASE outcome WHEN 'refused' THEN until WHEN 'success' THEN 0
          ELSE CASE WHEN failed >= 5 THEN ts + CAST(least(900, 60 * pow(2, least(failed - 5, 20))) AS BIGINT) ELSE 0 END END
      FROM (SELECT o.login, o.n, o.ts, f.last, f.until,
          CASE WHEN o.ts < f.until THEN 'refused' WHEN o.ok THEN 'success' ELSE 'failure' END AS outcome,
          CASE WHEN o.ts < f.until THEN f.failed WHEN o.ok THEN 0 WHEN f.last IS NOT NULL AND o.ts - f.last <= 1800 THEN f.failed + 1 ELSE 1 END AS failed
        FROM f JOIN o ON o.login = f.login AND o.n = f.n + 1))
    SELECT login, ts, outcome, CAST(failed AS INT) AS failed FROM f""",
)
def lockouts(spark, sf_dir):
    """Login throttling over errors as failed attempts: what an attempt does depends on all before it."""
    attempts = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("login"), F.unix_timestamp("ts").alias("ts"), (F.col("event_type") == "purchase").alias("ok")
    )
    return ledger.lockouts(attempts)


@query(
    "failure_sessions",
    """WITH f AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 1800 THEN 0 ELSE 1 END AS new_one
      FROM events WHERE event_type = 'error'),
    s AS (SELECT user_id, ts, sum(new_one) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM f)
    SELECT user_id, CAST(session AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS failures FROM s GROUP BY ALL""",
)
def failure_sessions(spark, sf_dir):
    """Failures grouped by gaps of at most half an hour."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    failed = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    gap = seconds - F.lag(seconds).over(order)
    marked = failed.withColumn("new_one", F.when(gap <= 1800, 0).otherwise(1))
    sessions = marked.withColumn("session", F.sum("new_one").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return sessions.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("failures"))


@query(
    "lock_lengths",
    """SELECT CAST(n AS BIGINT) AS n, CAST(CASE WHEN n < 5 THEN 0 ELSE least(900, 60 * pow(2, least(n - 5, 20))) END AS BIGINT) AS seconds, CAST(count(*) AS BIGINT) AS logins
    FROM (SELECT user_id, count(*) FILTER (WHERE event_type <> 'purchase') AS n FROM events GROUP BY user_id) GROUP BY n""",
)
def lock_lengths(spark, sf_dir):
    """Logins by their failures, with the lock that so many in a row bring."""
    failed = F.count(F.when(F.col("event_type") != "purchase", 1)).alias("n")
    logins = table(spark, sf_dir, "events").groupBy("user_id").agg(failed)
    return logins.groupBy("n").agg(F.count(F.lit(1)).alias("logins")).withColumn("seconds", ledger.lock_seconds(F.col("n")))


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, CAST(count(*) AS BIGINT) AS n FROM {t}" for t in ("orders", "events", "documents", "pages")))
def table_counts(spark, sf_dir):
    whole = None
    for name in ("orders", "events", "documents", "pages"):
        one = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        whole = one if whole is None else whole.unionByName(one)
    return whole
