"""Calendar and deadline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import deadlines as dl
from lodestone.registry import query
from lodestone.session import table

FIRST, LAST = "1990-01-01", "2030-12-31"

SQL_CALENDAR = """
y AS (SELECT unnest(range(1990, 2031)) AS y),
e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
e2 AS (SELECT *, b // 4 AS d, b % 4 AS e, (b - (b + 8) // 25 + 1) // 3 AS g, c // 4 AS i, c % 4 AS k FROM e1),
e3 AS (SELECT *, (19 * a + b - d - g + 15) % 30 AS h FROM e2),
e4 AS (SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS l FROM e3),
e5 AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM e4),
easter AS (SELECT y, make_date(y, n // 31, n % 31 + 1) AS sunday FROM e5),
days AS (SELECT CAST(unnest(generate_series(DATE '1990-01-01', DATE '2031-02-28', INTERVAL 1 DAY)) AS DATE) AS day),
cal AS (SELECT day, isodow(day) >= 6 OR (month(day), day(day)) IN ((1,1),(1,6),(5,1),(5,3),(8,15),(11,1),(11,11),(12,25),(12,26))
          OR coalesce(date_diff('day', sunday, day) IN (0, 1, 49, 60), false) AS free FROM days LEFT JOIN easter ON year(day) = y),
nxt AS (SELECT day, free, min(CASE WHEN NOT free THEN day END) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS next_working FROM cal)
"""


@query(
    "easter_dates",
    f"""WITH {SQL_CALENDAR} SELECT CAST(y AS BIGINT) AS y, sunday, CAST(count(*) FILTER (WHERE date_diff('day', sunday, CAST(o_orderdate AS DATE)) IN (0, 1)) AS BIGINT) AS orders
    FROM orders JOIN easter ON year(o_orderdate) = y GROUP BY ALL""",
)
def easter_dates(spark, sf_dir):
    """Easter Sunday of every year with orders, and the orders of that day and of the Monday."""
    daily = _daily(spark, sf_dir).withColumn("y", F.year("day").cast("long")).withColumn("sunday", dl.easter(F.col("y")))
    there = F.datediff("day", "sunday").isin(0, 1)
    return daily.groupBy("y", "sunday").agg(F.sum(F.when(there, F.col("orders")).otherwise(0)).alias("orders"))


@query(
    "holiday_calendar",
    f"WITH {SQL_CALENDAR} SELECT day, free, next_working, CAST(count(*) AS BIGINT) AS orders FROM orders JOIN nxt ON day = CAST(o_orderdate AS DATE) GROUP BY ALL",
)
def holiday_calendar(spark, sf_dir):
    """Every day with orders: whether it is free, the next working day at or after it, and how many orders it has."""
    return _daily(spark, sf_dir).join(F.broadcast(dl.calendar(spark, FIRST, LAST)), "day").select("day", "free", "next_working", "orders")


def _daily(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("orders"))


@query("next_business_day", f"WITH {SQL_CALENDAR} SELECT o_orderkey, next_working FROM orders JOIN nxt ON day = CAST(o_orderdate AS DATE)")
def next_business_day(spark, sf_dir):
    days = dl.calendar(spark, FIRST, LAST)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return orders.join(F.broadcast(days), "day").select("o_orderkey", "next_working")


SQL_EVENTS = f"""r(rule_id, event, days) AS (VALUES {", ".join(f"('{r}', '{e}', {d})" for r, e, d, _ in dl.RULES)}),
    ev AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS event_date, CASE o_orderstatus WHEN 'F' THEN 'ogloszenie_wyroku'
      WHEN 'O' THEN 'doreczenie_postanowienia' ELSE 'doreczenie_nakazu_zaplaty' END AS event FROM orders)"""


def _events(spark, sf_dir):
    event = F.when(F.col("o_orderstatus") == "F", "ogloszenie_wyroku").when(F.col("o_orderstatus") == "O", "doreczenie_postanowienia")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("event_date"), event.otherwise("doreczenie_nakazu_zaplaty").alias("event")
    )


@query(
    "deadlines",
    f"""WITH {SQL_CALENDAR}, {SQL_EVENTS}
    SELECT o_orderkey, rule_id, CAST(event_date + CAST(days AS INT) AS DATE) AS raw_due, next_working AS due, 'unapproved_rule' AS status
    FROM ev JOIN r USING (event) JOIN nxt ON day = event_date + CAST(days AS INT)""",
)
def deadlines(spark, sf_dir):
    """Deadlines of every order's event under the default rules."""
    found = dl.deadlines(_events(spark, sf_dir), dl.default_rules(spark), dl.calendar(spark, FIRST, LAST))
    return found.select("o_orderkey", "rule_id", "raw_due", "due", "status")


@query(
    "rule_catalogue",
    f"""WITH {SQL_EVENTS}, n AS (SELECT event, count(*) AS n FROM ev GROUP BY event)
    SELECT rule_id, CAST(row_number() OVER (ORDER BY rule_id) AS INT) AS place, CAST(coalesce(n, 0) AS BIGINT) AS events FROM r LEFT JOIN n USING (event)""",
)
def rule_catalogue(spark, sf_dir):
    """Rules in catalogue order (approved ones first, then by id), each with the number of events that it applies to."""
    from pyspark.sql import Window

    order = Window.orderBy(F.col("approved_by").isNull(), "rule_id")  # seven rules
    events = _events(spark, sf_dir).groupBy("event").agg(F.count(F.lit(1)).alias("n"))
    rules = dl.default_rules(spark).select("rule_id", "event", F.row_number().over(order).alias("place"))
    return rules.join(events, "event", "left").select("rule_id", "place", F.coalesce("n", F.lit(0)).alias("events"))


@query(
    "confirmed_deadlines",
    f"""WITH {SQL_CALENDAR}, {SQL_EVENTS}
    SELECT o_orderkey, rule_id, next_working AS due, 'confirmed' AS status, CASE WHEN next_working <> raw THEN 3 ELSE 2 END AS warnings
    FROM (SELECT *, CAST(event_date + CAST(days AS INT) AS DATE) AS raw FROM ev JOIN r USING (event)) JOIN nxt ON day = raw WHERE days = 14""",
)
def confirmed_deadlines(spark, sf_dir):
    """The deadlines of the fortnight rules once these are approved, confirmed by a person; warnings are counted."""
    approved = F.when(F.col("days") == 14, "head of office")
    rules = dl.default_rules(spark).withColumn("approved_by", approved)
    found = dl.deadlines(_events(spark, sf_dir), rules, dl.calendar(spark, FIRST, LAST)).where("status = 'proposal'")
    return dl.confirm(found, "clerk").select("o_orderkey", "rule_id", "due", "status", F.size("warnings").alias("warnings"))


@query("time_estimates", "SELECT o_custkey, CAST(CASE WHEN count(*) = 1 THEN 5 WHEN count(*) <= 4 THEN 13 ELSE count(*) * 15 END AS BIGINT) AS seconds FROM orders GROUP BY o_custkey")
def time_estimates(spark, sf_dir):
    """Expected answer time by number of documents."""
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.when(n == 1, 5).when(n <= 4, 13).otherwise(n * 15).cast("long").alias("seconds"))
