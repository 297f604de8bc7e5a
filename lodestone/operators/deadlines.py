"""Business-day deadlines: rules, a holiday calendar and triggering events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed public holidays as (month, day), and movable ones as days from Easter Sunday (fixed values).
FIXED_HOLIDAYS = ((1, 1), (1, 6), (5, 1), (5, 3), (8, 15), (11, 1), (11, 11), (12, 25), (12, 26))
FROM_EASTER = (0, 1, 49, 60)

#: rule_id, event, days (fixed values); all count from the next day and roll to the next working day.
RULES = (
    ("wniosek_o_uzasadnienie_karne", "ogloszenie_wyroku", 7, "art. 422 § 1 k.p.k."),
    ("apelacja_karna", "doreczenie_wyroku_z_uzasadnieniem", 14, "art. 445 § 1 k.p.k."),
    ("zazalenie_karne", "doreczenie_postanowienia", 7, "art. 460 k.p.k."),
    ("wniosek_o_uzasadnienie_cywilne", "ogloszenie_wyroku", 7, "art. 328 § 1 k.p.c."),
    ("apelacja_cywilna", "doreczenie_wyroku_z_uzasadnieniem", 14, "art. 369 § 1 k.p.c."),
    ("sprzeciw_od_nakazu_zaplaty", "doreczenie_nakazu_zaplaty", 14, "art. 502 § 1 k.p.c."),
    ("zazalenie_cywilne", "doreczenie_postanowienia", 7, "art. 394 § 2 k.p.c."),
)
RULE_SCHEMA = "rule_id string, event string, days int, basis string, from_next_day boolean, roll boolean, approved_by string"
LONGEST_GAP = 30


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, True, True, None) for r in RULES], RULE_SCHEMA)


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday by whole-number arithmetic."""
    div = lambda a, b: F.floor(a / b)
    century, in_century = div(year, 100), F.pmod(year, F.lit(100))
    golden = F.pmod(year, F.lit(19))
    moon_shift = div(century - div(century + 8, 25) + 1, 3)
    epact = F.pmod(19 * golden + century - div(century, 4) - moon_shift + 15, F.lit(30))
    weekday = F.pmod(32 + 2 * F.pmod(century, F.lit(4)) + 2 * div(in_century, 4) - epact - F.pmod(in_century, F.lit(4)), F.lit(7))
    late = div(golden + 11 * epact + 22 * weekday, 451)
    days = epact + weekday - 7 * late + 114
    return F.make_date(year.cast("int"), div(days, 31).cast("int"), (F.pmod(days, F.lit(31)) + 1).cast("int"))


def is_holiday(day: Column, extra: list | None = None) -> Column:
    fixed = F.lit(False)
    for month, d in FIXED_HOLIDAYS:
        fixed = fixed | ((F.month(day) == month) & (F.dayofmonth(day) == d))
    moved = F.datediff(day, easter(F.year(day))).isin(*FROM_EASTER)
    named = day.isin(*extra) if extra else F.lit(False)
    return (F.weekday(day) >= 5) | fixed | moved | named


def calendar(spark: SparkSession, first: str, last: str, extra: list | None = None) -> DataFrame:
    """(day, free, next_working): one row per day; the next working day is at most ``LONGEST_GAP`` away.

    A dimension of bounded size (days between two dates), so joins with it are broadcast.
    """
    ahead = F.sequence(F.lit(0), F.lit(LONGEST_GAP - 1))
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    candidates = F.filter(F.transform(ahead, lambda i: F.date_add(F.col("day"), i)), lambda d: ~is_holiday(d, extra))
    return days.select("day", is_holiday(F.col("day"), extra).alias("free"), F.get(candidates, F.lit(0)).alias("next_working"))


def deadlines(events: DataFrame, rules: DataFrame, days: DataFrame) -> DataFrame:
    """``events`` (event, event_date, ...) x rules of the same event kind -> deadlines with their status.

    Raises where more than ``LONGEST_GAP`` free days follow each other. Unapproved rules never bind.
    """
    start = F.when(F.col("from_next_day"), F.date_add("event_date", 1)).otherwise(F.col("event_date"))
    due = events.join(F.broadcast(rules), "event").withColumn("raw_due", F.date_add(start, F.col("days") - 1))
    rolled = due.join(F.broadcast(days), due["raw_due"] == days["day"], "left").withColumn(
        "due",
        F.when(~F.col("roll"), F.col("raw_due")).otherwise(
            F.coalesce("next_working", F.raise_error(F.lit("no working day within 30 days, or outside the calendar")).cast("date"))
        ),
    )
    approved = F.col("approved_by").isNotNull()
    moved = F.when(
        F.col("due") != F.col("raw_due"), F.concat(F.lit("moved from "), F.col("raw_due").cast("string"), F.lit(" to "), F.col("due").cast("string"))
    )
    return rolled.select(
        *events.columns,
        "rule_id",
        "basis",
        "raw_due",
        "due",
        F.when(approved, "proposal").otherwise("unapproved_rule").alias("status"),
        F.array_compact(F.array(F.when(~approved, F.lit("rule not approved")), moved, F.when(approved, F.lit("needs confirmation")))).alias("warnings"),
    )


def confirm(found: DataFrame, person: str) -> DataFrame:
    """Deadlines confirmed by a person; those of unapproved rules cannot be."""
    status = F.when(F.col("status") == "unapproved_rule", F.raise_error(F.lit("an unapproved rule cannot be confirmed")).cast("string"))
    return found.withColumn("status", status.otherwise("confirmed")).withColumn(
        "warnings", F.array_append("warnings", F.lit(f"confirmed by {person}"))
    )
