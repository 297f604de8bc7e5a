"""URL rules by expression lookup.

A URL expands into (host suffix, path prefix) expressions; a rule is one such expression. Both sides are
hashed: the equi-join runs on the first eight hex digits of a SHA-256 digest, the full digest confirms,
and the longest confirmed expression decides. Distinct (host, path) pairs are judged once, so a host that
makes up a third of the pages costs its distinct paths only.

Path prefixes are taken at the lengths that occur among the rules (never more than the longest path a rule
has), so a rule need not end at a path separator.

Defined results: a null URL or one without ``://`` has an empty host and path, which no rule fits; rules of
equal expression resolve to block; no fitting rule gives ``default``; repeated rows are judged each; a URL of
any length is judged whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower

#: (host, path prefix, verdict), as the query's contract states them.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain: a.b.c gives a.b.c, b.c, c."""
    labels = F.split(host, r"\.", -1)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        )
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict; ``rules`` has (host, path, verdict).

    Rule hosts are compared lower-cased. Clashing input columns are replaced by the results.
    """
    rules = (
        rules.select(ascii_lower(F.col("host")).alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v"))
        .where("h is not null and p is not null")
        .groupBy("h", "p")
        .agg(F.max("v").alias("v"))
        .select(
            F.concat("h", "p").alias("rule"),
            "v",
            F.length("p").alias("plen"),
            F.sha2(F.concat("h", F.lit("\n"), "p"), 256).alias("full"),
        )
        .withColumn("short", F.substring("full", 1, PREFIX_DIGITS))
    )
    # Distinct path lengths are at most the length of the longest path of a rule.
    lengths = sorted(r[0] for r in rules.select("plen").distinct().collect())
    new = {"host", "path", "rule", "verdict"}
    kept = [c for c in pages.columns if c.lower() not in new]
    pages = pages.select(*kept, url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths] or [F.lit(None).cast("int")]), lambda n: n <= F.length("path"))
    asked = (
        pages.where("host <> ''")
        .select("host", "path")
        .distinct()
        .withColumn("suffix", F.explode(host_suffixes(F.col("host"))))
        .withColumn("plen", F.explode(prefixes))
        .withColumn("full", F.sha2(F.concat("suffix", F.lit("\n"), F.expr("substring(path, 1, plen)")), 256))
        .withColumn("short", F.substring("full", 1, PREFIX_DIGITS))
        .select("host", "path", "short", "full")
    )
    judged = (
        asked.join(rules.select("short", F.col("full").alias("rule_full"), "rule", "v"), "short")
        .where("full = rule_full")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "v")).alias("best"))
        .select("host", "path", "best.rule", "best.v")
    )
    return pages.join(judged, ["host", "path"], "left").select(
        *kept, "host", "path", "rule", F.coalesce("v", F.lit(default)).alias("verdict")
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict under ``RULES``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
m AS (
  SELECT u.page_id, u.host, u.path, h || p AS rule, v,
    row_number() OVER (PARTITION BY u.page_id ORDER BY length(h || p) DESC) AS rn
  FROM u LEFT JOIN rules ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE rn = 1
"""
