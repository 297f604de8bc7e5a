"""What is kept: admitted documents, languages filled in later, log-in sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import store
from lodestone.operators.sessions import VALID, sessions
from lodestone.plans.cleaning import _sql_clean
from lodestone.plans.retrieval import SQL_LANGUAGE
from lodestone.registry import query
from lodestone.session import table

SQL_FOUND = "CASE WHEN blank OR conf < 0.55::DOUBLE THEN 'unknown' WHEN pl > en THEN 'pl' ELSE 'en' END"


@query(
    "insert_documents",
    f"""WITH np AS (SELECT page_id AS doc_id, 'src' || (page_id % 30) AS source, '' AS lang, {_sql_clean('nfc_normalize(html)')} AS text FROM pages),
    {SQL_LANGUAGE.replace('FROM documents', 'FROM np')}
    SELECT doc_id AS page_id, source AS case_id, {SQL_FOUND} AS lang, round(CASE WHEN blank THEN 0 ELSE conf END, 3) AS confidence, np.text AS text,
      'page ' || doc_id || ' (' || length(np.text) || ' characters, language: ' || {SQL_FOUND} || ')' AS detail
    FROM g JOIN np USING (doc_id, source) WHERE source IN (SELECT source FROM documents)""",
)
def insert_documents(spark, sf_dir):
    """Pages admitted to cases that exist, as they are stored: composed, cleaned, with their language and audit entry."""
    new = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("src"), F.col("page_id") % 30).alias("case_id"), F.concat(F.lit("page "), "page_id").alias("name"), F.col("html").alias("text")
    )
    cases = table(spark, sf_dir, "documents").select(F.col("source").alias("case_id"))
    return store.admit(new, cases).select("page_id", "case_id", "lang", "confidence", "text", "detail")


@query(
    "refused_documents",
    "SELECT page_id, 'src' || (page_id % 30) AS case_id FROM pages WHERE 'src' || (page_id % 30) NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)",
)
def refused_documents(spark, sf_dir):
    """Pages whose case does not exist."""
    new = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("src"), F.col("page_id") % 30).alias("case_id"))
    return store.refused(new, table(spark, sf_dir, "documents").select(F.col("source").alias("case_id")))


@query(
    "language_backfill",
    f"""WITH {SQL_LANGUAGE} SELECT g.doc_id, CASE WHEN g.doc_id % 3 = 2 THEN true_lang ELSE {SQL_FOUND} END AS lang,
      CASE WHEN g.doc_id % 3 <> 2 THEN round(CASE WHEN blank THEN 0 ELSE conf END, 3) END AS confidence FROM g""",
)
def language_backfill(spark, sf_dir):
    """Documents of which two thirds had lost their language (null or empty), filled in; a second run over the result changes nothing."""
    part = F.pmod("doc_id", F.lit(3))
    lost = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.when(part == 2, F.col("lang")).when(part == 1, "").alias("lang"), F.lit(None).cast("double").alias("confidence")
    )
    return store.backfill_language(store.backfill_language(lost)).select("doc_id", "lang", "confidence")


@query(
    "login_sessions",
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS login, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events),
    s AS (SELECT login, min(ts) AS opened FROM e GROUP BY login
      UNION ALL SELECT login, min(ts) FROM (SELECT s.login, e.ts FROM s JOIN e ON e.login = s.login AND e.ts > s.opened + {VALID}) GROUP BY login)
    SELECT s.login, opened, opened + {VALID} AS expires, count(*) AS requests FROM s JOIN e ON e.login = s.login AND e.ts >= opened AND e.ts <= opened + {VALID} GROUP BY ALL""",
)
def login_sessions(spark, sf_dir):
    """Sessions of twelve hours: when they were opened, when they end and how many requests they saw."""
    return sessions(table(spark, sf_dir, "events").select(F.col("user_id").alias("login"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts")))
