"""Scoped reads and writes: the relational statements of the case store.

``documents.source`` plays the case; every read of text goes through ``scoped``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.registry import query
from lodestone.session import table


def scoped(documents: DataFrame, case_id: str, doc_id: int | None = None) -> DataFrame:
    """The only way to texts: one case's documents, or one of them."""
    rows = documents.where(F.col("source") == case_id)
    return rows if doc_id is None else rows.where(F.col("doc_id") == doc_id)


def select_own(documents: DataFrame, case_id: str, wanted: list[int]) -> DataFrame:
    """A user's choice of documents of one case; a foreign id fails the whole request."""
    own = scoped(documents, case_id)
    asked = documents.sparkSession.createDataFrame([(i,) for i in wanted], "doc_id long")
    foreign = [r[0] for r in asked.join(own, "doc_id", "left_anti").limit(5).collect()]
    if foreign:
        raise LookupError(f"not in this case: {foreign}")
    return own.join(F.broadcast(asked), "doc_id", "left_semi")  # ids a user listed


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


@query("scoped_documents", "SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3'")
def scoped_documents(spark, sf_dir):
    return scoped(table(spark, sf_dir, "documents"), "src3").select("doc_id", "lang", "n_chars")


@query("metadata_projection", "SELECT doc_id, source, lang, CAST(length(text) AS BIGINT) AS size FROM documents")
def metadata_projection(spark, sf_dir):
    """Metadata without content."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.length("text").cast("long").alias("size"))


@query("in_list", "SELECT item_id, CAST(length(text) AS BIGINT) AS size FROM benchmark WHERE item_id IN (1, 3, 5, 7)")
def in_list(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").where(F.col("item_id").isin(1, 3, 5, 7)).select("item_id", F.length("text").cast("long").alias("size"))


@query("foreign_selection_anti", "SELECT doc_id FROM documents WHERE doc_id % 10 = 0 AND source <> 'src0'")
def foreign_selection_anti(spark, sf_dir):
    """Wanted documents that are not in the case."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.where("doc_id % 10 = 0").select("doc_id").join(docs.where("source = 'src0'").select("doc_id"), "doc_id", "left_anti")


@query(
    "case_list_counts",
    """SELECT s.s_suppkey AS case_id, (SELECT count(*) FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 45) AS documents,
      (SELECT count(*) FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_returnflag = 'R') AS messages FROM supplier s""",
)
def case_list_counts(spark, sf_dir):
    """Cases with two correlated counts, 0 where nothing matches."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("case_id")).agg(
        F.sum((F.col("l_quantity") > 45).cast("long")).alias("documents"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("messages")
    )
    cases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id"))
    return cases.join(items, "case_id", "left").na.fill(0, ["documents", "messages"])


@query(
    "history_left_join",
    "SELECT o.o_orderkey, c.c_name AS author FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 WHERE o.o_orderstatus = 'F'",
)
def history_left_join(spark, sf_dir):
    """Messages with their author, where known."""
    people = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("author"))
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(people, "o_custkey", "left").select("o_orderkey", "author")


@query(
    "thread_list",
    """SELECT c.c_custkey AS thread, n.n_name AS place, r.r_name AS area, CAST(count(o.o_orderkey) AS BIGINT) AS messages FROM customer c
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL""",
)
def thread_list(spark, sf_dir):
    """Threads with two left joins and a count of messages."""
    sent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("thread")).agg(F.count(F.lit(1)).alias("messages"))
    place = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("place"), "n_regionkey")
    area = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("area"))
    threads = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("thread"), "c_nationkey")
    joined = threads.join(place, "c_nationkey", "left").join(area, "n_regionkey", "left").join(sent, "thread", "left")
    return joined.select("thread", "place", "area", F.coalesce("messages", F.lit(0)).alias("messages"))


@query("session_profiles", "SELECT e.event_id, c.c_name AS name FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'signup'")
def session_profiles(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return table(spark, sf_dir, "events").where("event_type = 'signup'").join(people, "user_id").select("event_id", "name")


@query("thread_messages", "SELECT v.conv_id, v.turn, m.role FROM conversations v LEFT JOIN (SELECT DISTINCT role FROM conversations WHERE role <> 'system') m ON v.role = m.role JOIN (SELECT DISTINCT conv_id FROM conversations WHERE turn = 2) t ON v.conv_id = t.conv_id")
def thread_messages(spark, sf_dir):
    """Messages of open threads with an optional author: a left and an inner join."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("r"))
    known = rows.where("r <> 'system'").select(F.col("r").alias("key"), F.col("r").alias("role")).distinct()
    longer = rows.where("turn = 2").select("conv_id").distinct()
    return rows.join(known, rows["r"] == known["key"], "left").join(longer, "conv_id").select("conv_id", "turn", "role")


@query("thread_activity", "SELECT conv_id, CAST(max(turn) AS BIGINT) AS last_turn, CAST(count(*) AS BIGINT) AS messages FROM conversations GROUP BY conv_id")
def thread_activity(spark, sf_dir):
    """A thread's activity is derived from its messages instead of being kept up to date."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("messages"))


@query("history_tail", "SELECT conv_id, turn, substr(text, 1, 400) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6")
def history_tail(spark, sf_dir):
    """The last six messages of a thread, 400 characters each."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("rn", F.row_number().over(newest)).where("rn <= 6")
    return rows.select("conv_id", "turn", F.substring("text", 1, 400).alias("text"))


@query("null_safe_history", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS thread, CASE WHEN event_id % 2 = 0 THEN NULL ELSE user_id END AS doc FROM events) WHERE thread IS NULL AND (doc = 7 OR doc IS NULL)")
def null_safe_history(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(e % 3 != 0, F.col("user_id")).alias("thread"), F.when(e % 2 != 0, F.col("user_id")).alias("doc"))
    return rows.where(F.col("thread").isNull() & ((F.col("doc") == 7) | F.col("doc").isNull())).select("event_id")


@query("thread_titles", "SELECT conv_id, coalesce(nullif(substr(trim(text), 1, 120), ''), 'untitled') AS title FROM conversations WHERE turn = 0")
def thread_titles(spark, sf_dir):
    title = F.coalesce(F.nullif(F.substring(F.trim("text"), 1, 120), F.lit("")), F.lit("untitled"))
    return table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", title.alias("title"))


@query("cascade_delete", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 0 AND role = 'system')")
def cascade_delete(spark, sf_dir):
    """What is left after threads that open with a system message were deleted, with their messages."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return rows.join(rows.where("turn = 0 and role = 'system'").select("conv_id"), "conv_id", "left_anti").select("conv_id", "turn")


@query("scoped_delete", "SELECT doc_id FROM documents WHERE NOT (source = 'src1' AND doc_id % 2 = 0)")
def scoped_delete(spark, sf_dir):
    """Documents after a delete that only reaches its own case."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    doomed = docs.where("doc_id % 2 = 0").withColumn("source", F.lit("src1"))
    return docs.join(doomed, ["doc_id", "source"], "left_anti").select("doc_id")


@query("upsert_labels", "SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, CAST(1 AS INT), CAST(0 AS INT) FROM labels WHERE doc_id % 4 = 0")
def upsert_labels(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    new = old.where("doc_id % 4 = 0").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    return upsert(old, new, "doc_id")


@query("duplicate_keys", "SELECT lower(trim(c_mktsegment)) AS docket, CAST(count(*) AS BIGINT) AS cases FROM customer GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """Dockets used more than once, whatever their case and blanks."""
    return table(spark, sf_dir, "customer").groupBy(F.lower(F.trim("c_mktsegment")).alias("docket")).agg(F.count(F.lit(1)).alias("cases")).where("cases > 1")


@query("default_maps", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL ELSE source END, ''), 'pasted') AS origin, coalesce(nullif(lang, ''), 'unknown') AS lang FROM documents")
def default_maps(spark, sf_dir):
    """Origin and language with their defaults."""
    i = F.col("doc_id") % 3
    origin = F.when(i == 0, "").when(i == 1, None).otherwise(F.col("source"))
    default = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
    return table(spark, sf_dir, "documents").select("doc_id", default(origin, "pasted").alias("origin"), default(F.col("lang"), "unknown").alias("lang"))


@query("identity_checks", "SELECT c_custkey, regexp_matches(c_name, '^[A-Za-z][A-Za-z0-9#_.-]{2,40}$') AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND length(c_name) >= 10 AS valid FROM customer")
def identity_checks(spark, sf_dir):
    ok = F.col("c_name").rlike("^[A-Za-z][A-Za-z0-9#_.-]{2,40}$") & F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.length("c_name") >= 10)
    return table(spark, sf_dir, "customer").select("c_custkey", ok.alias("valid"))


@query("consent_difference", "SELECT conv_id, array_to_string(list_sort(list_filter(['assistant', 'system', 'user'], lambda x: NOT list_contains(list(role), x))), ' ') AS missing FROM conversations GROUP BY conv_id")
def consent_difference(spark, sf_dir):
    """Required roles that a thread lacks."""
    need = F.array(F.lit("assistant"), F.lit("system"), F.lit("user"))
    missing = F.array_join(F.array_sort(F.array_except(need, F.collect_set("role"))), " ")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(missing.alias("missing"))


@query("seeded_shuffle")
def seeded_shuffle(spark, sf_dir):
    """Documents in a seeded order that does not depend on the partitioning."""
    order = Window.partitionBy("source").orderBy(F.xxhash64("doc_id", F.lit(42)), "doc_id")
    return table(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(order).alias("place"))


@query("top_counters", "SELECT l_shipmode AS name, CAST(n AS BIGINT) AS n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, l_shipmode LIMIT 3)")
def top_counters(spark, sf_dir):
    """The three commonest combinations (a top-k report)."""
    name = F.concat("l_returnflag", "l_linestatus").alias("name")
    return table(spark, sf_dir, "lineitem").groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(3)


@query("resolved_numbers", "SELECT e.event_id, p.p_name FROM events e JOIN part p ON p.p_partkey = e.event_id % 100000 WHERE e.event_type = 'view'")
def resolved_numbers(spark, sf_dir):
    """Numbers resolved to what they stand for; unknown ones fall out."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"), "p_name")
    picks = table(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", (F.col("event_id") % 100000).alias("number"))
    return picks.join(parts, "number").select("event_id", "p_name")
