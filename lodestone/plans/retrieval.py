"""Retrieval queries: term statistics, BM25, fusion, budgets, language."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as txt
from lodestone.operators import retrieve
from lodestone.registry import query
from lodestone.session import table


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words)) + "]"


FOLD = f"translate(lower(x), '{txt.POLISH_FOLD[0]}', '{txt.POLISH_FOLD[1]}')"


def sql_tokens(text: str, english: bool) -> str:
    """The DuckDB expression for ``text.tokens``."""
    folded = f"list_transform(list_filter(regexp_extract_all({text}, '{txt.TOKEN}'), lambda x: length(x) > 1), lambda x: {FOLD})"
    stop = txt.STOP_PL + (txt.STOP_EN if english else [])
    kept = f"list_filter({folded}, lambda x: NOT list_contains({sql_list(stop)}, x))"
    return f"list_transform({kept}, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN x ELSE regexp_replace(x, '{txt.STEM}', '\\1') END)"


SQL_TERMS = f"""
d AS (SELECT doc_id, {sql_tokens('text', True)} AS terms FROM documents),
q AS (SELECT item_id, {sql_tokens('text', True)} AS terms FROM benchmark),
s AS (SELECT count(*) AS n_units, avg(len(terms)) AS avg_len FROM d),
tf AS (SELECT doc_id, len(terms) AS unit_len, term, count(*) AS tf
       FROM (SELECT doc_id, terms, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
a AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(terms) AS term FROM q) GROUP BY ALL),
b AS (SELECT item_id, doc_id, round(sum(times * ln(1 + (n_units - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE)
        / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * unit_len / CASE WHEN avg_len > 0 THEN avg_len ELSE 1 END))), 6) AS score
      FROM a JOIN df USING (term) JOIN tf USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM b WHERE score > 0)
"""


def _ranked(spark, sf_dir, k: int):
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return retrieve.top_k(retrieve.bm25(docs, "doc_id", items, "item_id", "en"), "item_id", "score", k, "doc_id")


@query("bm25_topk_documents", f"WITH {SQL_TERMS} SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def bm25_topk_documents(spark, sf_dir):
    """The five best documents of every benchmark question."""
    return _ranked(spark, sf_dir, 5).select("item_id", "doc_id", "score", "rank")


@query(
    "term_stats",
    f"WITH {SQL_TERMS} SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY term",
)
def term_stats(spark, sf_dir):
    """Occurrences and document frequency of every term."""
    tf = retrieve.term_frequencies(table(spark, sf_dir, "documents"), "doc_id", lang="en")
    return tf.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("df"))


@query("corpus_stats", f"WITH {SQL_TERMS} SELECT CAST(n_units AS BIGINT) AS n_units, round(avg_len, 6) AS avg_len FROM s")
def corpus_stats(spark, sf_dir):
    """Number of documents and their average length in terms."""
    return retrieve.corpus_stats(table(spark, sf_dir, "documents"), lang="en").select("n_units", F.round("avg_len", 6).alias("avg_len"))


@query(
    "prefix_budget",
    f"""WITH {SQL_TERMS},
    p AS (SELECT r.*, length(text) AS size, sum(length(text)) OVER w AS used FROM r JOIN documents USING (doc_id) WHERE rank <= 8
          WINDOW w AS (PARTITION BY item_id ORDER BY rank)),
    o AS (SELECT *, max(CASE WHEN used > 9000 AND rank > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY rank) AS over FROM p)
    SELECT item_id, doc_id, CAST(rank AS INT) AS rank, CAST(size AS BIGINT) AS size FROM o WHERE over = 0""",
)
def prefix_budget(spark, sf_dir):
    """The best eight documents of a question as far as 9000 characters reach."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("size"))
    ranked = _ranked(spark, sf_dir, 8).join(sizes, "doc_id")
    return retrieve.within_budget(ranked, "item_id", "size", 9000).select("item_id", "doc_id", "rank", "size")


@query(
    "source_first_appearance",
    f"""WITH {SQL_TERMS},
    f AS (SELECT item_id, source, min(rank) AS best FROM r JOIN documents USING (doc_id) WHERE rank <= 30 GROUP BY ALL)
    SELECT item_id, source, CAST(position AS INT) AS position FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY best, source) AS position FROM f) WHERE position <= 12""",
)
def source_first_appearance(spark, sf_dir):
    """Sources in the order in which the document ranking first reaches them."""
    ranked = _ranked(spark, sf_dir, 30).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    out = retrieve.first_appearance(ranked, "item_id", "source", 12)
    return out.select("item_id", "source", F.col("rank").alias("position"))


@query(
    "rrf_fusion",
    f"""WITH {SQL_TERMS},
    l AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars, doc_id) AS rank
          FROM r JOIN documents USING (doc_id) WHERE rank <= 20),
    p AS (SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) AS part FROM r WHERE rank <= 20
          UNION ALL SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM l)
    SELECT item_id, doc_id, round(sum(part), 9) AS score FROM p GROUP BY ALL""",
)
def rrf_fusion(spark, sf_dir):
    """Two rankings of the same documents (relevance, brevity) fused."""
    first = _ranked(spark, sf_dir, 20)
    sized = first.join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("brief", -F.col("n_chars"))
    second = retrieve.top_k(sized.drop("rank"), "item_id", "brief", 20, "doc_id")
    return retrieve.reciprocal_rank_fusion([first, second], "item_id", "doc_id")


@query(
    "vector_topk",
    """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id,
        round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
        FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
    SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
)
def vector_topk(spark, sf_dir):
    """The ten nearest vectors of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieve.vector_top_k(vectors, asked, 10).select("query_id", "vec_id", "score", "rank")


SQL_LANGUAGE = f"""
w AS (SELECT doc_id, source, lang AS true_lang, substr(text, 1, 20000) AS head,
        list_transform(regexp_extract_all(substr(text, 1, 20000), '{txt.LETTERS}'), lambda x: lower(x)) AS words FROM documents),
c AS (SELECT *, len(words) AS n,
        len(list_filter(words, lambda x: list_contains({sql_list(txt.FUNCTION_PL)}, x)))::DOUBLE AS pl_n,
        len(list_filter(words, lambda x: list_contains({sql_list(txt.FUNCTION_EN)}, x)))::DOUBLE AS en_n,
        (length(head) - length(translate(head, '{txt.POLISH_MARKS}', '')))::DOUBLE / greatest(length(head), 1) AS marks FROM w),
b AS (SELECT *, least(marks / 0.015::DOUBLE, 1.0::DOUBLE) * 0.45::DOUBLE AS bonus, pl_n + en_n AS total FROM c),
e AS (SELECT *, least(CASE WHEN total > 0 THEN pl_n / total ELSE 0 END + bonus, 1.0::DOUBLE) AS pl,
        CASE WHEN total > 0 THEN en_n / total ELSE 0 END * (1.0::DOUBLE - bonus) AS en FROM b),
g AS (SELECT *, greatest(pl, en) / greatest(pl + en, 1e-9::DOUBLE) AS conf,
        n < 12 OR (total = 0 AND marks < 0.001::DOUBLE) AS blank FROM e),
l AS (SELECT doc_id, source, true_lang, CASE WHEN blank OR conf < 0.55::DOUBLE THEN 'unknown' WHEN pl > en THEN 'pl' ELSE 'en' END AS found_lang,
        round(CASE WHEN blank THEN 0 ELSE conf END, 6) AS confidence FROM g)
"""


def _languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("found", txt.language(F.col("text")))
    return docs.select(
        "doc_id", "source", F.col("lang").alias("true_lang"), F.col("found.lang").alias("found_lang"), F.round("found.confidence", 6).alias("confidence")
    )


@query("language_id", f"WITH {SQL_LANGUAGE} SELECT doc_id, found_lang, confidence FROM l")
def language_id(spark, sf_dir):
    return _languages(spark, sf_dir).select("doc_id", "found_lang", "confidence")


@query("language_confusion", f"WITH {SQL_LANGUAGE} SELECT true_lang, found_lang, CAST(count(*) AS BIGINT) AS docs FROM l GROUP BY ALL")
def language_confusion(spark, sf_dir):
    return _languages(spark, sf_dir).groupBy("true_lang", "found_lang").agg(F.count(F.lit(1)).alias("docs"))


@query(
    "majority_language",
    """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
    SELECT source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rn FROM c) WHERE rn = 1""",
)
def majority_language(spark, sf_dir):
    """The commonest language of every source; ties go to the first in order."""
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("source").agg(F.min(F.struct(-F.col("n"), "lang")).alias("best")).select("source", "best.lang")


@query(
    "model_routing",
    f"WITH {SQL_LANGUAGE} SELECT CASE WHEN found_lang = 'en' THEN 'model_en' ELSE 'model_pl' END AS model, CAST(count(*) AS BIGINT) AS docs FROM l GROUP BY ALL",
)
def model_routing(spark, sf_dir):
    """Documents by the model their language is sent to; unknown goes with Polish."""
    model = F.when(F.col("found_lang") == "en", "model_en").otherwise("model_pl")
    return _languages(spark, sf_dir).groupBy(model.alias("model")).agg(F.count(F.lit(1)).alias("docs"))
