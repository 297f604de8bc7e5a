"""Cleaning and segmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as txt
from lodestone.registry import query
from lodestone.session import table
from lodestone.sources.files import WRONG_PAGE


def _sql_replace(text: str, steps) -> str:
    for pattern, put in steps:
        flags = "g"
        text = f"regexp_replace({text}, '{pattern}', '{put.replace('$1', chr(92) + '1')}', '{flags}')"
    return text


def _sql_clean(text: str) -> str:
    t = _sql_replace(text, txt.CLEAN_BEFORE)
    for entity, put in txt.ENTITIES:
        t = f"replace({t}, '{entity}', '{put}')"
    t = _sql_replace(t, txt.CLEAN_AFTER)
    t = f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN regexp_matches({text}, '{txt.TAG}') OR contains({text}, '&') OR contains({text}, '<!--') THEN {t} ELSE {text} END"


@query("html_clean", f"SELECT page_id, {_sql_clean('html')} AS text FROM pages")
def html_clean(spark, sf_dir):
    """Pages without markup."""
    return table(spark, sf_dir, "pages").select("page_id", txt.clean_html(F.col("html")).alias("text"))


def _sql_clean_benchmark(text: str) -> str:
    t = _sql_replace(text, txt.BENCHMARK_BEFORE)
    for entity, put in txt.ENTITIES:
        t = f"replace({t}, '{entity}', '{put}')"
    return f"CASE WHEN contains({text}, '<') THEN regexp_replace({_sql_replace(t, txt.BENCHMARK_AFTER)}, '^\\s+|\\s+$', '', 'g') ELSE {text} END"


@query("html_clean_benchmark", f"SELECT page_id, {_sql_clean_benchmark('html')} AS text FROM pages")
def html_clean_benchmark(spark, sf_dir):
    """Pages as a benchmark corpus has them: every block tag, opening or closing, breaks a line."""
    return table(spark, sf_dir, "pages").select("page_id", txt.clean_benchmark_html(F.col("html")).alias("text"))


@query(
    "markup_share",
    f"""SELECT page_id, CAST(length(html) AS BIGINT) AS before, CAST(length({_sql_clean('html')}) AS BIGINT) AS after,
    round((length(html) - length(regexp_replace(html, '{txt.TAG}', '', 'g')))::DOUBLE / length(html), 6) AS share FROM pages""",
)
def markup_share(spark, sf_dir):
    """Characters before and after cleaning, and the share inside tags."""
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.length(html).cast("long").alias("before"),
        F.length(txt.clean_html(html)).cast("long").alias("after"),
        F.round(txt.markup_share(html), 6).alias("share"),
    )


@query(
    "backfill_report",
    f"""WITH c AS (SELECT html, {_sql_clean('html')} AS clean FROM pages)
    SELECT CAST(count(*) FILTER (WHERE clean <> html) AS BIGINT) AS changed, CAST(sum(length(html) - length(clean)) AS BIGINT) AS removed FROM c""",
)
def backfill_report(spark, sf_dir):
    """What cleaning all stored pages would change."""
    pages = table(spark, sf_dir, "pages").select("html", txt.clean_html(F.col("html")).alias("clean"))
    return pages.agg(
        F.sum((F.col("clean") != F.col("html")).cast("long")).alias("changed"),
        F.sum((F.length("html") - F.length("clean")).cast("long")).alias("removed"),
    )


JUNK = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
MOJIBAKE = WRONG_PAGE


@query(
    "text_quality_gate",
    f"""WITH c AS (SELECT doc_id, length(text) AS n,
        length(text) - length(regexp_replace(text, '{JUNK}', '', 'g')) AS junk,
        length(text) - length(translate(text, '{MOJIBAKE}', '')) AS mojibake FROM documents)
    SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN junk > 0.15::DOUBLE * n THEN 'junk' WHEN mojibake > 0.012::DOUBLE * n THEN 'mojibake'
        WHEN n < 200 THEN 'short' ELSE 'ok' END AS verdict FROM c""",
)
def text_quality_gate(spark, sf_dir):
    """Whether a text is fit for use: empty, unreadable, wrongly decoded, short or fine."""
    text = F.col("text")
    n = F.length(text)
    junk = n - F.length(F.regexp_replace(text, JUNK, ""))
    mojibake = n - F.length(F.translate(text, MOJIBAKE, ""))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(n == 0, "empty").when(junk > 0.15 * n, "junk").when(mojibake > 0.012 * n, "mojibake").when(n < 200, "short").otherwise("ok").alias("verdict"),
    )


@query(
    "control_chars",
    f"SELECT doc_id, CAST(length(t) - length(regexp_replace(t, '{JUNK}', '', 'g')) AS BIGINT) AS removed FROM (SELECT doc_id, concat(text, chr(7), chr(31)) AS t FROM documents)",
)
def control_chars(spark, sf_dir):
    """Control characters removed from every text (two are appended, so that there are some)."""
    t = F.concat("text", F.lit("\x07\x1f"))
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(t) - F.length(txt.strip_controls(t))).cast("long").alias("removed"))


@query(
    "codepage_counts",
    f"""SELECT doc_id, CAST(length(text) - length(translate(text, '{MOJIBAKE}', '')) AS BIGINT) AS suspicious,
    CAST(length(text) - length(translate(text, '{txt.POLISH_MARKS}', '')) AS BIGINT) AS polish FROM documents""",
)
def codepage_counts(spark, sf_dir):
    """Characters that hint at a wrong code page, and Polish letters."""
    lost = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", lost(MOJIBAKE).alias("suspicious"), lost(txt.POLISH_MARKS).alias("polish"))


@query(
    "usable_lines",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (WHERE length(line) >= 30 AND NOT regexp_matches(line, '<[^>]{1,80}>')
      AND length(line) - length(replace(line, '_', '')) <= 3 AND length(line) - length(replace(line, '|', '')) <= 2
      AND (length(line) - length(regexp_replace(line, '[\p{L}\s]', '', 'g')))::DOUBLE / greatest(length(line), 1) >= 0.62::DOUBLE
      AND len(regexp_extract_all(line, '\p{L}{3,}')) >= 5) AS BIGINT) AS usable FROM l GROUP BY doc_id""",
)
def usable_lines(spark, sf_dir):
    """How many lines of a document could serve as quotations."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(txt.usable_sentence(F.col("line")).cast("long")).alias("usable")
    )


def _sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", F.explode(txt.sentences(F.col("text"), F.lit("en"))).alias("s"))


@query("sentences_with_offsets")
def sentences_with_offsets(spark, sf_dir):
    """Sentences of every document with code-point offsets (abbreviations and short pieces are folded)."""
    return _sentences(spark, sf_dir).select("doc_id", "s.sent_no", "s.start", "s.end", "s.text")


@query("sentence_offset_invariant", "SELECT CAST(0 AS BIGINT) AS violations")
def sentence_offset_invariant(spark, sf_dir):
    """Sentences that differ from their source at their offsets; there must be none."""
    bad = F.expr("substring(text, s.start + 1, s.end - s.start) <> s.text").cast("long")
    return _sentences(spark, sf_dir).agg(F.coalesce(F.sum(bad), F.lit(0)).alias("violations"))


@query("fragments")
def fragments(spark, sf_dir):
    """Overlapping fragments of every document; the next one's start depends on the last cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(txt.fragments(F.col("text"))).alias("f"))
    return docs.select("doc_id", "f.start", "f.end", F.length("f.text").alias("size"))


@query("fragment_offset_invariant", "SELECT CAST(0 AS BIGINT) AS violations")
def fragment_offset_invariant(spark, sf_dir):
    """Fragments that differ from their source at their offsets; there must be none."""
    docs = table(spark, sf_dir, "documents").select("text", F.explode(txt.fragments(F.col("text"))).alias("f"))
    bad = F.expr("substring(text, f.start + 1, f.end - f.start) <> f.text").cast("long")
    return docs.agg(F.coalesce(F.sum(bad), F.lit(0)).alias("violations"))


@query(
    "pieces_with_offsets",
    rf"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '{txt.PIECE}') AS ps FROM documents),
    u AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS n FROM p)
    SELECT doc_id, CAST(n AS INT) AS n, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY n) - length(piece) AS BIGINT) AS start,
      CAST(length(piece) AS BIGINT) AS size FROM u""".replace("\"'”", "\"''”"),
)
def pieces_with_offsets(spark, sf_dir):
    """Contiguous boundary pieces; offsets are a running sum of lengths."""
    from pyspark.sql import Window

    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(txt.PIECE), F.lit(0))).alias("n", "piece"))
    upto = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select(
        "doc_id",
        (F.col("n") + 1).alias("n"),
        F.coalesce(F.sum(F.length("piece")).over(upto), F.lit(0)).cast("long").alias("start"),
        F.length("piece").cast("long").alias("size"),
    )


@query("question_hashes", "SELECT item_id, substr(sha256(lower(trim(text))), 1, 16) AS question_hash FROM benchmark")
def question_hashes(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", txt.question_hash(F.col("text")).alias("question_hash"))


@query("case_item_ids", "SELECT conv_id, turn, substr(sha256(concat_ws('|', role, CAST(conv_id AS VARCHAR), text)), 1, 12) AS item FROM conversations")
def case_item_ids(spark, sf_dir):
    digest = F.sha2(F.concat_ws("|", "role", F.col("conv_id").cast("string"), "text"), 256)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring(digest, 1, 12).alias("item"))


@query(
    "character_error_rate",
    """SELECT item_id, round(levenshtein(text, replace(text, 'e', 'c'))::DOUBLE / length(text), 6) AS cer
    FROM benchmark WHERE length(text) > 0""",
)
def character_error_rate(spark, sf_dir):
    """Edit distance of a damaged text to its reference, over the reference's length."""
    ref = F.col("text")
    damaged = F.replace(ref, F.lit("e"), F.lit("c"))
    return table(spark, sf_dir, "benchmark").where("length(text) > 0").select(
        "item_id", F.round(F.levenshtein(ref, damaged).cast("double") / F.length(ref), 6).alias("cer")
    )


@query(
    "numbered_text",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    w AS (SELECT doc_id, n, '[' || n || '] ' || regexp_replace(line, '\s+', ' ', 'g') AS line FROM l),
    r AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS used FROM w),
    o AS (SELECT *, max(CASE WHEN used > 2000 AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS over FROM r)
    SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS view FROM o WHERE over = 0 GROUP BY doc_id""",
)
def numbered_text(spark, sf_dir):
    """Numbered lines of a document up to 2000 characters; the first is always whole."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    lines = lines.select("doc_id", (F.col("i") + 1).alias("n"), F.concat(F.lit("["), (F.col("i") + 1).cast("string"), F.lit("] "), F.regexp_replace("raw", r"\s+", " ")).alias("line"))
    order = Window.partitionBy("doc_id").orderBy("n")
    used = F.sum(F.length("line") + 1).over(order) - 1
    over = F.max(((F.col("used") > 2000) & (F.col("n") > 1)).cast("int")).over(order)
    kept = lines.withColumn("used", used).withColumn("over", over).where("over = 0")
    ordered = F.array_sort(F.collect_list(F.struct("n", "line")))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("view"))


@query("file_slugs", r"SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_\-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def file_slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", txt.slug(F.col("url")).alias("slug"))
