"""Markdown and HTML exports of findings, one document per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOOTER = "Every quotation was checked against its source, character by character. A lawyer decides."


def _ordered(df: DataFrame, line: Column) -> DataFrame:
    listed = df.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))).alias("rows"))
    return listed.select("question_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("body"))


def _escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _sections(questions: DataFrame, findings: DataFrame, rejected: DataFrame, finding: Column, refused: Column) -> DataFrame:
    return (
        questions.join(_ordered(findings, finding).withColumnRenamed("body", "found"), "question_id", "left")
        .join(_ordered(rejected, refused).withColumnRenamed("body", "refused"), "question_id", "left")
    )


def to_markdown(questions: DataFrame, findings: DataFrame, rejected: DataFrame) -> DataFrame:
    """(question_id, document). ``findings``: (question_id, number, text, doc_id, start, end, quoted);
    ``rejected``: (question_id, number, text, reason)."""
    finding = F.concat(
        F.lit("**"), F.col("number").cast("string"), F.lit(".** "), F.trim("text"), F.lit("\n\n> "), F.trim("quoted"), F.lit("\n>\n> — "),
        F.col("doc_id").cast("string"), F.lit(", characters "), F.col("start").cast("string"), F.lit("–"), F.col("end").cast("string"), F.lit("\n"),
    )
    refused = F.concat(F.lit("- "), F.trim("text"), F.lit(" ("), F.col("reason"), F.lit(")"))
    parts = _sections(questions, findings, rejected, finding, refused)
    return parts.select(
        "question_id",
        F.concat_ws(
            "\n",
            F.concat(F.lit("# "), F.col("question")),
            F.lit(""),
            F.concat(F.lit("## Findings\n\n"), F.coalesce("found", F.lit("None: the documents do not answer this."))),
            F.concat(F.lit("\n## Rejected\n\n"), F.col("refused")),
            F.concat(F.lit("\n---\n"), F.lit(FOOTER)),
        ).alias("document"),
    )


def to_html(questions: DataFrame, findings: DataFrame, rejected: DataFrame) -> DataFrame:
    """The same as a self-contained page; all content is escaped."""
    finding = F.concat(
        F.lit("<li>"), _escape(F.trim("text")), F.lit("<blockquote>"), _escape(F.trim("quoted")), F.lit("</blockquote><small>"),
        F.col("doc_id").cast("string"), F.lit(" "), F.col("start").cast("string"), F.lit("–"), F.col("end").cast("string"), F.lit("</small></li>"),
    )
    refused = F.concat(F.lit("<li>"), _escape(F.trim("text")), F.lit(" ("), _escape(F.col("reason")), F.lit(")</li>"))
    parts = _sections(questions, findings, rejected, finding, refused)
    return parts.select(
        "question_id",
        F.concat_ws(
            "\n",
            F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>'),
            F.concat(F.lit("<h1>"), _escape(F.col("question")), F.lit("</h1>")),
            F.concat(F.lit("<ol>"), F.coalesce("found", F.lit("")), F.lit("</ol>")),
            F.concat(F.lit("<h2>Rejected</h2><ul>"), F.col("refused"), F.lit("</ul>")),
            F.lit(f"<footer>{FOOTER}</footer></body></html>"),
        ).alias("document"),
    )
