"""From a question to the sentences a model gets to see: document choice, sentence selection, recall, escalation.

The case file is every document with a clerk's note of the date of its customer's first order, spelled in one of three
ways; the questions are the benchmark's passages, most of them with a date that some note holds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import anchors
from lodestone.functions import text as txt
from lodestone.operators import answer, contain, retrieve
from lodestone.plans.retrieval import SQL_TERMS, sql_list, sql_tokens
from lodestone.registry import query
from lodestone.session import materialised, table

DOCUMENTS, BUDGET = 4, 3000
NOTE = "\n\nThe clerk noted that the order of this file was entered on ", " and kept in the record."


def _notes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.min(F.to_date("o_orderdate")).alias("d"))


def _case(spark, sf_dir):
    form = F.pmod("doc_id", F.lit(3))
    spelled = F.when(form == 0, F.date_format("d", "yyyy-MM-dd")).when(form == 1, F.date_format("d", "MMMM d, yyyy")).otherwise(F.date_format("d", "d MMMM yyyy"))
    note = F.when(F.col("d").isNotNull(), F.concat(F.lit(NOTE[0]), spelled, F.lit(NOTE[1]))).otherwise("")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    return docs.join(_notes(spark, sf_dir), "doc_id", "left").select("doc_id", "lang", F.concat("text", note).alias("text"))


def _questions(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text", (F.col("item_id") + 1).alias("doc_id"))
    dated = F.when(F.col("d").isNotNull(), F.concat(F.lit(" Entered "), F.date_format("d", "yyyy-MM-dd"))).otherwise("")
    return items.join(_notes(spark, sf_dir), "doc_id", "left").select("question_id", F.concat("text", dated).alias("text"), F.col("text").alias("passage"))


def _sentences(docs):
    """(doc_id, position, start, end, text) of the sentences that can serve as quotations."""
    found = docs.select("doc_id", F.explode(txt.sentences(F.col("text"), F.lit("en"))).alias("s")).select("doc_id", "s.*")
    place = F.row_number().over(retrieve.Window.partitionBy("doc_id").orderBy("start")) - 1
    return found.where(txt.usable_sentence(F.col("text"))).select("doc_id", place.alias("position"), "start", "end", "text")


def _valued(case, questions):
    """(question_id, doc_id, start) of all sentences that hold a value of the question; only those with digits are examined."""
    dated = case.select("doc_id", F.explode(txt.sentences(F.col("text"), F.lit("en"))).alias("s")).where(F.col("s.text").rlike("[0-9]"))
    values = dated.select("doc_id", "s.start", F.explode(anchors.compound(F.col("s.text"))).alias("value"))
    asked = questions.select("question_id", F.explode(anchors.compound(F.col("text"))).alias("value"))
    return materialised(asked.join(values, "value").select("question_id", "doc_id", "start").distinct(), "valued-sentences")


def _chosen(case, questions, valued):
    ranked = retrieve.bm25_top_k(case.select("doc_id", "text"), "doc_id", questions.select("question_id", "text"), "question_id", 2 * DOCUMENTS, "en")
    by_value = valued.select("question_id", "doc_id", F.col("doc_id").alias("position"))
    return materialised(answer.chosen_documents(by_value, ranked.withColumn("position", F.col("doc_id")), DOCUMENTS), "chosen-documents")


def _selected(spark, sf_dir):
    """(case, questions, chosen, selected): ``selected`` is (question_id, doc_id, start, end, number, phase)."""
    case, questions = _case(spark, sf_dir), materialised(_questions(spark, sf_dir), "questions")
    valued = _valued(case, questions)
    chosen = _chosen(case, questions, valued)
    pairs = chosen.select("question_id", "doc_id")
    sentences = materialised(_sentences(case.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")), "case-sentences")
    ranks = retrieve.sentence_ranks(pairs, sentences.select("doc_id", "position", "text"), questions.select("question_id", "text"), "en")
    spans = sentences.select("doc_id", "position", "start", "end", F.length("text").alias("size"))
    candidates = pairs.join(spans, "doc_id").join(valued.withColumn("by_value", F.lit(True)), ["question_id", "doc_id", "start"], "left")
    candidates = candidates.join(ranks, ["question_id", "doc_id", "position"], "left").withColumn("by_value", F.coalesce("by_value", F.lit(False)))
    selected = retrieve.select_sentences(materialised(candidates.drop("end"), "sentence-candidates"), BUDGET)
    return case, questions, chosen, selected.join(spans.select("doc_id", "start", "end"), ["doc_id", "start"])


SQL_CASE = f"""
nt AS (SELECT o_custkey AS doc_id, min(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY ALL),
cd AS (SELECT doc_id, lang, coalesce(text, '') || CASE WHEN d IS NULL THEN '' ELSE chr(10) || chr(10) || '{NOTE[0].strip()} ' ||
    CASE doc_id % 3 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%B ') || day(d) || strftime(d, ', %Y') ELSE day(d) || strftime(d, ' %B %Y') END || '{NOTE[1]}' END AS text
  FROM documents LEFT JOIN nt USING (doc_id)),
qu AS (SELECT item_id, b.text || CASE WHEN d IS NULL THEN '' ELSE ' Entered ' || strftime(d, '%Y-%m-%d') END AS text, b.text AS passage, d FROM benchmark b LEFT JOIN nt ON nt.doc_id = item_id + 1),
{SQL_TERMS.strip().replace('FROM documents', 'FROM cd').replace('FROM benchmark', 'FROM qu')},
dd AS (SELECT doc_id, d FROM documents JOIN nt USING (doc_id)),
ev AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS place FROM qu JOIN dd USING (d)),
sp AS (SELECT item_id, doc_id, 0 AS phase, place FROM ev WHERE place <= {DOCUMENTS} UNION ALL SELECT item_id, doc_id, 1, rank FROM r WHERE rank <= {2 * DOCUMENTS}),
ch AS (SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY spot) AS INT) AS rank
  FROM (SELECT item_id, doc_id, min(struct_pack(a := phase, b := place)) AS spot FROM sp GROUP BY ALL) QUALIFY rank <= {DOCUMENTS})
"""
_MARK = r"[.!?]+[\"''”»)\]]*\s+|\n{2,}"
_LETTERS = "A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż"
_STRIPPED = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
SQL_SELECTED = rf"""{SQL_CASE.strip()},
tx AS MATERIALIZED (SELECT doc_id, text, string_split(regexp_replace(text, '({_MARK})', '\1' || chr(57344), 'g'), chr(57344)) AS ps FROM cd WHERE doc_id IN (SELECT doc_id FROM ch)),
pc AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i, len(ps) AS k FROM tx),
pe AS (SELECT doc_id, i, k, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e,
    substr(piece, 1, length(piece) - length(regexp_extract(piece, '(?:{_MARK})$')) + 1) AS head FROM pc),
pw AS (SELECT *, lower(regexp_replace(regexp_extract(head, '([{_LETTERS}.]+)\.?\s*$', 1), '\.+$', '')) AS word FROM pe),
cl AS MATERIALIZED (SELECT doc_id, e, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM pw
  WHERE i = k OR NOT (list_contains({sql_list(txt.ABBREVIATIONS_EN)}, word) OR regexp_matches(word, '^\p{{L}}$'))),
rs AS (SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e, CAST(0 AS BIGINT) AS onward, false AS closed FROM tx
  UNION ALL SELECT doc_id, c.n, rs.onward, c.e, CASE WHEN z.long THEN c.e ELSE rs.onward END, z.long
  FROM rs JOIN cl c USING (doc_id) JOIN tx USING (doc_id), LATERAL (SELECT length({_STRIPPED.format('substr(text, rs.onward + 1, c.e - rs.onward)')}) >= 25 AS long) z WHERE c.n = rs.n + 1),
sn AS (SELECT doc_id, s + length(body) - length(regexp_replace(body, '^[\s\p{{Z}}]+', '')) AS start, {_STRIPPED.format('body')} AS line
  FROM (SELECT doc_id, s, substr(text, s + 1, e - s) AS body FROM rs JOIN tx USING (doc_id) WHERE closed)),
us AS MATERIALIZED (SELECT doc_id, start, start + length(line) AS stop, line, length(line) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS position,
    coalesce(try_strptime(regexp_extract(line, '\b\d{{4}}-\d{{2}}-\d{{2}}\b'), '%Y-%m-%d'), try_strptime(regexp_extract(line, '\b[A-Z][a-z]+ \d{{1,2}}, \d{{4}}\b'), '%B %-d, %Y'),
      try_strptime(regexp_extract(line, '\b\d{{1,2}} [A-Z][a-z]+ \d{{4}}\b'), '%-d %B %Y')) AS d, {sql_tokens('line', True)} AS terms
  FROM sn WHERE length(line) >= 30 AND NOT regexp_matches(line, '<[^>]{{1,80}}>')
    AND length(line) - length(replace(line, '_', '')) <= 3 AND length(line) - length(replace(line, '|', '')) <= 2
    AND (length(line) - length(regexp_replace(line, '[\p{{L}}\s]', '', 'g')))::DOUBLE / length(line) >= 0.62::DOUBLE AND len(regexp_extract_all(line, '\p{{L}}{{3,}}')) >= 5),
nq AS (SELECT item_id, count(*) AS n, sum(len(terms))::DOUBLE / count(*) AS avg_len FROM ch JOIN us USING (doc_id) GROUP BY item_id),
tq AS (SELECT doc_id, position, unit_len, term, count(*) AS tf FROM (SELECT doc_id, position, len(terms) AS unit_len, unnest(terms) AS term FROM us) GROUP BY ALL),
hq AS (SELECT item_id, doc_id, position, term, times, tf, unit_len FROM a JOIN ch USING (item_id) JOIN tq USING (doc_id, term)),
dq AS (SELECT item_id, term, count(*) AS df FROM hq GROUP BY ALL),
sq AS (SELECT item_id, doc_id, position, round(sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE)
    / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * unit_len / CASE WHEN avg_len > 0 THEN avg_len ELSE 1 END))), 6) AS score
  FROM hq JOIN dq USING (item_id, term) JOIN nq USING (item_id) GROUP BY ALL),
rq AS (SELECT item_id, doc_id, position, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, position) AS rank FROM sq WHERE score > 0 QUALIFY rank <= 120),
ca AS MATERIALIZED (SELECT item_id, doc_id, position, start, size, us.d IS NOT NULL AND us.d = qu.d AS valued, rank, row_number() OVER (PARTITION BY item_id ORDER BY doc_id, start) AS reading
  FROM (SELECT item_id, doc_id FROM ch) JOIN us USING (doc_id) JOIN qu USING (item_id) LEFT JOIN rq USING (item_id, doc_id, position)),
fa AS MATERIALIZED (SELECT item_id, doc_id, position, 1 AS kind, rank AS place FROM ca WHERE rank IS NOT NULL UNION ALL
  SELECT item_id, doc_id, position, 0, row_number() OVER (PARTITION BY item_id ORDER BY reading) FROM ca WHERE valued),
an AS (SELECT * FROM fa UNION ALL SELECT item_id, doc_id, position, 2, reading FROM ca WHERE reading <= 6 AND item_id NOT IN (SELECT item_id FROM fa)),
tu AS (SELECT * FROM (VALUES (0, 0, 0), (1, 0, -1), (1, 1, 1), (2, 0, -2), (2, 1, 2)) v(phase, side, delta)),
re AS MATERIALIZED (SELECT an.item_id, ca.doc_id, ca.start, ca.size + 6 AS cost, phase, row_number() OVER (PARTITION BY an.item_id ORDER BY phase, kind, place, side) AS turn
  FROM an, tu, ca WHERE ca.item_id = an.item_id AND ca.doc_id = an.doc_id AND ca.position = an.position + tu.delta),
fo AS (SELECT item_id, CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS start, 0 AS phase, CAST(0 AS BIGINT) AS used, false AS closed, CAST([] AS VARCHAR[]) AS taken, false AS took FROM qu
  UNION ALL SELECT item_id, q.turn, q.doc_id, q.start, q.phase, fo.used + CASE WHEN z.took THEN q.cost ELSE 0 END, z.closed, CASE WHEN z.took THEN list_append(fo.taken, y.key) ELSE fo.taken END, z.took
  FROM fo JOIN re q USING (item_id), LATERAL (SELECT q.doc_id || ':' || q.start AS key, len(fo.taken) > 0 AND fo.used + q.cost > {BUDGET} AS late) y,
    LATERAL (SELECT fo.closed OR (y.late AND q.phase = 0 AND NOT list_contains(fo.taken, y.key)) AS closed,
      NOT (y.late OR ((fo.closed OR y.late) AND q.phase = 0) OR list_contains(fo.taken, y.key)) AS took) z WHERE q.turn = fo.turn + 1),
se AS (SELECT fo.item_id, fo.doc_id, fo.start, us.stop, fo.phase, line, us.d, row_number() OVER (PARTITION BY item_id ORDER BY fo.doc_id, fo.start) AS number
  FROM fo JOIN us ON us.doc_id = fo.doc_id AND us.start = fo.start WHERE took)
"""


@query("chosen_documents", f"WITH {SQL_CASE} SELECT item_id AS question_id, doc_id, rank FROM ch")
def chosen_documents(spark, sf_dir):
    """The four documents of every question: those that hold its date in any spelling, then the best by BM25."""
    questions = _questions(spark, sf_dir)
    case = _case(spark, sf_dir)
    return _chosen(case, questions, _valued(case, questions))


@query(
    "sentence_selection",
    f"""WITH RECURSIVE {SQL_SELECTED} SELECT item_id AS question_id, doc_id, CAST(start AS INT) AS start, CAST(stop AS INT) AS "end", CAST(number AS INT) AS number, phase FROM se""",
)
def sentence_selection(spark, sf_dir):
    """Sentences of each question's documents under a budget: those with its date, the best ranked, then their neighbours."""
    return _selected(spark, sf_dir)[3].select("question_id", "doc_id", "start", "end", "number", "phase")


@query(
    "retrieval_recall",
    f"""WITH RECURSIVE {SQL_SELECTED},
    go AS (SELECT item_id, doc_id, lang, strpos(cd.text, passage) - 1 AS a, strpos(cd.text, passage) - 1 + length(passage) AS z FROM qu JOIN cd ON length(passage) > 0 AND contains(cd.text, passage)),
    hi AS (SELECT item_id, doc_id, lang, EXISTS (SELECT 1 FROM ch WHERE ch.item_id = go.item_id AND ch.doc_id = go.doc_id) AS chosen,
      EXISTS (SELECT 1 FROM se WHERE se.item_id = go.item_id AND se.doc_id = go.doc_id AND least(se.stop, go.z) > greatest(se.start, go.a)) AS reached FROM go)
    SELECT lang, CAST(count(*) AS BIGINT) AS cases, CAST(count(*) FILTER (chosen) AS BIGINT) AS chosen, CAST(count(*) FILTER (reached) AS BIGINT) AS reached,
      round(avg(CASE WHEN reached THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall FROM hi GROUP BY lang""",
)
def retrieval_recall(spark, sf_dir):
    """How often the passage that answers a question was among the sentences shown, by language.

    A case is a document that holds the passage; it is reached where a selected sentence of that document overlaps it.
    """
    case, questions, chosen, selected = _selected(spark, sf_dir)
    quoted = questions.select(F.col("question_id").alias("quote_id"), F.col("passage").alias("quoted"))
    gold = contain.first_occurrence(case, quoted, tolerant=False).withColumnRenamed("quote_id", "question_id")
    spans = selected.select("question_id", "doc_id", F.col("start").alias("from"), F.col("end").alias("upto"))
    shown = gold.join(spans, ["question_id", "doc_id"]).where(F.least("end", "upto") > F.greatest("start", "from"))  # a budget bounds the spans of a question
    shown = shown.select("question_id", "doc_id").distinct().withColumn("reached", F.lit(1))
    cases = gold.join(shown, ["question_id", "doc_id"], "left").join(chosen.select("question_id", "doc_id", F.lit(1).alias("chosen")), ["question_id", "doc_id"], "left")
    cases = cases.join(case.select("doc_id", "lang"), "doc_id")
    return cases.groupBy("lang").agg(
        F.count(F.lit(1)).alias("cases"), F.count("chosen").alias("chosen"), F.count("reached").alias("reached"),
        F.round(F.avg(F.coalesce("reached", F.lit(0))), 6).alias("recall"),
    )


@query(
    "escalation_gate",
    f"""WITH {SQL_CASE} SELECT item_id AS question_id, qu.d IS NULL OR EXISTS (SELECT 1 FROM dd WHERE dd.d = qu.d AND NOT EXISTS
      (SELECT 1 FROM ch WHERE ch.item_id = qu.item_id AND ch.doc_id = dd.doc_id)) AS escalate FROM qu""",
)
def escalation_gate(spark, sf_dir):
    """Whether reading on may help: the question names no value, or a document not yet read holds it in some spelling."""
    questions, case = _questions(spark, sf_dir), _case(spark, sf_dir)
    valued = _valued(case, questions)
    unread = valued.select("question_id", "doc_id").distinct().join(_chosen(case, questions, valued), ["question_id", "doc_id"], "left_anti")
    unread = unread.select("question_id").distinct().withColumn("unread", F.lit(True))
    asked = questions.select("question_id", (F.size(anchors.compound(F.col("text"))) == 0).alias("free"))
    return asked.join(unread, "question_id", "left").select("question_id", (F.col("free") | F.col("unread").isNotNull()).alias("escalate"))


@query(
    "any_pick_anchored",
    f"""WITH RECURSIVE {SQL_SELECTED} SELECT qu.item_id AS question_id, coalesce(bool_or(qu.d IS NULL OR coalesce(se.d = qu.d, false)), false) AS anchored
    FROM qu LEFT JOIN se ON se.item_id = qu.item_id AND se.number % 3 = 1 GROUP BY qu.item_id""",
)
def any_pick_anchored(spark, sf_dir):
    """Whether any picked sentence (every third one shown) carries the question's value; where none does, the escalation starts."""
    case, questions, _, selected = _selected(spark, sf_dir)
    shown = selected.where("number % 3 = 1").join(case, "doc_id").select("question_id", F.expr("substring(text, start + 1, end - start)").alias("quoted"))
    picked = questions.select("question_id", F.col("text").alias("question")).join(shown, "question_id", "left")
    held = F.col("quoted").isNotNull() & anchors.anchored(F.col("question"), F.coalesce("quoted", F.lit("")))
    return picked.groupBy("question_id").agg(F.bool_or(held).alias("anchored"))
