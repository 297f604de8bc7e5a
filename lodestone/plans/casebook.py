"""Benchmark cases over files made of the orders: a customer's file is a sentence for each order, a nation's files are a case."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as txt
from lodestone.operators import casebook
from lodestone.registry import query
from lodestone.session import materialised, table

TRIES, PAIRS, LEVELS = 8, 50, (0.01, 0.03, 0.05, 0.1)


def _files(spark, sf_dir):
    """(case_id, doc_id, text)."""
    d, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    date = F.date_format(d, "MMMM d, yyyy")
    amount = F.concat(F.lit("$"), F.format_number(F.floor("o_totalprice"), 0), F.lit(".50"))
    docket = F.concat(F.pmod(key, F.lit(10)), F.lit(":"), F.date_format(d, "yy"), F.lit("-cv-"), F.lpad(F.pmod("o_custkey", F.lit(100_000)).cast("string"), 5, "0"))
    form = F.pmod(key, F.lit(4))
    sentence = (
        F.when(form == 0, F.concat(F.lit("The court entered the order of "), date, F.lit(" in the docket of the plaintiff without further notice.")))
        .when(form == 1, F.concat(F.lit("The plaintiff claims "), amount, F.lit(" in damages under the order that the court entered on "), date, F.lit(" here.")))
        .when(form == 2, F.concat(F.lit("The period for the defendant to answer is "), F.pmod(key, F.lit(90)) + 3, F.lit(" days from service of the order in this matter.")))
        .otherwise(F.concat(F.lit("The clerk opened docket "), docket, F.lit(" for the appeal of the defendant against the order of the court.")))
    )
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", sentence.alias("s"))
    files = orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "s"))).alias("x"))
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("case_id"))
    return files.join(cases, "doc_id").select("case_id", "doc_id", F.array_join(F.transform("x", lambda x: x["s"]), " ").alias("text"))


def _pairs(spark, sf_dir):
    files = materialised(_files(spark, sf_dir), "case-files")
    sentences = files.select("case_id", "doc_id", F.explode(txt.sentences(F.col("text"), F.lit("en"))).alias("s")).select("case_id", "doc_id", "s.start", "s.end", "s.text")
    return files, casebook.matched_pairs(files, sentences, PAIRS, tries=TRIES)


_MONTHS = "[" + ", ".join(f"'{m}'" for m in casebook.MONTHS) + "]"
_DRAWN = "CAST('0x' || substr(md5(value || '|42|' || attempt), {}, 8) AS BIGINT) AS h{}"


def _question(value: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{q}'" for k, q in casebook.QUESTIONS.items())
    return f"replace(CASE kind {whens} END, '{{}}', {value})"


SQL_PAIRS = rf"""
o AS (SELECT o_orderkey, o_custkey, c_nationkey AS case_id, CAST(o_orderdate AS DATE) AS d, o_orderkey % 4 AS form, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey),
v AS (SELECT *, strftime(d, '%B ') || day(d) || strftime(d, ', %Y') AS date, '$' || format('{{:,}}', CAST(floor(o_totalprice) AS BIGINT)) || '.50' AS amount, (o_orderkey % 90 + 3) || ' days' AS period,
    (o_orderkey % 10) || ':' || strftime(d, '%y') || '-cv-' || lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') AS docket FROM o),
s AS (SELECT *, CASE form WHEN 0 THEN 'The court entered the order of ' || date || ' in the docket of the plaintiff without further notice.'
    WHEN 1 THEN 'The plaintiff claims ' || amount || ' in damages under the order that the court entered on ' || date || ' here.'
    WHEN 2 THEN 'The period for the defendant to answer is ' || period || ' from service of the order in this matter.'
    ELSE 'The clerk opened docket ' || docket || ' for the appeal of the defendant against the order of the court.' END AS text FROM v),
p AS (SELECT *, CAST(sum(length(text) + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - length(text) - 1 AS BIGINT) AS start FROM s),
f AS MATERIALIZED (SELECT case_id, o_custkey AS doc_id, string_agg(text, ' ' ORDER BY o_orderkey) AS body FROM s GROUP BY ALL),
w AS MATERIALIZED (SELECT case_id, string_agg(body, chr(10)) AS whole FROM f GROUP BY case_id),
a AS (SELECT case_id, o_custkey AS doc_id, start, text, unnest(CASE form WHEN 0 THEN [struct_pack(turn := 0, kind := 'date', value := date)]
    WHEN 1 THEN [struct_pack(turn := 0, kind := 'amount', value := amount), struct_pack(turn := 1, kind := 'date', value := date)]
    WHEN 2 THEN [struct_pack(turn := 0, kind := 'period', value := period)] ELSE [struct_pack(turn := 0, kind := 'docket', value := docket)] END, recursive := true) FROM p),
u AS MATERIALIZED (SELECT a.* FROM a JOIN w USING (case_id) WHERE length(whole) - length(replace(whole, value, '')) = length(value)),
h AS (SELECT *, {_DRAWN.format(1, 1)}, {_DRAWN.format(9, 2)}, {_DRAWN.format(17, 3)}, {_DRAWN.format(25, 4)} FROM (SELECT u.*, unnest(range({TRIES})) AS attempt FROM u)),
g AS (SELECT *, list_filter(range(1, length(value) + 1), lambda i: substr(value, i, 1) BETWEEN '0' AND '9') AS places, regexp_extract(value, '^(\w+) (\d+)', 2) AS old, list_position({_MONTHS}, regexp_extract(value, '^\w+')) AS m FROM h),
k AS (SELECT *, CASE WHEN len(places) > 2 THEN places[2:] ELSE places END AS free FROM g),
i AS (SELECT *, h1 % len(free) AS i1, (h1 % len(free) + 1 + h2 % greatest(len(free) - 1, 1)) % len(free) AS i2, 1 + CASE WHEN CAST(old AS INT) > 28 THEN h2 % 28 ELSE h2 % 27 END AS nd FROM (SELECT * REPLACE (CASE WHEN old = '' THEN '0' ELSE old END AS old) FROM k)),
j AS (SELECT *, free[i1 + 1] AS p1, free[i2 + 1] AS p2, CAST(nd + CASE WHEN CAST(old AS INT) <= 28 AND nd >= CAST(old AS INT) THEN 1 ELSE 0 END AS VARCHAR) AS newday FROM i),
l AS (SELECT *, substr(value, 1, p1 - 1) || ((CAST(substr(value, p1, 1) AS INT) + 3 + h3 % 4) % 10) || substr(value, p1 + 1) AS once FROM j),
z AS (SELECT *, CASE WHEN kind = 'date' THEN {_MONTHS}[(m + h1 % 11) % 12 + 1] || ' ' || CASE WHEN length(old) = 1 THEN newday ELSE lpad(newday, 2, '0') END || substr(value, length(value) - 5)
    WHEN i1 = i2 THEN once ELSE substr(once, 1, p2 - 1) || ((CAST(substr(once, p2, 1) AS INT) + 3 + h4 % 4) % 10) || substr(once, p2 + 1) END AS twin FROM l),
e AS (SELECT case_id, doc_id, start, min(struct_pack(turn, attempt, kind, value, twin, text)) AS x FROM z JOIN w USING (case_id) WHERE twin <> value AND NOT contains(whole, twin) GROUP BY ALL),
b AS MATERIALIZED (SELECT case_id, doc_id, start, x.kind AS kind, x.value AS value, x.twin AS twin, x.text AS text,
    substr(sha256(concat_ws('|', case_id, doc_id, start, x.value)), 1, 12) AS ida, substr(sha256(concat_ws('|', case_id, doc_id, start, x.twin, 'b')), 1, 12) AS idb FROM e
    QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY CAST('0x' || substr(md5(concat_ws('|', doc_id, '42')), 1, 8) AS BIGINT), doc_id, start) <= {PAIRS})
"""


@query(
    "matched_pairs",
    f"""WITH {SQL_PAIRS} SELECT case_id, ida AS id, idb AS pair_id, 'anchored_fact' AS category, 'cite' AS expected, kind, value AS anchor, {_question('value')} AS question,
      doc_id, CAST(start AS INT) AS start, CAST(start + length(text) AS INT) AS "end", text AS sentence FROM b
    UNION ALL SELECT case_id, idb, ida, CASE WHEN kind IN ('amount', 'period') THEN 'number_trap' ELSE 'no_cover' END, 'refuse', kind, twin, {_question('twin')}, NULL, NULL, NULL, NULL FROM b""",
)
def matched_pairs(spark, sf_dir):
    """Questions on anchors that stand once in a case's files, each with a twin on a like value that stands nowhere in them."""
    return _pairs(spark, sf_dir)[1]


@query(
    "leakage_cases",
    f"""WITH {SQL_PAIRS}, q AS (SELECT a.case_id, doc_id, start, min(struct_pack(turn, kind, value)) AS x FROM a LEFT JOIN w t ON t.case_id = (a.case_id + 1) % 25
        WHERE NOT coalesce(contains(whole, value), false) GROUP BY a.case_id, doc_id, start),
      n AS (SELECT case_id, CAST((case_id + 1) % 25 AS BIGINT) AS target_id, doc_id, start, x.kind AS kind, x.value AS value FROM q
        QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY CAST('0x' || substr(md5(concat_ws('|', doc_id, '42')), 1, 8) AS BIGINT), doc_id, start) <= 20)
    SELECT substr(sha256(concat_ws('|', 'leakage', target_id, doc_id, start, value)), 1, 12) AS id, CAST(case_id AS BIGINT) AS case_id, target_id, 'leakage' AS category, 'refuse' AS expected,
      kind, value AS anchor, {_question('value')} AS question FROM n""",
)
def leakage_cases(spark, sf_dir):
    """Facts of every nation's files asked for in the next nation's, where they do not stand."""
    files = materialised(_files(spark, sf_dir).withColumn("case_id", F.col("case_id").cast("long")), "leak-files")
    sentences = files.select("case_id", "doc_id", F.explode(txt.sentences(F.col("text"), F.lit("en"))).alias("s")).select("case_id", "doc_id", "s.start", "s.end", "s.text")
    targets = files.select("case_id").distinct().withColumn("target_id", F.pmod(F.col("case_id") + 1, F.lit(25)).cast("long"))
    return casebook.leakage_cases(files, sentences, targets)


@query(
    "anchor_occurrences",
    rf"""WITH {SQL_PAIRS},
    cc AS (SELECT *, CASE kind WHEN 'date' THEN strftime(strptime(value, '%B %-d, %Y'), '%Y-%m-%d') ELSE value END AS canon FROM b),
    li AS (SELECT ida AS id, doc_id, greatest(0, start + strpos(text, value) - 1 - 100) AS s, least(length(body), start + strpos(text, value) - 1 + length(value) + 400) AS t FROM cc JOIN f USING (case_id, doc_id)),
    sg AS (SELECT case_id, doc_id, unnest(string_split_regex(body, '[\n.!?]')) AS seg, generate_subscripts(string_split_regex(body, '[\n.!?]'), 1) AS n FROM f),
    so AS (SELECT *, sum(length(seg) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(seg) - 1 AS off FROM sg),
    va AS (SELECT case_id, doc_id, off AS s, off + length(seg) AS t, unnest(list_concat(list_transform(regexp_extract_all(seg, '[A-Z][a-z]+ \d{{1,2}}, \d{{4}}'), lambda x: strftime(strptime(x, '%B %-d, %Y'), '%Y-%m-%d')),
      list_concat(regexp_extract_all(seg, '\d{{1,3}} days'), regexp_extract_all(seg, '\d:\d{{2}}-cv-\d{{5}}')))) AS canon FROM so),
    al AS (SELECT id, doc_id, s, t FROM li UNION ALL SELECT DISTINCT ida, va.doc_id, va.s, va.t FROM cc JOIN va USING (case_id, canon)),
    fr AS (SELECT *, CASE WHEN s > max(t) OVER (PARTITION BY id, doc_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM al),
    il AS (SELECT *, sum(fresh) OVER (PARTITION BY id, doc_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS island FROM fr)
    SELECT id, doc_id, CAST(min(s) AS INT) AS start, CAST(max(t) AS INT) AS "end" FROM il GROUP BY id, doc_id, island""",
)
def anchor_occurrences(spark, sf_dir):
    """Every stretch that may truly be cited for an answerable case's anchor, in its own or any other spelling."""
    files, pairs = _pairs(spark, sf_dir)
    cases = pairs.where("expected = 'cite'").select("id", "case_id", "anchor")
    return casebook.true_places(files, cases)


_TABLE = ", ".join(f"('{name}', '{a}', '{b}')" for name, a, b in casebook.confusions("en"))
SQL_NOISE = f"""
lv AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in LEVELS)}]) AS level),
cf AS (SELECT * FROM (VALUES {_TABLE}) v(class, before, after)),
ps AS (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS pos FROM benchmark),
cd AS MATERIALIZED (SELECT item_id, pos, length(before) AS width, after, class, row_number() OVER (PARTITION BY item_id ORDER BY md5('42|' || (pos - 1) || '|' || before), pos, before) AS n
  FROM ps JOIN cf ON substr(text, pos, length(before)) = before),
fo AS (SELECT item_id, level, greatest(1, CAST(floor(length(text) * level) AS BIGINT)) AS budget, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS taken, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS width, '' AS after, '' AS class, false AS took
    FROM benchmark, lv WHERE text IS NOT NULL
  UNION ALL SELECT item_id, level, budget, cd.n, CASE WHEN z.ok THEN list_concat(taken, range(cd.pos, cd.pos + cd.width)) ELSE taken END, cd.pos, cd.width, cd.after, cd.class, z.ok
  FROM fo JOIN cd USING (item_id), LATERAL (SELECT NOT list_has_any(fo.taken, range(cd.pos, cd.pos + cd.width)) AS ok) z WHERE cd.n = fo.n + 1 AND len(fo.taken) < fo.budget),
tk AS MATERIALIZED (SELECT item_id, level, pos, width, after, class FROM fo WHERE took),
nz AS (SELECT item_id, level, string_agg(coalesce(tk.after, CASE WHEN EXISTS (SELECT 1 FROM tk c WHERE c.item_id = ps.item_id AND c.level = lv.level AND c.pos < ps.pos AND c.pos + c.width > ps.pos) THEN '' ELSE substr(text, pos, 1) END), '' ORDER BY pos) AS noised,
    length(any_value(text)) AS size FROM ps CROSS JOIN lv LEFT JOIN tk USING (item_id, level, pos) GROUP BY ALL),
ct AS (SELECT item_id, level, sum(width) AS changed, coalesce(sum(width) FILTER (class = 'digits'), 0) AS digits FROM tk GROUP BY ALL),
ns AS (SELECT item_id, level, coalesce(noised, '') AS noised, coalesce(changed, 0) AS changed, coalesce(digits, 0) AS digits, coalesce(length(text), 0) AS size
  FROM (SELECT item_id, text, level FROM benchmark, lv) LEFT JOIN nz USING (item_id, level) LEFT JOIN ct USING (item_id, level))
"""


def _noised(spark, sf_dir):
    return casebook.noise_sweep(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("text_id"), "text"), LEVELS)


@query(
    "noised_texts",
    f"WITH RECURSIVE {SQL_NOISE} SELECT item_id AS text_id, level, noised, CAST(changed AS INT) AS changed, CAST(digits AS INT) AS digits FROM ns",
)
def noised_texts(spark, sf_dir):
    """Every passage with the confusions of a scanner at four levels of error."""
    return _noised(spark, sf_dir).select("text_id", "level", "noised", "changed", "digits")


@query(
    "noise_levels",
    f"""WITH RECURSIVE {SQL_NOISE} SELECT level, count(*) AS texts, round(avg(changed::DOUBLE / size), 6) AS error, CAST(sum(digits) AS BIGINT) AS digits,
      CAST(max(changed - greatest(1, floor(size * level))) AS BIGINT) AS most_over FROM ns WHERE size > 0 GROUP BY level""",
)
def noise_levels(spark, sf_dir):
    """The error that each level really made; a confusion of two characters may exceed a text's budget by one."""
    over = (F.col("changed") - F.greatest(F.lit(1), F.floor(F.col("size") * F.col("level")))).cast("long")
    return _noised(spark, sf_dir).where("size > 0").groupBy("level").agg(
        F.count(F.lit(1)).alias("texts"), F.round(F.avg(F.col("changed") / F.col("size")), 6).alias("error"),
        F.sum("digits").cast("long").alias("digits"), F.max(over).alias("most_over"),
    )
