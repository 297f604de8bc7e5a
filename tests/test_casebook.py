"""Pairs, places and noise of benchmark cases."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as txt
from lodestone.operators import casebook


def test_pairs_name_each_other_and_twins_stand_nowhere(spark):
    text = ("The court entered the order of January 2, 1996 in the docket of the plaintiff without notice. "
            "The plaintiff claims $12,345.50 in damages under the order that was entered and not appealed. "
            "The period for the defendant to answer is 14 days from service of the order in this matter. ")  # fmt: skip
    files = spark.createDataFrame([(1, 10, text + "Again the period of 14 days was granted to the defendant by the court."), (2, 20, text)], "case_id int, doc_id long, text string")
    sentences = files.select("case_id", "doc_id", F.explode(txt.sentences(F.col("text"), F.lit("en"))).alias("s")).select("case_id", "doc_id", "s.start", "s.end", "s.text")
    rows = casebook.matched_pairs(files, sentences, pairs=50).collect()
    by_id, texts = {r["id"]: r for r in rows}, {r["case_id"]: r["text"] for r in files.collect()}
    assert len(by_id) == len(rows) and all(by_id[r["pair_id"]]["pair_id"] == r["id"] for r in rows)
    for r in rows:
        assert texts[r["case_id"]].count(r["anchor"]) == (1 if r["expected"] == "cite" else 0) and r["anchor"] in r["question"]
        if r["expected"] == "cite":
            assert texts[r["case_id"]][r["start"] : r["end"]] == r["sentence"]
    kinds = lambda case: sorted(r["kind"] for r in rows if r["case_id"] == case and r["expected"] == "cite")
    assert kinds(1) == ["amount", "date"] and kinds(2) == ["amount", "date", "period"]
    assert casebook.matched_pairs(files, sentences, pairs=1).count() == 4


@pytest.mark.parametrize("kind, value", [("date", "January 31, 1996"), ("date", "May 09 2018"), ("amount", "$1,008.00"), ("docket", "2:18-cr-00422"), ("period", "7 days"), ("period", "no digit")])
def test_twins_keep_the_shape(kind, value):
    twins = {casebook.twin_of(value, kind, f"42|{k}") for k in range(60)}
    shape = lambda v: "".join("0" if c.isdigit() else c for c in v)
    if kind == "date":
        assert all(t.split()[0] in casebook.MONTHS and t.endswith(value[-4:]) and t != value for t in twins) and len(twins) > 30
        assert all(1 <= int(t.split()[1].strip(",")) <= 28 for t in twins)
    elif any(c.isdigit() for c in value):
        assert {shape(t) for t in twins} == {shape(value)} and value not in twins
    else:
        assert twins == {value}


def test_places_are_united_and_found_in_any_spelling(spark):
    text = "x " * 200 + "It was signed on January 2, 1996 by the clerk of the court. Later it was cited as of 2 January 1996 in full. " + "y " * 400
    files = spark.createDataFrame([(1, 10, text), (2, 20, text)], "case_id int, doc_id long, text string")
    cases = spark.createDataFrame([("a", 1, "January 2, 1996"), ("b", 1, "March 1, 1996")], "id string, case_id int, anchor string")
    (row,) = casebook.true_places(files, cases).collect()
    at = text.index("January 2, 1996")
    assert (row["id"], row["doc_id"]) == ("a", 10) and row["start"] <= at - 100 and row["end"] == at + 15 + 400


def test_values_are_found_in_short_and_long_clauses(spark):
    """A clause counts whole: shorter than a line, longer than a page, and with the value anywhere in it."""
    short, long = "Due 2 January 1996. ", "and so on " * 39 + "as of 2 January 1996 and so on " + "and so on " * 60
    ends = "y" * 790 + ", 2 January 1996"
    texts = [(1, 10, f"Heard. {short}Closed."), (1, 20, f"Heard. {long}. Closed."), (1, 30, ends), (1, 40, f"at 1 $ {'7' * 5000}! 2 Jan 1996"), (1, 50, "3 January 1996"), (1, 60, None)]
    files = spark.createDataFrame(texts, "case_id int, doc_id long, text string")
    cases = spark.createDataFrame([("a", 1, "January 2, 1996"), ("b", 1, "$7,000.50")], "id string, case_id int, anchor string")
    got = sorted((r["id"], r["doc_id"], r["start"], r["end"]) for r in casebook.true_places(files, cases).collect())
    assert got == [("a", 10, 6, 25), ("a", 20, 6, 7 + len(long)), ("a", 30, 0, len(ends)), ("a", 40, 5008, 5019)]


def test_cases_of_amounts_have_places_as_in_the_sql(spark, sf):
    import duckdb

    from lodestone import registry

    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    found = registry.queries()["anchor_occurrences"](spark, sf)
    got = sorted(map(tuple, found.select("id", "doc_id", "start", "end").collect()))
    assert got == sorted(con.execute(registry.oracle_sql()["anchor_occurrences"]).fetchall())
    amounts = con.execute(f"select id from ({registry.oracle_sql()['matched_pairs']}) where expected = 'cite' and kind = 'amount'").fetchall()
    assert amounts and {a for a, in amounts} <= {g[0] for g in got}


def test_united_spans(spark):
    rnd = random.Random(2)
    spans = [(rnd.randrange(3), a, a + rnd.randrange(1, 30)) for a in (rnd.randrange(1000) for _ in range(200))]
    got = sorted(tuple(r) for r in casebook.united(spark.createDataFrame(spans, "k int, start int, end int"), "k").select("k", "start", "end").collect())
    want = []
    for k, a, b in sorted(spans):
        if want and want[-1][0] == k and a <= want[-1][2]:
            want[-1] = (k, want[-1][1], max(want[-1][2], b))
        else:
            want.append((k, a, b))
    assert got == want


@pytest.mark.parametrize("lang", ["en", "pl"])
def test_noise_stays_within_its_budget(lang):
    text = "Sąd w tym clinical wrzasnn 2018 will modern 15 vv OSBZ łódź " * 20
    for level in (0.005, 0.05, 0.3):
        noised, changed, digits = casebook.noised_text(text, level, lang, 42)
        assert noised != text and digits <= changed <= max(1, int(len(text) * level)) + 1
        assert casebook.noised_text(text, level, lang, 42)[0] == noised != casebook.noised_text(text, level, lang, 43)[0]
    assert casebook.noised_text("", 0.1, lang, 1) == ("", 0, 0) and casebook.noised_text(text, 0, lang, 1) == (text, 0, 0)


def test_facts_of_one_case_are_asked_where_they_do_not_stand(spark):
    a = "The court entered the order of January 2, 1996 in the docket of the plaintiff without notice. The plaintiff claims $12,345.50 in damages under the order of January 2, 1996 here."
    b = "The clerk has read of $12,345.50 in the files of the defendant and of nothing else in this matter."
    files = spark.createDataFrame([(1, 10, a), (2, 20, b)], "case_id long, doc_id long, text string")
    sentences = files.select("case_id", "doc_id", F.explode(txt.sentences(F.col("text"), F.lit("en"))).alias("s")).select("case_id", "doc_id", "s.start", "s.end", "s.text")
    targets = spark.createDataFrame([(1, 2), (2, 1), (1, 9)], "case_id long, target_id long")
    rows = casebook.leakage_cases(files, sentences, targets).collect()
    got = sorted((r["case_id"], r["target_id"], r["kind"], r["anchor"]) for r in rows)
    date = "January 2, 1996"
    assert got == [(1, 2, "date", date), (1, 2, "date", date), (1, 9, "amount", "$12,345.50"), (1, 9, "date", date)]
    assert len({r["id"] for r in rows}) == 4 and all(r["expected"] == "refuse" and r["anchor"] in r["question"] for r in rows)
    assert casebook.leakage_cases(files, sentences, targets, most=1).count() == 2


def test_counts_of_strings_equal_plain_python(spark):
    from lodestone.operators import contain

    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice(["$1,2", "14 days", "3 days", "é", "1:96-cv-00001", " ", "漢", "aa"]) for _ in range(n))
    docs = [(i % 3, i, text(rnd.choice([0, 2, 40, 400]))) for i in range(40)] + [(1, 90, None), (2, 91, "x" * 40)]
    values = ["4 days", "$1,2", "a", "é", "漢", "1:96-cv-00001", "x" * 40, "x" * 32, "", "not there", *(docs[k][2][:k] for k in range(3, 40))]
    got = contain.counted(spark.createDataFrame(docs, "case_id int, doc_id long, text string").repartition(3), "case_id", spark.createDataFrame([(v,) for v in values], "value string"))
    every = lambda t, v: sum(t.startswith(v, k) for k in range(len(t)))
    want = {(c, v): n for c in range(3) for v in set(values) - {""} if (n := sum(every(t or "", v) for k, _, t in docs if k == c))}
    assert {(r["case_id"], r["value"]): r["places"] for r in got.collect()} == want


def test_rounds_give_the_same_cases_and_write_no_more_than_they_need(spark, monkeypatch):
    line = "The clerk opened docket 2:96-cv-{:05d} for the appeal of the defendant against the order of the court."
    rows = [(k % 2, k, line.format(k if k % 2 else k % 300)) for k in range(3000)]  # in one case all dockets stand once, in the other several times
    files = spark.createDataFrame([*rows, (0, 5000, line.format(99_999))], "case_id long, doc_id long, text string")
    sentences = files.select("case_id", "doc_id", F.lit(0).alias("start"), F.length("text").alias("end"), "text")
    written, keep = [], casebook.materialised

    def counted(df, name):
        written.append((name, (out := keep(df, name)).count(), out.columns))
        return out

    monkeypatch.setattr(casebook, "materialised", counted)
    monkeypatch.setattr(casebook, "ROUND", 40, raising=False)
    pairs = lambda: sorted(map(repr, casebook.matched_pairs(files, sentences, pairs=10, tries=4).collect()))
    leaks = lambda: sorted(map(repr, casebook.leakage_cases(files, sentences, files.select("case_id", (1 - F.col("case_id")).alias("target_id")).distinct(), 10).collect()))
    some = pairs(), leaks()
    assert len(some[0]) == 2 * 11 and len(some[1]) == 20
    assert sum(n for name, n, _ in written if name == "twins") < 4 * 1500 and not any("text" in c for name, _, c in written if name in ("anchors", "twins", "leak-anchors"))
    monkeypatch.setattr(casebook, "ROUND", 10_000, raising=False)
    assert (pairs(), leaks()) == some
