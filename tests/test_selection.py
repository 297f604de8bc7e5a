"""Containment, sentences and the budget walk against plain Python."""

import random
import re

import pytest

from lodestone.functions import text as txt
from lodestone.operators import contain, retrieve


def plain_occurrences(docs, quotes, tolerant):
    def form(t):
        if not tolerant:
            return t, list(range(len(t)))
        t = t.translate(str.maketrans(*txt.VARIANTS)).lower()
        spots = [m.start() for m in re.finditer(r"\s+|\S", t)]
        out = "".join(" " if t[i].isspace() else t[i] for i in spots)
        left, right = len(out) - len(out.lstrip()), len(out.rstrip())
        return out[left:right], spots[left:right]

    found = []
    for q, quoted in quotes:
        want = form(quoted or "")[0]
        for d, t in docs:
            whole, spots = form(t or "")
            at = whole.find(want) if want else -1
            while at >= 0:
                found.append((q, d, spots[at], spots[at + len(want) - 1] + 1))
                at = whole.find(want, at + 1)
    return sorted(found)


@pytest.mark.parametrize("tolerant", [True, False])
def test_occurrences_equal_plain_python(spark, tolerant):
    rnd = random.Random(3)
    words = ["ab", "Abc", "“q”", "d’e", "–", " ", "łŁ", "漢", "aa", "aaa"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", "  ", "\n", ""]) for _ in range(n))
    docs = [(i, text(rnd.choice([0, 3, 30, 200]))) for i in range(30)] + [(90, None), (91, " " * 50), (92, "aaaa" * 30)]
    quotes = [(1, None), (2, ""), (3, "   "), (4, "aaaa"), (5, "a" * 40), (6, "ABC"), (7, "not there at all, whatever is written")]
    for k in range(10, 60):
        t = docs[rnd.randrange(30)][1]
        a = rnd.randrange(len(t) + 1)
        piece = t[a : a + rnd.choice([1, 5, 16, 17, 33, 80])]
        quotes.append((k, piece.upper().replace(" ", " \n") if tolerant and k % 2 else piece))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    out = contain.occurrences(frame, spark.createDataFrame(quotes, "quote_id long, quoted string"), tolerant)
    assert sorted(tuple(r) for r in out.collect()) == plain_occurrences(docs, quotes, tolerant)


def test_occurrences_of_nothing(spark):
    docs, quotes = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "some words")], "quote_id long, quoted string")
    assert contain.occurrences(docs, quotes).count() == 0 and contain.occurrences(docs, quotes.limit(0)).count() == 0


def test_plans_of_containment_have_no_nested_loop(spark, sf):
    from lodestone import registry

    for name in ("statute_match", "verify_citations", "passage_locate"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name


def test_sentence_spans():
    text = "Mr. Smith v. Jones was heard on Oct. 6, 2016 in court. Short one. Then it went on!\n\nA heading\n\nThe rest has no end mark"
    spans = txt.sentence_spans(text, True)
    assert [text[a:b] for a, b in spans] == [
        "Mr. Smith v. Jones was heard on Oct. 6, 2016 in court.", "Short one. Then it went on!", "A heading\n\nThe rest has no end mark",
    ]
    assert txt.sentence_spans("", True) == [] and txt.sentence_spans(" \n\n ", False) == [] and txt.sentence_spans("tiny.", True) == []
    long = "Sentence number one stands here. " * 20_000
    assert len(txt.sentence_spans(long, True)) == 20_000


def plain_walk(rows, budget, most=120):
    """rows of one question: (doc, position, start, size, valued, rank)."""
    rows = sorted(rows, key=lambda r: (r[0], r[2]))
    valued, ranked = [r for r in rows if r[4]], sorted((r for r in rows if r[5] is not None), key=lambda r: r[5])[:most]
    anchors = valued + ranked if ranked else valued or rows[:6]
    taken, used = {}, 0

    def take(r, phase):
        nonlocal used
        if r[:2] not in taken:
            if taken and used + r[3] + 6 > budget:
                return False
            taken[r[:2]] = (phase, r[2])
            used += r[3] + 6
        return True

    for r in anchors:
        if not take(r, 0):
            break
    at = {r[:2]: r for r in rows}
    for step in (1, 2):
        for r in anchors:
            for p in (r[1] - step, r[1] + step):
                if (r[0], p) in at:
                    take(at[r[0], p], step)
    return sorted((d, s, phase) for (d, _), (phase, s) in taken.items())


def test_budget_walk_equals_plain_python(spark):
    rnd = random.Random(9)
    rows, want = [], {}
    for q in range(25):
        own = []
        ranks = rnd.sample(range(1, 60), 59)
        for d in range(rnd.choice([1, 3])):
            for p in range(rnd.choice([1, 4, 15])):
                rank = ranks.pop() if q % 5 and rnd.random() < 0.3 else None
                own.append((d, p, p * 100, rnd.choice([10, 60, 300, 2000]), q % 3 == 0 and rnd.random() < 0.1, rank))
        want[q] = plain_walk(own, 700)
        rows += [(q, *r) for r in own]
    df = spark.createDataFrame(rows, "question_id long, doc_id long, position int, start int, size int, by_value boolean, rank int")
    got = {}
    for r in retrieve.select_sentences(df, budget=700).orderBy("question_id", "number").collect():
        got.setdefault(r["question_id"], []).append((r["doc_id"], r["start"], r["phase"]))
    assert got == want


def test_the_best_by_blocks_equal_the_ranking_of_all_pairs(spark):
    rnd = random.Random(8)
    words = [f"word{chr(97 + i)}" for i in range(26)]
    text = lambda n: " ".join(rnd.choice(words[: rnd.choice([3, 26])]) for _ in range(n))
    docs = [(i, text(rnd.choice([1, 4, 9, 30]))) for i in range(60)]
    docs += [(i + 100, t) for i, t in docs[:25]] + [(200, None), (201, ""), (None, docs[3][1]), (None, docs[4][1])]
    asked = [(i, text(rnd.choice([1, 5, 20]))) for i in range(30)] + [(40, None), (41, "zzzz"), (42, "worda worda worda wordb")]
    docs, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(asked, "item_id long, text string")
    rows = lambda df: sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()))
    for k in (3, 200):
        want = rows(retrieve.top_k(retrieve.bm25(docs, "doc_id", asked, "item_id", "en"), "item_id", "score", k, "doc_id"))
        for block in ((4096, 1024), (7, 5)):
            assert rows(retrieve.bm25_top_k(docs, "doc_id", asked, "item_id", k, "en", block)) == want
    assert retrieve.bm25_top_k(docs.limit(0), "doc_id", asked, "item_id", 3, "en").count() == 0
    assert retrieve.bm25_top_k(docs, "doc_id", asked.limit(0), "item_id", 3, "en").count() == 0


def test_document_choice_makes_no_row_for_a_pair_that_merely_shares_a_word(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lodestone.plans import case

    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("common words stand here "), F.col("id").cast("string")).alias("text"))
    asked = spark.range(40).select(F.col("id").alias("question_id"), F.lit("common words asked").alias("text"))
    ranked = []
    monkeypatch.setattr(case.answer, "chosen_documents", lambda by_value, by_score, k: ranked.append(by_score) or by_score)
    case._chosen(docs, asked, spark.createDataFrame([], "question_id long, doc_id long, start int"))
    assert ranked[0].count() == 40 * 2 * case.DOCUMENTS  # of 2000 pairs
