"""Operators 11 to 13 against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import fill_middle, lexical, neighbours

CLASHES = "digest string, n string, form string, output string, first string, item string, term string, rank string, score string, gid string, vector string, place string"


def documents(spark, rows):
    names = [c.split()[0] for c in CLASHES.split(", ")]
    return spark.createDataFrame([(*r, *["z"] * len(names)) for r in rows], f"doc_id long, text string, {CLASHES}")


# -- fill in the middle ----------------------------------------------------------


def plain_cut(doc_id, text):
    text = text or ""
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(s[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b])
    return (doc_id, n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b])


def test_cuts_equal_plain_python_and_texts_come_back(spark):
    rnd = random.Random(5)
    letters = "ab <PSM>\n<<éł漢\U0001f600"
    rows = [(i, "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 2, 7, 300, 1500])))) for i in range(400)]
    rows += [(None, "no id at all"), (None, None), (3, None), (1000, "<M> marked"), (1001, "long ł " * 60_000), (5, "copy"), (5, "copy"), (6, "copy")]
    out = fill_middle.fill_in_middle(documents(spark, rows)).withColumn("again", fill_middle.restored("output", "form")).collect()
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted([tuple(r)[:6] for r in out], key=key) == sorted([plain_cut(*r) for r in rows], key=key)
    assert sorted((r["doc_id"] or -1, r["again"]) for r in out) == sorted((i or -1, t or "") for i, t in rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_cuts_of_nothing(spark):
    assert fill_middle.fill_in_middle(documents(spark, [])).count() == 0


def test_a_distinct_text_has_one_list(spark):
    rows = spark.createDataFrame([(t,) for t in ["same"] * 50 + ["other", ""]], "text string").select(
        F.unhex(F.sha2("text", 256)).alias("digest"), F.col("text").cast("binary").alias("text")
    )
    assert fill_middle.distinct_text_index(rows.repartition(7)).count() == 3


def test_plain_documents_take_no_part_in_the_join(spark, monkeypatch):
    rows = [(i, f"text {i} ąb😀" * (i % 5)) for i in range(80)] + [(100, None), (101, "a <S> b"), (102, "<P>"), (None, "none")]
    seen = []
    index = fill_middle.distinct_text_index
    monkeypatch.setattr(fill_middle, "distinct_text_index", lambda docs: seen.append(docs.count()) or index(docs))
    out = fill_middle.fill_in_middle(documents(spark, rows)).collect()
    assert seen == [sum(r["form"] != "plain" for r in out)] and seen[0] < 80 and len(out) == len(rows)
    plain = {(r["doc_id"], r["n"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out if r["form"] == "plain"}
    texts = dict(rows)
    assert plain == {(d, len(texts[d] or ""), None, None, texts[d] or "") for d, *_ in plain} and {100, 101, 102} <= {d for d, *_ in plain}


@pytest.mark.parametrize("seed", range(6))
def test_every_boundary_is_selected(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice(["a", "é", "漢", "\U0001f600"][: 1 + seed % 4] if seed < 5 else ["\U0001f600"]) for _ in range(rnd.choice([1, 255, 256, 257, 1500])))
    places = fill_middle.boundaries(text.encode())
    held = fill_middle.elias_fano(places)
    assert [fill_middle.select(i, *held) for i in range(len(places))] == places.tolist() == [len(text[:i].encode()) for i in range(len(text) + 1)]


# -- nearest neighbours ------------------------------------------------------------


def brute_nearest(rows, k, step):
    fine = {(i, tuple(float(x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in fine:
        if q % step == 0:
            cos = lambda b: sum(x * y for x, y in zip(a, b, strict=True)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))  # noqa: E731, B023
            out[q] = sorted((-round(cos(b), 9), i) for i, b in fine if i != q and len(b) == len(a))[:k]
    return out


def embeddings(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "z", "z") for i, v in rows], f"vec_id long, embedding array<{kind}>, gid string, vector string")


def found_by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def test_few_vectors_copies_ties_and_unusable_rows(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 0.0]),
            (8, [float("nan"), 1.0, 1.0]), (9, [float("inf"), 1.0, 1.0]), (None, [1.0, 0.0, 0.0]), (10, [1.0, 1.0, 0.0]), (10, [1.0, 1.0, 0.0]), (50, [1.0, 0.0, 0.0]), (100, [5.0, 1.0])]
    out = found_by_query(neighbours.nearest_vectors(embeddings(spark, rows), F.col("vec_id") % 50 == 0))
    assert [v[1] for v in out[0]] == [1, 2, 50, 10, 3] and [v[0] for v in out[0]] == [1, 2, 3, 4, 5]
    assert [v[1] for v in out[50]] == [0, 1, 2, 10, 3] and 100 not in out
    assert out[0][0][2] == 1.0 and abs(out[0][3][2] - math.sqrt(0.5)) < 1e-12 and out[0][4][2] == 0.0
    assert neighbours.nearest_vectors(embeddings(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    huge = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1e200, -1e200])]
    assert [v[1:] for v in found_by_query(neighbours.nearest_vectors(embeddings(spark, huge, "double"), F.col("vec_id") == 0))[0]] == [(1, pytest.approx(1)), (2, pytest.approx(0))]


@pytest.mark.parametrize("hashes", [1, 2])
def test_recall_against_brute_force(spark, hashes):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16))
    x[300:600] = x[:300] + 0.3 * rng.standard_normal((300, 16))
    x[900:1200] = x[7]  # copies
    rows = [(i, [float(v) for v in np.float32(row)]) for i, row in enumerate(x)]
    want = brute_nearest(rows, 5, 20)
    got = found_by_query(neighbours.nearest_vectors(embeddings(spark, rows).repartition(5), F.col("vec_id") % 20 == 0, hashes=hashes))
    assert set(got) == set(want)
    hits = sum(len({i for _, i in want[q]} & {v[1] for v in got[q]}) for q in want)
    assert hits >= 0.93 * sum(map(len, want.values()))
    for q, near in got.items():
        assert [v[0] for v in near] == [1, 2, 3, 4, 5]
        cos = {i: -c for c, i in brute_nearest([rows[q], *[rows[v[1]] for v in near]], 5, 20)[q]}
        assert all(abs(cos[v[1]] - v[2]) < 1e-8 for v in near)


def test_slices_of_a_crowded_bucket(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.ones(8) + 0.01 * rng.standard_normal((400, 8))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    monkeypatch.setattr(neighbours, "SLICE", 30)
    got = found_by_query(neighbours.nearest_vectors(embeddings(spark, rows, "double"), F.col("vec_id") % 50 == 0, recall=0.999))
    want = brute_nearest(rows, 5, 50)
    assert sum(len({i for _, i in want[q]} & {v[1] for v in got[q]}) for q in want) >= 0.97 * 40


def test_probes_fall_as_neighbours_come_near():
    counts = neighbours.probes_by_cosine(64, 4, 1, 0.95)
    assert counts[0] > 30 and counts[-1] == 1 and all(a >= b for a, b in zip(counts, counts[1:], strict=False))


# -- ranked search -----------------------------------------------------------------


def plain_ranking(docs, items, k=10):
    term = re.compile(lexical.TERM.encode().decode("unicode_escape"))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: term.findall((t or "").translate(lower))
    texts = [(i, Counter(split(t))) for i, t in docs]
    n, words = sum(bool(c) for _, c in texts), sum(c.total() for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in texts:
            m = 25 + 75 * c.total() * n // words if words else 0
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in Counter(split(text)).items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda r: tuple((x is None, x or 0) for x in r))


def ranked(spark, docs, items, **more):
    out = lexical.ranked_documents(documents(spark, docs), spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, term string"), **more).collect()
    return sorted([tuple(r) for r in out], key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("more", [{}, {"block_terms": 20}, {"k": 3}])
def test_ranking_equals_plain_python(spark, more):
    rnd = random.Random(8)
    common, rare = ["The", "of", "and", "x1", "Éa"], [f"w{i}" for i in range(300)]
    text = lambda n: rnd.choice([" ", "-", "_", "\n"]).join(rnd.choice(common if rnd.random() < 0.6 else rare) for _ in range(n))
    docs = [(i, text(rnd.choice([0, 1, 5, 40, 200]))) for i in range(250)] + [(None, "w1 w2 w3"), (None, None), (300, "w1 " * 30_000), (301, "The w1"), (301, "The w1"), (302, "the W1")]
    items = [(i, text(rnd.choice([1, 3, 25]))) for i in range(30)] + [(40, None), (41, "--"), (42, "w1 w1 The"), (42, "w1 w1 The"), (None, "w2 w2 w3"), (43, "the of and"), (44, "nowhere")]
    items += [(45, docs[7][1]), (46, docs[11][1])]
    assert ranked(spark, docs, items, **more) == plain_ranking(docs, items, more.get("k", 10))


def test_ranking_of_nothing(spark):
    assert ranked(spark, [], [(1, "a")]) == [] and ranked(spark, [(1, "a b")], []) == []


def test_pruned_terms_generate_no_candidates():
    """A frequent term that cannot lift a document to the threshold is left to rescoring."""
    rows = [(0, "rare", 1, 9000, 900, 800), (0, "common", 1, 1, 2, 1)]
    block = lexical._block(rows, 1000, 10_000)
    own = lexical.Search(block, 10)
    assert own.floor.tolist() == [800] and (block.suffix >= own.floor[block.item]).tolist() == [True, False]
