import itertools
import random
import re

import pyarrow as pa
import pytest

from lodestone.llm import ngram_join, shingles

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text):
    w = WORDS.findall((text or "").translate(LOWER))
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows):
    sets = {i: brute_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 10
    passage = [rnd.choice(vocab) for _ in range(60)]
    for family in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 4, 5, 6, 30, 80, 200]))]
        for _ in range(rnd.randint(1, 9)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            if family % 3 == 0:
                copy = copy + passage
            rows.append((i, " ".join(w.upper() if rnd.random() < 0.1 else w for w in copy)))
            i += rnd.randint(1, 3)
    return rows + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "ONE"), (1005, "É é"), (1006, "é é")]


def test_shingle_sets_agree_with_tuples():
    texts = [t for _, t in corpus()] + ["a  b\tc d e f", "a b c d e f" * 3000]
    found = shingles.shingle_sets(pa.array(texts))
    assert [len(s) for s in found] == [len(brute_set(t)) for t in texts]
    for a in range(0, len(texts), 3):
        for b in range(0, len(texts), 4):
            common = len(set(found[a].tolist()) & set(found[b].tolist()))
            assert common == len(brute_set(texts[a]) & brute_set(texts[b]))


def test_components_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert found == brute_components(rows)


def test_short_texts_with_words_added(spark):
    rnd = random.Random(8)
    rows = []
    for k in range(60):
        words = [f"v{rnd.randrange(10**6)}" for _ in range(12)]
        short, more = ((7, 8), (10, 12))[k % 2]
        rows += [(2 * k, " ".join(words[:short])), (2 * k + 1, " ".join(words[:more]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert found == brute_components(rows)
    assert all(found[2 * k + 1][1] == 2 * k for k in range(60))


def test_linked_sets_emit_enough_of_each_other():
    for n in range(1, 300):
        for m in range(-(-3 * n // 4), 4 * n // 3 + 1):
            common = -(-75 * (n + m) // 175)  # the least overlap of a link, with which most is lost
            if common <= min(n, m):
                lost = max(n - common, ngram_join.emitted_size(n) + m - common - ngram_join.emitted_size(m))
                assert lost <= n // 4, (n, m, common)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(docs).count() == 0


def families(seed, n_families, keep, added):
    """Sets of tokens with weights: families of one base each, as rows of a block."""
    rnd = random.Random(seed)
    weight, rows = {}, []
    for _ in range(n_families):
        base = [rnd.getrandbits(62) for _ in range(rnd.choice([2, 9, 40, 90, 300]))]
        for _ in range(4):
            held = [x for x in base if rnd.random() < keep] + [rnd.getrandbits(62) for _ in range(len(base) // added)]
            for t in held:
                weight.setdefault(t, rnd.choice([1, 1, 1, 2, 7, 30]))
            if held:
                k = len(rows)
                rows.append((k, k, sum(weight[t] for t in held), held, [weight[t] for t in held], k % 2))
    return rows


def linked_in_block(rows, across):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(rows, 2):
        w = dict(zip(a[3], a[4], strict=True))
        common = sum(w[t] for t in w.keys() & set(b[3]))
        if 100 * common >= 75 * (a[2] + b[2] - common) and (not across or a[5] != b[5]):
            parent[max(find(a[0]), find(b[0]))] = min(find(a[0]), find(b[0]))
    return [find(k) for k in range(len(rows))]


@pytest.mark.parametrize("across", [False, True])
@pytest.mark.parametrize("seed", [11, 12, 13])
def test_trees_lose_no_component(across, seed):
    rows = families(seed, 30, 0.92, 25)
    parent = list(range(len(rows)))
    for a, b in ngram_join.Block(rows).links(across):
        x, y = a, b
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        assert x != y  # every link joins two components
        parent[max(x, y)] = min(x, y)
    want = linked_in_block(rows, across)
    assert len(set(want)) < len(rows)
    for k in range(len(rows)):
        x = k
        while parent[x] != x:
            x = parent[x]
        assert x == want[k]


def test_members_of_one_component_are_not_linked():
    rows = [(k, 5, 3, [1, 2, 3], [1, 1, 1], 0) for k in range(30)]
    assert list(ngram_join.Block(rows).links(False)) == []


def test_node_bounds_prune_unlike_sets():
    rnd = random.Random(5)
    rows = [(i, i, 200, [rnd.getrandbits(62) for _ in range(200)], [1] * 200, 0) for i in range(64)]
    block = ngram_join.Block(rows)
    tree = ngram_join.signature_tree(block.members)
    assert not any(block.may_link(x, y) for x, y in itertools.combinations(tree.children, 2))
    assert list(block.links(False)) == []


def test_weights_sum_over_bits():
    rnd = random.Random(1)
    weights = [rnd.randrange(1, 5000) for _ in range(300)]
    bits = rnd.getrandbits(300)
    assert ngram_join.Weights(weights)(bits) == sum(w for k, w in enumerate(weights) if bits >> k & 1)


def test_blocks_cut_into_chunks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 12)
    rows = corpus(17)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert found == brute_components(rows)


def test_near_copies_around_the_threshold(spark):
    """A crowd of copies of which about half of all pairs link: hubs leave many components to the trees."""
    rnd = random.Random(21)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(2 + i % 3):
            words[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert found == brute_components(rows)


def test_clashing_columns_nulls_and_a_long_text(spark):
    long = " ".join(f"t{i % 7919}" for i in range(300_000))
    names = ["sid", "n", "kept_id", "component_id", "key", "table_word", "token", "rep", "text_"]
    rows = [(i, t, *["z"] * len(names)) for i, t in [(5, long), (3, long + " end"), (None, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f"), (None, None), (1, "q r s t u v")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    found = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in ngram_join.near_duplicates(docs).collect())
    assert found == [(0, 0), (0, 9), (1, 1), (3, 3), (5, 3), (9, 9), (9, 9)]
    kept = ngram_join.one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 9, 9]


def test_rows_without_id_bridge_components(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words[:50]), " ".join(words[5:55]), " ".join(words[10:60])
    rows = [(1, a), (None, b), (9, c), (None, "only one of its kind here and nowhere else"), (4, "x y z")]
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_text = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in found}
    assert by_text[(1, 46)] == 1 and by_text[(9, 46)] == 1 and by_text[(None, 46)] == 1
    assert by_text[(None, 5)] is None and by_text[(4, 1)] == 4
