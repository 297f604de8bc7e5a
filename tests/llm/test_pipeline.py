import re

import pytest

import corpus_pipeline
from lodestone.llm.toxicity import fit_toxicity, score_toxicity
from tests.llm.test_shingles_and_join import brute_components


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf)
    scores = score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    want = {r["doc_id"] for r in scores.collect() if r["score"] < 0.5}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == want
    last = {rows[i].lower(): i for i in sorted(want)}
    once = stages["exact_dedup"](spark, clean, sf)
    assert once.columns == docs.columns and {r["doc_id"] for r in once.collect()} == set(last.values())
    near = stages["ngram_jaccard"](spark, once, sf)
    found = brute_components([(i, rows[i]) for i in last.values()])
    left = {i for i, (_, c) in found.items() if i == c}
    assert near.columns == docs.columns and {r["doc_id"] for r in near.collect()} == left


def test_run_packs_whole_documents(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    bins: dict = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at <= 4096
    assert len(bins) <= 1.05 * sum(r["length"] for r in out) / 4096 + 1


def test_run_equals_its_stages_by_hand(spark, sf):
    """Every document that the first three stages keep is packed as often as the mix takes it, token for token."""
    import zlib
    from collections import Counter

    import numpy as np
    from tokenizers import Tokenizer

    from lodestone.llm import packing

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name in ("toxicity", "exact_dedup", "ngram_jaccard"):
        docs = stages[name](spark, docs, sf)
    kept = {r["doc_id"]: r for r in docs.collect()}
    mixed = Counter(r["doc_id"] for r in stages["mixing"](spark, docs, sf).collect())
    assert set(mixed) <= set(kept) and max(mixed.values()) <= 3

    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in kept.items()}
    size, took = Counter(), Counter()
    for i, r in kept.items():
        size[r["source"]] += words[i]
        took[r["source"]] += words[i] * mixed[i]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    full: set = set()
    while True:  # sources above three epochs are capped, the rest shared anew
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        share = {s: left * weight[s] / sum(weight[t] for t in order if t not in full) for s in order if s not in full}
        over = {s for s in share if share[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    for s in order:
        longest = max((words[i] for i, r in kept.items() if r["source"] == s), default=0)
        assert abs(took[s] - (3 * size[s] if s in full else share[s])) <= longest

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want: Counter = Counter()
    for i, times in mixed.items():
        ids = np.asarray(tok.encode(kept[i]["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(-(-len(ids) // 4096)):
            part = ids[4096 * k : 4096 * (k + 1)]
            want[i, k, 4096 * k, len(part), zlib.crc32(part.tobytes())] += times
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want


@pytest.mark.parametrize("rows", [[], [(1, None, "s"), (2, "", None), (2, "", None), (None, "a b c d e f", "s"), (4, "word " * 30_000, "t"), (4, "word " * 30_000, "t")]])
def test_stages_take_nulls_repeats_long_texts_and_nothing(spark, sf, rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "z", "z") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, keep_id string, size string")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert bool(packed) == bool(rows)
    assert {r["doc_id"] for r in packed} <= {i for i, _, _ in rows}
