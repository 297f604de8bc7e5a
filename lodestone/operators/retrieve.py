"""Ranking and budgeted selection, for many questions at once.

Units (documents, fragments or sentences) and questions are DataFrames; term statistics are joined on the
questions' terms only, so the exploded corpus never meets the questions whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import content_words, stem, tokens
from lodestone.operators.ledger import in_order
from lodestone.session import materialised

K1, B = 1.5, 0.75


def word_counts(units: DataFrame, unit: str, text: str = "text", lang: Column | str | None = None) -> DataFrame:
    """(unit, word, tf, unit_len): content words as they stand, counted in each unit; a table, for its several readers."""
    listed = units.select(F.col(unit), content_words(F.col(text), lang).alias("words"))
    counted = (
        listed.select(unit, F.size("words").alias("unit_len"), F.explode("words").alias("word"))
        .groupBy(unit, "word")
        .agg(F.count(F.lit(1)).alias("tf"), F.first("unit_len").cast("long").alias("unit_len"))
    )
    return materialised(counted, "word-counts")


def stemmed(counted: DataFrame, unit: str, only: DataFrame | None = None) -> DataFrame:
    """(unit, term, tf, unit_len) from ``word_counts``, of the terms of ``only`` (term) if given.

    Each distinct word is stemmed once; the few words that lead to asked terms then meet the counts, which stay where
    they are as long as those words fit a broadcast.
    """
    vocabulary = counted.select("word").distinct().select("word", stem(F.col("word")).alias("term"))
    if only is not None:
        vocabulary = vocabulary.join(only, "term", "left_semi")
    return counted.join(vocabulary, "word").groupBy(unit, "term").agg(F.sum("tf").alias("tf"), F.first("unit_len").alias("unit_len"))


def term_frequencies(units: DataFrame, unit: str, text: str = "text", lang: Column | str | None = None) -> DataFrame:
    """(unit, term, tf, unit_len): one row for each distinct term of a unit."""
    return stemmed(word_counts(units, unit, text, lang), unit)


def corpus_stats(units: DataFrame, text: str = "text", lang: Column | str | None = None) -> DataFrame:
    """One row (n_units, avg_len) over all units, those without terms included."""
    return units.select(F.size(content_words(F.col(text), lang)).alias("n")).agg(
        F.count(F.lit(1)).alias("n_units"), F.avg("n").alias("avg_len")
    )


def _bm25_tables(units: DataFrame, unit: str, questions: DataFrame, question: str, lang: Column | str | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(asked, tf, df, size) as ``bm25_scores`` takes them; only postings of terms that some question asks reach the shuffle."""
    asked = (
        questions.select(F.col(question), F.explode(tokens(F.col("text"), lang)).alias("term"))
        .groupBy(question, "term")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    counted = word_counts(units, unit, lang=lang)
    tf = materialised(stemmed(counted, unit, asked.select("term").distinct()), "postings")
    # One row: all units, those without terms included, and the mean number of their words.
    size = counted.agg(F.sum("tf").alias("words")).join(units.agg(F.count(F.lit(1)).alias("n_units")))
    size = size.select("n_units", (F.coalesce("words", F.lit(0)) / F.greatest("n_units", F.lit(1))).alias("avg_len"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return asked, tf, df, size


def _gain(times: Column) -> Column:
    """What a term asked ``times`` times adds to a unit's score, from df, tf, unit_len, n_units and avg_len."""
    n, avg = F.col("n_units"), F.col("avg_len")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = 1 - B + B * F.col("unit_len") / F.when(avg > 0, avg).otherwise(1.0)
    return times * idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * norm)


def bm25(units: DataFrame, unit: str, questions: DataFrame, question: str, lang: Column | str | None = None) -> DataFrame:
    """(question, unit, score) with score > 0, rounded to six places; repeated question terms count each time.

    ``questions`` has (question, text). A row for every pair that shares a term; ``bm25_top_k`` makes only the best of them.
    """
    return bm25_scores(*_bm25_tables(units, unit, questions, question, lang), question, unit)


def bm25_scores(asked: DataFrame, tf: DataFrame, df: DataFrame, size: DataFrame, question: str, unit: str) -> DataFrame:
    """(question, unit, score) from asked terms (question, term, times), postings (unit, term, tf, unit_len) and statistics.

    ``df``: (term, df), ``size``: one row (n_units, avg_len).
    """
    return (
        asked.join(df, "term")
        .join(tf, "term")
        .join(F.broadcast(size))
        .groupBy(question, unit)
        .agg(F.round(F.sum(_gain(F.col("times"))), 6).alias("score"))
        .where("score > 0")
    )


def _ordered(ids: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values of ``ids``, ascending with null first, and the place of each of ``ids`` among them."""
    coded = ids.combine_chunks().dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary, null_placement="at_start")
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy()]


def _best_of_block(unit: str, question: str, k: int):
    """Postings (unit, term, gain) and asked terms (question, term, times) of a block each -> its ``k`` best units a question."""

    def best(held: pa.Table, asked: pa.Table) -> pa.Table:
        units, row = _ordered(held[unit])
        questions, side = _ordered(asked[question])
        score = np.zeros((len(questions), len(units)))
        gain, times = held["gain"].to_numpy(), asked["times"].to_numpy()
        ours, theirs = held["term"].to_numpy(), asked["term"].to_numpy()
        by_term, by_asked = np.argsort(ours, kind="stable"), np.argsort(theirs, kind="stable")
        terms = np.intersect1d(ours, theirs)
        spans = [np.searchsorted(x[by], terms, side=s).tolist() for x, by in ((ours, by_term), (theirs, by_asked)) for s in ("left", "right")]
        for a, b, c, d in zip(*spans, strict=True):
            some, who = by_term[a:b], by_asked[c:d]
            score[np.ix_(side[who], row[some])] += times[who][:, None] * gain[some]
        score = np.round(score, 6)
        least = np.partition(score, -k, axis=1)[:, -k] if k < len(units) else np.zeros(len(questions))
        q, u = np.nonzero((score >= least[:, None]) & (score > 0))
        order = np.lexsort((u, -score[q, u], q))  # equal scores by id: of them all, the first k stay
        order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k]
        q, u = q[order], u[order]
        return pa.table({question: questions.take(pa.array(q)), unit: units.take(pa.array(u)), "score": score[q, u]})

    return best


def bm25_top_k(
    units: DataFrame, unit: str, questions: DataFrame, question: str, k: int, lang: Column | str | None = None, block: tuple[int, int] = (4096, 1024)
) -> DataFrame:
    """(question, unit, score, rank): the first ``k`` rows of ``bm25`` for every question, ties by ascending id; exact.

    Postings are dealt into blocks of some ``block[0]`` units, asked terms into blocks of some ``block[1]`` questions; each pair of
    blocks is a table of scores in one task, of which ``k`` rows a question remain. So no row is made for a pair that merely
    shares a term; a posting travels once for each block of questions and the other way round.
    """
    asked, tf, df, size = _bm25_tables(units, unit, questions, question, lang)
    n_units, avg_len = size.first()  # one row
    vocabulary = materialised(df.withColumn("number", F.monotonically_increasing_id()), "asked-vocabulary")
    rows, sides = max(1, -(-n_units // block[0])), max(1, -(-questions.count() // block[1]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    sized = tf.join(vocabulary, "term").withColumns({"n_units": F.lit(n_units), "avg_len": F.lit(avg_len)})
    left = sized.select(dealt(unit, rows).alias("row"), every(sides).alias("side"), unit, F.col("number").alias("term"), _gain(F.lit(1)).alias("gain"))
    right = asked.join(vocabulary, "term").select(every(rows).alias("row"), dealt(question, sides).alias("side"), question, F.col("number").alias("term"), "times")
    kinds = (right.schema[question].dataType.simpleString(), left.schema[unit].dataType.simpleString())
    pairs = left.groupBy("row", "side").cogroup(right.groupBy("row", "side"))
    found = pairs.applyInArrow(_best_of_block(unit, question, k), f"{question} {kinds[0]}, {unit} {kinds[1]}, score double")
    return top_k(found, question, "score", k, unit)


def top_k(ranked: DataFrame, by: str, score: str, k: int, *ties: str) -> DataFrame:
    """The first ``k`` rows of every group with their rank, ties broken by ``ties`` ascending."""
    order = Window.partitionBy(by).orderBy(F.desc(score), *ties)
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reciprocal_rank_fusion(rankings: list[DataFrame], question: str, unit: str, k: int = 60) -> DataFrame:
    """(question, unit, score) from rankings that carry (question, unit, rank)."""
    each = [r.select(question, unit, (F.lit(1.0) / (k + F.col("rank"))).alias("part")) for r in rankings]
    whole = each[0]
    for more in each[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy(question, unit).agg(F.round(F.sum("part"), 9).alias("score"))


def within_budget(ranked: DataFrame, by: str, size: str, budget: int, rank: str = "rank") -> DataFrame:
    """Prefix semantics: rows in rank order up to the first that would overflow; the first row always stays."""
    order = Window.partitionBy(by).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    overflow = (F.sum(size).over(order) > budget) & (F.col(rank) > 1)
    return ranked.withColumn("over", overflow.cast("int")).withColumn("over", F.max("over").over(order)).where("over = 0").drop("over")


def first_appearance(ranked: DataFrame, by: str, group: str, k: int, rank: str = "rank") -> DataFrame:
    """Groups (documents of ranked fragments) in the order in which they first appear."""
    best = ranked.groupBy(by, group).agg(F.min(rank).alias("best"))
    order = Window.partitionBy(by).orderBy("best", group)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sentence_ranks(
    chosen: DataFrame, sentences: DataFrame, questions: DataFrame, lang: Column | str | None = None, most: int = 120
) -> DataFrame:
    """(question_id, doc_id, position, rank): the ``most`` best sentences of each question's own documents.

    ``chosen``: (question_id, doc_id), ``sentences``: (doc_id, position, text), ``questions``: (question_id, text). The corpus of a
    question is the sentences of its documents: their number, mean length and document frequencies differ from question to
    question, and are sums over documents that were counted once.
    """
    asked = questions.select("question_id", F.explode(tokens(F.col("text"), lang)).alias("term")).groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("times"))
    counted = word_counts(sentences.select(F.struct("doc_id", "position").alias("unit"), "text"), "unit", lang=lang)
    tf = stemmed(counted, "unit", asked.select("term").distinct()).select("unit.doc_id", "unit.position", "term", "tf", "unit_len")
    words = counted.groupBy("unit.doc_id").agg(F.sum("tf").alias("words"))
    sizes = sentences.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units")).join(words, "doc_id", "left")
    sizes = chosen.join(sizes, "doc_id").groupBy("question_id").agg(F.sum("units").alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    hits = materialised(asked.join(chosen, "question_id").join(tf, ["doc_id", "term"]), "sentence-hits")
    df = hits.groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("df"))
    n, avg = F.col("n"), F.col("words") / F.col("n")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = 1 - B + B * F.col("unit_len") / F.when(avg > 0, avg).otherwise(1.0)
    gain = F.col("times") * idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * norm)
    scored = hits.join(df, ["question_id", "term"]).join(sizes, "question_id").groupBy("question_id", "doc_id", "position").agg(F.round(F.sum(gain), 6).alias("score"))
    return top_k(scored.where("score > 0"), "question_id", "score", most, "doc_id", "position").drop("score")


_TURNS = ((0, 0), (1, -1), (1, 1), (2, -2), (2, 2))


def _budgeted(budget: int):
    """The fold of ``select_sentences`` over one question's requests: what it holds is bounded by the budget."""

    def fold():
        used, full, taken = 0, False, set()

        def step(_, row: list) -> tuple:
            nonlocal used, full
            phase, turn, side, doc_id, start, cost = row
            late = bool(taken) and used + cost > budget
            full = full or (late and phase == 0 and (doc_id, start) not in taken)
            if late or (full and phase == 0) or (doc_id, start) in taken:
                return doc_id, start, phase, False
            taken.add((doc_id, start))
            used += cost
            return doc_id, start, phase, True

        return step

    return fold


def select_sentences(candidates: DataFrame, budget: int = 9000, most_anchors: int = 120, overhead: int = 6) -> DataFrame:
    """Anchor sentences first, then their neighbours, under a budget of characters.

    ``candidates``: (question_id, doc_id, position, start, size, by_value, rank) for every sentence of a
    question's documents; ``by_value`` marks a shared value anchor, ``rank`` is the BM25 rank or null.
    Anchors stop at the first that overflows; neighbours (one step around every anchor, then two) are
    skipped one by one. Without any anchor the first six sentences stand in. Anchors and neighbours are requests in
    order; the walk depends on what was taken before, so it is a fold that streams over a question's requests.
    """
    doc = candidates.schema["doc_id"].dataType.simpleString()
    question = candidates.schema["question_id"].dataType.simpleString()
    reading = Window.partitionBy("question_id").orderBy("doc_id", "start")
    spot = ["question_id", "doc_id", "position"]
    ranked = candidates.where(F.col("rank") <= most_anchors).select(*spot, F.lit(1).alias("kind"), F.col("rank").cast("long").alias("place"))
    valued = candidates.where("by_value").withColumn("place", F.row_number().over(reading).cast("long")).select(*spot, F.lit(0).alias("kind"), "place")
    first = candidates.withColumn("place", F.row_number().over(reading).cast("long")).where("place <= 6").select(*spot, F.lit(2).alias("kind"), "place")
    found = ranked.unionByName(valued)
    anchors = found.unionByName(first.join(found.select("question_id").distinct(), "question_id", "left_anti"))
    turns = F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(k).alias("side"), F.lit(d).alias("delta")) for k, (p, d) in enumerate(_TURNS)])
    requests = anchors.withColumn("turn", F.col("kind") * F.lit(1 << 40) + F.col("place")).select(*spot, "turn", F.explode(turns).alias("x"))
    requests = requests.select("question_id", "doc_id", (F.col("position") + F.col("x.delta")).alias("position"), "turn", "x.phase", "x.side")
    requests = requests.join(candidates.select(*spot, "start", (F.col("size") + overhead).alias("cost")), spot)
    requests = requests.select("question_id", "phase", "turn", "side", "doc_id", "start", "cost")
    folded = in_order(requests, "question_id", ["phase", "turn", "side"], _budgeted(budget), f"question_id {question}, doc_id {doc}, start int, phase int, taken boolean")
    return folded.where("taken").select("question_id", "doc_id", "start", F.row_number().over(reading).alias("number"), "phase")


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 8192) -> DataFrame:
    """Exact nearest vectors of a stated set of query vectors; ties go to the smaller vec_id.

    ``vectors``: (vec_id, embedding); ``queries``: (query_id, query). Both sides are dealt into blocks of some ``block`` rows by
    hash, and each pair of blocks is one product in one task, of which ``k`` rows a query remain. Every vector travels once for
    each block of queries and the other way round; nothing passes the driver. Null vectors take no part.
    """
    vectors = vectors.select("vec_id", "embedding").where("embedding is not null")
    queries = queries.select("query_id", "query").where("query is not null")
    many = lambda df: max(1, -(-df.count() // block))
    rows, sides = many(vectors), many(queries)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = vectors.select(dealt("vec_id", rows).alias("row"), every(sides).alias("side"), "vec_id", "embedding")
    right = queries.select(every(rows).alias("row"), dealt("query_id", sides).alias("side"), "query_id", "query")

    def nearest(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        names = ["query_id", "vec_id", "score"]
        if not len(held) or not len(asked):
            return pd.DataFrame(columns=names).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        vec, matrix = held["vec_id"].to_numpy(), np.stack(held["embedding"].to_numpy()).astype(np.float64)
        parts = []
        for at in range(0, len(asked), 256):  # a product of at most 256 queries at a time
            some = asked.iloc[at : at + 256]
            ids = some["query_id"].to_numpy()
            score = np.round(matrix @ np.stack(some["query"].to_numpy()).astype(np.float64).T, 6)
            score[vec[:, None] == ids[None, :]] = -np.inf
            near = np.lexsort((np.broadcast_to(vec[:, None], score.shape), -score), axis=0)[:k]
            best = np.take_along_axis(score, near, axis=0)
            found = pd.DataFrame({"query_id": np.repeat(ids, len(near)), "vec_id": vec[near.T.ravel()], "score": best.T.ravel()})
            parts.append(found[found["score"] > -np.inf])
        return pd.concat(parts)

    pairs = left.groupBy("row", "side").cogroup(right.groupBy("row", "side"))
    found = pairs.applyInPandas(nearest, "query_id long, vec_id long, score double")
    return top_k(found.withColumn("score", F.round("score", 6)), "query_id", "score", k, "vec_id")

