"""Benchmark cases made from a corpus: matched pairs with twins, every true place of an anchor, noise of scanned text.

Random choices are drawn from MD5 sums of what they are made for and a seed, so a plan gives the same cases however its
rows are partitioned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import anchors
from lodestone.operators.contain import counted, occurrences
from lodestone.session import materialised

MONTHS = "January February March April May June July August September October November December".split()
#: Kinds of anchors that questions ask for, in the order in which a sentence's are tried (the recognised language is fixed).
KINDS = {
    "docket": r"\b\d:\d{2}-[a-z]{2}-\d{5}\b",
    "amount": r"\$\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b",
    "date": r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b",
    "period": r"\b\d{1,3}\s+(?:days|day|months|month|years|year)\b",
    "statute": r"\b\d{1,2}\s+U\.S\.C\.\s*§*\s*\d{1,5}\b",
}
QUESTIONS = {
    "docket": "What do the files say about docket {}?", "amount": "What does the amount {} relate to in the files?",
    "date": "What happened on {} according to the files?", "period": "What does the period of {} refer to in the files?",
    "statute": "In what context do the files invoke {}?",
}
DATE = re.compile(r"(\w+)(\s+)(\d{1,2})(,?\s+\d{4})$")
TRIES = 40
#: Documents that a case gives on average in the first round of seeded order, and how much further each round goes.
ROUND, GROWTH = 400, 16


def gold_sentence(text: Column, least: int = 60) -> Column:
    """Whether a sentence can be a benchmark's truth: long, of letters, of six words at least, without markup."""
    size = F.length(text)
    lost = lambda c: size - F.length(F.translate(text, c, ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\s]", ""))
    return (
        (size >= least) & ~text.rlike(r"<[^>]{1,80}>") & (lost("_") <= 3) & (lost("|") <= 2)
        & (letters >= 0.62 * size) & (F.regexp_count(text, F.lit(r"\p{L}{3,}")) >= 6)
    )


def drawn(k: int, *parts: Column) -> Column:
    """The k-th of four numbers under 2**32 drawn for ``parts``."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 8 * k - 7, 8), 16, 10).cast("long")


def twin_of(value: str, kind: str, seed: str) -> str:
    """A value of the same shape that might well stand in the files, but is another.

    A date gets another month and another day up to 28, its year keeps it plausible; elsewhere two digits change, not the
    leading one where there are more than two.
    """
    sums = hashlib.md5(f"{value}|{seed}".encode()).hexdigest()
    h = [int(sums[k : k + 8], 16) for k in range(0, 32, 8)]
    if kind == "date":
        month, gap, day, year = DATE.match(value).groups()
        old, days = int(day), 27 if int(day) <= 28 else 28
        new = 1 + h[1] % days
        new += days == 27 and new >= old
        return MONTHS[(MONTHS.index(month) + 1 + h[0] % 11) % 12] + gap + str(new).zfill(len(day)) + year
    places = [i for i, c in enumerate(value) if c in "0123456789"]
    free = places[1:] if len(places) > 2 else places
    out = list(value)
    if free:
        first = h[0] % len(free)
        second = (first + 1 + h[1] % max(len(free) - 1, 1)) % len(free)
        for place, draw in {first: h[2], second: h[3]}.items() if first != second else ((first, h[2]),):
            out[free[place]] = str((int(out[free[place]]) + 3 + draw % 4) % 10)
    return "".join(out)


@F.pandas_udf(T.StringType())
def perturbed(value: pd.Series, kind: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series([twin_of(*x) for x in zip(value, kind, seed, strict=True)], dtype=object)


def sentence_anchors(sentences: DataFrame) -> DataFrame:
    """``sentences`` (..., text) with kind, value and ``turn``, the order in which a sentence's anchors are tried."""
    def of(kind: str, pattern: str) -> Column:
        values = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), F.trim(v).alias("value")))

    found = [of(kind, pattern) for kind, pattern in KINDS.items()]
    each = sentences.where(F.col("text").rlike("[0-9]")).select("*", F.posexplode(F.concat(*found)).alias("turn", "anchor"))
    return each.select(*sentences.columns, "turn", "anchor.kind", "anchor.value")


def in_seeded_order(documents: DataFrame, sentences: DataFrame, groups: DataFrame, most: int, seed: int, taken: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The first ``most`` rows of every group, documents in seeded order.

    ``groups``: (case_id, ...), ``taken(sentences, groups)`` gives all rows (of the columns of ``groups``, doc_id, start, ...) of these
    sentences. A document's draw does not depend on its case, so documents under a bound come before all others: rounds raise
    the bound, the last to all documents, and only groups that lack rows go on.
    """
    key, draw = groups.columns, drawn(1, F.col("doc_id"), F.lit(seed))
    order = Window.partitionBy(*key).orderBy("draw", "doc_id", "start")
    first = lambda rows: rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")
    left = groups = materialised(groups.join(documents.select("case_id").distinct(), "case_id", "left_semi").distinct().select(*key), "case-groups")
    n, cases = documents.agg(F.count(F.lit(1)), F.count_distinct("case_id")).first()
    low, upto, found = 0, min(1 << 32, (ROUND * cases << 32) // max(n, 1) + 1), None
    while True:
        some = sentences.where((draw >= low) & (draw < upto)).join(left.select("case_id").distinct(), "case_id", "left_semi")
        rows = materialised(first(taken(some, left).withColumn("draw", draw)), "round")
        found = rows if found is None else found.unionByName(rows)
        low, upto = upto, min(1 << 32, upto * GROWTH)
        if low == 1 << 32:
            break
        full = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most)
        left = materialised(groups.join(full, key, "left_anti"), "case-groups")
        if left.isEmpty():
            break
    return first(found).drop("draw")


def leakage_cases(documents: DataFrame, sentences: DataFrame, targets: DataFrame, most: int = 20, seed: int = 42) -> DataFrame:
    """Questions on facts of one case that are asked in another, where they must be refused.

    ``documents`` and ``sentences`` as in ``matched_pairs``; ``targets``: (case_id, target_id), the case whose facts are asked for
    and the one that is asked. A sentence gives one case, of its first anchor that stands nowhere in the target's texts; a
    pair of cases gives its first ``most``, documents in seeded order.
    """

    def asked(some: DataFrame, groups: DataFrame) -> DataFrame:
        found = sentence_anchors(some.where(gold_sentence(F.col("text")))).drop("end", "text")
        found = materialised(found, "leak-anchors")
        there = documents.join(groups.select(F.col("target_id").alias("case_id")).distinct(), "case_id", "left_semi")
        there = counted(there, "case_id", found).select(F.col("case_id").alias("target_id"), "value")
        absent = found.join(groups, "case_id").join(there, ["target_id", "value"], "left_anti")
        return absent.groupBy("case_id", "target_id", "doc_id", "start").agg(F.min(F.struct("turn", "kind", "value")).alias("x")).select("case_id", "target_id", "doc_id", "start", "x.*")

    taken = in_seeded_order(documents, sentences, targets.select("case_id", "target_id"), most, seed, asked)
    questions = F.create_map(*[F.lit(x) for pair in QUESTIONS.items() for x in pair])
    parts = [F.col(c).cast("string") for c in ("target_id", "doc_id", "start", "value")]
    return taken.select(
        F.substring(F.sha2(F.concat_ws("|", F.lit("leakage"), *parts), 256), 1, 12).alias("id"), "case_id", "target_id", F.lit("leakage").alias("category"),
        F.lit("refuse").alias("expected"), "kind", F.col("value").alias("anchor"), F.replace(F.try_element_at(questions, F.col("kind")), F.lit("{}"), F.col("value")).alias("question"),
    )


def matched_pairs(documents: DataFrame, sentences: DataFrame, pairs: int = 50, seed: int = 42, tries: int = TRIES) -> DataFrame:
    """Answerable cases and their twins that must be refused; each names the other in ``pair_id``.

    ``documents``: (case_id, doc_id, text), ``sentences``: (case_id, doc_id, start, end, text) of them. An anchor serves if it
    stands once in its case's texts; its twin is the first of ``tries`` perturbations that stands nowhere in them. A
    sentence gives one pair, of its first anchor that serves and has a twin; a case gives its first ``pairs`` pairs, documents in
    seeded order.
    """
    spot = ["case_id", "doc_id", "start"]

    def served(some: DataFrame, groups: DataFrame) -> DataFrame:
        found = materialised(sentence_anchors(some.where(gold_sentence(F.col("text")))).drop("text"), "anchors")
        own = documents.join(groups, "case_id", "left_semi")
        unique = counted(own, "case_id", found).where("places = 1").select("case_id", "value")
        tried = found.join(unique, ["case_id", "value"]).select("*", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("attempt"))
        tried = tried.withColumn("twin", perturbed("value", "kind", F.concat_ws("|", F.lit(str(seed)), "attempt")))
        tried = materialised(tried.where("twin <> value"), "twins")
        there = counted(own, "case_id", tried.select(F.col("twin").alias("value"))).select("case_id", F.col("value").alias("twin"))
        free = tried.join(there, ["case_id", "twin"], "left_anti")
        return free.groupBy(*spot).agg(F.min(F.struct("turn", "attempt", "kind", "value", "twin", "end")).alias("x")).select(*spot, "x.*")

    first = materialised(in_seeded_order(documents, sentences, documents.select("case_id"), pairs, seed, served), "first-pairs")
    texts = sentences.join(first.select("doc_id").distinct(), "doc_id", "left_semi").select(*spot, "end", "text")
    first = first.join(texts, [*spot, "end"])
    name = lambda value, *more: F.substring(F.sha2(F.concat_ws("|", F.col("case_id").cast("string"), F.col("doc_id").cast("string"), F.col("start").cast("string"), value, *more), 256), 1, 12)
    first = first.withColumn("a", name("value")).withColumn("b", name("twin", F.lit("b")))
    questions = F.create_map(*[F.lit(x) for pair in QUESTIONS.items() for x in pair])
    asked = lambda value: F.replace(F.try_element_at(questions, F.col("kind")), F.lit("{}"), F.col(value))
    none = F.lit(None)
    cite = first.select(
        "case_id", F.col("a").alias("id"), F.col("b").alias("pair_id"), F.lit("anchored_fact").alias("category"), F.lit("cite").alias("expected"), "kind",
        F.col("value").alias("anchor"), asked("value").alias("question"), "doc_id", "start", "end", F.col("text").alias("sentence"),
    )
    refuse = first.select(
        "case_id", F.col("b").alias("id"), F.col("a").alias("pair_id"), F.when(F.col("kind").isin("amount", "period"), "number_trap").otherwise("no_cover").alias("category"),
        F.lit("refuse").alias("expected"), "kind", F.col("twin").alias("anchor"), asked("twin").alias("question"),
        none.cast(first.schema["doc_id"].dataType).alias("doc_id"), none.cast("int").alias("start"), none.cast("int").alias("end"), none.cast("string").alias("sentence"),
    )
    return materialised(cite.unionByName(refuse), "matched-pairs")


CLAUSE = re.compile(r"[^\n.!?]+")
CLAUSES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(CLAUSES)
def clauses(text: pd.Series) -> pd.Series:
    """Stretches between sentence marks and line ends, of any length; only those with a digit, without which there is no value."""
    return text.map(lambda t: [(m.start(), m.end(), m[0]) for m in CLAUSE.finditer(t or "") if re.search(r"\d", m[0])])


def united(spans: DataFrame, *key: str) -> DataFrame:
    """Spans (key, start, end) that overlap or touch as one: gaps and islands."""
    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*key).orderBy("start", "end")
    opened = spans.withColumn("fresh", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    return opened.withColumn("island", F.sum("fresh").over(upto)).groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def true_places(documents: DataFrame, cases: DataFrame, margin: int = 400) -> DataFrame:
    """(id, doc_id, start, end): every stretch of a case's documents that may truly be cited for its anchor.

    ``cases``: (id, case_id, anchor), ``documents``: (case_id, doc_id, text). Literal hits count with a quarter of ``margin``
    before and ``margin`` after them, other spellings of the value with the whole clause they stand in, however short or long.
    """
    quoted = cases.select(F.col("anchor").alias("quote_id"), F.col("anchor").alias("quoted")).distinct()
    hits = occurrences(documents.select("doc_id", "text"), quoted, tolerant=False).withColumnRenamed("quote_id", "anchor")
    sizes = documents.select("case_id", "doc_id", F.length("text").alias("n"))
    literal = hits.join(sizes, "doc_id").join(cases.select("id", "case_id", "anchor"), ["case_id", "anchor"])
    literal = literal.select("id", "doc_id", F.greatest(F.lit(0), F.col("start") - margin // 4).alias("start"), F.least("n", F.col("end") + margin).alias("end"))
    asked = cases.select("id", "case_id", F.explode(anchors.compound(F.col("anchor"))).alias("value"))
    pieces = documents.select("case_id", "doc_id", F.explode(clauses("text")).alias("c"))
    valued = pieces.select("case_id", "doc_id", "c.start", "c.end", F.explode(anchors.compound(F.col("c.text"))).alias("value"))
    same = valued.join(asked, ["case_id", "value"]).select("id", "doc_id", "start", "end").distinct()
    return united(literal.unionByName(same), "id", "doc_id")


# -- noise of scanned text ---------------------------------------------------------

#: Confusions of scanned text by class (fixed values).
GLYPHS = {"rn": "m", "m": "rn", "cl": "d", "vv": "w", "w": "vv", "ii": "n", "li": "h", "nn": "rm"}
DIGITS = {"0": "O", "O": "0", "1": "l", "l": "1", "5": "S", "S": "5", "8": "B", "B": "8", "6": "b", "2": "Z", "Z": "2"}
DIACRITICS = dict(zip("ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "acelnoszzACELNOSZZ", strict=True))
KEYS = {"a": "s", "s": "a", "e": "r", "r": "e", "o": "p", "i": "o", "n": "m", "t": "y", "c": "v", "u": "y"}
NOISED = "text_id long, level double, noised string, changed int, digits int, size int"


def confusions(lang: str) -> list[tuple[str, str, str]]:
    """(class, before, after) in the order of the classes; diacritics are lost in Polish only."""
    classes = {"diacritics": DIACRITICS} if lang == "pl" else {}
    classes |= {"digits": DIGITS, "glyphs": GLYPHS, "keys": KEYS}
    return [(name, a, b) for name, table in classes.items() for a, b in table.items()]


def noised_text(text: str, level: float, lang: str, seed: int) -> tuple[str, int, int]:
    """(text, characters changed, those by confusions of digits): confusions at drawn places that do not overlap.

    Places come in the order of their draws, until ``level`` of the characters, one at least, are changed.
    """
    found = [
        (hashlib.md5(f"{seed}|{m.start()}|{before}".encode()).hexdigest(), m.start(), before, after, name)
        for name, before, after in confusions(lang)
        for m in re.finditer(f"(?={re.escape(before)})", text)
    ] if text and level > 0 else []
    budget, taken, put = max(1, int(len(text) * level)), set(), {}
    for _, at, before, after, name in sorted(found):
        if len(taken) >= budget:
            break
        spot = range(at, at + len(before))
        if taken.isdisjoint(spot):
            taken.update(spot)
            put[at] = (len(before), after, name)
    out, at = [], 0
    for place in sorted(put):
        out += [text[at:place], put[place][1]]
        at = place + put[place][0]
    return "".join([*out, text[at:]]), len(taken), sum(size for size, _, name in put.values() if name == "digits")


def noise_sweep(texts: DataFrame, levels: tuple[float, ...], lang: str = "en", seed: int = 42) -> DataFrame:
    """(text_id, level, noised, changed, digits, size) of ``texts`` (text_id, text) at every level of noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows += [(name, level, *noised_text(text or "", level, lang, seed), len(text or "")) for level in levels]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)],
                names=["text_id", "level", "noised", "changed", "digits", "size"],
            )

    kinds = (pa.int64(), pa.float64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
    return texts.select(F.col("text_id").cast("long"), "text").mapInArrow(run, NOISED)
