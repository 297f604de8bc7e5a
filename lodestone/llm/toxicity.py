"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration.

Every whole text becomes a short vector: densities and counts of lexicon words, their nearness to second-person
words, shares of capitals and punctuation, and rates of obfuscated spellings (digits or signs inside a
word that spell a lexicon word). The lexicon is a fixed list of plain insults and slurs of address, plus
words and beginnings of words learned from the training sample: those seen almost only in toxic texts, counted
once for texts that are copies of each other.

Trees are fitted on the driver on at most ``SAMPLE`` labelled rows (a documented bound; only vectors and
labels arrive there), a sixth of which only calibrates the scores. Labels of held-out documents, lang, source
and doc_id are never inputs.

Defined results: null and empty texts are scored like any other; without labelled rows of both kinds the
score is the share of toxic rows (0 without any); repeated rows are scored each, and equal
texts alike; ties among terms and cuts go by their order; a text of any length is read whole; an empty table gives no rows; other
columns are not read in scores and pass through ``reject_toxic``, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import TEXT_BYTES, by_bytes, held_out
from lodestone.llm.labelled import training_rows

SAMPLE = 12000
THRESHOLD = 0.5
#: One training row in this many calibrates; the others teach words and trees.
CALIBRATE_ONE_IN = 6
LEARNED_WORDS = 600
#: Lengths of the beginnings of words that can be learned.
STEMS = (4, 5, 6, 7, 8, 9)

#: Plain insults in the corpus's languages (fixed values).
INSULTS = """
idiot idiots moron morons stupid dumb imbecile fool loser losers pathetic worthless trash scum clown
disgusting garbage filth vermin pig jerk creep coward liar hate shut ugly freak psycho dumbass
bastard bitch asshole crap shit fuck fucking
dummkopf trottel versager abschaum arschloch widerlich
imbécile crétin connard salaud minable ordure dégoûtant
estúpido imbécil idiota basura inútil asqueroso
""".split()

#: Second-person words (fixed values).
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur ya du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti tus usted ustedes".split()
)

#: Signs that stand in for letters (fixed values).
LEET = str.maketrans({"0": "o", "1": "i", "!": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "*": None, ".": None, "-": None, "_": None})
EDGE = ".,;:!?\"'()[]{}<>«»“”‘’…*#$%&|~-_"

FEATURES = (
    "fixed_density fixed_count learned_density learned_count distinct_hits second_person_near second_person_density "
    "capital_share shouted_share punctuation_share exclamation_density obfuscated_density obfuscated_hits log_words"
).split()

_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W_][ .*_-]){3,}[^\W_](?![^\W_])")


def text_features(text: str, fixed: frozenset[str], learned: Learned) -> list[float]:
    """The vector of one whole text."""
    raw = text.split()
    n = max(len(raw), 1)
    words = [w.strip(EDGE) for w in text.lower().split()]
    hits = [i for i, w in enumerate(words) if w in fixed]
    known = sum(w in learned for w in words)
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON] if hits else []
    near = 0
    if you:
        at = np.asarray(you)
        for i in hits:
            k = np.searchsorted(at, i)
            near += bool((k < len(at) and at[k] - i <= 5) or (k > 0 and i - at[k - 1] <= 5))
    hidden = odd = 0
    for w in words:
        if not w.isalpha() and w and not w.isdigit():
            odd += 1
            plain = w.translate(LEET)
            hidden += plain != w and (plain in fixed or plain in learned)
    if " " in text:
        hidden += sum(re.sub(r"[ .*_-]", "", m[0]).lower() in fixed for m in _SPELLED.finditer(text))
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(data, minlength=128) if data.size else np.zeros(128, np.int64)
    letters = max(int(counts[65:91].sum() + counts[97:123].sum()), 1)
    punctuation = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    return [
        len(hits) / n,
        min(len(hits), 20),
        known / n,
        min(known, 20),
        len({words[i] for i in hits}),
        near,
        len(you) / n,
        counts[65:91].sum() / letters,
        sum(w.isupper() and len(w) > 2 for w in raw) / n,
        punctuation / max(data.size, 1),
        counts[33] / n,
        odd / n,
        hidden,
        float(np.log1p(len(raw))),
    ]


class BoostedTrees:
    """Logistic gradient boosting on quantile-binned features; plain arrays, so it pickles small."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.base)
        self.trees: list[list[tuple]] = []
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-raw))
            grad, hess = y - q, np.maximum(q * (1 - q), 1e-6)
            tree: list[tuple] = []
            raw += self._grow(tree, binned, grad, hess, np.arange(len(y)), 0, np.zeros(len(y)))
            self.trees.append(tree)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)

    def _grow(self, tree, b, g, h, rows, depth, out) -> np.ndarray:
        """Appends nodes in preorder: (feature, cut bin, index of the right child) or (None, value)."""
        at, total_g, total_h = len(tree), g[rows].sum(), h[rows].sum()
        best, gain = None, 1e-6
        if depth < self.depth and len(rows) >= 10:
            for f in range(b.shape[1]):
                sums = np.bincount(b[rows, f], weights=g[rows], minlength=self.bins + 1).cumsum()[:-1]
                mass = np.bincount(b[rows, f], weights=h[rows], minlength=self.bins + 1).cumsum()[:-1]
                rest_g, rest_h = total_g - sums, total_h - mass
                score = sums**2 / (mass + self.l2) + rest_g**2 / (rest_h + self.l2) - total_g**2 / (total_h + self.l2)
                score = np.where((mass > 1e-3) & (rest_h > 1e-3), score, -1)
                k = int(score.argmax())
                if score[k] > gain:
                    best, gain = (f, k), score[k]
        if best is None:
            value = self.rate * total_g / (total_h + self.l2)
            tree.append((None, value, 0))
            out[rows] = value
            return out
        f, k = best
        tree.append(None)
        left = b[rows, f] <= k
        self._grow(tree, b, g, h, rows[left], depth + 1, out)
        tree[at] = (f, k, len(tree))
        return self._grow(tree, b, g, h, rows[~left], depth + 1, out)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self._bin(x), np.full(len(x), self.base)
        for tree in self.trees:
            stack = [(0, np.arange(len(x)))]
            while stack:
                at, rows = stack.pop()
                f, k, right = tree[at]
                if f is None:
                    out[rows] += k
                elif len(rows):
                    left = b[rows, f] <= k
                    stack += [(at + 1, rows[left]), (right, rows[~left])]
        return out


class Isotonic:
    """Pool-adjacent-violators fit of label shares, read off by linear interpolation."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        blocks: list[list[float]] = []  # sum, rows, first x, last x
        for v, label in zip(x[order], y[order], strict=True):
            blocks.append([float(label), 1.0, float(v), float(v)])
            while len(blocks) > 1 and (
                blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]
            ):
                last = blocks.pop()
                blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
        self.x = np.asarray([b[2 + end] for b in blocks for end in (0, 1)])
        self.y = np.asarray([b[0] / b[1] for b in blocks for _ in (0, 1)])
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)


class ToxicityModel:
    def __init__(self, fixed: frozenset[str], terms: frozenset[str]):
        self.fixed, self.learned, self.trees, self.share = fixed, Learned(terms), None, 0.0

    def features(self, texts: list[str]) -> np.ndarray:
        return np.asarray([text_features(t, self.fixed, self.learned) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))

    def fit(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray) -> ToxicityModel:
        self.share = float(y.mean()) if len(y) else 0.0
        if 0 < y[~calibrate].sum() < (~calibrate).sum() and 0 < y[calibrate].sum() < calibrate.sum():
            self.trees = BoostedTrees().fit(x[~calibrate], y[~calibrate])
            self.isotonic = Isotonic().fit(self.trees.raw(x[calibrate]), y[calibrate])
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.share)
        return np.clip(self.isotonic(self.trees.raw(self.features(texts))), 0, 1)


def lexicon_terms(word: str) -> set[str]:
    """A word and its beginnings: invented words come in families that share one."""
    return {"=" + word} | {word[:k] for k in STEMS if len(word) > k}


def learned_lexicon(train: DataFrame, most: int = LEARNED_WORDS) -> frozenset[str]:
    """Words and beginnings of words that mark toxic documents of the training sample (at most ``most``).

    A term must be in at least six different toxic texts and in a twentieth as many others at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = {w.strip(EDGE) for w in text.lower().split()}
                sides[label].update(set().union(*(lexicon_terms(w) for w in words if w)))
            terms = sorted(sides[0].keys() | sides[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([sides[1][t] for t in terms], pa.int64()), pa.array([sides[0][t] for t in terms], pa.int64())],
                names=["term", "bad", "good"],
            )

    once = train.dropDuplicates(["text"]).select("text", "label").mapInArrow(count, "term string, bad long, good long")
    sums = once.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    chosen = sums.where("bad >= 6 and bad >= 20 * good").orderBy(F.desc("bad"), "term").limit(most)
    return frozenset(r[0] for r in chosen.select("term").collect())


class Learned:
    """Membership of a word in the learned terms, by a quick look at its first letters."""

    def __init__(self, terms: frozenset[str]):
        self.words = frozenset(t[1:] for t in terms if t[0] == "=")
        self.stems = frozenset(t for t in terms if t[0] != "=")
        self.heads = frozenset(t[: STEMS[0]] for t in self.stems)

    def __contains__(self, word: str) -> bool:
        return word in self.words or word[: STEMS[0]] in self.heads and any(len(word) > k and word[:k] in self.stems for k in STEMS)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    # By the text, so that copies of a text are on one side; the words are learned without the rows that calibrate.
    train = training_rows(docs, labels, "toxic", sample).withColumn("calibrate", F.pmod(F.xxhash64("text"), F.lit(CALIBRATE_ONE_IN)) == 0)
    model = ToxicityModel(frozenset(INSULTS), learned_lexicon(train.where("not calibrate")))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = model.features(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(x.tolist(), pa.list_(pa.float64())), batch.column("calibrate")],
                names=["doc_id", "label", "x", "calibrate"],
            )

    rows = train.select("doc_id", "label", "text", "calibrate").mapInArrow(
        vectors, "doc_id long, label int, x array<double>, calibrate boolean"
    ).collect()
    rows.sort(key=lambda r: r[:3])
    x = np.asarray([r[2] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return model.fit(x, np.asarray([r[1] for r in rows], dtype=float), np.asarray([r[3] for r in rows], dtype=bool))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every whole text."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, "text", TEXT_BYTES)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(texts), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored under ``threshold``, with their columns."""
    model = fit_toxicity(docs, labels)
    schema = docs.schema
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, at, TEXT_BYTES)):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(model.score(texts) < threshold))

    return docs.mapInArrow(keep, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
