"""Exact n-gram Jaccard join with signature trees.

Documents are sets of distinct five-word shingles; two link when 100 * |A & B| >= 75 * |A | B|. The join
loses no link, and its cost follows the near duplicates rather than the corpus:

1. *Sets.* Documents of equal sets (copies) become one set.
2. *Prune.* A partner of A holds all but floor(n / 4) of A's shingles. Every set emits its smallest hashes, a
   little more than that many, and enough that a partner emits all but floor(n / 4) of what A emits; a set of
   which more than floor(n / 4) emitted hashes are emitted by no other set has no partner. Most of a corpus
   ends here.
3. *Tokens.* Shingles that exactly the same remaining sets hold are one token, weighted by how many they are:
   a passage of 50 words that documents share is one token, not 46. Shingles of one set only are counted.
   Overlaps of sets are sums of the weights of common tokens, as exact as on the shingles.
4. *Prefixes.* Tokens are ordered by how many sets hold them, rarest first. Linked sets share one of the tokens
   that begin within their first floor(n / 4) + 1 shingles in that order, so the postings of those tokens hold
   every link. Passages that many documents share come last in the order and stay out.
5. *Hubs.* In each posting list every set is compared with one hub (two rounds, two hubs). A group of
   thousands of near copies becomes one component at a cost linear in its size.
6. *Signature trees.* Posting lists that still hold several components make blocks: those with the same least set
   are one block, so that a set's tokens travel once and not for each list. A block's sets are leaves
   of a tree whose nodes hold the OR of their token bitmaps and the range of their sizes; pairs of nodes are
   traversed together and dropped when the overlap they could reach at most is too small, or when both lie in
   one component. In a block every token has a bit of its own, so at the leaves the bound is the overlap itself;
   a block returns only links that join two of its components. Blocks over ``BLOCK`` sets or ``BLOCK_TOKENS``
   tokens are cut into chunks and every pair of chunks is a block of its own, so no block has to fit in one task.

Texts are read three times and only those of sets that outlive the prune are shuffled (a bit table of fixed size
is joined to the scan first; where it fills up, more texts are shuffled and the result is the same).

Defined results: null, empty and white-space texts have no shingles, n_shingles 0, and link with nothing;
texts under five words are one shingle; a text of any length is one set, hashed in pieces of bounded size;
repeated rows appear each; a row without doc_id links like any other, and its component is null where no row of it has one; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import TEXT_BYTES, by_bytes, forget, probable_rows, scratch, unused
from lodestone.llm.components import connected_components
from lodestone.llm.shingles import _Powers, set_digest, shingle_sets

#: Links need 100 * overlap >= 75 * union, so overlap >= 3/4 of either set and 3/7 of the sizes' sum.
PERCENT = 75
#: Share of a set's hashes that it emits for pruning.
EMITTED = 0.36
#: Sizes that emit one hash more: without it the set of a link could find a shared shingle emitted by itself only.
ONE_MORE = (4, 5, 8)
#: A block over this many sets, or tokens in them, is cut into chunks of half that size.
BLOCK = 2000
BLOCK_TOKENS = 250_000
FAN_OUT = 8

def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = _Powers()
    for batch in batches:
        for part in by_bytes(batch, "text", TEXT_BYTES):
            sets = shingle_sets(part.column("text"), powers)
            d1, d2 = set_digest(sets)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1), pa.array(d2)],
                names=["doc_id", "text_hash", "n", "sid", "sid2"],
            )


def emitted_size(n: int) -> int:
    """How many of its smallest hashes a set of ``n`` shingles emits.

    Of sets A and B that link, B not emitting a of A's emitted hashes needs a <= floor(|A| / 4): a is at most
    max(|A - B|, emitted_size(|A|) + |B - A| - emitted_size(|B|)). A test runs through the sizes where rounding
    matters; above them 0.36 |A - B| + 0.64 |B - A| + 1 stays under the limit.
    """
    return int(EMITTED * n) + 1 + (n in ONE_MORE)


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = _Powers()
    for batch in batches:
        for part in by_bytes(batch, "text", TEXT_BYTES):
            sets = shingle_sets(part.column("text"), powers)
            ids = set_digest(sets)[0]
            once = np.unique(ids, return_index=True)[1]
            heads = [sets[i][: emitted_size(len(sets[i]))] for i in once]
            sizes = [len(h) for h in heads]
            keys, owners = np.concatenate(heads or [np.zeros(0, np.int64)]), np.repeat(ids[once], sizes)
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), pa.array(owners[at : at + 100_000])], names=["key", "sid"])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = _Powers()
    for batch in batches:
        for part in by_bytes(batch, "text", TEXT_BYTES):
            sets = shingle_sets(part.column("text"), powers)
            right = np.flatnonzero(set_digest(sets)[0] == part.column("sid").to_numpy()).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.column("sid")[i].as_py() for i in right], pa.int64()),
                    pa.array([len(sets[i]) for i in right], pa.int64()),
                    pa.array([sets[i] for i in right], pa.list_(pa.int64())),
                ],
                names=["sid", "n", "shingles"],
            )


def tokens(arrays: DataFrame) -> DataFrame:
    """(sid, n, alone, token, weight) of ``arrays`` (sid, n, shingles): the shared shingles as weighted tokens.

    ``token`` and ``weight`` are arrays, rarest token first; ``alone`` counts the shingles of this set only. A token
    is named by a digest of the sets that hold it. Sets with too many lone shingles to have a partner are left out.
    """
    each = arrays.select("sid", F.explode("shingles").alias("key"))
    lists = each.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.bit_xor(F.xxhash64("sid")).alias("token")).where("df > 1")
    held = each.join(lists, "key").groupBy("sid", "token").agg(F.min("df").alias("df"), F.count(F.lit(1)).alias("weight"))
    held = held.groupBy("sid").agg(
        F.array_sort(F.collect_list(F.struct("df", "token", "weight"))).alias("held"), F.sum("weight").alias("shared")
    )
    return (
        held.join(arrays.select("sid", "n"), "sid")
        .select(
            "sid", "n", (F.col("n") - F.col("shared")).alias("alone"), F.col("held.token").alias("token"),
            F.col("held.weight").cast("array<int>").alias("weight"),
        )
        .where(F.col("alone") <= F.floor(F.col("n") / 4))
    )


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sid, n, alone = (batch.column(c).to_numpy() for c in ("sid", "n", "alone"))
        token, weight = (batch.column(c).flatten().to_numpy() for c in ("token", "weight"))
        ends = batch.column("token").offsets.to_numpy() - batch.column("token").offsets[0].as_py()
        owner = np.repeat(np.arange(len(sid)), np.diff(ends))
        before = np.cumsum(weight, dtype=np.int64) - weight
        start = alone[owner] + before - before[ends[:-1]][owner] if len(owner) else before
        early = start <= n[owner] // 4
        owner, token = owner[early], token[early]
        for at in range(0, max(len(token), 1), 100_000):
            part = owner[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(token[at : at + 100_000]), pa.array(sid[part]), pa.array(n[part])], names=["key", "sid", "n"])


def prefixes(members: DataFrame) -> DataFrame:
    """(key, sid, n): the tokens that begin within each set's first floor(n / 4) + 1 shingles, lone ones first."""
    return members.select("sid", "n", "alone", "token", "weight").mapInArrow(_prefixes, "key long, sid long, n long")


class Weights:
    """Sums of token weights over bitmaps: one plane of bits for each binary digit of the weights."""

    def __init__(self, of_bit: list[int]):
        self.planes = []
        for digit in range(max(of_bit, default=0).bit_length()):
            plane = np.asarray([w >> digit & 1 for w in of_bit], np.uint8)
            self.planes.append(int.from_bytes(np.packbits(plane, bitorder="little").tobytes(), "little"))

    def __call__(self, bits: int) -> int:
        return sum((bits & plane).bit_count() << digit for digit, plane in enumerate(self.planes))


class Member(NamedTuple):
    """A set in a block: its size and its tokens as bits."""

    sid: int
    component: int
    n: int
    bits: int
    side: int


class Node:
    """A signature-tree node: OR of the token bitmaps, size range, the component if it has but one."""

    __slots__ = ("bits", "children", "component", "least", "members", "most")

    def __init__(self, members: list[Member], children: list[Node]):
        self.members, self.children, self.bits = members, children, 0
        for part in children or members:
            self.bits |= part.bits
        self.least = min(p.least for p in children) if children else min(m.n for m in members)
        self.most = max(p.most for p in children) if children else max(m.n for m in members)
        owners = {p.component for p in children or members}
        self.component = owners.pop() if len(owners) == 1 else None


def signature_tree(members: list[Member]) -> Node:
    """A tree over ``members``, near ones together: by component, then size, then bitmap."""
    members = sorted(members, key=lambda m: (m.component, m.n, m.bits))
    level = [Node(members[i : i + FAN_OUT], []) for i in range(0, len(members), FAN_OUT)]
    while len(level) > 1:
        level = [Node([], level[i : i + FAN_OUT]) for i in range(0, len(level), FAN_OUT)]
    return level[0]


def _links(n1: int, n2: int, overlap: int) -> bool:
    return (100 + PERCENT) * overlap >= PERCENT * (n1 + n2)


class Block:
    """The sets of one block, or of two chunks of one. Links come one for each two components joined."""

    def __init__(self, rows: list[tuple]):
        """``rows``: (sid, component, n, tokens, weights, side)."""
        bit: dict[int, int] = {}
        of_bit: list[int] = []
        self.members: list[Member] = []
        for sid, component, n, token, weight, side in rows:
            for t, w in zip(token, weight, strict=True):
                if t not in bit:
                    bit[t] = len(of_bit)
                    of_bit.append(w)
            bits = np.zeros(len(of_bit), np.uint8)
            bits[[bit[t] for t in token]] = 1
            self.members.append(Member(sid, component, n, int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"), side))
        self.weight = Weights(of_bit)
        self.parent: dict[int, int] = {}

    def find(self, component: int) -> int:
        while component in self.parent:
            component = self.parent[component]
        return component

    def may_link(self, x: Node, y: Node) -> bool:
        """Whether any two members could link: the overlap is at most either size and the weight of common bits."""
        if x.component is not None and y.component is not None and self.find(x.component) == self.find(y.component):
            return False
        if 100 * x.most < PERCENT * y.least or 100 * y.most < PERCENT * x.least:
            return False
        return _links(x.least, y.least, min(x.most, y.most, self.weight(x.bits & y.bits)))

    def joins(self, a: Member, b: Member) -> bool:
        """Whether a and b link and lie in different components, which they do no more hereafter."""
        if 100 * min(a.n, b.n) < PERCENT * max(a.n, b.n):
            return False
        one, other = self.find(a.component), self.find(b.component)
        if one == other or not _links(a.n, b.n, self.weight(a.bits & b.bits)):
            return False
        self.parent[max(one, other)] = min(one, other)
        return True

    def traverse(self, x: Node, y: Node) -> Iterator[tuple[int, int]]:
        """Links between members of ``x`` and ``y`` (of ``x`` with itself where they are one)."""
        stack = [(x, y)]
        while stack:
            x, y = stack.pop()
            if not self.may_link(x, y):
                continue
            if x.children or y.children:
                if x is y:
                    stack += combinations(x.children, 2)
                    stack += [(c, c) for c in x.children]
                else:
                    stack += [(c, d) for c in x.children or [x] for d in y.children or [y]]
            else:
                pairs = combinations(x.members, 2) if x is y else ((a, b) for a in x.members for b in y.members)
                yield from ((a.sid, b.sid) for a, b in pairs if self.joins(a, b))

    def links(self, across: bool) -> Iterator[tuple[int, int]]:
        """``across``: only sets of different sides are compared."""
        if not across:
            tree = signature_tree(self.members)
            yield from self.traverse(tree, tree)
            return
        sides = [[m for m in self.members if m.side == k] for k in (0, 1)]
        if all(sides):
            yield from self.traverse(signature_tree(sides[0]), signature_tree(sides[1]))


def block_links(batches: Iterator[pa.RecordBatch], merged: Callable[[list[tuple]], list[tuple]] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block -> links; one block (at most ``BLOCK`` rows or so) is held at a time.

    ``merged`` makes a block's tokens of the rows' shingles where they have none yet."""
    held, block = [], None
    found: set[tuple[int, int]] = set()

    def out() -> pa.RecordBatch:
        pairs = np.asarray(sorted(found), np.int64).reshape(-1, 2)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def close() -> None:
        rows = merged(held) if merged and held else held
        if len(rows) > 1:
            found.update((min(p), max(p)) for p in Block(rows).links(block[1] != block[2]))

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("block", "i", "j", "sid", "component", "n", "token", "weight", "side")]
        for name, i, j, *row in zip(*columns, strict=True):
            if (name, i, j) != block:
                close()
                held, block = [], (name, i, j)
                if len(found) > 50_000:
                    yield out()
            held.append(tuple(row))
    close()
    yield out()


def _overlapping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, ta, wa, tb) -> the (a, b) that link, by the weights of their common tokens."""
    for batch in batches:
        a, b, na, nb = (batch.column(c).to_numpy() for c in ("a", "b", "na", "nb"))
        lists = [batch.column(c) for c in ("ta", "wa", "tb")]
        (ta, wa, tb), (oa, _, ob) = [x.flatten().to_numpy() for x in lists], [x.offsets.to_numpy() - x.offsets[0].as_py() for x in lists]
        right = []
        for k in range(batch.num_rows):
            common = np.isin(ta[oa[k] : oa[k + 1]], tb[ob[k] : ob[k + 1]], assume_unique=True)
            if _links(int(na[k]), int(nb[k]), int(wa[oa[k] : oa[k + 1]][common].sum())):
                right.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(a[right]), pa.array(b[right])], names=["a", "b"])


def _verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that link."""
    a = members.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("token").alias("ta"), F.col("weight").alias("wa"))
    b = members.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("token").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ta", "wa", "tb").mapInArrow(_overlapping, "a long, b long")


def _in_components(postings: DataFrame, components: DataFrame | None) -> DataFrame:
    """``postings`` with each set's component so far, of tokens that still join several components."""
    with_own = postings.withColumn("component", F.col("sid"))
    if components is not None:
        with_own = postings.join(components.withColumnRenamed("id", "sid"), "sid", "left").withColumn(
            "component", F.coalesce("component_id", "sid")
        ).drop("component_id")
    several = with_own.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return with_own.join(several.select("key"), "key", "left_semi")


def _hub_links(postings: DataFrame, members: DataFrame, first: bool) -> DataFrame:
    """Verified links of every set to the hub of each of its posting lists."""
    pick = F.min if first else F.max
    hubs = postings.groupBy("key").agg(pick(F.struct("sid", "n", "component")).alias("hub"))
    pairs = (
        postings.join(hubs, "key")
        .where("component <> hub.component")
        .where((100 * F.least("n", "hub.n") >= PERCENT * F.greatest("n", "hub.n")))
        .select(F.least("sid", "hub.sid").alias("a"), F.greatest("sid", "hub.sid").alias("b"))
        .distinct()
    )
    return _verified(pairs, members)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return block_links(batches)


def tree_links(postings: DataFrame, members: DataFrame) -> DataFrame:
    """Links between different components within the same posting list; lists with the same least set make a block."""
    return block_rows(postings, members, F.size("token"), "token", "weight").mapInArrow(_blocks, "a long, b long")


def block_rows(postings: DataFrame, members: DataFrame, held: Column, *carried: str) -> DataFrame:
    """(block, i, j, sid, component, n, carried columns of ``members``, side), sorted by block and chunks; ``held`` counts a set's tokens."""
    least = postings.groupBy("key").agg(F.min("sid").alias("block"))
    blocks = postings.join(least, "key").select("block", "sid", "component", "n").distinct()
    blocks = scratch(blocks.join(members.select("sid", held.alias("held")), "sid"), "blocks")
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("sets"), F.sum("held").alias("held"))
    parts = F.greatest(F.col("sets") / BLOCK, F.col("held") / BLOCK_TOKENS)
    sizes = sizes.select("block", F.when(parts <= 1, F.lit(1)).otherwise(F.ceil(2 * parts)).cast("int").alias("chunks"))
    own = F.pmod(F.hash("sid"), F.col("chunks")).cast("int")
    return (
        blocks.drop("held").join(sizes, "block")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .join(members.select("sid", *carried), "sid")
        .select(
            "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            "sid", "component", "n", *carried, (F.col("own") > F.col("other")).cast("int").alias("side"),
        )
        .repartition("block", "i", "j")
        .sortWithinPartitions("block", "i", "j")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, set_id) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = "doc_id long, text_hash long, n long, sid long, sid2 long"
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    rows = scratch(docs.mapInArrow(_described, described), "shingle-sets")
    sets = rows.where("n > 0").groupBy("sid", "sid2", "n").agg(F.min("text_hash").alias("rep"))  # one of its texts
    only = (
        docs.select("text").mapInArrow(_emitted, "key long, sid long")
        .groupBy("key").agg(F.min("sid").alias("sid"), F.max("sid").alias("other")).where("sid = other")
        .groupBy("sid").agg(F.count(F.lit(1)).alias("alone"))
    )
    left = scratch(
        sets.join(only, "sid", "left").where(F.coalesce("alone", F.lit(0)) <= F.floor(F.col("n") / 4))
        .select(F.col("rep").alias("text_hash"), "sid"),
        "candidate-sets",
    )
    texts = probable_rows(docs.select("text_hash", "text"), "text_hash", left).join(left, "text_hash").select("sid", "text").distinct()
    arrays = scratch(texts.select("sid", "text").mapInArrow(_arrays, "sid long, n long, shingles array<long>"), "candidate-shingles")
    members = scratch(tokens(arrays), "candidate-tokens")
    forget(arrays)
    forget(left)
    postings = scratch(_in_components(prefixes(members), None).select("key", "sid", "n"), "postings")
    links = components = None
    for first in (True, False):
        found = scratch(_hub_links(_in_components(postings, components), members, first), "hub-links")
        links = found if links is None else links.unionByName(found)
        components = connected_components(links)
    active = scratch(_in_components(postings, components), "active-postings")
    links = links.unionByName(tree_links(active, members))
    components = connected_components(links)
    named = rows.where("n > 0").groupBy("sid", "sid2").agg(F.min("doc_id").alias("rep")).join(
        components.withColumnRenamed("id", "sid"), "sid", "left"
    )
    least = named.where("component_id is not null").groupBy("component_id").agg(F.min("rep").alias("least"))
    label = scratch(
        named.join(least, "component_id", "left").select("sid", "sid2", F.coalesce("least", "rep").alias("component_id")),
        "set-components",
    )
    for table in (members, postings, active):
        forget(table)
    return rows.join(label, ["sid", "sid2"], "left").select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("sid").alias("set_id"),
    )


def one_per_component(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their component, with their columns.

    Equal rows all stay; rows without doc_id stay where no row of their component has one.
    """
    own, text_hash = unused("kept_id", docs), unused("kept_hash", docs)
    kept = near_duplicates(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias(own), F.col("text_hash").alias(text_hash)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(kept[own]) & (F.xxhash64(docs["text"].cast("string")) == kept[text_hash])
    return docs.join(kept, same, "left_semi")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and near-duplicate component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
