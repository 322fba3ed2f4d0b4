"""SimHash near-duplicates: fingerprints, and a Gray-order hierarchical index to link them.

Fingerprints are reduced to their distinct values first, so copies never meet each other. Two 64-bit values
that differ in at most 3 bits agree in all but 3 of some blocks of their bits; each distinct value is dealt out by what is left when any 3 blocks are taken
away: 4 blocks of 16 bits, or more and finer ones for more values, so that buckets stay small. A bucket with more than `HOT` values is dealt out again, by 4 blocks of the
bits that its values don't share by being in it, and so on: no bucket is compared with another, and none grows with the data. Within a
bucket the values stand in order of their Gray rank, in which neighbours share many bits. Runs
of 16 values form a node, runs of 16 nodes an upper node; a node holds the mask of bits that all of it share.
Two nodes differ at least in the masked bits in which they disagree: those differences are added up on the
way down and a pair of groups is dropped as soon as they exceed the limit, before any value is looked at.
Groups that are already in one component are skipped as well, since only components are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphora.llm._common import keyed, text_steps, texts_of, written
from glyphora.llm.components import connected_components

#: Bits in which linked fingerprints may differ.
MOST = 3
#: Values of a node, nodes of an upper node.
FAN = 16
#: A bucket of more distinct values is dealt out again.
HOT = 16_384
#: Values up to which 4 and 5 blocks do (1,000 a bucket on average, were they random); 6 beyond.
FOUR, FIVE = 1 << 26, 1 << 35
#: Pairs that a step of the search expands at once.
STEP = 1 << 20


def fingerprint(text: bytes) -> int:
    """SimHash of a UTF-8 text over lower-cased (A-Z) words and 3-word shingles, XXH64 with seed 42."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < 3:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[:-2].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[2:].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (doc_id, or others beside text) and fp long: the signed SimHash of text (null: 0)."""
    keep = keep or ["doc_id"]
    given = docs.select(*keep, F.col("text").alias("_text"))
    schema = docs.select(*keep).schema.add("fp", "long")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, "_text"):
                fps = np.array([fingerprint(t) for t in texts_of(part, "_text")], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fps)], [*keep, "fp"])

    return given.mapInArrow(kernel, schema)


def gray_rank(fp):
    """Column: the position of fp's 64 bits in Gray order, as a signed number with the same order."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _expand(na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair with na x nb members: index of the pair, and the member of either side."""
    n = na * nb
    pair = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    return pair, k // nb[pair], k % nb[pair]


class Index:
    """Nodes over values that stand in Gray order within groups (buckets or chunks).

    values uint64; groups: start of each group in values, with the end added.
    """

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        self.values = values
        self.label = np.arange(len(values))
        self.leaf = self._cut(groups)
        first = np.searchsorted(self.leaf[:-1], groups)  # leaves of each group
        self.top = self._cut(first)
        self.group_top = np.searchsorted(self.top[:-1], first)
        self.leaf_fixed, self.leaf_ones = self._masks(self.leaf[:-1], values, ~values)
        leaf_zeros = self.leaf_fixed & ~self.leaf_ones
        self.top_fixed, self.top_ones = self._masks(self.top[:-1], self.leaf_ones, leaf_zeros)

    @staticmethod
    def _cut(groups: np.ndarray) -> np.ndarray:
        sizes = np.diff(groups)
        pieces = -(-sizes // FAN)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        return np.append(np.repeat(groups[:-1], pieces) + FAN * within, groups[-1])

    @staticmethod
    def _masks(starts: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = np.bitwise_and.reduceat(ones, starts)
        return one | np.bitwise_and.reduceat(zeros, starts), one

    def link(self, tops: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        """Joins labels of values in the given pairs of upper nodes that differ in at most MOST bits."""
        for a, b in tops:
            common = self.top_fixed[a] & self.top_fixed[b]
            apart = np.bitwise_count(common & (self.top_ones[a] ^ self.top_ones[b]))
            for s in np.split(np.flatnonzero(apart <= MOST), range(STEP // FAN**2, int((apart <= MOST).sum()), STEP // FAN**2)):
                self._leaves(a[s], b[s], common[s], apart[s])

    def _leaves(self, ta: np.ndarray, tb: np.ndarray, common: np.ndarray, apart: np.ndarray) -> None:
        pair, i, j = _expand(self.top[ta + 1] - self.top[ta], self.top[tb + 1] - self.top[tb])
        a, b = self.top[ta][pair] + i, self.top[tb][pair] + j
        keep = a <= b
        pair, a, b = pair[keep], a[keep], b[keep]
        shared = self.leaf_fixed[a] & self.leaf_fixed[b]
        total = apart[pair] + np.bitwise_count(shared & ~common[pair] & (self.leaf_ones[a] ^ self.leaf_ones[b]))
        keep = np.flatnonzero(total <= MOST)
        order = keep[np.argsort(b[keep] - a[keep], kind="stable")]  # near ones first: they join whole groups early
        for s in np.split(order, range(STEP // FAN**2, len(order), STEP // FAN**2)):
            low, high = np.minimum.reduceat(self.label, self.leaf[:-1]), np.maximum.reduceat(self.label, self.leaf[:-1])
            s = s[~((low[a[s]] == high[a[s]]) & (low[a[s]] == low[b[s]]) & (low[b[s]] == high[b[s]]))]
            if len(s):
                self._values(a[s], b[s], shared[s], total[s])

    def _values(self, la: np.ndarray, lb: np.ndarray, shared: np.ndarray, apart: np.ndarray) -> None:
        pair, i, j = _expand(self.leaf[la + 1] - self.leaf[la], self.leaf[lb + 1] - self.leaf[lb])
        a, b = self.leaf[la][pair] + i, self.leaf[lb][pair] + j
        differ = apart[pair] + np.bitwise_count((self.values[a] ^ self.values[b]) & ~shared[pair])
        hit = (a < b) & (differ <= MOST)
        a, b = a[hit], b[hit]
        while True:
            x, y = self.label[a], self.label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, low = a[open_], b[open_], np.minimum(x, y)[open_]
            np.minimum.at(self.label, x[open_], low)
            np.minimum.at(self.label, y[open_], low)
            while not np.array_equal(after := self.label[self.label], self.label):
                self.label = after

    def edges(self) -> pa.RecordBatch:
        """Each value that has a smaller one in its component, with that one."""
        i = np.flatnonzero(self.label != np.arange(len(self.label)))
        v = self.values.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(v[i]), pa.array(v[self.label[i]])], ["u", "v"])


def _within(index: Index) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of upper nodes of a group, each with itself first, at growing distance."""
    group = np.repeat(np.arange(len(index.group_top) - 1), np.diff(index.group_top))
    left = np.arange(len(group))
    d = 0
    while len(left):
        yield left, left + d
        d += 1
        left = left[left + d < len(group)]
        left = left[group[left] == group[left + d]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key and Gray rank -> edges. Holds some whole buckets at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def done(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        index = Index(fp.view(np.uint64), np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key)))
        index.link(_within(index))
        return index.edges()

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= 200_000:
            key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield done(key[:cut], fp[:cut])
            held, size = [(key[cut:], fp[cut:])], len(key) - cut
    if size:
        yield done(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _cut(bits: list[int], parts: int) -> list[int]:
    """Masks of a run of bits each, all together the given bits."""
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:], strict=False) if y > x]


def masks(blocks: int) -> list[int]:
    """What is left of 64 bits if any MOST of `blocks` blocks are taken away."""
    parts = _cut(list(range(64)), blocks)
    return [sum(own) for own in combinations(parts, blocks - MOST)]


def finer(mask: int) -> list[int]:
    """The mask with each of MOST + 1 blocks of the other bits: values that agree in it and differ in at most MOST bits agree in one of these."""
    return [mask | more for more in _cut([b for b in range(64) if not mask >> b & 1], MOST + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(values: DataFrame, n: int, hot: int | None = None) -> DataFrame:
    """values (fp long), distinct, n of them -> edges (u, v) whose components are those of all pairs within MOST bits."""
    hot, edges = max(16, hot or HOT), None  # so a hot bucket has enough bits left for MOST + 1 blocks
    first = [_signed(m) for m in masks(4 if n <= FOUR else 5 if n <= FIVE else 6)]
    dealt = values.select("fp", F.explode(F.array(*[F.lit(m) for m in first])).alias("mask"))
    while True:
        dealt = dealt.withColumn("key", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))  # buckets that share a key share a search, no more
        many = written(dealt.groupBy("key", "mask").count().where(F.col("count") > hot).select("key", "mask"), "hot")
        again = [r.mask for r in many.select("mask").distinct().collect()]  # of a level's 4, 16, … masks
        cold = dealt.join(many, ["key", "mask"], "left_anti") if again else dealt
        found = cold.withColumn("gray", gray_rank(F.col("fp"))).repartition("key").sortWithinPartitions("key", "gray").select("key", "fp").mapInArrow(_local, "u long, v long")
        edges = found if edges is None else edges.union(found)
        if not again:
            return edges
        deeper = [(m, _signed(x)) for m in again for x in finer(m % (1 << 64))]
        deeper = values.sparkSession.createDataFrame(deeper, "mask long, finer long")  # four rows a mask
        inner = dealt.join(many, ["key", "mask"], "left_semi").join(F.broadcast(deeper), "mask")
        dealt = written(inner.select("fp", F.col("finer").alias("mask")).distinct(), "dealt")


def near_duplicates(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default doc_id) of every row of docs, fp long, root long (one value per component) and
    component_id: the smallest doc_id reachable over links, itself included.

    Null and empty texts have fingerprint 0 and are linked like any other; rows with a null doc_id link others
    but never name a component (null if it has no other id); repeated rows come back as often as they are given.
    """
    rows = written(fingerprints(docs, keep), "fingerprints")
    values = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    values = written(values, "values")
    comps = connected_components(links(values.select("fp"), values.count()))
    rooted = values.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(names, "root").select("fp", "root", "component_id"), "named")
    return rows.join(named, "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each component: the one with the smallest doc_id.

    A component without any doc_id keeps the row with the smallest row key; of repeated rows one stays.
    """
    rows = keyed(docs)
    marked = written(near_duplicates(rows, ["doc_id", "did", "th"]).select("root", "doc_id", "did", "th"), "marked")
    best = marked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "did", "th")).alias("x")).select("root", "x.did", "x.th")
    times = marked.groupBy("root", "did", "th").count()
    goes = written(times.join(best.withColumn("best", F.lit(True)), ["root", "did", "th"], "left").where("best is null or count > 1"), "goes")
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("did"), F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()).alias("th"))
    single = own.join(goes.select("did", "th").hint("shuffle_hash"), ["did", "th"], "left_anti").select("row.*")
    again = own.join(goes.where("best").select("did", "th"), ["did", "th"], "left_semi")
    again = again.groupBy("did", "th").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return single.unionByName(again)
