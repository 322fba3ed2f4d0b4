"""Exact top-k by inner product with pivot-table elimination.

Vectors become whole numbers; with one component added, sqrt(M^2 - |x|^2) for rows and 0 for queries (M: the largest
norm), a larger inner product is a smaller Euclidean distance. Pivots are picked from a bounded sample so that each is as far
as possible from the span of those before. The distances of the rows of a block to all pivots are computed as the block is read. Of all
lower bounds of a distance to the query that two rows of that table give, the largest is used: that of the
simplex over the pivots, at least as large as any difference |d(q, p) - d(x, p)|. A query looks at the rows of a block whose bounds do not
exceed the k-th best distance found, at many such in order of the bounds until one does; it brings that distance along from the sample and
from block to block. Scores are compared as integers, so the result is exact.

Rows are dealt to lanes, each of which has a copy of the queries, or of a part of them if they are many. A lane is read in order, queries first: only they are
held. Lanes are fewer than rows are to a query, so that the copies are no more than the rows, but LANES at least. Nothing is broadcast but the pivots and the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphora.llm._common import written

K, SCALE, PIVOTS = 10, 1024, 64
#: Rows of the sample that pivots are picked from, at most, and its bytes.
SAMPLE, SAMPLE_BYTES = 4096, 8 << 20
#: Rows of a block, queries of a block.
ROWS, QUERIES = 4096, 256
#: Lanes that rows are dealt to at most, unless the queries are parted; bytes of queries that a lane holds.
LANES, HELD = 64, 192 << 20
#: Rows of a block that a query takes as they come; if more may be better, it takes them in order of their bounds.
FEW = 64
#: Share of M by which bounds are lowered for rounding, and least height of a pivot over the span of the others.
SLACK, HEIGHT = 1e-5, 1e-4
#: What single precision may add to an inner product of table rows by M, a share of M^2: 66 terms, places within 2 M of the first pivot.
ROUND = 1e-5
LONG = (1 << 63) - 1


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vectors (vec_id, embedding) -> (vec_id, v array<double>, dim): floor(scale * x) per component, x as double; whole numbers of any size.

    Rows with a null vec_id, a null vector, or a null or non-finite component take no part, nor do those where scale * x is beyond a double (1024 times a
    float never is). Empty vectors score 0 with each other.
    """
    d = vectors.select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * float(scale)).alias("e"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    d = d.where("vec_id is not null and e is not null").where(F.forall("e", lambda x: F.coalesce(fine(x), F.lit(False))))
    floor = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)  # noqa: E731  larger doubles are whole
    return d.select("vec_id", F.transform("e", floor).alias("v"), F.size("e").alias("dim"))


def scores(x: np.ndarray, q: np.ndarray) -> list[int] | np.ndarray:
    """Inner products of the rows of x, whole numbers, with q: exact, as floats or 64-bit integers where these hold them, else as Python's integers."""
    most = float(np.abs(x).max(initial=0.0)) * float(np.abs(q).max(initial=0.0)) * max(1, len(q))
    if most < 2.0**52:
        return (x @ q).astype(np.int64)
    if most < 2.0**62 and max(np.abs(x).max(), np.abs(q).max()) < 2.0**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    own = [int(c) for c in q.tolist()]
    return [sum(int(a) * b for a, b in zip(row, own, strict=True)) for row in x.tolist()]


@dataclass
class Pivots:
    """Pivots of one dimension, lifted, and the sample that they come from."""

    points: np.ndarray  # one row each, the added component last
    solve: np.ndarray  # from inner products with the pivots' differences to coordinates over them
    top: float  # M squared
    sample_ids: np.ndarray
    sample: np.ndarray

    @classmethod
    def pick(cls, ids: np.ndarray, x: np.ndarray, top: float, most: int) -> Pivots:
        """At most `most` rows of the sample, each the farthest from the span of those before."""
        lifted = np.column_stack([x, np.sqrt(np.maximum(top - (x**2).sum(axis=1), 0.0))])
        points, rest, base = [lifted[0]], lifted - lifted[0], []
        while len(points) < most:
            heights = (rest**2).sum(axis=1)
            far = int(np.argmax(heights))
            if not heights[far] > HEIGHT**2 * top:
                break
            points.append(lifted[far])
            base.append(rest[far] / np.sqrt(heights[far]))
            rest = rest - np.outer(rest @ base[-1], base[-1])
        apart = np.array(points[1:]).reshape(-1, lifted.shape[1]) - points[0]
        over = apart @ np.array(base).reshape(len(base), lifted.shape[1]).T  # triangular: each pivot by the directions up to its own
        return cls(np.array(points), np.linalg.inv(np.tril(over)).T if len(base) else np.zeros((0, 0)), top, ids, x)

    def distances(self, x: np.ndarray, added: np.ndarray) -> np.ndarray:
        """Squared distances of rows to all pivots."""
        p = self.points
        return np.maximum((x**2).sum(1)[:, None] + added[:, None] ** 2 + (p**2).sum(1)[None] - 2 * (x @ p[:, :-1].T + np.outer(added, p[:, -1])), 0.0)

    def table(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """What the distances to the pivots say of each row: its place in their span, and its height over it. Distances of such places are lower bounds."""
        added = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - (x**2).sum(axis=1), 0.0))
        d = self.distances(x, added)
        sides = ((self.points[1:] - self.points[0]) ** 2).sum(axis=1)
        place = (d[:, :1] - d[:, 1:] + sides[None]) / 2 @ self.solve
        height = np.sqrt(np.maximum(d[:, 0] - (place**2).sum(axis=1), 0.0))
        return np.column_stack([place, height])

    def far(self, norm: float, score: float) -> float:
        """Distance beyond which no row scores as much as `score` with a query of this squared norm, rounding included."""
        return float(np.sqrt(max(norm + self.top - 2.0 * score, 0.0))) + SLACK * float(np.sqrt(self.top))


class Best:
    """The k best rows that a query has seen."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def add(self, found: list[int] | np.ndarray, ids: np.ndarray) -> None:
        found = found.tolist() if isinstance(found, np.ndarray) else found
        self.rows = sorted([*self.rows, *((-s, i) for s, i in zip(found, ids.tolist(), strict=True))])[: self.k]

    def last(self) -> int | None:
        """The k-th score, if there are k."""
        return -self.rows[-1][0] if self.rows and len(self.rows) == self.k else None


def _cut(size: int, make):
    """Kernel: rows (vec_id, v, dim) -> what `make` makes of up to `size` rows of one dim."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                v = batch.column(1).filter(pa.array(dims == dim)).flatten().to_numpy().reshape(-1, dim) if dim else np.zeros((int((dims == 0).sum()), 0))
                own = ids[dims == dim]
                for at in range(0, len(own), size):
                    held.setdefault(dim, []).append((own[at : at + size], v[at : at + size]))
                    if sum(len(a) for a, _ in held[dim]) >= size:
                        yield make(dim, *(np.concatenate(c) for c in zip(*held.pop(dim), strict=True)))
        for dim, parts in held.items():
            yield make(dim, *(np.concatenate(c) for c in zip(*parts, strict=True)))

    return kernel


def _bytes(x: np.ndarray) -> pa.Array:
    """Each row's components as bytes, in single precision if that holds all of them."""
    x = np.ascontiguousarray(x, np.float32 if np.abs(x).max(initial=0.0) < 2.0**24 else np.float64)
    at = np.arange(len(x) + 1, dtype=np.int64) * (x.shape[1] * x.itemsize)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(x)]).cast(pa.binary())


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """What `_bytes` wrote, as doubles."""
    out = np.zeros((len(column), dim))
    if not dim:
        return out
    single = np.asarray(pc.equal(pc.binary_length(column), 4 * dim))
    for kind, own in ((np.float32, single), (np.float64, ~single)):
        if own.any():
            out[own] = np.frombuffer(b"".join(column.filter(pa.array(own)).to_pylist()), kind).reshape(-1, dim)
    return out


_DEALT = {"dim": pa.int32(), "lane": pa.int32(), "copies": pa.int32(), "query": pa.bool_(), "vec_id": pa.int64(), "v": pa.binary(), "far": pa.float64()}
_DDL = "dim int, lane int, copies int, query boolean, vec_id long, v binary, far double"


def _dealt(dim: int, lane, copies: int, query: bool, ids: np.ndarray, x: np.ndarray, far) -> pa.RecordBatch:
    full = lambda c: c if isinstance(c, np.ndarray) else np.full(len(ids), c)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((full(dim), full(lane), full(copies), full(query), ids), list(_DEALT.values())[:5], strict=True)] + [_bytes(x), pa.array(full(far), pa.float64())], list(_DEALT))


def _row_lanes(lanes: dict[int, tuple[int, int]]):
    """Rows in turn to the lanes of their dim, once for each part of its queries. A row's place in its partition says which."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() * 7
        turn = iter(range(at, 1 << 62))
        make = lambda dim, ids, x: (dim, ids, x)
        for dim, ids, x in _cut(ROWS, make)(batches):
            n, parts = lanes[dim]
            first = next(turn) * 31
            for part in range(parts):
                yield _dealt(dim, (first + np.arange(len(ids))) % n * parts + part, 1, False, ids, x, 0.0)

    return kernel


def _query_lanes(lanes: dict[int, tuple[int, int]], pivots: dict[int, Pivots], k: int):
    """Queries by part, with the distance beyond which each need not look: from its k best of the sample, whose rows are candidates as any."""

    def make(dim: int, ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        p, far = pivots[dim], np.full(len(ids), np.inf)
        for i, qid in enumerate(ids.tolist()):
            best, others = Best(k), p.sample_ids != qid
            found = scores(p.sample[others], q[i])
            near = np.argsort(found)[-k:] if isinstance(found, np.ndarray) else sorted(range(len(found)), key=found.__getitem__)[-k:]
            best.add([int(found[j]) for j in near], p.sample_ids[others][near])
            if best.last() is not None:
                far[i] = p.far(float((q[i] ** 2).sum()), float(best.last()))
        n, parts = lanes[dim]
        return _dealt(dim, np.arange(len(ids)) % parts, n, True, ids, q, far)

    return make


class _Queries:
    """A block of a lane's queries: their rows of the pivots' table, the best that each has seen, and how far it looks."""

    def __init__(self, p: Pivots, k: int, ids: np.ndarray, q: np.ndarray, far: np.ndarray):
        self.p, self.k, self.ids, self.q, self.limit = p, k, ids, q, far
        self.unit = float(np.sqrt(p.top)) or 1.0
        self.norms, self.most = (q**2).sum(axis=1), float(np.abs(q).max(initial=0.0)) * max(1, q.shape[1])
        self.place = p.table(q, query=True) / self.unit
        self.squares = (self.place**2).sum(axis=1)
        self.single = np.column_stack([self.place, np.ones(len(q))]).astype(np.float32)
        self.round = ROUND * (1 + np.sqrt(self.squares))
        self.best = [Best(k) for _ in range(len(q))]

    def least(self) -> np.ndarray:
        """Of each query: what its inner product with a row of the table, less half of that row's square, must come to for the row's bound not to exceed the limit."""
        return (self.squares - (self.limit / self.unit + SLACK) ** 2) / 2 - self.round

    def see(self, i: int, found: list[int] | np.ndarray, ids: np.ndarray) -> None:
        self.best[i].add(found, ids)
        if (last := self.best[i].last()) is not None:
            self.limit[i] = min(self.limit[i], self.p.far(float(self.norms[i]), float(last)))

    def look(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray, box: tuple[np.ndarray, np.ndarray], largest: float) -> int:
        """Looks at a block of rows; returns how many scores were computed."""
        off = np.maximum(np.maximum(box[0] - self.place, self.place - box[1]), 0.0)  # of the box that holds the whole block
        asks = np.flatnonzero(~(np.sqrt((off**2).sum(axis=1)) - SLACK > self.limit / self.unit))
        if not len(asks):
            return 0
        near = self.single[asks] @ table.T
        least = self.least()
        at = np.flatnonzero(~(near < least[asks].astype(np.float32)[:, None]).ravel())
        i, j = asks[at // len(ids)], at % len(ids)
        own = ids[j] != self.ids[i]
        at, i, j = at[own], i[own], j[own]
        looked, ends = 0, np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(self.ids)))])
        plain = self.most * largest < 2.0**52
        few = plain and len(i) and (np.diff(ends)[i] <= FEW)
        exact = np.zeros(len(i), np.int64)
        if plain and len(i) and few.any():
            exact[few] = np.einsum("ij,ij->i", x[j[few]], self.q[i[few]]).astype(np.int64)
        for n in np.unique(i).tolist():
            a, b = ends[n], ends[n + 1]
            if plain and b - a <= FEW:
                self.see(n, exact[a:b], ids[j[a:b]])
                looked += int(b - a)
                continue
            bound, rows = near.ravel()[at[a:b]].astype(np.float64), j[a:b]
            bound[np.isnan(bound)] = np.inf
            order = np.argsort(-bound, kind="stable")
            bound, rows, to, step = bound[order], rows[order], 0, 4 * self.k
            while to < len(rows) and not bound[to] < self.least()[n]:
                some = rows[to : to + step]
                self.see(n, scores(x[some], self.q[n]), ids[some])
                looked += len(some)
                to, step = to + step, 2 * step
        return looked


class _Lane:
    """What a task holds of a lane: its queries, and rows up to a block."""

    def __init__(self, p: Pivots, k: int, rows: int, queries: int, seen: Accumulator | None):
        self.p, self.k, self.rows, self.queries, self.seen = p, k, rows, queries, seen
        self.asked: list[tuple] = []
        self.blocks: list[_Queries] | None = None
        self.held: list[tuple] = []

    def add(self, query: bool, ids: np.ndarray, x: np.ndarray, far: np.ndarray) -> None:
        (self.asked if query else self.held).append((ids, x, far))
        if not query and sum(len(h[0]) for h in self.held) >= self.rows:
            self.look()

    def look(self) -> None:
        if self.blocks is None:
            ids, q, far = (np.concatenate(c) for c in zip(*self.asked, strict=True)) if self.asked else (np.zeros(0),) * 3
            self.asked = []
            self.blocks = [_Queries(self.p, self.k, ids[a : a + self.queries], q[a : a + self.queries], far[a : a + self.queries].copy()) for a in range(0, len(ids), self.queries)]
        if not self.held or not self.blocks:
            self.held = []
            return
        every, xs, _ = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held = []
        for a in range(0, len(every), self.rows):
            ids, x = every[a : a + self.rows], xs[a : a + self.rows]
            place = self.p.table(x) / self.blocks[0].unit
            table = np.column_stack([place, -(place**2).sum(axis=1) / 2]).astype(np.float32)
            box, largest = (place.min(axis=0), place.max(axis=0)), float(np.abs(x).max(initial=0.0))
            looked = sum(b.look(ids, x, table, box, largest) for b in self.blocks)
            if self.seen is not None:
                self.seen.add(np.array([looked, sum(len(b.ids) for b in self.blocks) * len(ids)]))

    def results(self) -> Iterator[pa.RecordBatch]:
        self.look()
        for b in self.blocks or []:
            out = [(qid, j, max(-LONG - 1, min(LONG, -s)), -s) for qid, best in zip(b.ids.tolist(), b.best, strict=True) for s, j in best.rows]
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            wide = [None if s == t else f"{t:+}" for s, t in zip(cols[2], cols[3], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(wide, pa.string())], ["query_id", "vec_id", "score", "wide"])


def _search(k: int, pivots: dict[int, Pivots], rows: int, queries: int, seen: Accumulator | None):
    """Kernel: `_DEALT` by lane, queries first -> (query_id, vec_id, score, wide): each query's k best of the lane, but none known to be beaten."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lane = None, None
        for batch in batches:
            dims, lanes, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "lane", "query"))
            cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(lanes) != 0) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(dims)], strict=True):
                if a == b:
                    continue
                if (dims[a], lanes[a]) != now:
                    if lane is not None:
                        yield from lane.results()
                    now, lane = (dims[a], lanes[a]), _Lane(pivots[int(dims[a])], k, rows, queries, seen)
                own = batch.slice(a, b - a)
                lane.add(bool(asks[a]), own.column("vec_id").to_numpy(), _vectors(own.column("v"), int(dims[a])), own.column("far").to_numpy())
        if lane is not None:
            yield from lane.results()

    return kernel


def lanes_of(rows: int, queries: int, dim: int) -> tuple[int, int]:
    """Lanes that rows are dealt to, and parts that queries are in: a part is HELD bytes at most."""
    parts = max(1, -(-queries * (18 * dim + 1500) // HELD))
    return max(1, min(-(-rows // ROWS), max(LANES // parts, min(LANES, rows // max(1, queries))))), parts


def _pivots(rows: DataFrame, most: int) -> tuple[dict[int, Pivots], dict[int, int]]:
    """Of each dimension, of which there are a handful: pivots from the rows of the least hash, SAMPLE and SAMPLE_BYTES at most; and how many rows it has."""
    some = rows.select("vec_id", "v", "dim", F.xxhash64("vec_id", "v").alias("h"))
    all_dims = some.groupBy("dim").agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m"), F.count("*").alias("n")).collect()
    tops = {r.dim: float(r.m) for r in all_dims}
    out = {}
    for dim, top in tops.items():
        n = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, dim))))
        got = some.where(F.col("dim") == dim).orderBy("h", "vec_id").limit(n).select("vec_id", "v").toArrow()
        x = np.array(got.column(1).to_pylist(), np.float64).reshape(got.num_rows, dim)
        out[dim] = Pivots.pick(got.column(0).to_numpy(), x, top, most if np.isfinite(top) else 1)
    return out, {r.dim: r.n for r in all_dims}


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, seen: Accumulator | None = None) -> DataFrame:
    """rows, queries (vec_id, v array<double>, dim) of `whole` -> (query_id, rank int, vec_id, score): of each query the k
    rows with another vec_id and the largest inner product (all, if fewer), ties to the smaller vec_id.

    Only vectors of one dimension are compared. A query given twice answers once if its vectors agree; two vectors
    under one id answer as one query. Repeated rows are candidates as often as they are given. No rows: no result. Scores beyond a
    long are ranked as they are and given as the largest or least long. seen, if given, counts the rows whose scores were computed, and all.
    """
    picked, sizes = _pivots(rows, pivots)
    asked = queries.select("vec_id", "v", "dim").distinct()
    asked = written(asked.where(F.col("dim").isin(list(picked)) if picked else F.lit(False)), "asked")  # no rows of that dimension, no answer
    counts = {r.dim: r["count"] for r in asked.groupBy("dim").count().collect()}
    lanes = {dim: lanes_of(n, counts[dim], dim) for dim, n in sizes.items() if dim in counts}
    rows = rows.select("vec_id", "v", "dim").where(F.col("dim").isin(list(lanes)) if lanes else F.lit(False))
    asked = asked.repartition(max(1, -(-sum(counts.values()) // 8192))).mapInArrow(_cut(QUERIES, _query_lanes(lanes, picked, k)), _DDL)
    parts = F.coalesce(*[F.when(F.col("dim") == dim, p) for dim, (_, p) in lanes.items()], F.lit(1))
    asked = asked.withColumn("_n", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("lane", (F.col("_n") * parts + F.col("lane")).cast("int")).drop("_n")
    dealt = asked.unionByName(rows.mapInArrow(_row_lanes(lanes), _DDL))
    dealt = dealt.repartition(max(1, 2 * sum(n * p for n, p in lanes.values())), "dim", "lane").sortWithinPartitions("dim", "lane", F.desc("query"))
    found = dealt.mapInArrow(_search(k, picked, ROWS, QUERIES, seen), "query_id long, vec_id long, score long, wide string")
    # a score beyond a long: by sign, then by number of digits, then by digits, all turned about below zero
    below = F.col("wide").startswith("-")
    size, digits = F.coalesce(F.length("wide"), F.lit(0)), F.translate("wide", "0123456789", "9876543210")
    order = [F.desc("score"), F.when(below, -size).otherwise(size).desc(), F.when(below, digits).otherwise(F.col("wide")).desc(), F.asc("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
