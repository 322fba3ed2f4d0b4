import math
import random
from fractions import Fraction

import numpy as np
from pyspark.accumulators import AccumulatorParam

from glyphora.llm import topk


def brute(rows, k):
    out = []
    fine = [(i, [math.floor(1024 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and x == x and abs(x) != float("inf") for x in v)]
    for q, v in fine:
        if q % 100:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fine if i != q and len(w) == len(v)))
        out += [(q, n, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def result(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")
    whole = topk.whole(df)
    return sorted(map(tuple, topk.top_k(whole, whole.where("vec_id % 100 = 0"), **more).collect()))


def vectors(n, dim, seed=1):
    rng = random.Random(seed)
    f = lambda: rng.randint(-300, 300) / 256  # noqa: E731  exact as float
    return [(i, [f() for _ in range(dim)]) for i in range(n)]


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 64)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rows = vectors(450, 8)
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # ties
    assert result(spark, rows) == brute(rows, 10)
    assert result(spark, rows, k=3, pivots=1) == brute(rows, 3)


def test_edges(spark):
    rows = vectors(30, 3) + [(31, None), (32, []), (None, [1.0, 2.0, 3.0]), (33, [1.0, None, 2.0]), (34, [float("nan"), 1.0, 1.0]), (35, [float("inf"), 1.0, 1.0])]
    rows += [(100, [0.0, 0.0, 0.0]), (200, [1.0, 2.0]), (201, [2.0, 1.0]), (300, [5.0])]
    assert result(spark, rows) == brute(rows, 10)
    assert result(spark, []) == [] and result(spark, [(0, [1.0])]) == []


def test_repeated_rows(spark):
    rows = vectors(5, 2)
    got = result(spark, [*rows, *rows])
    assert [r[1] for r in got] == list(range(1, 9)) and len(got) == 8  # each other row twice, its own never


def test_large_components(spark):
    rows = [(0, [1.0, 1.0]), (1, [200000.0, 1.0]), (2, [2.0, 1.0])]
    assert result(spark, rows) == [(0, 1, 1, 204800000 * 1024 + 1024 * 1024), (0, 2, 2, 3 * 1024 * 1024)]
    wide = vectors(150, 4, 3) + [(200, [3e38, -1e30, 2.5, 1e9]), (201, [1e25, 1.0, 1.0, 1.0]), (202, [-1e25, 0.0, 1.0, 7.0]), (203, [1.1e25, 3.0, 1.0, 1.0]), (204, [-3e38, 3e38, 0.0, 0.0]), (300, [1e12, -1e13, 5e12, 3.0]), (301, [1e12, -1e13, 5e12, 4.0])]
    wide = [(i, [float(np.float32(x)) for x in v]) for i, v in wide]
    assert result(spark, wide) == brute(wide, 10)
    tiny = [(i, [1e-30 * i, -1e-30]) for i in range(20)]
    assert result(spark, [(i, [float(np.float32(x)) for x in v]) for i, v in tiny]) == brute([(i, [float(np.float32(x)) for x in v]) for i, v in tiny], 10)


def test_equal_and_collinear_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 16)
    rows = [(i, [1.5, -2.0, 0.25]) for i in range(120)] + [(200 + i, [0.5 * i, 0.0, 0.0]) for i in range(30)] + [(300 + i, [0.0, 0.0, 0.0]) for i in range(3)]
    assert result(spark, rows) == brute(rows, 10)


class Sum(AccumulatorParam):
    def zero(self, value):
        return np.zeros(2, np.int64)

    def addInPlace(self, a, b):
        return a + b


def test_pivots_leave_few_rows(spark):
    """Of all rows of the table, by number of pivots."""
    rows = topk.whole(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    share, got = {}, {}
    for n in (1, 48, 64):
        seen = spark.sparkContext.accumulator(np.zeros(2, np.int64), Sum())
        got[n] = sorted(map(tuple, topk.top_k(rows, rows.where("vec_id % 100 = 0"), pivots=n, seen=seen).collect()))
        share[n] = seen.value[0] / seen.value[1]
    assert got[1] == got[48] == got[64] and share[64] < 0.1 and share[64] < share[48] < share[1]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(300, 20)) * rng.choice([1, 40, 3000], size=(300, 1)))
    top = float((x**2).sum(axis=1).max())
    p = topk.Pivots.pick(np.arange(300), x, top, 12)
    q = np.floor(rng.normal(size=(9, 20)) * 500)
    a, b = p.table(q, query=True), p.table(x)
    bound = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    true = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2) + (top - (x**2).sum(axis=1))[None])
    plain = np.abs(np.sqrt(p.distances(q, np.zeros(9)))[:, None] - np.sqrt(p.distances(x, np.sqrt(top - (x**2).sum(axis=1))))[None]).max(axis=2)
    slack = topk.SLACK * np.sqrt(top)
    assert len(p.points) == 12 and (bound <= true + slack).all() and (bound >= plain - slack).all()


def test_mixed_dimensions_with_few_rows(spark):
    rows = [(100, [1.0, 2.0]), (1, [3.0, 4.0]), (200, [1.0, 2.0, 3.0]), (300, [1.0]), (2, [5.0]), (3, [5.0]), (400, []), (4, []), (5, [])]
    assert result(spark, rows) == brute(rows, 10) and len(result(spark, rows)) == 5


def test_copies_of_queries_are_bounded_and_not_broadcast(spark, monkeypatch):
    """Lanes don't grow with the rows once there are so many rows to a query, and no query block is broadcast to them."""
    rows, parts = topk.lanes_of(15_400_000, 154_000, 64)
    assert rows * 154_000 <= 15_400_000 and parts == 3 and rows == topk.LANES
    assert topk.lanes_of(10**6, 10**6, 64)[1] > 5 and topk.lanes_of(5, 1, 3) == (1, 1)
    monkeypatch.setattr(topk, "ROWS", 16)
    whole = topk.whole(spark.createDataFrame([(*r, "x") for r in vectors(450, 4)], "vec_id long, embedding array<float>, rank string"))
    found = topk.top_k(whole, whole.where("vec_id % 100 = 0"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_queries_in_parts(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 32)
    monkeypatch.setattr(topk, "QUERIES", 2)
    monkeypatch.setattr(topk, "HELD", 3000)
    monkeypatch.setattr(topk, "LANES", 6)
    rows = vectors(700, 5, 4) + [(100 * i, [float(i), 1e20, 0.0, 1.0, 2.0 * i]) for i in range(8, 12)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert topk.lanes_of(704, 11, 5)[1] > 1 and result(spark, rows) == brute(rows, 10)
