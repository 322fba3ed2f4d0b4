from pyspark.sql import functions as F

from glyphora.functions import position


def test_order_and_successor(spark):
    rows = [(s, c, f) for s in (0, 1, 5) for c in (0, 1, 2) for f in (False, True)]
    df = spark.createDataFrame(rows, "s int, c int, f boolean").withColumn("p", position.pack(F.col("s"), F.col("c"), F.col("f")))
    for r in df.select("*", position.key(F.col("p")).alias("k"), position.successor(F.col("p")).alias("n"), position.show(F.col("p")).alias("t"), position.parse(position.show(F.col("p"))).alias("q"), position.sign_no(F.col("p")).alias("sn"), position.component_no(F.col("p")).alias("cn")).collect():
        assert r.k == r.s * 128 + r.c and r.n == ((r.s + 1) * 128 if r.f else r.k + 1)
        assert r.t == f"{r.s}.{r.c}.{int(r.f)}" and r.q == r.p and (r.sn, r.cn) == (r.s, r.c)


def test_ranges(spark):
    df = spark.createDataFrame([(10_000_000, 0), (0, 100), (-1, 0)], "s int, c int")
    assert df.select(position.pack(F.col("s"), F.col("c"), F.lit(True)).alias("p")).where("p is not null").count() == 0


def _p(s, c, f):
    return (s << 8) | (c << 1) | f


def test_sets_of_positions(spark):
    rows = [
        ([_p(1, 0, 0), _p(1, 1, 1), _p(2, 0, 1)], True, True),
        ([_p(2, 0, 1), _p(1, 1, 1), None, _p(1, 0, 0)], True, True),
        ([_p(1, 0, 1), _p(3, 0, 1)], False, True),
        ([_p(1, 0, 1), _p(1, 0, 0)], False, False),
        ([_p(1, 0, 1), _p(1, 1, 1)], False, False),
        ([None], None, None),
    ]
    df = spark.createDataFrame(rows, "a array<long>, chain boolean, apart boolean")
    for r in df.select("*", position.unbroken(F.col("a")).alias("c"), position.disjoint(F.col("a")).alias("d")).collect():
        assert (r.c, r.d) == (r.chain, r.apart)


def test_sorted_distinct(spark):
    df = spark.createDataFrame([([4, 5, 4, None, 1],), ([None],), ([],)], "a array<int>")
    assert [r[0] for r in df.select(position.sorted_distinct(F.col("a"))).collect()] == [[1, 4, 5], None, None]
