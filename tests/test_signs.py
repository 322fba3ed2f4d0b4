from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphora.functions import labels, signtree
from glyphora.functions.signtree import compose, matches, normalize, normalized, number_specs, parse, split_glyphs, split_sign
from glyphora.operators import aggregates

TREES = st.recursive(st.sampled_from("ABCDE").map(lambda x: (x, ())), lambda t: st.tuples(st.sampled_from(".+×&"), st.tuples(t, t)) | st.tuples(st.sampled_from(["t", "g", "180"]), st.tuples(t)), max_leaves=8)


@settings(max_examples=500, derandomize=True)
@given(TREES)
def test_compose_then_parse(tree):
    assert parse(compose(tree)) == tree


@settings(max_examples=500, derandomize=True)
@given(TREES)
def test_normal_form_is_stable(tree):
    assert normalize(normalize(tree)) == normalize(tree)


def test_normal_forms():
    assert normalized("A.(B.C)") == "A.B.C" and normalized("(A&B).(C&D)") == "(A.C)&(B.D)" and normalized("A×(B.C)@t") == "A×(B.C)@t"
    assert compose(parse("((A))")) == "A" and parse("A@t@g") == ("g", (("t", (("A", ()),)),))


def test_matches():
    assert matches(parse("A.B.C"), parse("A.X")) and matches(parse("A×B"), parse("X×B")) and not matches(parse("A×B"), parse("A.B")) and not matches(parse("A"), parse("A.X"))


def test_splits():
    assert split_glyphs("A.(B.C).D") == ["A", "(B.C)", "D"]
    assert split_sign("KA×A") == [("", "KA"), ("×", "A"), ("", None)] and split_sign("(A.B)@t") == [("(", "A"), (".", "B"), (")@t", None)]
    assert number_specs("1(AŠ)2(DIŠ)3") == [("1", "AŠ"), ("2", "DIŠ"), ("3", None)]


def test_html():
    assert signtree.html(parse("A&B")) == '<span class="stack">A<br/>B</span>' and signtree.html(parse("LAK123")) == 'LAK<span class="slindex">123</span>'
    assert signtree.html(parse("DU3@t")) == 'DU<span class="index">3</span><span class="modifier">tenû</span>' and signtree.number_html("1!(AŠ)") == "1<span class='critics'>!</span><span class='signspec'>AŠ</span>"


def test_variant_types(spark):
    names = ["default", "nondefault", "reduced", "augmented", "nonstandard"]
    rows = [(a, b) for a in [*names, None] for b in [*names, None]]
    got = {(r.a, r.b): r.m for r in spark.createDataFrame(rows, "a string, b string").withColumn("m", aggregates.merge_variant_types(F.col("a"), F.col("b"))).collect()}
    for (a, b), m in got.items():
        if a is None or b is None:
            assert m is None
        elif a == b:
            assert m == a
        elif "default" in (a, b) and {"reduced", "augmented"} & {a, b}:
            assert m == (b if a == "default" else a)
        else:
            assert m == ("nondefault" if {a, b} == {"default", "nondefault"} else "nonstandard")


def test_conditions(spark):
    rows = [(1, "lost"), (1, "lost"), (2, "lost"), (2, "intact"), (3, "lost"), (3, "deleted"), (4, None), (5, "inserted"), (5, None)]
    got = dict(spark.createDataFrame(rows, "k int, c string").groupBy("k").agg(aggregates.condition_merge(F.col("c"))).collect())
    assert got == {1: "lost", 2: "damaged", 3: None, 4: None, 5: "inserted"}


def test_labels(spark):
    df = spark.createDataFrame([("column", "14"), ("summary", "a4b9"), ("block", None), ("caption", "x"), ("caption", None)], "k string, d string")
    assert [r[0] for r in df.select(labels.block_short(F.col("k"), F.col("d"))).collect()] == ["xiv", "aivbix", "", "caption x", "caption"]
    df = spark.createDataFrame([("obverse", None), ("surface", "C"), ("fragment", "2")], "k string, d string")
    assert [tuple(r) for r in df.select(labels.surface_short(F.col("k"), F.col("d")), labels.surface_long(F.col("k"), F.col("d"), F.lit("?"))).collect()] == [("o.", "obverse?"), ("C", "C?"), ("fragment 2", "fragment 2?")]
    assert [r[0] for r in spark.range(1, 4000).select(labels.roman(F.col("id"))).where("id in (4, 1994, 3999)").collect()] == ["iv", "mcmxciv", "mmmcmxcix"]


def test_streamed_counts(spark, tmp_path):
    from glyphora.streaming.counts import counted

    rows = [(k % 3, "insert" if k % 4 else "delete") for k in range(40)]
    df = spark.createDataFrame(rows, "id int, action string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = counted(stream, ["id"]).writeStream.outputMode("complete").format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("streamed").collect())) == sorted(map(tuple, counted(df, ["id"]).collect()))
