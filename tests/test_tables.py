from glyphora.operators import names
from glyphora.operators import signlist as signs
from glyphora.operators.editing import pack, unpack
from glyphora.schemas import KEYS, schema
from glyphora.sources import tables

from . import mini


def test_csv(spark, tmp_path):
    (tmp_path / "periods.csv").write_text('1,"Early","[-2500,-2300)",\\N\n2,Late,\\N,1\n')
    (tmp_path / "pn_variants.csv").write_text('1,0,"[{""word_no"":0,""value_id"":3,""sign_id"":2}]"\n')
    got = tables.read_csv(spark, str(tmp_path / "periods.csv"), schema("periods")).orderBy("period_id").collect()
    assert tuple(got[0].years) == (-2500, -2301) and got[0].super is None and got[1].years is None and got[1].super == 1
    row = tables.read_csv(spark, str(tmp_path / "pn_variants.csv"), schema("pn_variants")).first()
    assert row.sign_meanings[0].value_id == 3 and row.sign_meanings[0].stem is None


def test_round_trip_and_single_transliterations(spark, tmp_path):
    empty = tables.create_corpus(spark)
    assert set(empty) == set(KEYS) and tables.violations(empty).count() == 0
    t = empty | {
        "words": spark.createDataFrame([(1, 0, 0, False), (1, 1, 5, False), (2, 0, 0, True), (2, 0, 0, True)], schema("words")),
        "compounds": spark.createDataFrame([(1, 0, None, None, None, None), (2, 0, "person", None, None, "x")], schema("compounds")),
    }
    assert {tuple(r) for r in tables.violations(t).collect()} == {("words key", 2, 0), ("words.compound_no", 1, 5)}
    one = tables.copy_transliteration(t, 2, 9)
    assert {r.transliteration_id for r in one["compounds"].collect()} == {9}
    assert tables.delete_transliteration(t, 2)["words"].count() == 2
    tables.save(t, str(tmp_path / "p"))
    back = tables.open_tables(spark, str(tmp_path / "p"), ["words", "compounds"])
    assert sorted(map(tuple, back["words"].collect())) == sorted(map(tuple, t["words"].collect()))


def test_pack_and_unpack(spark):
    rows = {
        "compounds": spark.createDataFrame([(1, 1, None, None, None, None), (1, 0, "god", None, None, "c")], schema("compounds")),
        "words": spark.createDataFrame([(1, 0, 0, False), (1, 1, 1, True)], schema("words")),
    }
    t = tables.create_corpus(spark) | rows
    for name, df in unpack(pack(t)).items():
        assert sorted(map(repr, df.select(*t[name].columns).collect())) == sorted(map(repr, t[name].collect()))


def test_variants_keep_their_numbers(signlist):
    t = signlist
    found = signs.variants(t)
    again = signs.numbered(found, t["sign_variants"])
    assert sorted((r.allomorph_id, r.sign_variant_id) for r in again.collect()) == sorted((r.allomorph_id, r.sign_variant_id) for r in t["sign_variants"].collect())
    assert signs.signlist(t, t["composed"]).count() == sum(len(r) for _, r in mini.SIGNS)


def test_names(spark):
    meaning = [(0, 1, 2, "none", None, None, True), (1, 3, 4, "none", None, None, False)]
    v = spark.createDataFrame([(7, 0, meaning), (8, 0, [])], schema("pn_variants"))
    assert [(r.sign_no, r.value_id, r.capitalized) for r in names.unnested(v).collect()] == [(0, 1, True), (1, 3, False)]
    signs = spark.createDataFrame([(1, 0, 4, 4, 9, 2, "none", None, True, False), (1, 0, 5, 5, None, 3, "none", None, False, False), (1, 1, 6, 6, 1, None, "none", None, None, False)], "t int, c int, sign_no int, word_no int, value_id int, sign_id int, indicator_type string, phonographic boolean, stem boolean, capitalized boolean")
    got = {r.c: r for r in names.compound_meanings(signs, ["t", "c"]).collect()}
    assert [m.word_no for m in got[0].sign_meanings] == [0, 1] and got[0].suffix_len == 1 and got[1].sign_meanings is None and got[1].suffix_len is None
    ways = names.spelled(spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "pn int, sign_no int, sign_id int"), spark.createDataFrame([(1, [1], "default"), (1, [2, 3], "nondefault"), (2, [4], "nonstandard")], "sign_id int, grapheme_ids array<int>, variant_type string"), ["pn"])
    assert sorted((r.grapheme_ids, r.nonstandard, r.nondefault) for r in ways.collect()) == [([1, 4], 1, 1), ([2, 3, 4], 1, 2)]
