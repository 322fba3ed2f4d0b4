import pytest

from glyphora.operators import commands
from glyphora.operators import signlist as signs
from glyphora.schemas import schema


@pytest.fixture
def t(signlist):
    return signlist


def values(t):
    return {r.value for r in t["value_variants"].collect()}


def test_add(t):
    u, v = commands.add_value(t, commands.sign_named(t["composed"], "SI.A"), "dir5", True)
    row = u["values"].where(f"value_id = {v}").first()
    assert "dir5" in values(u) and row.phonographic and u["value_variants"].where(f"value_variant_id = {row.main_variant_id}").first().value_id == v
    u, g = commands.add_default_grapheme(u, "GA")
    u, s = commands.add_sign(u, "GA.A")
    found = signs.variants(u).where(f"sign_id = {s}").collect()
    assert len(found) == 1 and found[0].variant_type == "default"
    u, _ = commands.add_allograph_named(u, "GA", "E")
    assert {r.variant_type for r in signs.variants(u).where(f"sign_id = {s}").collect()} == {"default", "nondefault"}
    u, m = commands.add_allomorph(u, s, [g, g])
    assert u["allomorph_components"].where(f"allomorph_id = {m}").count() == 2
    with pytest.raises(LookupError):
        commands.add_allomorph(u, s, "NOPE")


def test_delete(t):
    s = commands.sign_named(t["composed"], "NI")
    u = commands.delete_sign(t, s)
    assert values(t) - values(u) == {"i3", "ni"} and u["allomorphs"].where(f"sign_id = {s}").count() == 0
    assert commands.delete_grapheme(t, 1)["allographs"].where("grapheme_id = 1").count() == 0


def test_merge(t):
    a, b = ([r.value_id for r in t["value_variants"].where(f"value = '{v}'").collect()][0] for v in ("si", "sig9"))
    u = commands.merge_values(t, a, b)
    assert {r.value for r in u["value_variants"].where(f"value_id = {a}").collect()} == {"si", "sig9"} and u["values"].where(f"value_id = {b}").count() == 0
    with pytest.raises(ValueError):
        commands.merge_values(t, a, t["value_variants"].where("value = 'a'").first().value_id)
    keep, gone = (commands.sign_named(t["composed"], s) for s in ("NI", "SI"))
    u, _ = commands.add_value(t, gone, "nix")
    u = commands.merge_signs(u, keep, gone)
    assert "nix" not in values(u) and {r.sign_id for r in u["values"].collect()} == {r.sign_id for r in t["values"].collect()} - {gone}
    assert {r.variant_type for r in u["allomorphs"].where(f"sign_id = {keep}").collect()} == {"default", "nondefault"}


def test_spelling_becomes_allograph(t):
    s = commands.sign_named(t["composed"], "A")
    u, m = commands.add_allomorph(t, s, "E")
    u["sign_variants"] = signs.numbered(signs.variants(u), u["sign_variants"]).select(*[f.name for f in schema("sign_variants").fields])
    before = u["sign_variants"].where(f"allomorph_id = {m}").first().sign_variant_id
    u = commands.allomorph_to_allograph(u, m)
    after = u["sign_variants"].where(f"sign_variant_id = {before}").first()
    assert after.allomorph_id != m and after.sign_id == s and u["allomorphs"].where(f"allomorph_id = {m}").count() == 0


def test_glyph_value(t):
    a, b = ([r.value_id for r in t["value_variants"].where(f"value = '{v}'").collect()][0] for v in ("diri", "si"))
    u = commands.make_glyph_value(t, t["composed"], a, b)
    row = u["glyph_values"].first()
    assert (row.value, row.value_id, len(row.glyph_ids)) == ("diri", b, 2) and "diri" not in values(u)


def test_names(spark):
    t = {n: spark.createDataFrame([], schema(n)) for n in ("pns", "pn_variants")}
    meaning = {"word_no": 0, "value_id": 1, "sign_id": 1, "indicator_type": "none", "phonographic": None, "stem": None, "capitalized": True}
    t, n = commands.add_name(t, "person", "sumerian", None, [meaning])
    t, k = commands.add_spelling(t, n, [meaning, meaning])
    t = commands.edit_spelling(t, n, 0, [])
    assert (n, k) == (1, 1) and {r.pn_variant_no: len(r.sign_meanings) for r in t["pn_variants"].collect()} == {0: 0, 1: 2}
