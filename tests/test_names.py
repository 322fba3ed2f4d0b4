"""Names as code, HTML and search; composite arrays; edits in one call with logs, replays and reverts."""

import random

import pytest
from pyspark.sql import functions as F

from glyphora.operators import commands, corpus_search, editing, history, html, names, serialize
from glyphora.schemas import schema
from glyphora.sources import tables

from .test_history import load

@pytest.fixture
def known(spark, signlist):
    t = signlist | {"pns": spark.createDataFrame([], schema("pns")), "pn_variants": spark.createDataFrame([], schema("pn_variants"))}
    t, a = commands.add_name_code(t, signlist, "person", "sumerian", "Diri", "&diri-a{ki}")
    t, _ = commands.add_spelling_code(t, signlist, a, "|SI.A|--ni")
    t, b = commands.add_name_code(t, signlist, "god", None, None, "{d}en-si".replace("en", "e"))
    return t | {n: spark.createDataFrame(t[n].collect(), schema(n)) for n in ("pns", "pn_variants")}, a, b


def test_names_are_written_as_read(known, signlist):
    t, a, b = known
    got = {(r.pn_id, r.pn_variant_no): r.pn for r in names.serialized(t["pn_variants"], t["pns"], signlist["composed"], signlist["characters"]).collect()}
    assert got == {(a, 0): "%s &diri-a{ki}", (a, 1): "%s |SI.A|--ni", (b, 0): "{d}e-si"}
    t = commands.edit_spelling_code(t, signlist, a, 1, "diri--ni")
    plain = {(r.pn_id, r.pn_variant_no): r.code for r in names.meanings_code(t["pn_variants"], names.NAME, signlist["composed"], signlist["characters"]).collect()}
    assert plain[a, 1] == "diri--ni" and plain[a, 0] == "&diri-a{ki}"
    shown = {r.pn_variant_no: r.html for r in names.meanings_html(t["pn_variants"].where(f"pn_id = {a}"), names.NAME, signlist["composed"], html.characters(signlist, signlist["composed"])).collect()}
    assert shown[1] == "diri–ni" and shown[0].startswith("Diri-a") and "<span class='indicator'>ki</span>" in shown[0]


@pytest.mark.parametrize(("code", "error"), [("a-(", "syntax"), ("a si", "compound"), ("nope7", "encoding"), ("", None)])
def test_spellings_that_are_none(signlist, code, error):
    with pytest.raises(ValueError, match=error):
        names.parse_meanings(code, signlist)


def test_search_names(spark, known, signlist):
    t, a, b = known
    rows = names.relation(t["pn_variants"], signlist["composed"])
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    links = spark.createDataFrame([(a, "early"), (b, "late")], "pn_id int, period string")
    find = lambda text, **more: sorted(tuple(r) for r in names.search(rows, text, signlist, **more).collect())
    assert find("diri") == [(a, 0)] and find("|SI.A|") == [(a, 0), (a, 1)] and find("; SI A") == [(a, 0), (a, 1)] and find("{d}e") == [(b, 0)]
    assert find("si ;") == [(b, 0)] and find("x", links=links, period=["late"]) == [(b, 0)] and len(find("x", links=links, period=[])) == 3


def test_composite_arrays(spark, tmp_path):
    (tmp_path / "pn_variants.csv").write_text('1,0,"{""(0,7,3,left,f,,t)"",""(1,,4,\\""none\\"",,t,f)""}"\n2,0,{}\n3,0,\\N\n')
    (tmp_path / "glyph_values.csv").write_text('a,1,"{3,NULL,5}"\nb,2,"[1,2]"\n')
    got = {r.pn_id: r.sign_meanings for r in tables.read_csv(spark, str(tmp_path / "pn_variants.csv"), schema("pn_variants")).collect()}
    assert [tuple(m) for m in got[1]] == [(0, 7, 3, "left", False, None, True), (1, None, 4, "none", None, True, False)] and got[2] == [] and got[3] is None
    assert {r.value: r.glyph_ids for r in tables.read_csv(spark, str(tmp_path / "glyph_values.csv"), schema("glyph_values")).collect()} == {"a": [3, None, 5], "b": [1, 2]}


def test_edits_in_one_call(spark, signlist):
    old = load(spark, signlist, [(1, "1\ta si-ni"), (2, "1\tki"), (3, "1\te diri")])
    logs = {n: spark.createDataFrame([], schema(n)) for n in ("edits", "edit_log")}
    codes = spark.createDataFrame([(1, "1\ta si-ni-e\n2\tpa"), (2, "1\tki"), (3, "1\te nope7"), (4, "1\ta")], "transliteration_id int, code string")
    code = lambda t: {r.transliteration_id: r.content for r in serialize.serialize(t, signlist["characters"]).collect()}
    new, logs, errors = history.edit_transliterations(old, logs, codes, signlist, user_id=7, time="2020-01-01")
    assert {r.transliteration_id: r.error for r in errors.collect()} == {3: 'encoding: "nope7", sign 1'}
    assert code(new) == {1: "1\ta si-ni-e\n2\tpa", 2: "1\tki", 3: "1\te diri"}
    assert [tuple(r)[:2] + (r.user_id, r.internal) for r in logs["edits"].collect()] == [(1, 0, 7, False)]
    new, logs = corpus_search.replace_in(new, logs, "DIRI", "si-a", signlist, user_id=8, internal=True, time="2021-01-01")
    new, logs = corpus_search.replace_in(new, logs, "SI", "sig9", signlist, texts=spark.createDataFrame([(1, "x"), (3, "y")], "transliteration_id int, period string"), period=["x"], time="2022-01-01")
    assert code(new) == {1: "1\ta sig9-ni-e\n2\tpa", 2: "1\tki", 3: "1\te si-a"}
    edits = {(r.transliteration_id, r.edit_no) for r in logs["edits"].collect()}
    assert edits == {(1, 0), (1, 1), (3, 0)}
    both = spark.createDataFrame([(1, 0), (1, 1)], "transliteration_id int, edit_no int")
    back = history.undo(new, logs["edit_log"], both)
    assert code(back) == {1: "1\ta si-ni", 2: "1\tki", 3: "1\te si-a"}
    assert code(history.redo(back, logs["edit_log"], both)) == code(new)
    then, left = history.revert_corpus_to(new, logs, "2020-06-01")
    assert code(then) == {1: "1\ta si-ni-e\n2\tpa", 2: "1\tki", 3: "1\te diri"} and {(r.transliteration_id, r.edit_no) for r in left["edits"].collect()} == {(1, 0)}
    one, left = history.revert_corpus_to(new, logs, "2020-06-01", [3])
    assert code(one)[3] == "1\te diri" and code(one)[1] == code(new)[1] and left["edit_log"].where("transliteration_id = 3").count() == 0


def test_relation_of_changed_transliterations(spark, signlist):
    old = load(spark, signlist, [(1, "1\ta si"), (2, "1\tki diri")])
    new = load(spark, signlist, [(1, "1\ta si"), (2, "1\tdiri")])
    kept = corpus_search.relation(old, signlist["composed"])
    ids = spark.createDataFrame([(2,)], "transliteration_id int")
    got = corpus_search.update_transliterations(kept, new, signlist["composed"], ids)
    key = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    assert key(got) == key(corpus_search.relation(new, signlist["composed"]))


def test_html_of_a_corpus(spark, signlist):
    t = load(spark, signlist, [(1, "1\ta diri 5(AŠ) nope7")])
    shown = html.characters(signlist, signlist["composed"])
    full = {r.sign_no: r.value for r in html.corpus_html(t, shown).collect()}
    assert full[0] == "a" and full[1] == "diri" and full[2] == "5<span class='signspec'>AŠ</span>"
    clean = {r.sign_no: r.value for r in html.corpus_html_clean(t, shown).collect()}
    assert clean[2] == '<span class="placeholder">N</span>' and clean[3] == '<span class="placeholder">X</span>'
    assert [r.line for r in html.in_range(html.corpus_html(t, shown), ["transliteration_id"], F.lit(0), F.lit(1)).collect()] == ["a diri"]


def slow_levenshtein(old, new):
    """The whole matrix, then back: keeping or updating first, then deleting, then inserting."""
    m, n = len(old), len(new)
    cost = [[i + j if not i or not j else 0 for j in range(n + 1)] for i in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (old[i - 1] != new[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    back, i, j = [], m, n
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (old[i - 1] != new[j - 1]):
            i, j = i - 1, j - 1
            if old[i] != new[j]:
                back.append(("UPDATE", j, new[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            back.append(("DELETE", j, None))
        else:
            j -= 1
            back.append(("INSERT", j, new[j]))
    return (cost[m][n] if m and n else None), back[::-1]


def test_edit_scripts_in_little_memory():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert editing.levenshtein(a, b) == slow_levenshtein(a, b)
    long = [rng.randrange(50) for _ in range(6000)]
    cost, script = editing.levenshtein(long, [*long[:100], 99, *long[101:3000], *long[3001:]])
    assert cost == 2 and len(script) == 2
