from datetime import datetime

import pyarrow as pa
import pytest

from glyphora.operators import corpus, corpus_search, editing, history, serialize
from glyphora.plans.pattern import PatternError, branches, parse
from glyphora.schemas import schema


def load(spark, signlist, codes):
    parsed = corpus.parse(spark.createDataFrame(codes, "transliteration_id int, code string"))
    parsed = spark.createDataFrame(parsed.collect(), parsed.schema)
    return {k: spark.createDataFrame(v.collect(), v.schema) for k, v in corpus.ingest(parsed, signlist).items()}


def test_edits_are_reverted(spark, signlist):
    old = load(spark, signlist, [(1, "1\ta si-ni\n2\te"), (2, "1\tki")])
    new = load(spark, signlist, [(1, "1\ta si-ni-e\n2\te\n3\tpa"), (2, "1\tki")])
    out = editing.edit_corpus(old, new)
    out = spark.createDataFrame(out.collect(), out.schema)
    assert {r.transliteration_id: r.n for r in out.selectExpr("transliteration_id", "size(log) as n").collect()}[2] == 0
    tables = editing.unpack(out)
    code = lambda t: {r.transliteration_id: r.content for r in serialize.serialize(t, signlist["characters"]).collect()}
    assert code(tables) == code(new)
    entries = out.selectExpr("transliteration_id", "0 as edit_no", "explode(log) as x").select("transliteration_id", "edit_no", "x.*")
    edits = spark.createDataFrame([(1, 0, datetime(2020, 1, 1), 1, False), (2, 0, datetime(2020, 1, 1), 1, False)], "transliteration_id int, edit_no int, timestamp timestamp, user_id int, internal boolean")
    assert code(history.revert_to(tables, entries, edits, None)) == code(old)
    assert code(history.revert_to(tables, entries, edits, datetime(2021, 1, 1))) == code(new)
    changed = history.changed_since(tables, entries, edits, None, signlist["characters"]).collect()
    assert [(r.transliteration_id, r.line_no_start, r.line_no_end, r.old, r.new) for r in changed] == [(1, 0, 0, "a si-ni", "a si-ni-e"), (1, 2, 2, None, "pa")]
    touched = {(r.transliteration_id, r.sign_no): r.edit_nos for r in history.modified(tables["corpus"], entries).collect()}
    assert touched[1, 3] == [0] and touched[1, 0] == []
    assert [r.group_no for r in history.edit_groups(edits.union(edits.selectExpr("transliteration_id", "1", "timestamp", "user_id", "true"))).orderBy("transliteration_id", "edit_no").collect()] == [0, 1, 0, 1]


def test_packed_rows_stay_packed(spark, signlist, monkeypatch):
    codes = [(1, "1\ta si-ni\n2\te"), (2, "1\tki"), (3, "1\tpa")]
    old = load(spark, signlist, codes)
    new = load(spark, signlist, [(1, "1\ta si-ni-e\n3\tpa"), codes[1], (3, "1\tpa e")])
    code = lambda t: {r.transliteration_id: r.content for r in serialize.serialize(t, signlist["characters"]).collect()}
    logs = {n: spark.createDataFrame([], schema(n)) for n in ("edits", "edit_log")}
    tables, logs = history.commit(old, logs, editing.edit_corpus(old, new), 1, False, "2020-01-01")
    packs = []
    monkeypatch.setattr(editing, "pack", lambda t, f=editing.pack: packs.append(t) or f(t))
    back = history.undo(tables, logs["edit_log"], logs["edits"])
    again = history.redo(back, logs["edit_log"], logs["edits"].where("transliteration_id = 1"))
    assert not packs and code(back) == code(old) and code(again) == code(old) | {1: code(new)[1]}
    then, left = history.revert_corpus_to(history.redo(again, logs["edit_log"], logs["edits"].where("transliteration_id = 3")), logs, "2019-01-01", [1])
    assert not packs and code(then) == code(old) | {3: code(new)[3]} and [r.transliteration_id for r in left["edits"].collect()] == [3]
    # of a transliteration that was never edited, as of all others, entries can be played
    other = spark.createDataFrame([(2, 0, 0, 0, "sign_no", "corpus", "update condition", '"lost"', '"intact"')], logs["edit_log"].schema)
    lost = history.redo(again, other, spark.createDataFrame([(2, 0)], "transliteration_id int, edit_no int"))
    assert code(lost) == code(again) | {2: "1\t[ki]"} and [{r.transliteration_id for r in t["corpus"].collect()} for t in packs] == [{2}]
    packs.clear()
    # a table put in place of another is heeded, and of plain tables only what is edited is packed
    assert code(history.undo({**tables}, logs["edit_log"], logs["edits"].where("transliteration_id = 3"))) == code(new) | {3: code(old)[3]}
    assert [{r.transliteration_id for r in t["corpus"].collect()} for t in packs] == [{3}]


def test_one_exchange_packs_all_tables(spark, signlist):
    t = load(spark, signlist, [(1, "1\ta si-ni\n2\te"), (2, "1\tki")])
    plan = editing.pack(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_rows_carried_along_keep_their_columns():
    kind = pa.list_(pa.struct([("compound_no", pa.int32()), ("capitalized", pa.bool_()), ("note", pa.string())]))
    before = pa.array([[{"compound_no": 0, "capitalized": None, "note": "a"}, {"compound_no": None, "capitalized": True, "note": None}], [], None, [{"compound_no": 2, "capitalized": False, "note": "b"}]], kind)
    rows = editing._carried(before, {"compound_no"})
    rows[0].insert(1, {"compound_no": 5, "capitalized": False, "note": "new"})
    rows[3][0]["compound_no"] = 7
    rows[2].append({"compound_no": None, "capitalized": True})
    rows[0].pop(0)
    assert editing._uncarried(rows, before, {"compound_no"}, kind).to_pylist() == [
        [{"compound_no": 5, "capitalized": False, "note": "new"}, {"compound_no": None, "capitalized": True, "note": None}],
        [],
        [{"compound_no": None, "capitalized": True, "note": None}],
        [{"compound_no": 7, "capitalized": False, "note": "b"}],
    ]


def test_search_and_what_it_found(spark, signlist):
    t = load(spark, signlist, [(1, "1\t[a]-si e--ni!\n2\t{d}diri{ki} <a>pa"), (2, "1\tsi a")])
    rows = corpus_search.relation(t, signlist["composed"])
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    find = lambda text: corpus_search.search(rows, text, signlist)
    got = lambda text: sorted((r.transliteration_id, tuple(r.signs)) for r in find(text).collect())
    assert got("si") == [(1, (1,)), (2, (0,))] and got("SI") == [(1, (1,)), (1, (5,)), (2, (0,))]
    assert got("DIRI") == [(1, (5,)), (2, (0, 1))] and got("|SI.A|") == [(1, (5,))]
    assert got("si-a") == [] and got("a-si") == [(1, (0, 1))] and got("e=ni") == [] and got("e-ni") == [(1, (2, 3))]
    assert got("a:si") == [(1, (0, 1)), (2, (0, 1))] and got("/s.*/") == [(1, (1,)), (2, (0,))]
    assert got("{d}") == [(1, (4,))] and got("{d}diri") == [(1, (4, 5))] and got("diri{ki}") == [(1, (5, 6))] and got("<a>") == [(1, (7,))] and got("diri{d}") == []
    assert got("[a … ni]") == [(1, (0, 3))] and got("[a … pa]") == [(1, (7, 8))] and got("[si … pa]") == [] and got("// ni|ki") == [] and got("; a") == [(1, (0,)), (1, (7,)), (2, (1,))] and got("a ;") == [(2, (1,))]
    assert got("// d") == [(1, (4,))] and got("ni //") == [(1, (3,))] and got("; ni") == [(1, (3,))] and got(", e") == [(1, (2,))] and got(", ni") == [] and got("diri{ki} ,") == [(1, (5, 6))] and got("{d} ,") == []
    assert got("// AN") == [(1, (4,))] and got("// A") == [(1, (0,))] and got("A //") == [(2, (1,))] and got("// a-si ,") == [(1, (0, 1))]
    assert got("si // a") == [] and got("ni // d") == [(1, (3, 4))] and got("nope") == [] and got("NOPE") == []
    matches = find("e … ki")
    assert [(r.signs, r.sign_nos) for r in corpus_search.found_signs(matches, t, signlist["characters"]).collect()] == [("e…{ki}", [2, 6])]
    assert [r.word for r in corpus_search.found_words(matches, t, signlist["characters"]).collect()] == ["e … {d}diri{ki}"]
    assert sorted((r.line_no, r.line) for r in corpus_search.found_lines(matches, t, signlist["characters"]).collect()) == [(0, "[a]-si e--ni!"), (1, "{d}diri{ki} <a>pa")]


@pytest.mark.parametrize("text", ["a …: b", "(a", "a)", "", "$", "[a", "{d", "a |", "()", "… a", "a …", "-a", "a="])
def test_bad_patterns(text):
    with pytest.raises(PatternError):
        parse(text)


def test_branches():
    assert len(branches(parse("(a|e) (i|u)"))) == 4 and len(branches(parse("a:e:i"))) == 6 and len(branches(parse("a:e i:u"))) == 4
    b = branches(parse("(a … e) [i]"))[0]
    assert b.captures == ((1, (0, 1)),) and b.lines == ((2,),)
