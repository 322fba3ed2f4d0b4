"""Golden examples of FIXTURES.md: replacement, re-spelling of names, actions and edits, with a brute-force search."""

import copy
import itertools
import re
from pathlib import Path

import pytest

from glyphora.functions.code import read
from glyphora.operators import corpus, corpus_search, editing, rewriting, serialize
from glyphora.plans.pattern import branches, parse

from . import mini

FIXTURES = Path(__file__).resolve().parent.parent / "FIXTURES.md"
SPELLED = {s: tuple(s.split(".")) for s, _ in mini.SIGNS}
READ = {r: s for s, rs in mini.SIGNS for r in rs}


def cases():
    out = []
    for line in FIXTURES.read_text().split("\n"):
        m = re.match(r"\| (test_\w+) \| (.*?) \| `(.*?)` \| `\S*/(test\w*)/sql/", line)
        if m:
            name, kind, cell, suite = m.groups()
            cell = cell.replace("\\|", "|").replace("\\n", "\n").replace("\\t", "\t")
            if kind == "parse":
                out.append((f"{suite}-{name}", cell, []))
            else:
                out[-1][2].append((kind.strip("*"), cell))
    return out


CASES = cases()


def code_of(kind, value):
    """(value, sign) of what is written; signs stand for their spelling."""
    return (value, READ[value]) if kind == "value" else (None, next(s for s, g in SPELLED.items() if ".".join(g) == value))


def text_of(code):
    d = read(code)
    assert not d.errors
    named = lambda rows, names: [dict(zip(names, r, strict=True)) for r in rows]
    signs = []
    for s in d.signs:
        value, sign = code_of(s["type"], s["value"]) if s["type"] in ("value", "sign") else (None, None)
        signs.append({k: v for k, v in s.items() if k not in ("value", "sign_spec", "open")} | {"value_id": value, "sign_variant_id": sign, "custom_value": None if sign else s["value"]})
    return editing.Text(
        {
            "sections": [{"section_name": r[0], "composition_id": None} for r in d.sections],
            "compounds": named(d.compounds, ["pn_type", "language", "section_no", "compound_comment"]),
            "words": named(d.words, ["compound_no", "capitalized"]),
            "surfaces": named(d.surfaces, ["surface_type", "surface_data", "surface_comment"]),
            "blocks": named(d.blocks, ["surface_no", "block_type", "block_data", "block_comment"]),
            "lines": named(d.lines, ["block_no", "line", "line_comment"]),
            "corpus": signs,
        }
    )


def glyphs_of(text):
    return [SPELLED.get(r["sign_variant_id"], ()) for r in text.tables["corpus"]]


def pattern_of(code):
    d = read(f"1\t{code}")
    out = []
    for k, s in enumerate(d.signs):
        before = d.signs[k - 1] if k else None
        word = d.words[s["word_no"]]
        link = "compound" if before is None or d.words[before["word_no"]][0] != word[0] else "word" if before["word_no"] != s["word_no"] else "sign"
        c = d.compounds[word[0]]
        compound = {"pn_type": c[0], "language": c[1], "compound_comment": c[3]} if link == "compound" else None
        if s["type"] == "description":
            out.append(rewriting.Sign({}, (), link, word[1], compound, int(s["value"])))
            continue
        value, sign = code_of(s["type"], s["value"])
        row = {"value_id": value, "sign_variant_id": sign, "custom_value": None, "type": s["type"], "indicator_type": s["indicator_type"], "phonographic": s["phonographic"]}
        out.append(rewriting.Sign(row, SPELLED[sign], link, word[1], compound))
    return out


def matches_of(text, pattern):
    """Brute force over whole signs and components."""
    rows = []
    for no, (r, g) in enumerate(zip(text.tables["corpus"], glyphs_of(text), strict=True)):
        compound = text.tables["words"][r["word_no"]]["compound_no"]
        rows.append((no, (no, 0), (no + 1, 0), r["value_id"], None, compound))
        rows += [(no, (no, k), (no, k + 1) if k + 1 < len(g) else (no + 1, 0), None, c, compound) for k, c in enumerate(g)]
    found = {}
    words = {s.replace(".", ""): g for s, g in SPELLED.items()} | {r.upper(): SPELLED[s] for r, s in READ.items()}
    for b in branches(parse(pattern)):
        leaves, owner = [], []
        for k, leaf in enumerate(b.leaves):
            parts = words[leaf.text] if leaf.kind == "form" else (leaf.text,)
            leaves += [(leaf.kind, p) for p in parts]
            owner += [k] * len(parts)
        ways = [[]]
        for i, (kind, name) in enumerate(leaves):
            fit = [r for r in rows if (r[3] if kind == "value" else r[4]) == name]
            inner = i and owner[i] == owner[i - 1]
            sep = frozenset(["next"]) if inner or not i else b.between[owner[i] - 1]
            ok = lambda w, r, sep=sep, i=i: not i or ((w[-1][1] < r[1] if "later" in sep else w[-1][2] == r[1]) and ("compound" not in sep or w[-1][5] == r[5]))
            ways = [[*w, r] for w, r in itertools.product(ways, fit) if ok(w, r)]
        for w in ways:
            nos = sorted({r[0] for r in w})
            captures = {c: sorted({r[0] for r, o in zip(w, owner, strict=True) if o in ks}) for c, ks in b.captures}
            found[str((nos, captures))] = (nos, captures)
    return list(found.values())


def same(text, code):
    want = text_of(code).tables
    have = copy.deepcopy(text.tables)
    for t in (want, have):
        for r in t["corpus"]:
            if r["stem"] is None:
                r["stem"] = None
    return have == want


@pytest.mark.parametrize(("name", "code", "steps"), CASES, ids=[c[0] for c in CASES])
def test_golden(name, code, steps):
    if "actions" in name or "editor" in name:
        pytest.skip("tested below")
    text, link = text_of(code), 0
    for kind, cell in steps:
        if kind == "replace":
            search, pattern = (x.strip() for x in cell.split("⇒"))
            try:
                new = rewriting.replace(copy.deepcopy(text), glyphs_of(text), matches_of(text, search), pattern_of(pattern))
                editing.edit(text, new)
            except (rewriting.Invalid, StopIteration):
                pass
        elif kind.startswith("link"):
            link = int(cell.split(",")[1])
        elif kind == "relink":
            link = 1
        elif kind.startswith("set name"):
            new = rewriting.respell(copy.deepcopy(text), glyphs_of(text), link, [[s] for s in pattern_of(cell)])
            editing.edit(text, new)
        elif kind == "expect":
            assert same(text, cell), cell


def test_merge_and_split_undone():
    text = text_of("1\ta--a a-a--a")
    text.merge("compounds", 0, "words", "compound_no")
    assert same(text, "1\ta--a--a-a--a")
    text.undo(text.log)
    assert same(text, "1\ta--a a-a--a")
    text.log = []
    text.split("words", 0, "compound_no", "compounds", {"pn_type": "person", "language": "sumerian", "section_no": None, "compound_comment": None})
    assert [w["compound_no"] for w in text.tables["words"]] == [0, 1, 2, 2]
    text.undo(text.log)
    assert same(text, "1\ta--a a-a--a")


CODES = sorted({c for _, c, _ in CASES} | {c for _, _, s in CASES for k, c in s if k == "expect"} | {"1\ta\n2\t\n3\te", "@obverse\n1\ta\n2\te\n@reverse\n1\tsi"})


@pytest.mark.parametrize("old", CODES[::5])
def test_any_edit_arrives_and_can_be_undone(old):
    for new in CODES:
        text, want = text_of(old), text_of(new)
        before = copy.deepcopy(text.tables)
        log = editing.edit(text, want)
        assert text.tables == want.tables
        text.undo(log)
        assert text.tables == before
        text.redo(log)
        assert text.tables == want.tables


def test_levenshtein():
    cost, script = editing.levenshtein(list("kitten"), list("sitting"))
    assert cost == 3 and editing.levenshtein([], ["a"])[0] is None
    have = list("kitten")
    for op, no, v in script:
        if op == "DELETE":
            have.pop(no)
        elif op == "INSERT":
            have.insert(no, v)
        else:
            have[no] = v
    assert have == list("sitting")


def test_serialized_text_reads_back(spark, signlist):
    codes = [c for c in CODES if "%person a" not in c and "a:A &|A.A|" not in c.replace("%st+ ", "x") or "%st+" in c]
    parsed = corpus.parse(spark.createDataFrame(list(enumerate(codes)), "transliteration_id int, code string"))
    parsed = spark.createDataFrame(parsed.collect(), parsed.schema)
    tables = corpus.ingest(parsed, signlist)
    assert tables["errors"].count() == 0 and tables["unencoded"].count() == 0
    got = {r.transliteration_id: r.content for r in serialize.serialize(tables, signlist["characters"]).collect()}
    known = {"1\t%s %person a %u a a-a--a": "1\t%s %person &a %u a a-a--a"}
    for k, c in enumerate(codes):
        want = known.get(c, c.replace("&|A.A|", "%st+ &|A.A|").replace("%st+ %st+", "%st+").replace("%person {d}", "%person &{d}").replace("\t[e]-;|E|-e", "\t%st+ [e]-;E-e").replace("%sec=b e:", "%sec=b %st- e:"))
        assert got[k] == want


def test_replace_on_spark(spark, signlist):
    codes = [(1, "1\tensi2 a diri"), (2, "1\tdiri diri"), (3, "1\ta a a"), (4, "1\tsi:a")]
    parsed = corpus.parse(spark.createDataFrame(codes, "transliteration_id int, code string"))
    parsed = spark.createDataFrame(parsed.collect(), parsed.schema)
    tables = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in corpus.ingest(parsed, signlist).items()}
    out = corpus_search.replace(tables, "DIRI", "si-a", signlist)
    out = spark.createDataFrame(out.collect(), out.schema)
    rows = {r.transliteration_id: r.content for r in serialize.serialize(editing.unpack(out), signlist["characters"]).collect()}
    assert rows == {1: "1\tensi2 a si-a", 2: "1\tsi-a si-a", 4: "1\tsi:a"}
    log = out.selectExpr("transliteration_id", "explode(log) as x").select("transliteration_id", "x.*")
    back = editing.revert(out, log)
    rows = {r.transliteration_id: r.content for r in serialize.serialize(editing.unpack(back), signlist["characters"]).collect()}
    assert rows == {1: "1\tensi2 a diri", 2: "1\tdiri diri"}


def test_encode_again(spark, signlist):
    parsed = corpus.parse(spark.createDataFrame([(1, "1\ta si-a |A.A| diri")], "transliteration_id int, code string"))
    tables = corpus.ingest(parsed, signlist)
    plain = corpus.unencode_corpus(tables["corpus"], signlist["characters"])
    assert [r.custom_value for r in plain.orderBy("sign_no").collect()] == ["a", "si", "a", "A.A", "diri"]
    again = corpus.encode_corpus(plain, signlist)
    key = lambda df: sorted((r.sign_no, r.value_id, r.sign_variant_id, r.custom_value) for r in df.select("sign_no", "value_id", "sign_variant_id", "custom_value").collect())
    none = lambda rows: [tuple(-1 if v is None else v for v in r) for r in rows]
    assert none(key(again.fillna(-1, ["value_id"]))) == none(key(tables["corpus"].fillna(-1, ["value_id"])))


def test_each_linked_compound_is_respelled(spark, signlist):
    codes = [(1, "1\tdiri e diri\n2\tki diri"), (2, "1\tdiri e"), (3, "1\tdiri")]
    parsed = corpus.parse(spark.createDataFrame(codes, "transliteration_id int, code string"))
    parsed = spark.createDataFrame(parsed.collect(), parsed.schema)
    tables = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in corpus.ingest(parsed, signlist).items()}
    links = spark.createDataFrame([(1, 0), (1, 2), (1, 3), (1, 4), (2, 0)], "transliteration_id int, compound_no int")
    out = corpus_search.respell(tables, links, "si-a", signlist)
    out = spark.createDataFrame(out.collect(), out.schema)
    code = lambda p: {r.transliteration_id: r.content for r in serialize.serialize(editing.unpack(p), signlist["characters"]).collect()}
    assert code(out) == {1: "1\tsi-a e si-a\n2\tki si-a", 2: "1\tsi-a e"}
    log = out.selectExpr("transliteration_id", "explode(log) as x").select("transliteration_id", "x.*")
    assert code(editing.revert(out, log)) == {k: c for k, c in codes if k < 3}
