"""Pattern search over an encoded corpus, and search-and-replace on top of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphora.functions import position
from glyphora.functions.code import read
from glyphora.operators import editing, encoder, history, html, rewriting, serialize
from glyphora.plans import search as plan
from glyphora.plans.pattern import Choice, Group, Leaf, branches, parse

KEY = "transliteration_id"


def relation(t: dict[str, DataFrame], composed: DataFrame) -> DataFrame:
    """transliteration_id, sign_no, pos, next_pos, word_no, compound_no, line_no, value_id, sign_variant_id, grapheme_id, glyph_id, type,
    indicator_type, phonographic: a row per sign, and per component of it; and whether words, compounds and lines start and end with its sign."""
    return sign_relation(t["corpus"].join(t["words"].select(KEY, "word_no", "compound_no"), [KEY, "word_no"]), composed, [KEY])


def sign_relation(signs: DataFrame, composed: DataFrame, keys: list[str]) -> DataFrame:
    """`relation` of signs (keys, sign_no, word_no, compound_no, line_no, value_id, sign_variant_id, type, indicator_type, phonographic)."""
    about = ["sign_no", "word_no", "compound_no", "line_no", "type", "indicator_type", "phonographic"]
    at = position.pack(F.col("sign_no"), F.lit(0), F.lit(True))
    none = F.lit(None).cast("int")
    whole = signs.select(*keys, *about, "value_id", "sign_variant_id", none.alias("grapheme_id"), none.alias("glyph_id"), at.alias("p"))
    parts = composed.select("sign_variant_id", F.posexplode(F.arrays_zip("grapheme_ids", "glyph_ids")).alias("k", "x"), F.size("glyph_ids").alias("n"))
    each = signs.join(parts, "sign_variant_id")
    at = position.pack(F.col("sign_no"), F.col("k"), F.col("k") + 1 == F.col("n"))
    each = each.select(*keys, *about, none.alias("value_id"), none.alias("sign_variant_id"), F.col("x.grapheme_ids").alias("grapheme_id"), F.col("x.glyph_ids").alias("glyph_id"), at.alias("p"))
    rows = whole.unionByName(each).withColumns({"pos": position.key(F.col("p")), "next_pos": position.successor(F.col("p"))}).drop("p")
    return plan.with_edges(rows, keys)


def update_transliterations(rows: DataFrame, t: dict[str, DataFrame], composed: DataFrame, ids: DataFrame) -> DataFrame:
    """A kept `relation` after changes of the transliterations ids (transliteration_id): theirs anew, all others as they are."""
    own = {name: t[name].join(ids, KEY, "left_semi") for name in ("corpus", "words")}
    return rows.join(ids, KEY, "left_anti").unionByName(relation(own, composed))


class Dictionary:
    """What the literals of a pattern stand for; looks up only the names that a pattern holds."""

    def __init__(self, signlist: dict[str, DataFrame]):
        self.s = signlist
        self._known: dict[str, str] = {}
        self._found: dict[tuple, Column | DataFrame] = {}

    def _normalized(self, text: str) -> str:
        """A text in normal form, looked up once; empty if the sign list lacks it."""
        if text not in self._known:
            known = encoder.normalized(self.s["composed"].sparkSession.createDataFrame([(text,)], "s string"), self.s["sign_map"]).first()
            self._known[text] = known.glyphs if known else ""
        return self._known[text]

    def _spec(self, rows: DataFrame, spec: str | None) -> DataFrame:
        if spec is None:
            return rows
        return rows.where(F.col("sign_spec") == self._normalized(spec))

    def condition(self, leaf: Leaf) -> Column | plan.Lookup:
        literal = leaf.kind, leaf.text, leaf.spec
        if literal not in self._found:
            self._found[literal] = self._literal(leaf)
        found = self._found[literal]
        also = F.lit(True)
        if leaf.indicator:
            also = also & (F.col("phonographic") == (leaf.indicator == "P")) & (F.col("indicator_type") != "none")
        if leaf.side:
            also = also & (F.col("indicator_type") == ("right" if leaf.side == "left" else "left"))
        return plan.Lookup(found, also) if isinstance(found, DataFrame) else found & also

    def _literal(self, leaf: Leaf) -> Column | DataFrame:
        """What a leaf stands for: a condition, or a table of ids, however many, that the relation is joined to."""
        if leaf.kind in ("value", "pattern"):
            names = self.s["value_variants"] if leaf.spec is None else self._spec(self.s["values_encoded"], leaf.spec)
            like = F.col("value") == leaf.text if leaf.kind == "value" else F.col("value").rlike(f"^(?:{leaf.text})([0-9]+|x)?$")
            columns = ["value_id"] if leaf.spec is None else ["value_id", "sign_variant_id"]
            return names.where(like).select(*columns).distinct()
        if leaf.kind == "sign":
            rows = self._spec(self.s["signs_encoded"].where(F.col("sign") == self._normalized(leaf.text)), leaf.spec)
            own = self.s["composed"].select("sign_id", "sign_variant_id")
            same = rows.select("sign_variant_id").join(own, "sign_variant_id").select("sign_id").distinct().join(own, "sign_id") if leaf.spec is None else rows
            return same.select("sign_variant_id").distinct()
        if leaf.kind == "component":
            kind, number = leaf.text.split(":")
            return F.col("grapheme_id" if kind == "g" else "glyph_id") == int(number)
        if leaf.kind == "any":
            return F.col("glyph_id").isNotNull()
        if leaf.kind == "sure":
            return F.col("sign_variant_id").isNotNull()
        return F.col("glyph_id").isNull() & (F.col("type") == "number")

    def expanded(self, node):
        """The tree with each form as the chain of its components."""
        if isinstance(node, Leaf):
            if node.kind != "form":
                return node
            rows = self.s["sign_map"].where(F.upper("identifier") == node.text.upper()).select("grapheme_ids", "glyph_ids").distinct().collect()
            ways = []
            for r in rows:
                ids = [f"g:{i}" for i in r.grapheme_ids] if r.grapheme_ids else [f"c:{i}" for i in r.glyph_ids or []]
                leaves = [Leaf("component", i, None, node.indicator, node.side) for i in ids]
                ways.append(leaves[0] if len(leaves) == 1 else Group(leaves, [frozenset(["inherit"])] * (len(leaves) - 1)))
            ways = [w for w in ways if isinstance(w, Leaf) or w.items]
            return Choice(ways) if len(ways) > 1 else ways[0] if ways else Leaf("component", "g:-1")
        if isinstance(node, Choice):
            return Choice([self.expanded(w) for w in node.ways])
        node.items = [self.expanded(i) for i in node.items]
        return node


def search(rows: DataFrame, text: str, signlist: dict[str, DataFrame], keys: list[str] | None = None, aliases: bool = True) -> DataFrame:
    """keys (default transliteration_id), signs, words, lines, captures of a pattern over a `relation`; each match once. aliases: c j v stand for š ĝ ř."""
    return search_all(rows, {"": text}, signlist, keys, aliases).drop("pattern")


def search_all(rows: DataFrame, texts: dict[str, str], signlist: dict[str, DataFrame], keys: list[str] | None = None, aliases: bool = True) -> DataFrame:
    """`search` of many patterns by name, which comes as the column pattern. The relation is read once for all, and what leaves share is looked up once."""
    words = Dictionary(signlist)
    each = [(name, b) for name, text in texts.items() for b in branches(words.expanded(parse(text, aliases)))]
    found = plan.matches(rows, [b for _, b in each], keys or [KEY], words.condition, names=[name for name, _ in each])
    flat = found.withColumn("captures", F.map_entries("captures")).distinct()
    return flat.withColumn("captures", F.when(F.col("captures").isNotNull(), F.map_from_entries("captures")))


def _clean(t: dict[str, DataFrame], characters: DataFrame) -> DataFrame:
    """Sign rows without editorial marks; what isn't encoded is a placeholder of its type."""
    rows = serialize.corpus_code(t, characters)
    no, none = F.lit(False), F.lit(None).cast("string")
    return rows.withColumns(
        {
            "value": F.coalesce("print", html.placeholder(F.col("type"), html=False)), "condition": F.lit("intact"), "section_no": F.lit(None).cast("int"), "section_name": none, "line_no": F.lit(0),
            "inverted": no, "newline": no, "ligature": no, "crits": none, "comment": none, "capitalized": no, "pn_type": none, "compound_comment": none,
        }
    )


def found_signs(matches: DataFrame, t: dict[str, DataFrame], characters: DataFrame) -> DataFrame:
    """transliteration_id, signs (text), sign_nos of each match."""
    each = matches.select(KEY, F.col("signs").alias("sign_nos"), F.explode("signs").alias("sign_no"))
    text = serialize.lines(_clean(t, characters).join(each, [KEY, "sign_no"]), [KEY, "sign_nos"])
    return text.select(KEY, F.col("content").alias("signs"), "sign_nos")


def found_words(matches: DataFrame, t: dict[str, DataFrame], characters: DataFrame) -> DataFrame:
    """transliteration_id, word: the whole words that each match touches."""
    each = matches.select(KEY, F.col("signs").alias("match"), F.explode("words").alias("word_no")).distinct()
    text = serialize.lines(_clean(t, characters).join(each, [KEY, "word_no"]), [KEY, "match"])
    return text.select(KEY, F.col("content").alias("word"))


def found_lines(matches: DataFrame, t: dict[str, DataFrame], characters: DataFrame) -> DataFrame:
    """transliteration_id, line, line_no: the whole lines that each match touches."""
    each = matches.select(KEY, F.col("signs").alias("match"), F.explode("lines").alias("line_no")).distinct()
    rows = serialize.corpus_code(t, characters).join(each, [KEY, "line_no"])
    return serialize.lines(rows, [KEY, "match"]).select(KEY, F.col("content").alias("line"), "line_no")


def read_pattern(code: str, signlist: dict[str, DataFrame]) -> list[rewriting.Sign]:
    """Signs of a replacement, encoded. A description "n" refers to capture n. Raises ValueError if it can't be read or encoded."""
    doc = read(f"1\t{code}")
    if doc.errors:
        raise ValueError(f"can't be read: {doc.errors[0]}")
    spark = signlist["composed"].sparkSession
    rows = [(k, s["value"], s["sign_spec"], s["type"]) for k, s in enumerate(doc.signs)]
    codes = encoder.encode(spark.createDataFrame(rows, "k int, value string, sign_spec string, type string"), ["k"], signlist["sign_map"], signlist["values_encoded"], signlist["signs_encoded"])
    codes = {r.k: r for r in codes.join(signlist["composed"].select("sign_variant_id", "glyph_ids"), "sign_variant_id").collect()}
    out = []
    for k, s in enumerate(doc.signs):
        before = doc.signs[k - 1] if k else None
        word = doc.words[s["word_no"]]
        link = "compound" if before is None or doc.words[before["word_no"]][0] != word[0] else "word" if before["word_no"] != s["word_no"] else "sign"
        c = doc.compounds[word[0]]
        compound = {"pn_type": c[0], "language": c[1], "compound_comment": c[3]} if link == "compound" else None
        if s["type"] == "description" and s["value"].isdigit():
            out.append(rewriting.Sign({}, (), link, word[1], compound, int(s["value"])))
            continue
        if k not in codes:
            raise ValueError(f"can't be encoded: {s['value']}")
        row = {"value_id": codes[k].value_id, "sign_variant_id": codes[k].sign_variant_id, "custom_value": None} | {x: s[x] for x in ("type", "indicator_type", "phonographic")}
        out.append(rewriting.Sign(row, tuple(codes[k].glyph_ids), link, word[1], compound))
    return out


def _with_glyphs(t: dict[str, DataFrame], composed: DataFrame) -> DataFrame:
    each = t["corpus"].select(KEY, "sign_no", "sign_variant_id").join(composed.select("sign_variant_id", "glyph_ids"), "sign_variant_id", "left")
    return each.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("sign_no", "glyph_ids"))), lambda x: x["glyph_ids"]).alias("glyphs"))


def _glyphs(row: dict) -> list[tuple]:
    return [tuple(int(x) for x in g) if g is not None else () for g in row["glyphs"]]


def _apply(make: Callable[[editing.Text, dict], editing.Text]) -> Callable[[editing.Text, dict], None]:
    def change(text: editing.Text, row: dict) -> None:
        try:
            new = make(text, row)
        except rewriting.Invalid:
            return
        editing.edit(text, new)

    return change


def replace(t: dict[str, DataFrame], text: str, replacement: str, signlist: dict[str, DataFrame], texts: DataFrame | None = None, aliases: bool = True, **chosen: list) -> DataFrame:
    """Packed rows, with logs, of the transliterations in which the pattern occurs: all its matches replaced, or none if any can't be or two overlap.

    With texts (transliteration_id and columns of its text) and chosen values of such columns, only in these transliterations.
    """
    pattern = read_pattern(replacement, signlist)
    found = search(relation(t, signlist["composed"]), text, signlist, aliases=aliases)
    if any(chosen.values()):
        found = plan.filtered(found, texts, [KEY], **chosen).select(*found.columns)
    found = found.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("signs", F.array_sort(F.map_entries("captures")).alias("captures")))).alias("matches"))

    def make(old: editing.Text, row: dict) -> editing.Text:
        matches = []
        for m in row["matches"]:
            captures = {int(c["key"]): [int(n) for n in c["value"]] for c in (m["captures"] if m["captures"] is not None else [])}
            matches.append(([int(n) for n in m["signs"]], captures))
        return rewriting.replace(old, _glyphs(row), matches, pattern)

    return editing.change(editing.pack(t), found.join(_with_glyphs(t, signlist["composed"]), KEY), _apply(make))


def replace_in(t: dict[str, DataFrame], logs: dict[str, DataFrame], text: str, replacement: str, signlist: dict[str, DataFrame], user_id: int | None = None, internal: bool = False, time=None, texts: DataFrame | None = None, **chosen: list) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Tables and logs (edits, edit_log) after `replace`, one edit for each changed transliteration. Each of them is changed whole or not at all."""
    return history.commit(t, logs, replace(t, text, replacement, signlist, texts, **chosen), user_id, internal, time)


def respell_in(t: dict[str, DataFrame], logs: dict[str, DataFrame], links: DataFrame, code: str, signlist: dict[str, DataFrame], user_id: int | None = None, internal: bool = False, time=None) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Tables and logs after `respell`, one edit for each changed transliteration."""
    return history.commit(t, logs, respell(t, links, code, signlist), user_id, internal, time)


def respell(t: dict[str, DataFrame], links: DataFrame, code: str, signlist: dict[str, DataFrame]) -> DataFrame:
    """Packed rows, with logs, of the transliterations of links (transliteration_id, compound_no): each linked compound written like a name."""
    pattern = read_pattern(code, signlist)
    kinds = ["default", "nondefault", "reduced", "augmented", "nonstandard"]
    ids = [p.row["sign_variant_id"] for p in pattern]
    own = signlist["composed"].select("sign_variant_id", "sign_id").where(F.col("sign_variant_id").isin(ids))
    rows = own.withColumnRenamed("sign_variant_id", "given").join(signlist["composed"].select("sign_id", "sign_variant_id", "glyph_ids", "variant_type"), "sign_id").collect()
    spelling = []
    for p in pattern:
        options = sorted((r for r in rows if r.given == p.row["sign_variant_id"]), key=lambda r: (kinds.index(r.variant_type), r.sign_variant_id))
        spelling.append([rewriting.Sign(p.row | {"sign_variant_id": r.sign_variant_id}, tuple(r.glyph_ids), p.link, p.capital, p.compound) for r in options])
    linked = links.groupBy(KEY).agg(F.sort_array(F.collect_set("compound_no")).alias("compounds_linked"))

    known = {p.row["sign_variant_id"]: p.glyphs for options in spelling for p in options}

    def change(text: editing.Text, row: dict) -> None:
        glyphs = known | dict(zip((r["sign_variant_id"] for r in text.tables["corpus"]), _glyphs(row), strict=True))
        for no in sorted((int(n) for n in row["compounds_linked"]), reverse=True):  # the last first, so that the numbers of the others stay
            try:
                new = rewriting.respell(text, [glyphs[r["sign_variant_id"]] for r in text.tables["corpus"]], no, spelling)
            except rewriting.Invalid:
                continue
            editing.edit(text, new)

    return editing.change(editing.pack(t), linked.join(_with_glyphs(t, signlist["composed"]), KEY), change)
