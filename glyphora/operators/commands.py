"""Changes of the sign list and of names: tables in, changed tables out. New ids follow the largest one.

A sign list is small; lookups of single ids are read by the driver. Relations that depend on the tables are computed anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphora.operators import names
from glyphora.operators.signlist import Tables
from glyphora.schemas import schema


def _next(df: DataFrame, column: str) -> int:
    return (df.agg(F.max(column)).first()[0] or 0) + 1


def _with(df: DataFrame, *rows: tuple) -> DataFrame:
    return df.unionByName(df.sparkSession.createDataFrame(list(rows), df.schema))


def _one(df: DataFrame, condition, column: str):
    found = [r[0] for r in df.where(condition).select(column).distinct().limit(2).collect()]
    if len(found) != 1:
        raise LookupError(f"{column}: {'none' if not found else 'more than one'} where {condition}")
    return found[0]


def sign_named(composed: DataFrame, sign: str) -> int:
    return _one(composed, (F.col("graphemes") == sign) & F.col("specific"), "sign_id")


def add_value(t: Tables, sign_id: int, value: str, phonographic: bool | None = None) -> tuple[Tables, int]:
    """A reading of a sign, with its spelling as the main one -> tables, value_id."""
    v, w = _next(t["values"], "value_id"), _next(t["value_variants"], "value_variant_id")
    return t | {"values": _with(t["values"], (v, sign_id, w, phonographic)), "value_variants": _with(t["value_variants"], (w, v, value))}, v


def add_allograph(t: Tables, grapheme_id: int, glyph_id: int, variant_type: str = "nondefault", specific: bool = False) -> tuple[Tables, int]:
    a = _next(t["allographs"], "allograph_id")
    return t | {"allographs": _with(t["allographs"], (a, grapheme_id, glyph_id, variant_type, specific))}, a


def add_allograph_named(t: Tables, grapheme: str, glyph: str, variant_type: str = "nondefault", specific: bool = False) -> tuple[Tables, int]:
    return add_allograph(t, _one(t["graphemes"], F.col("grapheme") == grapheme, "grapheme_id"), _one(t["glyphs"], F.col("glyph") == glyph, "glyph_id"), variant_type, specific)


def add_default_grapheme(t: Tables, grapheme: str) -> tuple[Tables, int]:
    """A grapheme and a glyph of one name, each other's default -> tables, grapheme_id."""
    g, c = _next(t["graphemes"], "grapheme_id"), _next(t["glyphs"], "glyph_id")
    t = t | {"graphemes": _with(t["graphemes"], (g, grapheme, None)), "glyphs": _with(t["glyphs"], (c, grapheme, None))}
    return add_allograph(t, g, c, "default", True)[0], g


def add_allomorph(t: Tables, sign_id: int, graphemes: str | list[int], variant_type: str = "nondefault", specific: bool = False) -> tuple[Tables, int]:
    """A spelling of a sign, by grapheme ids or by names with dots."""
    if isinstance(graphemes, str):
        graphemes = [_one(t["graphemes"], F.col("grapheme") == g, "grapheme_id") for g in graphemes.split(".")]
    m = _next(t["allomorphs"], "allomorph_id")
    parts = [(m, k, g) for k, g in enumerate(graphemes, 1)]
    return t | {"allomorphs": _with(t["allomorphs"], (m, sign_id, variant_type, specific)), "allomorph_components": _with(t["allomorph_components"], *parts)}, m


def add_sign(t: Tables, graphemes: str | list[int]) -> tuple[Tables, int]:
    s = _next(t["signs"], "sign_id") if "signs" in t else _next(t["allomorphs"], "sign_id")
    if "signs" in t:
        t = t | {"signs": _with(t["signs"], (s,))}
    return add_allomorph(t, s, graphemes, "default", True)[0], s


def _without(t: Tables, names: list[str], condition) -> Tables:
    return t | {n: t[n].where(~condition) for n in names}


def delete_value(t: Tables, value_id: int) -> Tables:
    return _without(t, ["values", "value_variants"], F.col("value_id") == value_id)


def delete_allomorph(t: Tables, allomorph_id: int) -> Tables:
    return _without(t, ["allomorphs", "allomorph_components"], F.col("allomorph_id") == allomorph_id)


def delete_grapheme(t: Tables, grapheme_id: int) -> Tables:
    return _without(t, ["graphemes", "allographs"], F.col("grapheme_id") == grapheme_id)


def delete_sign(t: Tables, sign_id: int) -> Tables:
    """The sign with its readings and spellings."""
    own = lambda name, key: t[name].join(t["values" if key == "value_id" else "allomorphs"].where(F.col("sign_id") == sign_id).select(key), key, "left_anti").select(*t[name].columns)
    t = t | {"value_variants": own("value_variants", "value_id"), "allomorph_components": own("allomorph_components", "allomorph_id")}
    return _without(t, [n for n in ("values", "allomorphs", "signs") if n in t], F.col("sign_id") == sign_id)


def merge_values(t: Tables, keep: int, gone: int) -> Tables:
    """Spellings of one reading go to another of the same sign."""
    if _one(t["values"], F.col("value_id") == keep, "sign_id") != _one(t["values"], F.col("value_id") == gone, "sign_id"):
        raise ValueError("values of different signs")
    moved = t["value_variants"].withColumn("value_id", F.when(F.col("value_id") == gone, keep).otherwise(F.col("value_id")).cast("int"))
    return t | {"value_variants": moved, "values": t["values"].where(F.col("value_id") != gone)}


def merge_signs(t: Tables, keep: int, gone: int) -> Tables:
    """Readings and spellings of one sign go to another; readings with x that the other has with a number vanish, on either side."""
    read = t["value_variants"].join(t["values"].select("value_id", "sign_id"), "value_id")
    stem = lambda df, sign: df.where(F.col("sign_id") == sign)
    for a, b in ((gone, keep), (keep, gone)):
        loose = stem(read, a).where(F.col("value").contains("x")).select("value_id", F.regexp_replace("value", "x", "").alias("s"))
        known = stem(read, b).select(F.regexp_replace("value", "[0-9x]+$", "").alias("s"))
        drop = [r.value_id for r in loose.join(known, "s", "left_semi").distinct().collect()]
        t = _without(t, ["values", "value_variants"], F.col("value_id").isin(drop))
        read = read.where(~F.col("value_id").isin(drop))
    own = F.col("sign_id") == gone
    moved = F.when(own, keep).otherwise(F.col("sign_id")).cast("int")
    kind = F.when(own & (F.col("variant_type") == "default"), "nondefault").otherwise(F.col("variant_type"))
    t = t | {"values": t["values"].withColumn("sign_id", moved), "allomorphs": t["allomorphs"].withColumns({"variant_type": kind, "sign_id": moved})}
    return t | ({"signs": t["signs"].where(~own)} if "signs" in t else {})


def allomorph_to_allograph(t: Tables, allomorph_id: int) -> Tables:
    """A one-grapheme spelling becomes an allograph of the sign's own grapheme; its sign_variant_id stays."""
    m = t["allomorphs"].where(F.col("allomorph_id") == allomorph_id).first()
    graph = t["allomorph_components"].where(F.col("allomorph_id") == allomorph_id).join(t["allographs"].where("variant_type = 'default'"), "grapheme_id").collect()
    own = t["allomorphs"].where((F.col("sign_id") == m.sign_id) & (F.col("variant_type") == "default")).select("allomorph_id").join(t["allomorph_components"], "allomorph_id").collect()
    if len(graph) != 1 or len(own) != 1:
        raise ValueError("both spellings must be of one grapheme")
    old, specific = graph[0], bool(m.specific and graph[0].specific)
    kept = t["sign_variants"].where((F.col("allomorph_id") == allomorph_id) & (F.array_join("allograph_ids", ",") == str(old.allograph_id))).first()
    t = delete_allomorph(t, allomorph_id)
    if specific:
        t = delete_grapheme(t, old.grapheme_id)
    t, a = add_allograph(t, own[0].grapheme_id, old.glyph_id, m.variant_type, specific)
    rest = t["sign_variants"].where(F.col("allomorph_id") != allomorph_id)
    row = (kept.sign_variant_id, m.sign_id, own[0].allomorph_id, [a], m.variant_type, specific)
    return t | {"sign_variants": rest.select(*[f.name for f in schema("sign_variants").fields]).unionByName(rest.sparkSession.createDataFrame([row], schema("sign_variants")))}


def make_glyph_value(t: Tables, composed: DataFrame, value_id: int, new_value_id: int) -> Tables:
    """A reading becomes a way to write its default glyphs with another reading."""
    rows = t["value_variants"].where((F.col("value_id") == value_id) & ~F.col("value").contains("x")).join(t["values"].select("value_id", "sign_id"), "value_id")
    rows = rows.join(composed.where("variant_type = 'default'").select("sign_id", "glyph_ids"), "sign_id").select("value", F.lit(new_value_id).cast("int").alias("value_id"), "glyph_ids")
    return delete_value(t | {"glyph_values": t["glyph_values"].unionByName(rows)}, value_id)


def add_name_code(t: Tables, signlist: Tables, pn_type: str, language: str, normal_form: str | None, code: str) -> tuple[Tables, int]:
    """`add_name` with its spelling as code. Raises ValueError if it can't be read or encoded."""
    return add_name(t, pn_type, language, normal_form, names.parse_meanings(code, signlist))


def add_spelling_code(t: Tables, signlist: Tables, pn_id: int, code: str) -> tuple[Tables, int]:
    return add_spelling(t, pn_id, names.parse_meanings(code, signlist))


def edit_spelling_code(t: Tables, signlist: Tables, pn_id: int, pn_variant_no: int, code: str) -> Tables:
    return edit_spelling(t, pn_id, pn_variant_no, names.parse_meanings(code, signlist))


def add_name(t: Tables, pn_type: str, language: str, normal_form: str | None, meanings: list[dict]) -> tuple[Tables, int]:
    """A proper noun with its first spelling -> tables (pns, pn_variants), pn_id."""
    n = _next(t["pns"], "pn_id")
    return t | {"pns": _with(t["pns"], (n, pn_type, language, normal_form)), "pn_variants": _with(t["pn_variants"], (n, 0, meanings))}, n


def add_spelling(t: Tables, pn_id: int, meanings: list[dict]) -> tuple[Tables, int]:
    no = (t["pn_variants"].where(F.col("pn_id") == pn_id).agg(F.max("pn_variant_no")).first()[0] or 0) + 1
    return t | {"pn_variants": _with(t["pn_variants"], (pn_id, no, meanings))}, no


def edit_spelling(t: Tables, pn_id: int, pn_variant_no: int, meanings: list[dict]) -> Tables:
    this = (F.col("pn_id") == pn_id) & (F.col("pn_variant_no") == pn_variant_no)
    return t | {"pn_variants": _with(t["pn_variants"].where(~this), (pn_id, pn_variant_no, meanings))}
