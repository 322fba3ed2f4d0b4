"""Dictionaries of searches: what is written -> codes v<value>, s<sign variant>, g<grapheme>, c<glyph>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphora.operators.signlist import Tables, joined, ordered


def _code(kind: str, number: str) -> Column:
    return F.concat(F.lit(kind), F.col(number).cast("string"))


def _none() -> Column:
    return F.lit(None).cast("string")


def _either(rows: DataFrame, name: Column, spec: Column, code: Column, as_: str) -> DataFrame:
    """Each row without and with its variant."""
    return rows.select(name.alias(as_), F.explode(F.array(_none(), spec)).alias("sign_spec"), code.alias("code"))


def values_search(t: Tables, composed: DataFrame) -> DataFrame:
    """value, sign_spec, code."""
    read = t["value_variants"].join(t["values"].select("value_id", "sign_id"), "value_id", "left")
    full = read.join(composed.select("sign_id", "sign_variant_id", "glyphs"), "sign_id")
    both = F.concat(_code("v", "value_id"), _code("s", "sign_variant_id"))
    glyph = t["glyph_values"].join(composed.select("glyph_ids", "sign_variant_id", "glyphs"), "glyph_ids")
    return (
        read.select("value", _none().alias("sign_spec"), _code("v", "value_id").alias("code"))
        .unionByName(full.select("value", F.col("glyphs").alias("sign_spec"), both.alias("code")))
        .unionByName(_either(glyph, F.col("value"), F.col("glyphs"), both, "value"))
    )


def signs_search(t: Tables, composed: DataFrame) -> DataFrame:
    """sign, sign_spec, code: readings in capitals stand for any variant of their sign."""
    read = t["value_variants"].join(t["values"].select("value_id", "sign_id"), "value_id").join(composed.select("sign_id", "sign_variant_id", "glyphs"), "sign_id")
    glyph = t["glyph_values"].join(composed.select("glyph_ids", "sign_variant_id", "glyphs"), "glyph_ids")
    rows = [_either(df, F.upper("value"), F.col("glyphs"), _code("s", "sign_variant_id"), "sign") for df in (read, glyph)]
    return rows[0].unionByName(rows[1])


def sign_descriptions_search(composed: DataFrame) -> DataFrame:
    """sign, sign_spec, code: glyphs of a specific variant stand for any variant of its sign."""
    a = composed.where("specific").select("sign_id", F.col("glyphs").alias("g"))
    return _either(a.join(composed.select("sign_id", "sign_variant_id", "glyphs"), "sign_id"), F.col("g"), F.col("glyphs"), _code("s", "sign_variant_id"), "sign")


def forms_search(t: Tables, composed: DataFrame) -> DataFrame:
    """form, sign_spec, code: readings in capitals as chains of components, `(g1|c2)~(g3|c4)`."""
    parts = t["allomorphs"].where("specific").select("sign_id", "allomorph_id").join(t["allomorph_components"], "allomorph_id").join(t["allographs"].where("specific").select("grapheme_id", "glyph_id"), "grapheme_id")
    one = parts.groupBy("sign_id", "allomorph_id", "pos", "grapheme_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("glyph_id")), lambda g: F.concat(F.lit("c"), g.cast("string"))), "|").alias("cs"))
    one = one.select("sign_id", "allomorph_id", "pos", F.concat(F.lit("(g"), F.col("grapheme_id").cast("string"), F.lit("|"), "cs", F.lit(")")).alias("code"))
    chain = one.groupBy("sign_id", "allomorph_id").agg(joined(ordered(F.col("code"), F.col("pos")), "~").alias("code"))
    read = t["value_variants"].join(t["values"].select("value_id", "sign_id"), "value_id").select("value", "sign_id")
    glyphs = lambda c: F.array_join(F.transform(c, lambda g: F.concat(F.lit("c"), g.cast("string"))), "~")
    own = read.join(composed.select("sign_id", "glyphs", "glyph_ids"), "sign_id")
    named = t["glyph_values"].select("value", "glyph_ids", F.posexplode("glyph_ids").alias("o", "glyph_id")).join(t["glyphs"].select("glyph_id", "glyph"), "glyph_id")
    named = named.groupBy("value", "glyph_ids").agg(joined(ordered(F.col("glyph"), F.col("o")), ".").alias("glyphs"))
    return (
        read.join(chain, "sign_id", "left").select(F.upper("value").alias("form"), _none().alias("sign_spec"), "code")
        .unionByName(own.select(F.upper("value").alias("form"), F.col("glyphs").alias("sign_spec"), glyphs("glyph_ids").alias("code")))
        .unionByName(_either(named, F.upper("value"), F.col("glyphs"), glyphs("glyph_ids"), "form"))
    )


def form_descriptions_search(t: Tables) -> DataFrame:
    """form, sign_spec, code: names of graphemes and glyphs."""
    graphs = t["graphemes"].select("grapheme_id", "grapheme").join(t["allographs"].select("grapheme_id", "glyph_id"), "grapheme_id", "left").join(t["glyphs"].select("glyph_id", "glyph"), "glyph_id", "left")
    return (
        t["graphemes"].select(F.col("grapheme").alias("form"), _none().alias("sign_spec"), _code("g", "grapheme_id").alias("code"))
        .unionByName(graphs.select(F.col("grapheme").alias("form"), F.col("glyph").alias("sign_spec"), _code("c", "glyph_id").alias("code")))
        .unionByName(t["glyphs"].select(F.col("glyph").alias("form"), _none().alias("sign_spec"), _code("c", "glyph_id").alias("code")))
    )
