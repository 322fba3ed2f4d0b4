"""Encoding: from written values and signs to ids of the sign list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphora.functions import signtree
from glyphora.operators.signlist import Tables
from glyphora.schemas import ordinal


def values_encoded(t: Tables, composed: DataFrame) -> DataFrame:
    """value, sign_spec, value_id, sign_variant_id: of each written value with or without a variant; the plainest variant wins.

    Ties go to the smallest value_id and sign_variant_id.
    """
    none = F.lit(None).cast("string")
    signs = composed.select("sign_id", "sign_variant_id", "glyphs", "glyph_ids", "variant_type")
    own = t["values"].select("value_id", "sign_id")
    read = t["value_variants"].select("value", "value_id").join(own, "value_id").join(signs, "sign_id")
    known = ~F.col("value").contains("x")
    glyph = t["glyph_values"].select("value", "value_id", "glyph_ids").join(own, "value_id").join(signs, ["sign_id", "glyph_ids"])
    index_x = F.concat(F.regexp_replace("value", "[0-9]+$", ""), F.lit("x"))
    out = lambda df, value, spec: df.select(value.alias("value"), spec.alias("sign_spec"), "value_id", "sign_variant_id", "variant_type")
    value, glyphs = F.col("value"), F.col("glyphs")
    rows = out(read, value, glyphs).union(out(read.where(known & (F.col("variant_type") == "default")), value, none)).union(out(read.where(known), index_x, glyphs))
    rows = rows.union(out(glyph, value, glyphs)).union(out(glyph, value, none))
    best = Window.partitionBy("value", "sign_spec").orderBy(ordinal("sign_variant_type", F.col("variant_type")), "value_id", "sign_variant_id")
    return rows.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k", "variant_type")


def signs_encoded(composed: DataFrame) -> DataFrame:
    """sign, sign_spec, sign_variant_id: specific variants by their glyphs, and any variant of a sign by its default glyphs."""
    specific = composed.where("specific").select(F.col("glyphs").alias("sign"), F.lit(None).cast("string").alias("sign_spec"), "sign_variant_id")
    default = composed.where("variant_type = 'default'").select("sign_id", F.col("glyphs").alias("sign"))
    return specific.union(default.join(composed.select("sign_id", F.col("glyphs").alias("sign_spec"), "sign_variant_id"), "sign_id").select("sign", "sign_spec", "sign_variant_id"))


def normalized(texts: DataFrame, mapping: DataFrame) -> DataFrame:
    """texts (s) -> s, glyphs: each component replaced by the glyphs that it stands for, operators normalized; unknown components vanish."""
    glyph = texts.select("s").distinct().where("s is not null").select("s", F.posexplode(signtree.glyphs_column(F.col("s"))).alias("glyph_no", "glyph"))
    part = glyph.select("s", "glyph_no", F.posexplode(signtree.components_column(F.col("glyph"))).alias("no", "x")).select("s", "glyph_no", "no", "x.op", "x.component")
    known = part.join(mapping.select(F.col("identifier").alias("component"), "glyphs"), "component", "left")
    text = F.concat("op", F.coalesce(F.concat(F.lit("("), "glyphs", F.lit(")")), F.lit("")))
    whole = known.groupBy("s", "glyph_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", text.alias("t")))), lambda x: x["t"]), "").alias("t"))
    whole = whole.select("s", "glyph_no", signtree.normalize_column(F.col("t")).alias("t"))
    return whole.groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("glyph_no", "t"))), lambda x: x["t"]), ".").alias("glyphs"))


def encode(rows: DataFrame, keys: list[str], mapping: DataFrame, values: DataFrame, signs: DataFrame) -> DataFrame:
    """rows (keys, value, sign_spec, type) -> keys, value_id, sign_variant_id, type of those that can be encoded.

    Only distinct texts of signs and variants are normalized; null variants match null.
    """
    texts = rows.where("type = 'sign'").select(F.col("value").alias("s")).union(rows.select(F.col("sign_spec").alias("s")))
    known = normalized(texts, mapping)
    spec = known.withColumnsRenamed({"s": "sign_spec", "glyphs": "spec_glyphs"})
    full = rows.join(spec, "sign_spec", "left")
    v = values.select(F.col("value").alias("v"), F.col("sign_spec").alias("vs"), "value_id", "sign_variant_id")
    by_value = full.where("type = 'value'").join(v, (F.col("value") == F.col("v")) & F.col("spec_glyphs").eqNullSafe(F.col("vs")))
    g = known.withColumnsRenamed({"s": "value", "glyphs": "sign_glyphs"})
    e = signs.select("sign", F.col("sign_spec").alias("es"), "sign_variant_id")
    by_sign = full.where("type = 'sign'").join(g, "value").join(e, (F.col("sign_glyphs") == F.col("sign")) & F.col("spec_glyphs").eqNullSafe(F.col("es")))
    none = F.lit(None).cast("int").alias("value_id")
    return by_value.select(*keys, "value_id", "sign_variant_id", "type").unionByName(by_sign.select(*keys, none, "sign_variant_id", "type"))


def split_custom(custom: DataFrame, keys: list[str]) -> DataFrame:
    """custom (keys, custom_value, type) -> keys, value, sign_spec, type: `a(B)` parted at its first parenthesis behind a letter or digit."""
    parts = F.split("custom_value", r"(?<=[0-9a-zA-ZŠšḪḫŘřĝĜṣṢṭṬ])\(", 2)
    spec = F.get(parts, F.lit(1))
    rows = custom.where("custom_value is not null and type in ('value', 'sign')")
    return rows.select(*keys, F.get(parts, F.lit(0)).alias("value"), F.when(spec.isNotNull(), F.regexp_replace(spec, r"\)$", "")).alias("sign_spec"), "type")
