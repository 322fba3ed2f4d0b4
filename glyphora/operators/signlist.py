"""The sign list: variants of signs, their composition, and what identifiers stand for.

All functions take the sign list's tables by name (see `schemas`) and recompute their relation from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphora.functions import signtree
from glyphora.operators.aggregates import merge_variant_types
from glyphora.schemas import ordinal

Tables = dict[str, DataFrame]


def ordered(value: Column, order: Column) -> Column:
    """Aggregate: array of values, nulls included, by order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def joined(values: Column, sep: str) -> Column:
    """String of an array without nulls; null if nothing is left."""
    kept = F.array_compact(values)
    return F.when(F.size(kept) > 0, F.array_join(kept, sep))


def variants(t: Tables) -> DataFrame:
    """sign_id, allomorph_id, allograph_ids, variant_type, specific: every choice of an allograph for each component of each
    spelling of a sign; of those that look alike the plainest.

    One join per component, as many as the longest spelling has.
    """
    parts = t["allomorph_components"].join(t["allographs"].withColumnRenamed("variant_type", "graph_type").withColumnRenamed("specific", "graph_specific"), "grapheme_id", "left")
    parts = parts.select("allomorph_id", "pos", "grapheme_id", "allograph_id", "glyph_id", "graph_type", "graph_specific")
    size = t["allomorph_components"].groupBy("allomorph_id").agg(F.max("pos").alias("size"))
    longest = size.agg(F.max("size")).first()[0] or 0
    own = t["allomorphs"].select("allomorph_id", "sign_id", F.col("variant_type").alias("morph_type"), F.col("specific").alias("morph_specific"))
    first = parts.where("pos = 1").join(own, "allomorph_id")
    level = first.select(
        "sign_id",
        "allomorph_id",
        "morph_type",
        F.array("allograph_id").alias("allograph_ids"),
        F.array("grapheme_id").alias("grapheme_ids"),
        F.array("glyph_id").alias("glyph_ids"),
        merge_variant_types(F.col("graph_type"), F.col("morph_type")).alias("variant_type"),
        (F.col("graph_specific") & F.col("morph_specific")).alias("specific"),
    )
    found = level
    for pos in range(2, longest + 1):
        step = parts.where(F.col("pos") == pos).select("allomorph_id", "allograph_id", "grapheme_id", "glyph_id", "graph_type", "graph_specific")
        level = level.join(step, "allomorph_id").select(
            "sign_id",
            "allomorph_id",
            "morph_type",
            *[F.array_append(f"{c}s", F.col(c)).alias(f"{c}s") for c in ("allograph_id", "grapheme_id", "glyph_id")],
            merge_variant_types(F.col("graph_type"), F.col("variant_type")).alias("variant_type"),
            (F.col("graph_specific") & F.col("specific")).alias("specific"),
        )
        found = found.unionByName(level)
    whole = found.join(size, "allomorph_id").where(F.size("allograph_ids") == F.col("size"))
    plain = Window.partitionBy("sign_id", "glyph_ids").orderBy(ordinal("sign_variant_type", F.col("variant_type")), ordinal("sign_variant_type", F.col("morph_type")), "grapheme_ids")
    return whole.withColumn("k", F.rank().over(plain)).where("k = 1").select("sign_id", "allomorph_id", "allograph_ids", "variant_type", "specific")


def numbered(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Variants with sign_variant_id: that of a known one with the same allomorph and allographs, else the next free numbers.

    New ones are numbered by one sort: a sign list is small, whatever the corpus is.
    """
    key = ["allomorph_id", "allograph_ids"]
    if known is None:
        known = found.select(*key).limit(0).withColumn("sign_variant_id", F.lit(None).cast("int"))
    base = known.agg(F.coalesce(F.max("sign_variant_id"), F.lit(0))).first()[0]
    rows = found.join(known.select(*key, "sign_variant_id"), key, "left")
    old, new = rows.where("sign_variant_id is not null"), rows.where("sign_variant_id is null")
    rank = F.row_number().over(Window.orderBy("sign_id", "allomorph_id", "allograph_ids"))
    return old.unionByName(new.withColumn("sign_variant_id", (rank + base).cast("int")))


def composition(t: Tables) -> DataFrame:
    """sign_variants with grapheme_ids, glyph_ids, graphemes, glyphs, unicode, tree."""
    each = t["sign_variants"].select("sign_variant_id", F.posexplode_outer("allograph_ids").alias("o", "allograph_id"))
    each = each.join(t["allographs"].select("allograph_id", "grapheme_id", "glyph_id"), "allograph_id", "left").join(t["graphemes"], "grapheme_id", "left").join(t["glyphs"], "glyph_id", "left")
    o = F.col("o")
    rows = each.groupBy("sign_variant_id").agg(
        ordered(F.col("grapheme_id"), o).alias("grapheme_ids"),
        ordered(F.col("glyph_id"), o).alias("glyph_ids"),
        joined(ordered(F.col("grapheme"), o), ".").alias("graphemes"),
        joined(ordered(F.col("glyph"), o), ".").alias("glyphs"),
        F.array_join(ordered(F.coalesce("unicode", F.lit("□")), o), "").alias("unicode"),
    )
    return t["sign_variants"].join(rows, "sign_variant_id").withColumn("tree", signtree.tree_column(F.col("glyphs")))


def sign_map(t: Tables) -> DataFrame:
    """identifier, graphemes, grapheme_ids, glyphs, glyph_ids: what values, glyph values, synonyms, graphemes, glyphs and X stand for."""
    default = F.col("variant_type") == "default"
    graphs = t["allographs"].where(default).select("grapheme_id", "glyph_id")
    blank = F.lit(None).cast("array<int>")
    unless_null = lambda a: F.when(~((F.size(a) == 1) & F.get(a, F.lit(0)).isNull()), a)
    names = t["value_variants"].select(F.upper("value").alias("name")).distinct()

    spelled = t["value_variants"].where(~F.col("value").contains("x")).join(t["values"].select("value_id", "sign_id"), "value_id")
    spelled = spelled.join(t["allomorphs"].where(default).select("allomorph_id", "sign_id"), "sign_id").join(t["allomorph_components"], "allomorph_id")
    spelled = spelled.join(t["graphemes"], "grapheme_id", "left").join(graphs, "grapheme_id", "left").join(t["glyphs"], "glyph_id", "left")
    o = F.col("pos")
    values = spelled.groupBy("value").agg(
        joined(ordered(F.col("grapheme"), o), ".").alias("graphemes"),
        unless_null(ordered(F.col("grapheme_id"), o)).alias("grapheme_ids"),
        joined(ordered(F.col("glyph"), o), ".").alias("glyphs"),
        unless_null(ordered(F.col("glyph_id"), o)).alias("glyph_ids"),
    )
    values = values.select(F.upper("value").alias("identifier"), "graphemes", "grapheme_ids", "glyphs", "glyph_ids")

    null = F.lit(None).cast("string")
    each = t["glyph_values"].select("value", "glyph_ids", F.posexplode_outer("glyph_ids").alias("o", "glyph_id")).join(t["glyphs"], "glyph_id", "left")
    glyph_values = each.groupBy("value", "glyph_ids").agg(joined(ordered(F.col("glyph"), F.col("o")), ".").alias("glyphs"))
    glyph_values = glyph_values.select(F.upper("value").alias("identifier"), null.alias("graphemes"), blank.alias("grapheme_ids"), "glyphs", "glyph_ids")
    synonyms = t["glyph_synonyms"].join(t["glyphs"], "glyph_id").select(F.col("synonym").alias("identifier"), null.alias("graphemes"), blank.alias("grapheme_ids"), "glyph", F.array("glyph_id"))
    graphemes = t["graphemes"].join(graphs, "grapheme_id", "left").join(t["glyphs"], "glyph_id", "left")
    graphemes = graphemes.join(names, F.col("grapheme") == F.col("name"), "left_anti").select("grapheme", "grapheme", F.array("grapheme_id"), "glyph", F.when(F.col("glyph_id").isNotNull(), F.array("glyph_id")))
    glyphs = t["glyphs"].join(t["allographs"].where("specific").select("glyph_id", "grapheme_id"), "glyph_id", "left").join(t["graphemes"], "grapheme_id", "left")
    glyphs = glyphs.join(names, F.col("glyph") == F.col("name"), "left_anti").select("glyph", "grapheme", F.when(F.col("grapheme_id").isNotNull(), F.array("grapheme_id")), "glyph", F.array("glyph_id"))
    any_ = t["glyphs"].sparkSession.range(1).select(F.lit("X"), F.lit("X"), blank, F.lit("X"), blank)
    return values.union(glyph_values).union(synonyms).union(graphemes).union(glyphs).union(any_).distinct()


def signlist(t: Tables, composed: DataFrame) -> DataFrame:
    """Each reading of each variant of each sign."""
    values = t["value_variants"].join(t["values"].select("value_id", "sign_id", "main_variant_id"), "value_id")
    rows = values.join(composed, "sign_id").withColumn("main", F.col("value_variant_id") == F.col("main_variant_id"))
    return rows.select("sign_id", "sign_variant_id", "graphemes", "glyphs", "unicode", "variant_type", "specific", "value_id", "value_variant_id", "value", "main")


def characters(t: Tables, composed: DataFrame) -> DataFrame:
    """sign_variant_id, value_id (null: the sign without a reading), print: in code.

    A reading of another than the default variant, or one with x, is followed by the variant in parentheses.
    """
    kind = F.col("variant_type")
    spec = F.when(kind == "default", F.concat(F.lit("("), "graphemes", F.lit(")"))).when(kind == "nondefault", F.concat(F.lit("("), "glyphs", F.lit(")"))).otherwise(F.concat(F.lit("!("), "glyphs", F.lit(")")))
    main = t["value_variants"].join(t["values"], F.col("value_variant_id") == F.col("main_variant_id")).select(t["values"]["value_id"], "sign_id", "value")
    read = main.join(composed.select("sign_id", "sign_variant_id", "graphemes", "glyphs", "variant_type"), "sign_id")
    read = read.select("sign_variant_id", "value_id", F.when((kind == "default") & ~F.col("value").contains("x"), F.col("value")).otherwise(F.concat("value", spec)).alias("print"))
    piped = lambda c: F.when(c.contains("."), F.concat(F.lit("|"), c, F.lit("|"))).otherwise(c)
    plain = composed.where(kind == "default").select("sign_id", piped(F.col("graphemes")).alias("plain"))
    bare = composed.join(plain, "sign_id", "left")
    bare = bare.select("sign_variant_id", F.lit(None).cast("int").alias("value_id"), F.when(kind == "default", F.col("plain")).when(F.col("specific"), piped(F.col("glyphs"))).otherwise(F.concat("plain", spec)).alias("print"))
    return read.unionByName(bare)
