"""Corpora bound to the driver's tables: documents, orders, a region tree, an event log, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_positions(signs: DataFrame) -> DataFrame:
    """Adds pos and next_pos of whole signs (component 0, final) to rows with sign_no."""
    return signs.withColumns({"pos": F.shiftleft(F.col("sign_no").cast("long"), 7), "next_pos": F.shiftleft(F.col("sign_no").cast("long") + 1, 7)})


def document_tokens(spark: SparkSession, sf_dir: str, *more: str, edges: bool = False) -> DataFrame:
    r"""tid, sign_no, line_no, value, pos, next_pos (with edges: starts_line, ends_line): lower-cased letters of the words of each line, in order.

    Words without letters drop out before numbering. All is done within the row, so nothing is shuffled.
    """
    letters = F.regexp_replace(F.lower("text"), r"[^\p{L} \n]", "")  # one pass over the text, before it is split
    words = F.transform(F.split(letters, "\n", -1), lambda x: F.filter(F.split(x, " ", -1), lambda w: w != ""))
    about = lambda ws, w, k: [(k == 0).alias("starts_line"), (k == F.size(ws) - 1).alias("ends_line")] if edges else []
    signs = F.flatten(F.transform(words, lambda ws, i: F.transform(ws, lambda w, k: F.struct(i.alias("line_no"), w.alias("value"), *about(ws, w, k)))))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tid"), *more, F.posexplode(signs).alias("sign_no", "x"))
    return with_positions(rows.select("tid", *more, "sign_no", "x.*"))


#: Makes lines of an order unique.
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def order_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, sign_no, value_id, grapheme, glyph, flag, status, word_no, compound_no, line_no, pos, next_pos of order lines.

    A word is a run of equal return flags, a compound one of equal line status, a line three signs. One exchange by
    order serves the numbering and both runs.
    """
    own = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *ORDER, "l_returnflag", "l_linestatus")
    turn = lambda c: F.coalesce((F.col(c) != F.lag(c).over(own)).cast("int"), F.lit(0))
    lines = lines.withColumns({"w": turn("l_returnflag"), "c": turn("l_linestatus"), "sign_no": F.row_number().over(own) - 1})
    lines = lines.withColumns({"word_no": F.sum("w").over(own).cast("int"), "compound_no": F.sum("c").over(own).cast("int")})
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("grapheme"), F.col("p_brand").alias("glyph"))
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return with_positions(
        rows.select(
            F.col("l_orderkey").alias("tid"),
            "sign_no",
            F.col("l_partkey").alias("value_id"),
            "grapheme",
            "glyph",
            F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("status"),
            "word_no",
            "compound_no",
            F.floor(F.col("sign_no") / 3).cast("int").alias("line_no"),
        )
    )


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, text_id, period, genre, provenience, object of orders."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select(
        F.col("o_orderkey").alias("tid"), F.col("o_custkey").alias("text_id"), F.col("o_orderpriority").alias("period"), F.col("o_orderstatus").alias("genre"), F.col("n_name").alias("provenience"),
        F.col("c_mktsegment").alias("object"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent: regions, the nations of each, their customers and suppliers, as a tree."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier")}
    of = lambda df, k, kp, p, pp: df.select(F.concat(F.lit(k), F.col(kp).cast("string")).alias("id"), (F.concat(F.lit(p), F.col(pp).cast("string")) if p else F.lit(None).cast("string")).alias("parent"))
    rows = of(t["region"], "r", "r_regionkey", None, None)
    for df, k, kp, p, pp in ((t["nation"], "n", "n_nationkey", "r", "n_regionkey"), (t["customer"], "c", "c_custkey", "n", "c_nationkey"), (t["supplier"], "s", "s_suppkey", "n", "s_nationkey")):
        rows = rows.unionByName(of(df, k, kp, p, pp))
    return rows


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, log_no, action, entry_no, internal, edit_no of events: an edit log per user, from 0 in order of time."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    action = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "update").otherwise("other")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("tid"),
        (F.row_number().over(own) - 1).alias("log_no"),
        action.alias("action"),
        F.pmod(F.floor("value"), F.lit(50)).cast("int").alias("entry_no"),
        F.col("event_type").isin("view", "purchase").alias("internal"),
        F.col("event_id").alias("edit_no"),
        "ts",
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, line_no, role, text, block_no of conversations: a block is a run of equal roles."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("t", F.coalesce((F.col("role") != F.lag("role").over(own)).cast("int"), F.lit(0)))
    return rows.select(F.col("conv_id").alias("tid"), F.col("turn").alias("line_no"), "role", "text", F.sum("t").over(own).cast("int").alias("block_no"))


def part_signlist(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A sign list of part names: a name is a sign, its words are graphemes with two or three glyphs each; it may also be spelled backwards."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("id"), "p_name")
    sign = part.groupBy("p_name").agg(F.min("id").alias("sign_id"))
    word = part.select("id", F.posexplode(F.split("p_name", " ")).alias("k", "grapheme")).groupBy("grapheme").agg(F.min(F.col("id") * 10 + F.col("k")).alias("grapheme_id"))
    glyph = lambda no, name, kind, specific: F.struct(F.lit(no).alias("no"), name.alias("glyph"), F.lit(kind).alias("variant_type"), F.lit(specific).alias("specific"))
    upper = F.upper("grapheme")
    kinds = F.array(glyph(1, upper, "default", True), glyph(2, F.concat(upper, F.lit("2")), "nondefault", False), glyph(3, F.concat(upper, F.lit("3")), "reduced", False))
    graph = word.select("grapheme_id", "grapheme", F.explode(kinds).alias("x")).where("x.no < 3 or length(grapheme) % 2 = 0")
    graph = graph.select((F.col("grapheme_id") * 10 + F.col("x.no")).alias("allograph_id"), "grapheme_id", "x.glyph", "x.variant_type", "x.specific")
    morph = sign.select("sign_id", "p_name", F.explode(F.array(F.lit(1), F.lit(2))).alias("no"))
    spelled = F.when(F.col("no") == 1, F.split("p_name", " ")).otherwise(F.reverse(F.split("p_name", " ")))
    parts = morph.select((F.col("sign_id") * 10 + F.col("no")).alias("allomorph_id"), F.posexplode(spelled).alias("k", "grapheme")).join(word, "grapheme")
    reading = sign.select("sign_id", F.explode(F.array(F.struct(F.lit(1).alias("no"), F.concat(F.regexp_replace("p_name", " ", ""), F.lit("1")).alias("v")), F.struct(F.lit(2).alias("no"), F.concat(F.regexp_replace("p_name", " .*", ""), F.lit("x")).alias("v")))).alias("x"))
    return {
        "glyphs": graph.select(F.col("allograph_id").alias("glyph_id"), "glyph", F.lit(None).cast("string").alias("unicode")),
        "glyph_synonyms": graph.where("variant_type = 'reduced'").select(F.concat(F.lit("SYN"), "glyph").alias("synonym"), F.col("allograph_id").alias("glyph_id")),
        "graphemes": word.select("grapheme_id", F.upper("grapheme").alias("grapheme"), F.lit(None).cast("int").alias("mzl_no")),
        "allographs": graph.select("allograph_id", "grapheme_id", F.col("allograph_id").alias("glyph_id"), "variant_type", "specific"),
        "allomorphs": morph.select((F.col("sign_id") * 10 + F.col("no")).alias("allomorph_id"), "sign_id", F.when(F.col("no") == 1, "default").otherwise("nondefault").alias("variant_type"), (F.col("no") == 1).alias("specific")),
        "allomorph_components": parts.select("allomorph_id", (F.col("k") + 1).alias("pos"), "grapheme_id"),
        "values": sign.select(F.col("sign_id").alias("value_id"), "sign_id", (F.col("sign_id") * 10 + 1).alias("main_variant_id"), F.lit(False).alias("phonographic")),
        "value_variants": reading.select((F.col("sign_id") * 10 + F.col("x.no")).alias("value_variant_id"), F.col("sign_id").alias("value_id"), F.col("x.v").alias("value")),
        "glyph_values": graph.where("variant_type = 'nondefault'").limit(0).select(F.col("glyph").alias("value"), F.col("allograph_id").alias("value_id"), F.array("allograph_id").alias("glyph_ids")),
    }


KEY = "transliteration_id"


def sign_rows(spark: SparkSession, sf_dir: str, composed: DataFrame) -> DataFrame:
    """Order lines as signs of the sign list of part names: transliteration_id, sign_no, compound_no, line_no, p_name, sign_id, plain_variant_id (the plainest variant), sign_variant_id, value_id,
    custom_value, type, indicator_type, phonographic, stem.

    Returned parts have no reading, parts of size 1 are numbers; sizes that end in 3 are determinatives, in 4 phonetic complements.
    """
    part = table(spark, sf_dir, "part")
    known = part.select(F.col("p_partkey").alias("value_id"), "p_name", "p_size", F.min(F.col("p_partkey").cast("int")).over(Window.partitionBy("p_name")).alias("sign_id"))
    rows = order_signs(spark, sf_dir).join(known, "value_id").join(composed.where("specific").select("sign_id", "sign_variant_id"), "sign_id")
    size, last = F.col("p_size"), F.col("p_size") % 10
    number = size == 1
    return rows.select(
        F.col("tid").cast("int").alias(KEY), "sign_no", "compound_no", "line_no", "p_name", "sign_id", F.col("sign_variant_id").alias("plain_variant_id"),
        F.when(~number, F.col("sign_variant_id")).alias("sign_variant_id"), F.when(~number & (F.col("flag") != "R"), F.col("sign_id")).alias("value_id"), F.when(number, F.col("p_name")).alias("custom_value"),
        F.when(number, "number").when(F.col("flag") != "R", "value").otherwise("sign").alias("type"),
        F.when(last == 3, "left").when(last == 4, "right").otherwise("none").alias("indicator_type"), F.when(last == 3, False).when(last == 4, True).alias("phonographic"),
        F.when(F.col("status") == "F", True).alias("stem"),
    )


def sign_tables(signs: DataFrame) -> dict[str, DataFrame]:
    """The seven tables of a corpus of such signs; each sign is a word."""
    none, no = lambda k: F.lit(None).cast(k), F.lit(False)
    each = lambda *c: signs.select(KEY, *c).distinct()
    return {
        "sections": signs.select(KEY, F.lit(0).alias("section_no"), none("string").alias("section_name"), none("int").alias("composition_id")).limit(0),
        "compounds": each("compound_no", none("string").alias("pn_type"), none("string").alias("language"), none("int").alias("section_no"), none("string").alias("compound_comment")),
        "words": each(F.col("sign_no").alias("word_no"), "compound_no", no.alias("capitalized")),
        "surfaces": each(F.lit(0).alias("surface_no"), F.lit("surface").alias("surface_type"), none("string").alias("surface_data"), none("string").alias("surface_comment")),
        "blocks": each(F.lit(0).alias("block_no"), F.lit(0).alias("surface_no"), F.lit("block").alias("block_type"), none("string").alias("block_data"), none("string").alias("block_comment")),
        "lines": each("line_no", F.lit(0).alias("block_no"), F.col("line_no").cast("string").alias("line"), none("string").alias("line_comment")),
        "corpus": signs.select(
            KEY, "sign_no", "line_no", F.col("sign_no").alias("word_no"), "value_id", "sign_variant_id", "custom_value", "type", "indicator_type", "phonographic",
            "stem", F.lit("intact").alias("condition"), none("string").alias("crits"), none("string").alias("comment"), no.alias("newline"), no.alias("inverted"), no.alias("ligature"),
        ),
    }
