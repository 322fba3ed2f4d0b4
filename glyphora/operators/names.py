"""Proper nouns: spellings read from code, written as code or HTML, unnested, searched and matched to compounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphora.operators import corpus, corpus_search, encoder, html, serialize
from glyphora.operators.signlist import ordered
from glyphora.sources.store import materialized


def unnested(variants: DataFrame) -> DataFrame:
    """pn_id, pn_variant_no, sign_no from 0, and the fields of each sign's meaning."""
    return variants.select("pn_id", "pn_variant_no", F.posexplode("sign_meanings").alias("sign_no", "x")).select("pn_id", "pn_variant_no", "sign_no", "x.*")


NAME = ["pn_id", "pn_variant_no"]


def meanings(codes: DataFrame, key: str, signlist: dict[str, DataFrame]) -> DataFrame:
    """codes (key, code) -> key, sign_meanings, error: the signs of a name's spelling by what they mean.

    error: syntax, if the code can't be read; compound, if it isn't one compound; encoding, if the sign list lacks a sign. sign_meanings is null then.
    """
    parsed = materialized(corpus.parse(codes.select(key, F.concat(F.lit("1\t"), "code").alias("code")), key), "names")
    signs = corpus.exploded(parsed, "signs", key).join(corpus.exploded(parsed, "words", key), [key, "word_no"], "left")
    ids = encoder.encode(signs.select(key, "sign_no", "value", "sign_spec", "type"), [key, "sign_no"], signlist["sign_map"], signlist["values_encoded"], signlist["signs_encoded"]).drop("type")
    ids = ids.join(signlist["composed"].select("sign_variant_id", "sign_id"), "sign_variant_id").select(key, "sign_no", "value_id", "sign_id")
    rows = signs.join(ids, [key, "sign_no"], "left")
    meaning = F.struct("word_no", "value_id", "sign_id", "indicator_type", "phonographic", "stem", "capitalized")
    each = rows.groupBy(key).agg(ordered(meaning, F.col("sign_no")).alias("m"), F.min(F.col("sign_id").isNotNull()).alias("known"))
    whole = parsed.select(key, F.size("errors").alias("e"), F.size("compounds").alias("n")).join(each, key, "left")
    error = F.when(F.col("e") > 0, "syntax").when(F.col("n") != 1, "compound").when(~F.coalesce("known", F.lit(False)), "encoding")
    return whole.select(key, F.when(error.isNull(), F.col("m")).alias("sign_meanings"), error.alias("error"))


def parse_meanings(code: str, signlist: dict[str, DataFrame]) -> list[dict]:
    """`meanings` of one spelling. Raises ValueError if it can't be read or encoded."""
    row = meanings(signlist["composed"].sparkSession.createDataFrame([(0, code)], "k int, code string"), "k", signlist).first()
    if row.error:
        raise ValueError(f"{row.error} error in {code!r}")
    return [m.asDict() for m in row.sign_meanings]


def _default(variants: DataFrame, keys: list[str], composed: DataFrame) -> DataFrame:
    """keys, the fields of each sign's meaning and its default variant; signs that have none are left out."""
    own = composed.where("variant_type = 'default'").select("sign_id", "sign_variant_id")
    return variants.select(*keys, F.posexplode("sign_meanings").alias("sign_no", "x")).select(*keys, "sign_no", "x.*").join(own, "sign_id")


def _rows(variants: DataFrame, keys: list[str], composed: DataFrame, characters: DataFrame) -> DataFrame:
    """Sign rows as the serializers take them. A column language of variants is that of all their signs."""
    c = characters.select(F.col("sign_variant_id").alias("_v"), F.col("value_id").alias("_r"), F.col("print").alias("value"))
    rows = _default(variants, keys, composed)
    rows = rows.join(c, (F.col("sign_variant_id") == F.col("_v")) & F.col("value_id").eqNullSafe(F.col("_r")), "left")
    none, no, zero = F.lit(None).cast("string"), F.lit(False), F.lit(0)
    kind = F.when(F.col("value_id").isNull(), "sign").otherwise("value")
    plain = {"compound_no": zero, "section_no": F.lit(None).cast("int"), "line_no": zero, "type": kind, "condition": F.lit("intact"), "inverted": no, "newline": no, "ligature": no}
    plain |= {c: none for c in ("crits", "comment", "pn_type", "section_name", "compound_comment", "language")}
    return rows.withColumns({k: v for k, v in plain.items() if k not in keys}).drop("_v", "_r")


def serialized(variants: DataFrame, names: DataFrame, composed: DataFrame, characters: DataFrame) -> DataFrame:
    """pn_variants, pns -> pn_id, pn_variant_no, pn: each spelling as code, in the name's language, with the default variants of its signs."""
    rows = variants.join(names.select("pn_id", "language"), "pn_id", "left")
    return serialize.lines(_rows(rows, [*NAME, "language"], composed, characters), [*NAME, "language"]).select(*NAME, F.col("content").alias("pn"))


def meanings_code(rows: DataFrame, keys: list[str], composed: DataFrame, characters: DataFrame) -> DataFrame:
    """rows (keys, sign_meanings) -> keys, code; without language."""
    return serialize.lines(_rows(rows, keys, composed, characters), keys).select(*keys, F.col("content").alias("code"))


def meanings_html(rows: DataFrame, keys: list[str], composed: DataFrame, characters: DataFrame) -> DataFrame:
    """rows (keys, sign_meanings) -> keys, html; characters are those of `html.characters`."""
    return html.lines(_rows(rows, keys, composed, characters), keys).select(*keys, F.col("line").alias("html"))


def relation(variants: DataFrame, composed: DataFrame) -> DataFrame:
    """The search relation of spellings, keys pn_id and pn_variant_no; each is one compound on one line, signs in their default variants."""
    rows = _default(variants, NAME, composed)
    kind = F.when(F.col("value_id").isNull(), "sign").otherwise("value")
    return corpus_search.sign_relation(rows.withColumns({"compound_no": F.lit(0), "line_no": F.lit(0), "type": kind}), composed, NAME)


def search(rows: DataFrame, text: str, signlist: dict[str, DataFrame], links: DataFrame | None = None, aliases: bool = True, **chosen: list) -> DataFrame:
    """pn_id, pn_variant_no of the spellings in which a pattern occurs, over their `relation`.

    With links (pn_id and columns of texts) and chosen values of such columns, names that are linked to no such text are left out.
    """
    found = corpus_search.search(rows, text, signlist, NAME, aliases).select(*NAME).distinct()
    for column, values in chosen.items():
        if values:
            links = links.where(F.col(column).isin(values))
    return found if links is None or not any(chosen.values()) else found.join(links.select("pn_id").distinct(), "pn_id", "left_semi")


def compound_meanings(signs: DataFrame, keys: list[str], sign_id: str = "sign_id") -> DataFrame:
    """keys, sign_meanings (null if a sign isn't encoded), suffix_len: signs behind the stem (null without stems).

    signs: keys (with the compound), sign_no, word_no, value_id, sign_id, indicator_type, phonographic, stem, capitalized. Words are numbered from the
    compound's first.
    """
    first = Window.partitionBy(*keys)
    rows = signs.withColumn("word_no", F.col("word_no") - F.min("word_no").over(first))
    meaning = F.struct("word_no", "value_id", F.col(sign_id).alias("sign_id"), "indicator_type", "phonographic", "stem", "capitalized")
    known = F.min(F.col(sign_id).isNotNull())
    out = rows.groupBy(*keys).agg(ordered(meaning, F.col("sign_no")).alias("m"), known.alias("k"), (F.max("sign_no") - F.max(F.when(F.col("stem"), F.col("sign_no")))).alias("suffix_len"))
    return out.select(*keys, F.when(F.col("k"), F.col("m")).alias("sign_meanings"), "suffix_len")


def compound_graphemes(signs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, grapheme_ids of all signs in order; null if a sign has none. signs: keys, sign_no, grapheme_ids."""
    out = signs.groupBy(*keys).agg(F.flatten(ordered(F.coalesce("grapheme_ids", F.array().cast("array<int>")), F.col("sign_no"))).alias("g"), F.min(F.col("grapheme_ids").isNotNull()).alias("k"))
    return out.select(*keys, F.when(F.col("k"), F.col("g")).alias("grapheme_ids"))


def prefix_matches(compounds: DataFrame, names: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """compounds (keys, kind, elements), names (tie, kind, elements) -> keys, tie: the name whose spelling is the longest beginning of a compound.

    Joined by kind and first element; ties go to the smallest name.
    """
    c = compounds.where(F.size("elements") > 0).withColumn("_first", F.get("elements", F.lit(0)))
    n = names.where(F.size("elements") > 0).select(*tie, "kind", F.col("elements").alias("_spelled"), F.get("elements", F.lit(0)).alias("_first"))
    found = c.join(n, ["kind", "_first"]).where(F.slice("elements", F.lit(1), F.size("_spelled")) == F.col("_spelled"))
    best = Window.partitionBy(*keys).orderBy(F.desc(F.size("_spelled")), *tie)
    return found.withColumn("_k", F.row_number().over(best)).where("_k = 1").select(*keys, *tie)


def spelled(names: DataFrame, signs: DataFrame, keys: list[str]) -> DataFrame:
    """names (keys, sign_no, sign_id), signs (sign_id, grapheme_ids, variant_type) -> keys, grapheme_ids, nonstandard, nondefault: all ways to write a
    name with variants of its signs, and how many are out of the ordinary. One join per sign, as many as the longest name has."""
    longest = names.agg(F.max("sign_no")).first()[0]
    if longest is None:
        longest = -1
    size = names.groupBy(*keys).agg((F.max("sign_no") + 1).alias("n"))
    odd = lambda t: (F.col("variant_type") == t).cast("int") if t == "nonstandard" else (F.col("variant_type") != "default").cast("int")
    each = names.join(signs, "sign_id").select(*keys, "sign_no", F.col("grapheme_ids").alias("g"), odd("nonstandard").alias("a"), odd("default").alias("b"))
    level, found = None, []
    for k in range(longest + 1):
        step = each.where(F.col("sign_no") == k).drop("sign_no")
        if level is None:
            level = step
        else:
            level = level.join(step.withColumnsRenamed({"g": "h", "a": "c", "b": "d"}), keys).select(*keys, F.concat("g", "h").alias("g"), (F.col("a") + F.col("c")).alias("a"), (F.col("b") + F.col("d")).alias("b"))
        found.append(level.join(size.where(F.col("n") == k + 1), keys).drop("n"))
    if not found:
        return each.drop("sign_no").withColumnsRenamed({"g": "grapheme_ids", "a": "nonstandard", "b": "nondefault"})
    return reduce(DataFrame.unionByName, found).withColumnsRenamed({"g": "grapheme_ids", "a": "nonstandard", "b": "nondefault"})
