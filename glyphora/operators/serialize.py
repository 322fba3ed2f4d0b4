"""Serializer: sign rows -> code, line by line and as whole documents.

What a sign contributes depends on it and its neighbours only, so it is a window of lag and lead over a text's signs and one
ordered string aggregation per line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Marks of the notation.
LANGUAGE = {"akkadian": "%a ", "eblaite": "%e ", "hittite": "%h ", "sumerian": "%s "}
NAMES = ["person", "god", "place", "water", "field", "temple", "month", "object", "ethnicity"]
OPEN = {"lost": "[", "damaged": "⸢", "inserted": "‹", "deleted": "«"}
CLOSE = {"lost": "]", "damaged": "⸣", "inserted": "›", "deleted": "»"}
FIELDS = ["sign_no", "word_no", "compound_no", "section_no", "line_no", "type", "indicator_type", "phonographic", "stem", "language", "pn_type", "compound_comment", "inverted", "newline", "ligature"]


def _pick(value: Column, names: dict[str, str]) -> Column:
    return reduce(lambda rest, k: F.when(value == k, F.lit(names[k])).otherwise(rest), names, F.lit(""))


def _text(*cases: tuple[Column, str]) -> Column:
    """The text of the first case that holds; empty if none does."""
    return reduce(lambda rest, c: F.when(F.coalesce(c[0], F.lit(False)), F.lit(c[1])).otherwise(rest), reversed(cases), F.lit(""))


def _bracket(value: Column, condition: Column) -> tuple[Column, Column]:
    """Conditions at the start and the end of a sign whose value may hold brackets itself."""
    brackets = "\\[\\]⸢⸣‹›«»"
    first = F.regexp_extract(F.coalesce(value, F.lit("")), f"([{brackets}])", 1)
    last = F.regexp_extract(F.coalesce(value, F.lit("")), f"([{brackets}])[^{brackets}]*$", 1)
    shut = {v: k for k, v in CLOSE.items()}
    start = F.when(first == "", condition).when(first.isin(*shut), _pick(first, shut)).otherwise("intact")
    end = F.when(last == "", condition).when(last.isin(*shut), "intact").otherwise(_pick(last, {v: k for k, v in OPEN.items()}))
    return start, end


def _logogram(s: Column) -> Column:
    return s["phonographic"].isNotNull() & ~s["phonographic"] & (s["indicator_type"] == "none")


def _plain(s: Column) -> Column:
    return s["phonographic"].isNull() | s["phonographic"] | (s["indicator_type"] != "none")


def _opening(p: Column, s: Column, start: Column, p_end: Column, capital: Column) -> Column:
    first = p.isNull()
    new_line = ~p["line_no"].eqNullSafe(s["line_no"])
    compound = first | (p["compound_no"] != s["compound_no"])
    language = F.when(first | ~p["language"].eqNullSafe(s["language"]), F.when(s["language"].isNull(), F.when(first, "").otherwise("%u ")).otherwise(_pick(s["language"], LANGUAGE))).otherwise("")
    name = F.when(s["pn_type"].isNotNull() & (compound | ~p["pn_type"].eqNullSafe(s["pn_type"])), _pick(s["pn_type"], {n: f"%{n} " for n in NAMES})).otherwise("")
    stem = _text(
        (s["stem"].isNotNull() & (first | (p["stem"].isNull() & (p["compound_no"] != s["compound_no"]))), "%st+ "),
        (s["stem"].isNull() & ~first & p["stem"].isNotNull() & (p["compound_no"] != s["compound_no"]), "%st- "),
    )
    begins = _text((~first & (p["word_no"] == s["word_no"]) & ~p["stem"] & s["stem"], ";"))
    logogram = _text((_logogram(s) & (first | _plain(p) | new_line), "_"))
    condition = F.when(first | (p_end != start) | new_line, _pick(start, OPEN)).otherwise("")
    edge = (s["indicator_type"] != "none") & (first | (p["indicator_type"] != s["indicator_type"]) | ~p["phonographic"].eqNullSafe(s["phonographic"]) | new_line)
    indicator = F.when(edge, F.when(F.coalesce(s["phonographic"], F.lit(False)), "<").otherwise("{")).otherwise("")
    return F.concat(language, name, stem, begins, logogram, condition, F.when(capital, "&").otherwise(""), indicator)


def _closing(s: Column, n: Column, end: Column, n_start: Column) -> Column:
    last = n.isNull()
    new_line = last | (n["line_no"] != s["line_no"])
    edge = (s["indicator_type"] != "none") & (last | (n["indicator_type"] != s["indicator_type"]) | ~n["phonographic"].eqNullSafe(s["phonographic"]) | new_line)
    indicator = F.when(edge, F.when(F.coalesce(s["phonographic"], F.lit(False)), ">").otherwise("}")).otherwise("")
    remark = F.when((last | (n["compound_no"] != s["compound_no"])) & (F.coalesce(F.length(s["compound_comment"]), F.lit(0)) > 0), F.concat(F.lit(" ("), s["compound_comment"], F.lit(")"))).otherwise("")
    condition = F.when(last | (n_start != end) | new_line, _pick(end, CLOSE)).otherwise("")
    logogram = _text((_logogram(s) & (last | _plain(n) | new_line), "_"))
    ends = _text((~last & s["stem"] & ~n["stem"] & (s["word_no"] == n["word_no"]), ";"))
    return F.concat(indicator, remark, condition, logogram, ends)


def _connector(s: Column, n: Column) -> Column:
    """What stands between a sign and the next."""
    inner = (s["indicator_type"] != "none") & (n["indicator_type"] == s["indicator_type"])
    side = (
        F.when(inner & s["phonographic"].eqNullSafe(n["phonographic"]), F.when(F.coalesce(s["phonographic"], F.lit(False)), "P").otherwise("L"))
        .when(inner, "M")
        .when(s["indicator_type"].isin("right", "center") | n["indicator_type"].isin("left", "center"), "0")
        .when(n["compound_no"] != s["compound_no"], "C")
        .when(n["word_no"] != s["word_no"], "W")
        .when((s["type"] == "number") & (n["type"] == "number"), "N")
        .when((s["type"] == "sign") & (n["type"] == "sign") & s["stem"].eqNullSafe(n["stem"]), "D")
        .otherwise("S")
    )
    plain = _pick(side, {"L": ".", "D": ".", "N": ".", "P": "-", "S": "-", "W": "--", "C": " "})
    inverted = F.when(side == "W", "--:").when(side == "C", " : ").otherwise(":")
    wrapped = F.when(side.isin("L", "P", "M", "0"), "~").when(side == "C", "").otherwise(plain)
    return (
        F.when(n.isNull(), "")
        .when(n["sign_no"] != s["sign_no"] + 1, F.concat(plain, F.lit("…"), plain))
        .when(n["inverted"], inverted)
        .when(n["newline"], F.concat(plain, F.lit("/"), F.when(side == "C", " ").otherwise("")))
        .when(n["ligature"], F.concat(F.when(side == "W", plain).otherwise(""), F.lit("+")))
        .when(n["line_no"] != s["line_no"], wrapped)
        .otherwise(plain)
    )


def fragments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_no, sign_no, fragment: each sign's part of its line.

    rows: keys, value, sign_no, word_no, compound_no, section_no, line_no, type, indicator_type, phonographic, stem, condition,
    language, inverted, newline, ligature, crits, comment, capitalized, pn_type, section_name, compound_comment.
    """
    own = Window.partitionBy(*keys).orderBy("sign_no")
    start, end = _bracket(F.col("value"), F.col("condition"))
    rows = rows.withColumns({"_s": F.struct(*FIELDS), "_start": start, "_end": end})
    rows = rows.withColumns(
        {"_p": F.lag("_s").over(own), "_p_end": F.lag("_end").over(own), "_n": F.lead("_s").over(own), "_n_start": F.lead("_start").over(own)}
    )
    parts = ["_p", "_p_end", "_s", "_start", "_end", "_n", "_n_start", "section_name", "capitalized", "value", "crits", "comment"]
    # A lambda is evaluated as one expression; generated code for it would outgrow a method.
    text = F.get(F.transform(F.array(F.struct(*parts)), _fragment), F.lit(0))
    return rows.select(*keys, "line_no", "sign_no", text.alias("fragment"))


def _fragment(x: Column) -> Column:
    p, s, n = x["_p"], x["_s"], x["_n"]
    changed = p.isNull() | ~p["section_no"].eqNullSafe(s["section_no"])
    section = F.when(s["section_no"].isNotNull() & changed, F.concat(F.lit("%sec="), x["section_name"], F.lit(" "))).when(s["section_no"].isNull() & p["section_no"].isNotNull(), "%sec ").otherwise("")
    capital = F.coalesce(x["capitalized"] & (p.isNull() | (p["word_no"] != s["word_no"])), F.lit(False))
    quote = F.when(s["type"] == "description", '"').otherwise("")
    body = F.concat(quote, F.coalesce(x["value"], F.lit("")), quote, F.coalesce(x["crits"], F.lit("")), F.coalesce(F.concat(F.lit("("), x["comment"], F.lit(")")), F.lit("")))
    return F.concat(section, _opening(p, s, x["_start"], x["_p_end"], capital), body, _closing(s, n, x["_end"], x["_n_start"]), _connector(s, n))


def joined(rows: DataFrame, keys: list[str], order: str, text: Column, sep: str, name: str) -> DataFrame:
    """keys, name: texts by order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["t"]), sep).alias(name))


def lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_no, content: code of each line with signs."""
    return joined(fragments(rows, keys), [*keys, "line_no"], "sign_no", F.col("fragment"), "", "content")


def _headed(kind: Column, data: Column, comment: Column, blank: str, content: Column) -> Column:
    head = F.concat(F.lit("@"), kind, F.coalesce(F.concat(F.lit(" "), data), F.lit("")), F.coalesce(F.concat(F.lit("\n# "), comment), F.lit("")), F.coalesce(F.concat(F.lit("\n"), content), F.lit("")))
    return F.when((kind != blank) | data.isNotNull(), head).otherwise(F.coalesce(content, F.lit("")))


def documents(rows: DataFrame, t: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """keys, content: whole documents. Lines, blocks and surfaces without signs stay."""
    line = t["lines"].join(lines(rows, keys), [*keys, "line_no"], "left")
    text = F.concat("line", F.lit("\t"), F.coalesce("content", F.lit("")), F.coalesce(F.concat(F.lit("\n# "), "line_comment"), F.lit("")))
    block = t["blocks"].join(joined(line, [*keys, "block_no"], "line_no", text, "\n", "content"), [*keys, "block_no"], "left")
    text = _headed(F.col("block_type"), F.col("block_data"), F.col("block_comment"), "block", F.col("content"))
    surface = t["surfaces"].join(joined(block, [*keys, "surface_no"], "block_no", text, "\n", "content"), [*keys, "surface_no"], "left")
    text = _headed(F.col("surface_type"), F.col("surface_data"), F.col("surface_comment"), "surface", F.col("content"))
    return joined(surface, keys, "surface_no", text, "\n", "content")


def corpus_code(t: dict[str, DataFrame], characters: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sign rows of a corpus as the serializer takes them: what is not encoded stands as written, signs of several parts in pipes."""
    keys = keys or ["transliteration_id"]
    one = r"\(?[A-ZĜḪŘŠṢṬ]+[0-9]*(?:@(?:[gštvzn]|90|180))*\)?"
    piped = F.regexp_replace("custom_value", rf"^({one}(?:[×.%&@+]{one})+)(?=\(|$)", "|$1|")
    custom = F.when(F.col("type") == "sign", piped).otherwise(F.col("custom_value"))
    c = characters.select(F.col("sign_variant_id").alias("_v"), F.col("value_id").alias("_r"), "print")
    rows = t["corpus"].join(c, (F.col("sign_variant_id") == F.col("_v")) & F.col("value_id").eqNullSafe(F.col("_r")), "left").drop("_v", "_r")
    rows = rows.join(t["words"], [*keys, "word_no"], "left").join(t["compounds"], [*keys, "compound_no"], "left").join(t["sections"].drop("composition_id"), [*keys, "section_no"], "left")
    return rows.withColumn("value", F.coalesce("print", custom))


def serialize(t: dict[str, DataFrame], characters: DataFrame) -> DataFrame:
    """transliteration_id, content."""
    keys = ["transliteration_id"]
    return documents(corpus_code(t, characters, keys), t, keys)


def in_range(rows: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """keys, line_no, content of the signs from low to high alone."""
    return lines(rows.where(F.col("sign_no").between(low, high)), keys)
