"""Serializer to HTML: nested spans per attribute, opened and closed where an attribute changes between signs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphora.functions import signtree
from glyphora.operators import serialize
from glyphora.operators.serialize import FIELDS, _bracket, _pick, joined
from glyphora.operators.signlist import Tables

# Attributes from outermost to innermost, their weights, and class names.
WEIGHTS = {"language": 128, "pn_type": 64, "stem": 32, "highlight": 16, "phonographic": 8, "type": 4, "indicator": 2, "condition": 1}
LANGUAGES = {"akkadian": "akkadian", "hittite": "hittite", "eblaite": "eblaite"}
TYPES = {"number": "number", "description": "description", "damage": "damage", "sign": "unknown_reading"}
PLACEHOLDERS = {"number": "N", "description": "DESC", "punctuation": "|", "damage": "…"}
SPACES = [("||", "hspace"), ("=", "vspace"), ("|", "hline"), ("–", "vline")]


def _extra_weights(extra: tuple[str, ...]) -> list[int]:
    """Weights of extra attributes, outside all others, the first outermost."""
    return [2 * WEIGHTS["language"] << (len(extra) - 1 - k) for k in range(len(extra))]


def _classes(s: Column, condition: Column, extra: tuple[str, ...]) -> list[tuple[int, Column]]:
    """(weight, class or null) of each span, outermost first."""
    none = F.lit(None).cast("string")
    language = F.when(s["language"].isNotNull(), F.when(s["language"].isin(*LANGUAGES), s["language"]).otherwise("otherlanguage"))
    kind = F.when(s["type"].isin(*TYPES), _pick(s["type"], TYPES))
    return [
        *((w, F.concat(F.lit(f"extra{k}-"), s[c].cast("string"))) for k, (w, c) in enumerate(zip(_extra_weights(extra), extra, strict=True))),
        (WEIGHTS["language"], language),
        (WEIGHTS["stem"], F.when(s["stem"], "stem")),
        (WEIGHTS["highlight"], F.when(s["highlight"], "highlight")),
        (WEIGHTS["phonographic"], F.when(s["phonographic"], "phonographic").when(~s["phonographic"], "logographic")),
        (WEIGHTS["type"], kind),
        (WEIGHTS["indicator"], F.when(s["indicator_type"] != "none", "indicator")),
        (WEIGHTS["condition"], F.when(condition != "intact", condition).otherwise(none)),
    ]


def _change(a: Column, b: Column, a_end: Column, b_start: Column, extra: tuple[str, ...]) -> Column:
    """Weight of the outermost attribute that differs; above all where a line ends or a text begins or ends."""
    differs = lambda c: ~a[c].eqNullSafe(b[c])
    word = a["word_no"] != b["word_no"]
    cases = [
        *((differs(c), w) for w, c in zip(_extra_weights(extra), extra, strict=True)),
        (differs("language"), 128),
        (differs("pn_type") | word, 64),
        (differs("stem") | (F.coalesce(a["stem"], F.lit(False)) & word), 32),
        (differs("highlight"), 16),
        (differs("phonographic"), 8),
        (differs("type"), 4),
        (differs("indicator_type"), 2),
        (a_end != b_start, 1),
    ]
    out = F.lit(0)
    for test, weight in reversed(cases):
        out = F.when(test, weight).otherwise(out)
    return F.when(a.isNull() | b.isNull() | (a["line_no"] != b["line_no"]), 1 << 30).otherwise(out)


def _fragment(x: Column, extra: tuple[str, ...]) -> Column:
    p, s, n = x["_p"], x["_s"], x["_n"]
    first, last = p.isNull(), n.isNull()
    blank = F.lit("")
    mark = lambda kind, c: F.when(c != "intact", F.concat(F.lit(f"<span class='{kind}-"), c, F.lit("'></span>"))).otherwise(blank)
    before, after = _change(p, s, x["_p_end"], x["_start"], extra), _change(s, n, x["_end"], x["_n_start"], extra)
    opened = [F.when((before >= w) & c.isNotNull(), F.concat(F.lit("<span class='"), c, F.lit("'>"))).otherwise(blank) for w, c in _classes(s, x["_start"], extra)]
    closed = [F.when((after >= w) & c.isNotNull(), F.lit("</span>")).otherwise(blank) for w, c in reversed(_classes(s, x["_end"], extra))]
    value = F.coalesce(x["value"], blank)
    capital = F.concat(F.upper(F.substring(value, 1, 1)), F.substring(value, 2, 1_000_000))
    text = F.when(F.coalesce(x["_capital"], F.lit(False)), capital).otherwise(value)
    for sign, kind in reversed(SPACES):
        text = F.when(value.startswith(sign), F.lit(f"<span class='{kind}'></span>")).otherwise(text)
    wrap = lambda kind, c: F.coalesce(F.concat(F.lit(f"<span class='{kind}'>"), c, F.lit("</span>")), blank)
    remark = F.when((last | (n["compound_no"] != s["compound_no"])) & (F.coalesce(F.length(s["compound_comment"]), F.lit(0)) > 0), F.concat(F.lit(" "), wrap("word-comment", s["compound_comment"]))).otherwise(blank)
    return F.concat(
        F.when(s["newline"], "<br class='internal-linebreak'>").otherwise(blank),
        F.when(first | (x["_p_end"] != x["_start"]) | (p["line_no"] != s["line_no"]), mark("open", x["_start"])).otherwise(blank),
        *opened,
        text,
        wrap("critics", F.nullif(x["crits"], F.lit(""))),
        wrap("comment", F.nullif(x["comment"], F.lit(""))),
        remark,
        *closed,
        F.when(last | (x["_end"] != x["_n_start"]) | (s["line_no"] != n["line_no"]), mark("close", x["_end"])).otherwise(blank),
        _connector(s, n),
    )


def _connector(s: Column, n: Column) -> Column:
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
    plain = _pick(side, {"L": ".", "D": ".", "N": ".", "P": "-", "S": "-", "W": "–", "C": " ", "M": "<span class='indicator'>.</span>"})
    inverted = F.when(side == "W", "—:").when(side == "C", " : ").when(side == "M", "<span class='indicator'>:</span>").otherwise(":")
    return (
        F.when(n.isNull(), "")
        .when(n["sign_no"] != s["sign_no"] + 1, F.concat(plain, F.lit("…"), plain))
        .when(n["inverted"], inverted)
        .when(n["newline"], F.when(side.isin("C", "L", "P", "M", "0"), "").otherwise(plain))
        .when(n["ligature"], F.when(side == "M", "<span class='indicator'>+</span>").otherwise("+"))
        .when(n["line_no"] != s["line_no"], F.when(side.isin("C", "L", "P", "M", "0"), "").otherwise(plain))
        .otherwise(plain)
    )


def lines(rows: DataFrame, keys: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """keys, line_no, line: HTML of each line. rows as for the code serializer, with highlight boolean if signs are to be highlighted.

    extra: integer columns of rows; a run of signs with one value v of the k-th of them is in a span of class extra<k>-<v>, the first outermost. A change of one
    ends all spans within it.
    """
    if "highlight" not in rows.columns:
        rows = rows.withColumn("highlight", F.lit(False))
    own = Window.partitionBy(*keys).orderBy("sign_no")
    start, end = _bracket(F.col("value"), F.col("condition"))
    plain = F.col("indicator_type") == "none"
    earlier = F.max(plain.cast("int")).over(Window.partitionBy(*keys, "word_no").orderBy("sign_no").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_s": F.struct(*FIELDS, "highlight", *extra), "_start": start, "_end": end, "_capital": F.col("capitalized") & plain & (F.coalesce(earlier, F.lit(0)) == 0)})
    rows = rows.withColumns({"_p": F.lag("_s").over(own), "_p_end": F.lag("_end").over(own), "_n": F.lead("_s").over(own), "_n_start": F.lead("_start").over(own)})
    parts = ["_p", "_p_end", "_s", "_start", "_end", "_n", "_n_start", "_capital", "value", "crits", "comment"]
    text = F.get(F.transform(F.array(F.struct(*parts)), lambda x: _fragment(x, extra)), F.lit(0))
    return joined(rows.select(*keys, "line_no", "sign_no", text.alias("t")), [*keys, "line_no"], "sign_no", F.col("t"), "", "line")


def value_html(value: Column) -> Column:
    """A reading with its index apart."""
    return F.regexp_replace(value, r"(?<=[^0-9x])([0-9x]+)$", "<span class='index'>$1</span>")


def placeholder(kind: Column, html: bool = True) -> Column:
    """What stands for a sign that isn't encoded."""
    text = F.when(kind.isin(*PLACEHOLDERS), _pick(kind, PLACEHOLDERS)).otherwise("X")
    text = F.when(kind.isNotNull(), text)
    return F.concat(F.lit('<span class="placeholder">'), text, F.lit("</span>")) if html else text


def characters(t: Tables, composed: DataFrame) -> DataFrame:
    """sign_variant_id, value_id (null: the sign without a reading), print: as HTML."""
    kind = F.col("variant_type")
    shown = composed.withColumns({"g": signtree.html_column(F.col("graphemes")), "c": signtree.html_column(F.col("glyphs"))})
    wrap = lambda x: F.concat(F.lit("<span class='signspec'>"), x, F.lit("</span>"))
    spec = F.when(kind == "default", wrap(F.col("g"))).when(kind == "nondefault", wrap(F.col("c"))).otherwise(F.concat(F.lit("<span class='critic'>!</span>"), wrap(F.col("c"))))
    main = t["value_variants"].join(t["values"], F.col("value_variant_id") == F.col("main_variant_id")).select(t["values"]["value_id"], "sign_id", "value")
    read = main.join(shown.select("sign_id", "sign_variant_id", "g", "c", "variant_type"), "sign_id")
    read = read.select("sign_variant_id", "value_id", F.when((kind == "default") & ~F.col("value").contains("x"), value_html(F.col("value"))).otherwise(F.concat(value_html(F.col("value")), spec)).alias("print"))
    unknown = lambda c: F.concat(F.lit("<span class='unknown_value'>"), c, F.lit("</span>"))
    plain = shown.where(kind == "default").select("sign_id", unknown(F.col("g")).alias("plain"))
    bare = shown.join(plain, "sign_id", "left")
    bare = bare.select("sign_variant_id", F.lit(None).cast("int").alias("value_id"), F.when(kind == "default", F.col("plain")).when(F.col("specific"), unknown(F.col("c"))).otherwise(F.concat("plain", spec)).alias("print"))
    return read.unionByName(bare)


def corpus_html(t: Tables, shown: DataFrame) -> DataFrame:
    """Sign rows of a corpus as `lines` takes them; shown: `characters`. What isn't encoded is printed as a number or a sign; punctuation and descriptions are not."""
    rows = serialize.corpus_code(t, shown)  # its value: print, or what is written
    kind = F.col("type")
    written = F.when(kind == "number", signtree.number_html_column(F.col("custom_value"))).when(~kind.isin("punctuation", "description"), signtree.html_column(F.col("custom_value")))
    return rows.withColumn("value", F.coalesce("print", written))


def corpus_html_clean(t: Tables, shown: DataFrame) -> DataFrame:
    """transliteration_id, value, sign_no, word_no, compound_no, type, indicator_type, phonographic, stem, language: signs without editorial marks; what isn't encoded
    is a placeholder of its type."""
    rows = serialize.corpus_code(t, shown).withColumn("value", F.coalesce("print", placeholder(F.col("type"))))
    return rows.select("transliteration_id", "value", "sign_no", "word_no", "compound_no", "type", "indicator_type", "phonographic", "stem", "language")


def in_range(rows: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """keys, line_no, line of the signs from low to high alone."""
    return lines(rows.where(F.col("sign_no").between(low, high)), keys)
