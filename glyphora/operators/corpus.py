"""Ingest of transliteration code into the seven tables of a corpus, and encoding of its signs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphora.functions.code import read
from glyphora.operators import encoder

# What the reader gives of each table.
_PARSED = {
    "surfaces": "surface_type string, surface_data string, surface_comment string",
    "blocks": "surface_no int, block_type string, block_data string, block_comment string",
    "lines": "block_no int, line string, line_comment string",
    "sections": "section_name string",
    "compounds": "pn_type string, language string, section_no int, compound_comment string",
    "words": "compound_no int, capitalized boolean",
    "signs": (
        "line_no int, word_no int, value string, sign_spec string, type string, indicator_type string, phonographic boolean, stem boolean, condition string, "
        "crits string, comment string, newline boolean, inverted boolean, ligature boolean"
    ),
    "errors": "line int, col int, symbol string, message string",
}
_NUMBERS = {"surfaces": "surface_no", "blocks": "block_no", "lines": "line_no", "sections": "section_no", "compounds": "compound_no", "words": "word_no", "signs": "sign_no"}


def _struct(ddl: str) -> str:
    return "struct<" + ", ".join(":".join(f.split(" ")) for f in ddl.split(", ")) + ">"


def _document(code: str) -> dict:
    doc, out = read(code or ""), {}
    for name, ddl in _PARSED.items():
        columns = [f.split(" ")[0] for f in ddl.split(", ")]
        rows = getattr(doc, name)
        out[name] = [{c: r[c] for c in columns} if isinstance(r, dict) else dict(zip(columns, r, strict=True)) for r in rows]
    return out


def parse(codes: DataFrame, key: str = "transliteration_id") -> DataFrame:
    """codes (key, code) -> one row each with an array of rows per table. Write it before using several of them: each use reads the code again."""
    ddl = f"{key} {dict(codes.dtypes)[key]}, " + ", ".join(f"{n} array<{_struct(d)}>" for n, d in _PARSED.items())

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_document(c) for c in batch["code"]]
            yield pd.DataFrame({key: batch[key], **{n: [r[n] for r in rows] for n in _PARSED}})

    return codes.select(key, "code").mapInPandas(kernel, ddl)


def exploded(parsed: DataFrame, name: str, key: str = "transliteration_id") -> DataFrame:
    """One table of parsed documents, with its ordinal."""
    if name == "errors":
        return parsed.select(key, F.explode(name).alias("x")).select(key, "x.*")
    return parsed.select(key, F.posexplode(name).alias(_NUMBERS[name], "x")).select(key, _NUMBERS[name], "x.*")


def ingest(parsed: DataFrame, signlist: dict[str, DataFrame], compositions: DataFrame | None = None) -> dict[str, DataFrame]:
    """parsed documents, sign list (sign_map, values_encoded, signs_encoded) -> the seven tables, unencoded and errors.

    Signs that can't be encoded keep what was written as custom_value and are listed in unencoded.
    """
    key = "transliteration_id"
    t = {n: exploded(parsed, n) for n in ("surfaces", "blocks", "lines", "compounds", "words", "errors")}
    sections = exploded(parsed, "sections")
    if compositions is None:
        t["sections"] = sections.withColumn("composition_id", F.lit(None).cast("int"))
    else:
        t["sections"] = sections.join(compositions.select("composition_id", F.col("composition_name").alias("section_name")), "section_name", "left").select(key, "section_no", "section_name", "composition_id")
    signs = exploded(parsed, "signs")
    codes = encoder.encode(signs.select(key, "sign_no", "value", "sign_spec", "type"), [key, "sign_no"], signlist["sign_map"], signlist["values_encoded"], signlist["signs_encoded"]).drop("type")
    rows = signs.join(codes, [key, "sign_no"], "left")
    custom = F.when(F.col("sign_variant_id").isNull(), F.concat("value", F.coalesce(F.concat(F.lit("("), "sign_spec", F.lit(")")), F.lit(""))))
    t["corpus"] = rows.select(
        key, "sign_no", "line_no", "word_no", "value_id", "sign_variant_id", custom.alias("custom_value"), "type", "indicator_type", "phonographic", "stem", "condition", "crits", "comment", "newline", "inverted", "ligature"
    )
    t["unencoded"] = rows.where("sign_variant_id is null and type in ('value', 'sign')").select(key, "sign_no", "value", "sign_spec", "type")
    return t


def encode_corpus(corpus: DataFrame, signlist: dict[str, DataFrame]) -> DataFrame:
    """corpus with ids for custom values that the sign list knows by now."""
    keys = ["transliteration_id", "sign_no"]
    codes = encoder.encode(encoder.split_custom(corpus, keys), keys, signlist["sign_map"], signlist["values_encoded"], signlist["signs_encoded"])
    codes = codes.select(*keys, F.col("value_id").alias("_r"), F.col("sign_variant_id").alias("_v"))
    rows = corpus.join(codes, keys, "left")
    new = F.col("_v").isNotNull()
    return rows.withColumns(
        {"value_id": F.when(new, F.col("_r")).otherwise(F.col("value_id")), "sign_variant_id": F.coalesce("_v", "sign_variant_id"), "custom_value": F.when(~new, F.col("custom_value"))}
    ).drop("_r", "_v")


def unencode_corpus(corpus: DataFrame, characters: DataFrame) -> DataFrame:
    """corpus with all encoded signs written out as custom values."""
    c = characters.select(F.col("sign_variant_id").alias("_v"), F.col("value_id").alias("_r"), "print")
    rows = corpus.join(c, (F.col("sign_variant_id") == F.col("_v")) & F.col("value_id").eqNullSafe(F.col("_r")), "left")
    written = F.coalesce(F.regexp_replace("print", r"\|", ""), F.col("custom_value"))
    return rows.withColumns({"custom_value": written, "value_id": F.lit(None).cast("int"), "sign_variant_id": F.lit(None).cast("int")}).drop("_v", "_r", "print")
