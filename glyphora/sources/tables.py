"""Sources and sinks: CSV tables with fixed schemas, Parquet tables, and single transliterations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from glyphora.schemas import KEYS, PARENTS, schema

# Tables of each group.
GROUPS = {
    "signlist": ["glyphs", "glyph_synonyms", "graphemes", "allographs", "allomorphs", "allomorph_components", "sign_variants", "values", "value_variants", "glyph_values"],
    "context": ["objects", "object_subtypes", "genres", "periods", "proveniences"],
    "corpus": ["corpora", "ensembles", "compositions", "texts", "transliterations", *KEYS],
    "log": ["edits", "edit_log"],
    "pns": ["pns", "pn_variants"],
}


def read_csv(spark: SparkSession, path: str, kind: StructType) -> DataFrame:
    r"""A headerless CSV with \N for null. Ranges are `[lo,hi)` text; arrays JSON text, or as a database writes them: `{1,2}`, and with rows, `{"(0,7,,t)","(1,8,,f)"}`."""
    flat = StructType.fromDDL(", ".join(f"`{f.name}` {'string' if isinstance(f.dataType, ArrayType | StructType) else f.dataType.simpleString()}" for f in kind.fields))
    rows = spark.read.csv(path, schema=flat, nullValue="\\N", header=False, escape='"')
    return rows.select(*[_parsed(f).alias(f.name) for f in kind.fields])


def composite_array(c: Column, kind: ArrayType) -> Column:
    """An array as a database writes it, `{1,NULL}`, or of rows, `{"(0,7,,\\"left\\",t)"}`: fields in their order, nothing for null, t and f for booleans."""
    inner = F.regexp_extract(c, r"^\s*\{(.*)\}\s*$", 1)
    if not isinstance(kind.elementType, StructType):
        items = F.filter(F.split(inner, ","), lambda x: x != "")
        return F.transform(items, lambda x: F.when(F.upper(F.trim(x)) != "NULL", F.trim(x, F.lit('"'))).cast(kind.elementType))

    def field(x: Column, f) -> Column:
        return F.when(x != "", x == "t").cast("boolean") if f.dataType.simpleString() == "boolean" else F.when(x != "", x).cast(f.dataType)

    rows = F.regexp_extract_all(F.regexp_replace(inner, r'[\\"]', ""), F.lit(r"\(([^()]*)\)"), 1)
    return F.transform(rows, lambda r: F.struct(*[field(F.get(F.split(r, ",", -1), F.lit(k)), f).alias(f.name) for k, f in enumerate(kind.elementType.fields)]))


def _parsed(field):
    c = F.col(field.name)
    if isinstance(field.dataType, ArrayType):
        return F.when(c.startswith("{"), composite_array(c, field.dataType)).otherwise(F.from_json(c, field.dataType))
    if isinstance(field.dataType, StructType):
        lo, hi = (F.regexp_extract(c, r"(-?\d+)\s*,\s*(-?\d+)", k).try_cast("int") for k in (1, 2))
        lo, hi = F.when(c.startswith("("), lo + 1).otherwise(lo), F.when(c.endswith(")"), hi - 1).otherwise(hi)
        return F.when(c.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))
    return c


def load(spark: SparkSession, path: str, group: str) -> dict[str, DataFrame]:
    """All tables of a group from `path/<table>.csv`. The sign list's signs are those of its allomorphs."""
    out = {name: read_csv(spark, f"{path}/{name}.csv", schema(name)) for name in GROUPS[group]}
    if group == "signlist":
        out["signs"] = out["allomorphs"].select("sign_id").distinct()
    return out


def save(tables: dict[str, DataFrame], path: str, key: str | None = "transliteration_id") -> None:
    """Parquet tables; those with the key are sorted by it within files, so that its statistics prune."""
    for name, df in tables.items():
        if key and key in df.columns:
            df = df.repartition(key).sortWithinPartitions(key)
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def open_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def create_corpus(spark: SparkSession) -> dict[str, DataFrame]:
    """The seven empty tables of transliterations."""
    return {name: spark.createDataFrame([], schema(name)) for name in KEYS}


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(constraint, transliteration_id, no): repeated keys and children without their parent."""
    found = []
    for name, key in KEYS.items():
        again = tables[name].groupBy("transliteration_id", F.col(key).alias("no")).count().where("count > 1")
        found.append(again.select(F.lit(f"{name} key").alias("constraint"), "transliteration_id", "no"))
    for child, column, parent in PARENTS:
        own = tables[child].where(F.col(column).isNotNull()).select("transliteration_id", F.col(column).alias("no")).distinct()
        lost = own.join(tables[parent].select("transliteration_id", F.col(KEYS[parent]).alias("no")), ["transliteration_id", "no"], "left_anti")
        found.append(lost.select(F.lit(f"{child}.{column}").alias("constraint"), "transliteration_id", "no"))
    return reduce(DataFrame.unionByName, found)


def copy_transliteration(tables: dict[str, DataFrame], transliteration_id: int, to: int | None = None) -> dict[str, DataFrame]:
    """One transliteration's rows of each table, under another id if given."""
    new = F.lit(transliteration_id if to is None else to)
    return {name: df.where(F.col("transliteration_id") == transliteration_id).withColumn("transliteration_id", new) for name, df in tables.items()}


def delete_transliteration(tables: dict[str, DataFrame], transliteration_id: int) -> dict[str, DataFrame]:
    return {name: df.where(F.col("transliteration_id") != transliteration_id) for name, df in tables.items()}
