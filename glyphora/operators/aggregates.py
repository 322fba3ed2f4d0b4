"""Merges of ordered enumerations, and aggregates that depend on an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphora.schemas import ENUMS, ordinal


def merge_variant_types(a: Column, b: Column) -> Column:
    """The type of a variant made of two parts; null if one is.

    Alike: that. Reduced or augmented with default stays so; with anything else, and with nonstandard, it is
    nonstandard; default with nondefault is nondefault.
    """
    x, y = ordinal("sign_variant_type", a), ordinal("sign_variant_type", b)
    names = F.array(*[F.lit(n) for n in ENUMS["sign_variant_type"]])
    low, high = F.least(x, y), F.greatest(x, y)
    merged = F.when(x == y, high).when((low == 0) & high.isin(2, 3), high).when(high >= 2, 4).otherwise(1)
    return F.when(a.isNotNull() & b.isNotNull(), F.get(names, merged))


def condition_merge(condition: Column) -> Column:
    """Aggregate: the condition of several signs. Alike: that; null if any other mix holds inserted or deleted; else damaged. Nulls are left out."""
    return (
        F.when(F.min(condition) == F.max(condition), F.min(condition))
        .when(F.max(condition.isin("inserted", "deleted").cast("int")) == 1, F.lit(None).cast("string"))
        .when(F.count(condition) > 0, F.lit("damaged"))
    )


def last(value: Column, *order: str) -> Column:
    """Aggregate: the value of the last row, be it null."""
    return F.max_by(F.struct(value.alias("v")), F.struct(*order))["v"]


def all_but_last(rows: DataFrame, keys: list[str], order: list[str], flag: Column, name: str) -> DataFrame:
    """keys, name: whether flag holds on every row of a group but its last; true for a single row."""
    own = Window.partitionBy(*keys)
    marked = rows.withColumns({"_n": F.count("*").over(own), "_k": F.row_number().over(own.orderBy(*order)), "_f": flag})
    return marked.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_k") < F.col("_n"), F.col("_f"))), F.lit(True)).alias(name))


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str = "run_no") -> DataFrame:
    """Adds the number, from 0, of the run of equal values (nulls alike) that a row belongs to."""
    own = Window.partitionBy(*keys).orderBy(*order)
    turn = F.when(F.row_number().over(own) == 1, 0).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(own))).cast("int"))
    return rows.withColumn("_turn", turn).withColumn(name, F.sum("_turn").over(own).cast("int")).drop("_turn")
