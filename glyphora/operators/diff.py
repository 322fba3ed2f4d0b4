"""Differences of two versions line by line, set-wise changes of keyed rows, and overlaps of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphora.operators.signlist import joined, ordered


def changed_lines(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, new (keys, line_no, text) -> keys, line_no_start, line_no_end, old, new: runs of neighbouring lines that differ, joined by ` / `.

    A line that only one version has differs.
    """
    both = old.withColumnRenamed("text", "_old").join(new.withColumnRenamed("text", "_new"), [*keys, "line_no"], "full")
    rows = both.where(~F.col("_old").eqNullSafe(F.col("_new")))
    own = Window.partitionBy(*keys).orderBy("line_no")
    rows = rows.withColumn("_run", F.col("line_no") - F.row_number().over(own))
    o = F.col("line_no")
    out = rows.groupBy(*keys, "_run").agg(
        F.min("line_no").alias("line_no_start"), F.max("line_no").alias("line_no_end"), joined(ordered(F.col("_old"), o), " / ").alias("old"), joined(ordered(F.col("_new"), o), " / ").alias("new")
    )
    return out.drop("_run")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts of old with those of new added; keys of either."""
    both = old.select(*keys, F.col(value).alias("_old")).join(new.select(*keys, F.col(value).alias("_new")), keys, "full")
    return both.select(*keys, (F.coalesce("_old", F.lit(0)) + F.coalesce("_new", F.lit(0))).alias(value))


def overlaps(matches: DataFrame, keys: list[str], signs: str = "signs") -> DataFrame:
    """matches with overlap: whether another match of the text shares a sign. Matches are told apart by their signs."""
    each = matches.select(*keys, signs).distinct().select(*keys, signs, F.explode(signs).alias("_sign"))
    shared = each.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "_sign")))
    flags = shared.groupBy(*keys, signs).agg((F.max("_n") > 1).alias("overlap"))
    return matches.join(flags, [*keys, signs])


def renumbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their place, from 0, in order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
