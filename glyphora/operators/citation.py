"""Citations of lines: `o. i 1–3; r. 5`, by gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cite(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines (keys, surface, surface_no, block, block_no, line, line_no), one row per cited line -> keys, citation.

    Consecutive line numbers are one range. A range names its surface and block only where they differ from the one
    before; if block or surface changes within a range, its end names what changed and ` – ` joins both.
    """
    own = Window.partitionBy(*keys).orderBy("line_no")
    rows = lines.withColumn("_island", F.col("line_no") - F.row_number().over(own))
    place = F.struct("line_no", "surface", "surface_no", "block", "block_no", "line")
    ranges = rows.groupBy(*keys, "_island").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    turn = Window.partitionBy(*keys).orderBy("_island")
    ranges = ranges.withColumn("p", F.lag("b").over(turn))

    def name(x: str, before: str | None):
        new_surface = ~F.col(f"{x}.surface_no").eqNullSafe(F.col(f"{before}.surface_no"))
        new_block = new_surface | ~F.col(f"{x}.block_no").eqNullSafe(F.col(f"{before}.block_no"))
        part = lambda show, c: F.when(show & (F.coalesce(F.col(f"{x}.{c}"), F.lit("")) != ""), F.concat(F.col(f"{x}.{c}"), F.lit(" "))).otherwise("")
        return F.concat(part(new_surface, "surface"), part(new_block, "block"), F.col(f"{x}.line"))

    apart = (F.col("a.surface_no") != F.col("b.surface_no")) | (F.col("a.block_no") != F.col("b.block_no"))
    end = F.when(F.col("a.line_no") == F.col("b.line_no"), "").otherwise(F.concat(F.when(apart, " – ").otherwise("–"), name("b", "a")))
    ranges = ranges.withColumn("_text", F.concat(name("a", "p"), end))
    return ranges.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_island", "_text"))), lambda x: x["_text"]), "; ").alias("citation"))


def extended(texts: DataFrame) -> DataFrame:
    """texts (text_id, ensemble_id, citation, object_type) -> text_id, extended_citation: with the object's type if its ensemble has more texts."""
    n = F.count("*").over(Window.partitionBy("ensemble_id"))
    return texts.withColumn("_n", n).select("text_id", F.when(F.col("_n") > 1, F.concat_ws(" ", "citation", "object_type")).otherwise(F.col("citation")).alias("extended_citation"))
