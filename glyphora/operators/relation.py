"""The search relation of a corpus: rows of components, of signs, and pseudo rows at both ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphora.functions import position

_NUMBERS = ["word_no", "compound_no", "line_no"]


def search_relation(signs: DataFrame, components: DataFrame, keys: list[str]) -> DataFrame:
    """signs (keys, sign_no, word_no, compound_no, line_no, more), components (keys, sign_no, component_no from 0, more) ->
    keys, sign_no, position, word_no, compound_no, line_no and the columns of both.

    Five kinds of rows: each component; each sign; one before the first and one after the last sign, without sign_no;
    and one of nulls, which stands for parts of a pattern that a match doesn't use. Positions number signs from 1.
    """
    own = [c for c in signs.columns if c not in (*keys, "sign_no", *_NUMBERS)]
    parts = [c for c in components.columns if c not in (*keys, "sign_no", "component_no")]
    types = dict(signs.dtypes) | dict(components.dtypes)
    null = lambda names: [F.lit(None).cast(types[c]).alias(c) for c in names]
    at = lambda sign, k, final: position.pack(sign, k, final).alias("position")
    final = F.row_number().over(Window.partitionBy(*keys, "sign_no").orderBy(F.desc("component_no"))) == 1
    by_part = components.withColumn("_final", final).join(signs.drop(*own), [*keys, "sign_no"])
    rows = [
        by_part.select(*keys, "sign_no", at(F.col("sign_no") + 1, F.col("component_no"), F.col("_final")), *_NUMBERS, *null(own), *parts),
        signs.select(*keys, "sign_no", at(F.col("sign_no") + 1, F.lit(0), F.lit(True)), *_NUMBERS, *own, *null(parts)),
    ]
    ends = signs.groupBy(*keys).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("sign_no", *_NUMBERS) for f in (F.min, F.max)])

    def pseudo(f: str, step: int, sign: Column) -> DataFrame:
        numbers = [(F.col(f"{f}_{c}") + step).alias(c) for c in _NUMBERS]
        return ends.select(*keys, F.lit(None).cast(types["sign_no"]).alias("sign_no"), at(sign, F.lit(0), F.lit(True)), *numbers, *null(own), *null(parts))

    rows += [pseudo("min", -1, F.col("min_sign_no")), pseudo("max", 1, F.col("max_sign_no") + 2)]
    rows.append(ends.select(*keys, *null(["sign_no"]), F.lit(None).cast("long").alias("position"), *null(_NUMBERS), *null(own), *null(parts)))
    return reduce(DataFrame.unionByName, rows)
