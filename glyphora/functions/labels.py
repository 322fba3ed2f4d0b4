"""Names of surfaces and blocks in citations, and placeholders of signs without a reading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short and long names of surfaces; placeholders by sign type.
SURFACES = {
    "obverse": ("o.", "obverse"),
    "reverse": ("r.", "reverse"),
    "top": ("u.e.", "upper edge"),
    "bottom": ("lo.e.", "lower edge"),
    "left": ("l.e.", "left edge"),
    "right": ("r.e.", "right edge"),
}
ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def _choice(value: Column, names: dict, rest: Column) -> Column:
    return reduce(lambda other, k: F.when(value == k, F.lit(names[k])).otherwise(other), reversed(list(names)), rest)


def roman(number: Column) -> Column:
    """Lower-case roman numeral of a positive whole number below 4000."""
    start = F.struct(number.cast("int").alias("n"), F.lit("").alias("s"))
    table = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(r).alias("r")) for v, r in ROMAN])
    return F.aggregate(
        table, start, lambda a, x: F.struct((a["n"] % x["v"]).cast("int").alias("n"), F.concat(a["s"], F.repeat(x["r"], F.floor(a["n"] / x["v"]).cast("int"))).alias("s")), lambda a: a["s"]
    )


def romanized(text: Column) -> Column:
    """text with each run of digits as a roman numeral."""
    digits = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1)
    return F.when(text.isNotNull(), F.array_join(F.transform(digits, lambda x: F.when(x.rlike(r"^\d"), roman(x.try_cast("int"))).otherwise(x)), ""))


def _typed(kind: Column, data: Column) -> Column:
    return F.concat(kind, F.coalesce(F.concat(F.lit(" "), data), F.lit("")))


def surface_short(kind: Column, data: Column) -> Column:
    return _choice(kind, {k: v[0] for k, v in SURFACES.items()}, F.when(kind == "surface", F.coalesce(data, F.lit(""))).otherwise(_typed(kind, data)))


def surface_long(kind: Column, data: Column, comment: Column) -> Column:
    name = _choice(kind, {k: v[1] for k, v in SURFACES.items()}, F.when(kind == "surface", F.coalesce(data, F.lit(""))).otherwise(_typed(kind, data)))
    return F.concat(name, F.coalesce(comment, F.lit("")))


def block_short(kind: Column, data: Column) -> Column:
    return F.when(kind.isin("column", "summary"), romanized(data)).when(kind == "block", F.coalesce(data, F.lit(""))).otherwise(_typed(kind, data))


def block_long(kind: Column, data: Column, comment: Column) -> Column:
    return F.concat(block_short(kind, data), F.coalesce(comment, F.lit("")))
