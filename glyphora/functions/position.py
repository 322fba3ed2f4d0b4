"""Positions in a text: sign number, component number, and whether the component is its sign's last.

Packed as sign_no * 256 + component_no * 2 + final. Comparisons ignore the final flag, so `key` (without it) is what
is compared, sorted and joined; the successor is a column, which makes adjacency an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_SIGN, MOST_COMPONENT = 9_999_999, 99


def pack(sign_no: Column, component_no: Column, final: Column) -> Column:
    """Null outside the ranges."""
    fits = sign_no.between(0, MOST_SIGN) & component_no.between(0, MOST_COMPONENT)
    return F.when(fits, F.shiftleft(sign_no.cast("long"), 8) + F.shiftleft(component_no.cast("long"), 1) + final.cast("long"))


def sign_no(p: Column) -> Column:
    return F.shiftright(p, 8).cast("int")


def component_no(p: Column) -> Column:
    return F.shiftright(p, 1).bitwiseAND(F.lit(127)).cast("int")


def is_final(p: Column) -> Column:
    return p.bitwiseAND(F.lit(1)) == 1


def key(p: Column) -> Column:
    return F.shiftright(p, 1)


def successor(p: Column) -> Column:
    """Key of the next position: the first component of the next sign after a final one, else the next component."""
    return F.when(is_final(p), F.shiftleft(F.shiftright(p, 8) + 1, 7)).otherwise(key(p) + 1)


def parse(text: Column) -> Column:
    """From `sign.component.final`."""
    part = F.split(text, r"\.")
    return pack(F.get(part, F.lit(0)).cast("long"), F.get(part, F.lit(1)).cast("long"), F.get(part, F.lit(2)) == "1")


def show(p: Column) -> Column:
    return F.concat_ws(".", sign_no(p), component_no(p), is_final(p).cast("int"))


def _sorted(positions: Column) -> Column:
    return F.transform(F.array_sort(F.transform(F.array_compact(positions), lambda p: F.struct(key(p).alias("k"), p.alias("p")))), lambda s: s["p"])


def unbroken(positions: Column) -> Column:
    """Whether an array of positions, in any order, is a chain of successors; nulls are left out, null if nothing else is there."""
    p = _sorted(positions)
    steps = F.zip_with(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: successor(a) == key(b))
    return F.when(F.size(p) > 0, F.forall(steps, lambda x: x))


def disjoint(positions: Column) -> Column:
    """Whether no position occurs twice and none lies within another whole sign."""
    p = _sorted(positions)
    same = F.size(F.array_distinct(F.transform(p, key))) == F.size(p)
    whole = lambda x: (component_no(x) == 0) & is_final(x)
    signs = F.transform(F.filter(p, whole), sign_no)
    others = F.transform(F.filter(p, lambda x: ~whole(x)), sign_no)
    return F.when(F.size(p) > 0, same & ~F.arrays_overlap(signs, others))


def sign_nos(positions: Column) -> Column:
    return sorted_distinct(F.transform(positions, sign_no))


def sorted_distinct(numbers: Column) -> Column:
    """Sorted distinct numbers without nulls; null if nothing is left."""
    out = F.array_sort(F.array_distinct(F.array_compact(numbers)))
    return F.when(F.size(out) > 0, out)
