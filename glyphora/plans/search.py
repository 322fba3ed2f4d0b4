"""Patterns -> joins over a search relation.

The relation has one row per sign (and per component, where there are any): key column(s), sign_no, pos, next_pos,
word_no, compound_no, line_no and what the leaves' conditions need. It is read once: the rows that any leaf stands for are
marked with the leaves that they match, and written. Each branch of a pattern is a chain of joins of these few rows on
the text's key; adjacency is an equi-join of next_pos to pos, and same word, compound or line are equi-joins as well. A break at an
end of the pattern is a condition on the first or last sign, so it needs no join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphora.functions.position import sorted_distinct
from glyphora.plans.pattern import Branch, Leaf, branches, parse
from glyphora.sources.store import materialized

_NUMBERS = ["sign_no", "pos", "next_pos", "word_no", "compound_no", "line_no"]
_BREAKS = {"other_word": "word", "other_compound": "compound", "other_line": "line"}


@dataclass(frozen=True)
class Lookup:
    """Rows that a leaf stands for: those whose columns are in a table of distinct rows, and meet a condition."""

    table: DataFrame
    also: Column


def with_edges(relation: DataFrame, keys: list[str]) -> DataFrame:
    """The relation with starts_word, starts_compound, starts_line and ends_… (booleans): whether the sign before or after is in another one, or there is none."""
    before, after = (Window.partitionBy(*keys).orderBy("sign_no").rangeBetween(n, n) for n in (-1, 1))
    other = lambda c, w: F.coalesce(F.max(c).over(w) != F.col(c), F.lit(True))
    return relation.withColumns({f"{side}_{n}": other(f"{n}_no", w) for n in _BREAKS.values() for side, w in (("starts", before), ("ends", after))})


def _place(branch: Branch) -> tuple[list[int], dict[int, frozenset[str]]]:
    """A branch's leaves that are signs, and the columns that must be true at the first and last of them."""
    own = [k for k, leaf in enumerate(branch.leaves) if leaf.kind != "edge"]
    must: dict[int, frozenset[str]] = {}
    for at, edge, sep, side in ((own[0], 0, 0, "starts"), (own[-1], -1, -1, "ends")):
        if branch.leaves[edge].kind == "edge":
            must[at] = must.get(at, frozenset()) | {f"{side}_{_BREAKS[b]}" for b in branch.between[sep] if b in _BREAKS}
    return own, must


def _marked(relation: DataFrame, wanted: list[tuple[Leaf, frozenset[str]]], condition: Callable[[Leaf], Column | Lookup], kept: list[str]) -> DataFrame:
    """Rows that match any wanted leaf, and m0, m1, …: whether they match that one."""
    marks = {}
    joined: dict[int, tuple[int, DataFrame]] = {}  # tables that are joined already
    for n, (leaf, must) in enumerate(wanted):
        is_it = condition(leaf)
        if isinstance(is_it, Lookup):
            if id(is_it.table) not in joined:
                joined[id(is_it.table)] = n, is_it.table
                on = is_it.table.columns
                found = is_it.table.select(*[F.col(c).alias(f"_{n}_{c}") for c in on], F.lit(True).alias(f"_{n}"))
                relation = relation.join(found, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{n}_{c}") for c in on]), "left")
            is_it = F.col(f"_{joined[id(is_it.table)][0]}").isNotNull() & is_it.also
        start = F.col("pos") == F.shiftleft(F.col("sign_no").cast("long"), 7)
        end = F.col("next_pos") == F.shiftleft(F.col("sign_no").cast("long") + 1, 7)
        for c in sorted(must):
            is_it = is_it & F.col(c) & (start if c.startswith("starts") else end)
        marks[f"m{n}"] = F.coalesce(is_it, F.lit(False))
    rows = relation.where(reduce(lambda a, b: a | b, marks.values()))
    return rows.select(*kept, *[m.alias(name) for name, m in marks.items()])


def _branch(rows: DataFrame, branch: Branch, keys: list[str], marks: list[str], show: str | None) -> DataFrame:
    own = _place(branch)[0]
    numbered = [*_NUMBERS, *([show] if show else [])]
    out = None
    for mark, k in zip(marks, own, strict=True):
        one = rows.where(mark).select(*keys, *[F.col(c).alias(f"{c}{k}") for c in numbered])
        if out is None:
            out = one
            continue
        sep, a = branch.between[k - 1], k - 1
        one = one.withColumnsRenamed({c: f"_{c}" for c in keys})
        on = [out[c] == one[f"_{c}"] for c in keys]
        on.append(out[f"pos{a}"] < one[f"pos{k}"] if "later" in sep else out[f"next_pos{a}"] == one[f"pos{k}"])
        for name, column in (("word", "word_no"), ("compound", "compound_no")):
            if name in sep:
                on.append(out[f"{column}{a}"] == one[f"{column}{k}"])
        for name, column in _BREAKS.items():
            if name in sep:
                on.append(out[f"{column}_no{a}"] != one[f"{column}_no{k}"])
        for line in branch.lines:
            if k in line and line[0] < k:
                on.append(out[f"line_no{line[0]}"] == one[f"line_no{k}"])
        out = out.join(one, reduce(lambda x, y: x & y, on)).drop(*[f"_{c}" for c in keys])
    numbers = lambda column, ks: sorted_distinct(F.array(*[F.col(f"{column}{k}") for k in ks]))
    pairs = [x for c, ks in branch.captures for x in (F.lit(c), numbers("sign_no", ks))]
    captures = F.create_map(*pairs) if pairs else F.lit(None)
    shown = [F.array(*[F.col(f"{show}{k}") for k in own]).alias("shown")] if show else []
    found = [numbers(c, own).alias(name) for c, name in (("sign_no", "signs"), ("word_no", "words"), ("line_no", "lines"))]
    return out.select(*keys, *found, captures.cast("map<int,array<int>>").alias("captures"), *shown)


def matches(relation: DataFrame, found: list[Branch], keys: list[str], condition: Callable[[Leaf], Column | Lookup], show: str | None = None, names: list[str] | None = None) -> DataFrame:
    """keys; signs, words, lines: sorted distinct numbers of a match; captures: map of capture number -> sign numbers; shown: the column `show` of each leaf.

    A way to match that two branches share comes once for each. names, one a branch, are given as the column pattern: many patterns read the relation once.
    """
    if any(leaf.kind == "edge" for b in found for leaf in b.leaves) and "starts_word" not in relation.columns:
        relation = with_edges(relation, keys)
    wanted: dict[tuple[Leaf, frozenset[str]], str] = {}
    marks = []
    for b in found:
        own, must = _place(b)
        marks.append([wanted.setdefault((b.leaves[k], must.get(k, frozenset())), f"m{len(wanted)}") for k in own])
    rows = _marked(relation, list(wanted), condition, [*keys, *_NUMBERS, *([show] if show else [])])
    if sum(map(len, marks)) > 1:
        rows = materialized(rows, "candidates")
    ways = [_branch(rows, b, keys, m, show) for b, m in zip(found, marks, strict=True)]
    return reduce(DataFrame.unionByName, ways if names is None else [w.select(F.lit(n).alias("pattern"), "*") for n, w in zip(names, ways, strict=True)])


def search(relation: DataFrame, text: str, condition: Callable[[Leaf], Column | Lookup], keys: list[str] | None = None, aliases: bool = True, show: str | None = None) -> DataFrame:
    """`matches` of a pattern. condition: the relation's rows that a leaf stands for."""
    return matches(relation, branches(parse(text, aliases)), keys or ["tid"], condition, show)


def filtered(matches: DataFrame, texts: DataFrame, keys: list[str] | None = None, **chosen: list) -> DataFrame:
    """Matches in texts whose columns have one of the chosen values; an empty list doesn't filter."""
    for column, values in chosen.items():
        if values:
            texts = texts.where(F.col(column).isin(values))
    return matches.join(texts, keys or ["tid"])
