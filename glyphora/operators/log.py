"""Folds of edit logs: where an entry ends up, which entries edits touch, and the undoing of edits.

An entry's number moves when others are inserted or deleted before it. Folds run over each group's log in order,
as native `aggregate` over a sorted array: a log belongs to one transliteration, which bounds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _log(*fields: str) -> Column:
    """Aggregate: the log as an array in order of its first field."""
    return F.array_sort(F.collect_list(F.struct(*fields)))


def moved(no: Column, action: Column, at: Column) -> Column:
    """An entry's number after an action at another: null if it is the deleted one."""
    return (
        F.when(no.isNull(), F.lit(None).cast("int"))
        .when((action == "insert") & (at <= no), no + 1)
        .when((action == "delete") & (at == no), F.lit(None).cast("int"))
        .when((action == "delete") & (at < no), no - 1)
        .otherwise(no)
    )


def moved_back(no: Column, action: Column, at: Column) -> Column:
    """An entry's number before an action: null if the action inserted it."""
    return (
        F.when(no.isNull(), F.lit(None).cast("int"))
        .when((action == "insert") & (at == no), F.lit(None).cast("int"))
        .when((action == "insert") & (at < no), no - 1)
        .when((action == "delete") & (at <= no), no + 1)
        .otherwise(no)
    )


def trace(log: DataFrame, keys: list[str], start: Column, order: str = "log_no") -> DataFrame:
    """keys, entry_no: where the entry that was at `start` is after the whole log; null if it is gone."""
    rows = log.withColumn("_start", start.cast("int")).groupBy(*keys).agg(_log(order, "action", "entry_no").alias("_log"), F.min("_start").alias("_start"))
    return rows.select(*keys, F.aggregate("_log", F.col("_start"), lambda no, x: moved(no, x["action"], x["entry_no"])).alias("entry_no"))


def trace_back(log: DataFrame, keys: list[str], start: Column, order: str = "log_no") -> DataFrame:
    """keys, entry_no: where the entry that is at `start` after the log was before it; null if the log made it."""
    rows = log.withColumn("_start", start.cast("int")).groupBy(*keys).agg(F.reverse(_log(order, "action", "entry_no")).alias("_log"), F.min("_start").alias("_start"))
    return rows.select(*keys, F.aggregate("_log", F.col("_start"), lambda no, x: moved_back(no, x["action"], x["entry_no"])).alias("entry_no"))


def affected(log: DataFrame, keys: list[str], order: str = "log_no") -> DataFrame:
    """keys, entry_nos: sorted numbers, as they are after the log, of entries that were inserted or updated and still exist."""
    rows = log.groupBy(*keys).agg(_log(order, "action", "entry_no").alias("_log"))

    def step(seen: Column, x: Column) -> Column:
        after = F.array_compact(F.transform(seen, lambda no: moved(no, x["action"], x["entry_no"])))
        return F.when(x["action"].isin("insert", "update"), F.array_union(after, F.array(x["entry_no"]))).otherwise(after)

    return rows.select(*keys, F.array_sort(F.aggregate("_log", F.array().cast("array<int>"), step)).alias("entry_nos"))


def touching(log: DataFrame, entries: DataFrame, keys: list[str], order: str = "log_no") -> DataFrame:
    """entries (keys, entry_no as after the log) -> keys, entry_no, edit_nos: distinct edits that touched the entry, the latest first.

    The log is walked from its end with the entry's number moved back at each action.
    """
    rows = log.groupBy(*keys).agg(F.reverse(_log(order, "action", "entry_no", "edit_no")).alias("_log"))
    start = F.struct(F.col("entry_no").alias("no"), F.array().cast("array<bigint>").alias("edits"))

    def step(s: Column, x: Column) -> Column:
        hit = (s["no"] == x["entry_no"]) & x["action"].isin("insert", "update")
        edits = F.when(hit, F.array_union(s["edits"], F.array(x["edit_no"].cast("bigint")))).otherwise(s["edits"])
        return F.struct(moved_back(s["no"], x["action"], x["entry_no"]).alias("no"), edits.alias("edits"))

    both = entries.join(rows, keys)
    return both.select(*keys, "entry_no", F.aggregate("_log", start, step, lambda s: s["edits"]).alias("edit_nos"))
