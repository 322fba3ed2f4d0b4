"""Counts and presence of values and sign variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of texts that presence is counted by.
WHERE = ["period", "provenience", "genre", "object"]


def per_text(signs: DataFrame, texts: DataFrame, item: str, key: str = "tid") -> DataFrame:
    """text_id, item, count of signs; rows without the item don't count.

    Signs are counted per transliteration first, so that the join to texts moves counts.
    """
    counted = signs.where(F.col(item).isNotNull()).groupBy(key, item).agg(F.count("*").alias("n"))
    return counted.join(texts.select(key, "text_id"), key).groupBy("text_id", item).agg(F.sum("n").alias("count"))


def transliterations_per_text(texts: DataFrame) -> DataFrame:
    return texts.groupBy("text_id").agg(F.count("*").alias("count"))


def _weighed(signs: DataFrame, texts: DataFrame, item: str, where: list[str], key: str) -> DataFrame:
    counted = per_text(signs, texts, item, key)
    about = texts.groupBy("text_id").agg(F.count("*").alias("times"), *[F.min(c).alias(c) for c in where])
    rows = counted.join(about, "text_id")
    return rows.groupBy(item, *where).agg(F.sum("count").alias("count"), F.sum(F.col("count") / F.col("times")).alias("count_norm"))


def presence(signs: DataFrame, texts: DataFrame, item: str, where: list[str] | None = None, key: str = "tid", places: int | None = 6) -> DataFrame:
    """item, where, count, count_norm: occurrences by properties of the text, and the same with each text weighing as one transliteration.

    A null property is a group of its own. places: digits of count_norm; None for all, as `presence_after` wants them.
    """
    rows = _weighed(signs, texts, item, where or WHERE, key)
    return rows if places is None else rows.withColumn("count_norm", F.round("count_norm", places))


def presence_after(kept: DataFrame, before: DataFrame, after: DataFrame, texts: DataFrame, item: str, where: list[str] | None = None, key: str = "tid") -> DataFrame:
    """A kept `presence` after changes: before and after are the signs of the changed transliterations alone. What occurs no more is left out.

    Only these signs are counted. count_norm isn't rounded.
    """
    where = where or WHERE
    less = _weighed(before, texts, item, where, key).withColumns({"count": -F.col("count"), "count_norm": -F.col("count_norm")})
    rows = kept.unionByName(less).unionByName(_weighed(after, texts, item, where, key))
    sums = rows.groupBy(item, *where).agg(F.sum("count").alias("count"), F.sum("count_norm").alias("count_norm"))
    return sums.where("count > 0")
