"""A join of all rows with one row per group that stays even when a group is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group counts as hot from this share of all rows on, so there are never more than its inverse.
HOT_SHARE = 1 / 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (unique on ``key``; ``size`` counts the rows of each group).

    Groups of more than ``n_rows * HOT_SHARE`` rows number at most ``1 / HOT_SHARE``, so they are broadcast;
    all others meet in a shuffle whose largest key holds a thousandth of the rows.
    """
    most = max(1, int(n_rows * HOT_SHARE))
    hot = groups.filter(F.col(size) > most)
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left")
    few = rows.join(F.broadcast(hot), key)
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot")
    return few.unionByName(rest.join(groups.filter(F.col(size) <= most), key))


def hot_keys(many: DataFrame, key: str, n_rows: int) -> DataFrame:
    """The hot keys of ``many`` and into how many parts each is dealt: at most ``1 / HOT_SHARE`` rows."""
    most = max(1, int(n_rows * HOT_SHARE))
    return many.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).alias("_parts"))


def deal(many: DataFrame, hot: DataFrame, key: str, salt: str) -> DataFrame:
    """``many`` with the part of each row, by a hash of ``salt`` for hot keys."""
    return many.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(salt), F.coalesce("_parts", F.lit(1)))).drop("_parts")


def copy(one: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``one`` with a copy of each row for every part of its key."""
    last = F.coalesce("_parts", F.lit(1)).cast("bigint") - 1
    return one.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).drop("_parts")


def join_dealt(many: DataFrame, one: DataFrame, key: str, salt: str, n_rows: int) -> DataFrame:
    """Inner join of ``many`` (about ``n_rows`` rows) with ``one`` (unique on ``key``, rows too wide to broadcast).

    The rows of a hot key are dealt to parts and the key's one row is copied to each part, so no task holds more
    than a thousandth of ``many`` for a key. The copies number at most ``2 / HOT_SHARE``.
    """
    hot = hot_keys(many, key, n_rows)
    return deal(many, hot, key, salt).join(copy(one, hot, key), [key, "_part"]).drop("_part")
