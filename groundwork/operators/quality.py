"""Constraints as queries that give one row per issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _issue(rows: DataFrame, rule: str, key: Column, n: Column | None = None) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (F.lit(1) if n is None else n).cast("bigint").alias("n"))


def duplicate_keys(rows: DataFrame, rule: str, *keys: str) -> DataFrame:
    return _issue(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1"), rule, F.concat_ws("/", *(F.col(k).cast("string") for k in keys)), F.col("n"))


def orphans(rows: DataFrame, parents: DataFrame, rule: str, child: str, parent: str) -> DataFrame:
    """Keys of ``rows`` without a parent, with the rows that have them."""
    lost = rows.join(parents.select(F.col(parent).alias(child)).distinct(), child, "left_anti")
    return _issue(lost.groupBy(child).agg(F.count("*").alias("n")), rule, F.col(child), F.col("n"))


def violations(rows: DataFrame, rule: str, key: str, holds: Column) -> DataFrame:
    """Rows for which a predicate does not hold; unknown counts as not holding."""
    return _issue(rows.filter(~F.coalesce(holds, F.lit(False))), rule, F.col(key))


def all_issues(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def diff(old: DataFrame, new: DataFrame, key: str, *compared: str) -> DataFrame:
    """key, change: added, removed or changed between two versions."""
    sides = old.select(key, F.struct(*compared).alias("was")).join(new.select(key, F.struct(*compared).alias("now")), key, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return sides.select(key, change.alias("change")).filter(F.col("change").isNotNull())
