"""Documents, blocks and sections: groups, repetition, offsets and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def identical_groups(rows: DataFrame, key: Column, item: str) -> DataFrame:
    """sha256, members and the first item of every key that more than one row has."""
    return rows.groupBy(F.sha2(key, 256).alias("sha256")).agg(F.count("*").alias("members"), F.min(item).alias("first_item")).filter("members > 1")


def preferred(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The first row of each group; others are cut within tasks before the shuffle."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("_place = 1").drop("_place")


def repeated_texts(parts: DataFrame, host: str, item: str, text: str, least: int = 2) -> DataFrame:
    """host, text, pages: texts on at least ``least`` different items of a host; occurrences within one count once."""
    return parts.groupBy(host, text).agg(F.countDistinct(item).alias("pages")).filter(F.col("pages") >= least)


def with_offsets(blocks: DataFrame, document: str, order: str, text: str, gap: int = 2) -> DataFrame:
    """Blocks with start and end in their document's text, joined by a gap of ``gap`` characters."""
    w = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + gap).over(w), F.lit(0))
    return blocks.withColumn("start", start).withColumn("end", F.col("start") + F.length(text))


def runs(rows: DataFrame, item: str, order: list[str], value: str) -> DataFrame:
    """Rows with the number of their run of equal values, from 1."""
    w = Window.partitionBy(item).orderBy(*order)
    new = F.coalesce((~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int"), F.lit(1))
    return rows.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(new)).withColumn("run", F.sum("_new").over(w)).drop("_new")


def candidate_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that holds against a record; null where none does."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def newest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    return preferred(rows, key, [F.desc(at), F.asc(tie)])


def range_blocks(ranges: DataFrame, first: str, last: str) -> DataFrame:
    """One row for each block number of a range."""
    return ranges.withColumn("block", F.explode(F.sequence(F.col(first), F.col(last))))


def overlapping(start: Column, end: Column, at: Column, to: Column) -> Column:
    return (end > at) & (start < to)
