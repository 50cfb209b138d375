"""Joins of addresses with prefix rules, and of places with places that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identity import host_of, path_of


def longest_prefix(urls: DataFrame, rules: DataFrame, item: str, url: str) -> DataFrame:
    """Each item with the longest rule (host, prefix) that holds its address, or null.

    An address is expanded to the prefixes of its own path, so the join is on equality.
    """
    parts = urls.select(item, url, host_of(F.col(url)).alias("host"), F.filter(F.split(path_of(F.col(url)), "/"), lambda s: s != "").alias("segments"))
    prefixes = parts.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("segments"))))
    prefixes = prefixes.withColumn("prefix", F.concat(F.lit("/"), F.array_join(F.slice("segments", F.lit(1), F.col("depth")), "/")))
    hits = prefixes.join(rules, ["host", "prefix"])
    best = hits.groupBy(item).agg(F.max_by("rule", "depth").alias("rule"), F.max_by("prefix", "depth").alias("prefix"))
    return urls.join(best, item, "left").select(item, url, "rule", "prefix")


def holders(places: DataFrame, code: str) -> DataFrame:
    """code, outer: every place with itself and all that hold it, by the prefixes of its code."""
    parts = F.split(F.col(code), "-")
    outer = F.array_join(F.slice(parts, F.lit(1), F.col("_n")), "-")
    return places.select(code).distinct().withColumn("_n", F.explode(F.sequence(F.lit(1), F.size(parts)))).select(code, outer.alias("outer"))


def newest_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).filter("_r = 1").drop("_r")
