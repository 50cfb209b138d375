"""Operational analytics over a call log."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import bucket


def latency(calls: DataFrame, tool: str, ms: str, failed: Column) -> DataFrame:
    """Calls, failures and nearest-rank percentiles of each tool."""
    p = [F.expr(f"round(percentile_disc({q}) WITHIN GROUP (ORDER BY {ms}), 1)").alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return calls.groupBy(tool).agg(F.count("*").alias("calls"), F.count_if(failed).alias("failed"), *p)


def traffic(calls: DataFrame, at: str, tool: str, by: str = "hour") -> DataFrame:
    return calls.groupBy(bucket(F.col(at), by).alias("bucket"), tool).agg(F.count("*").alias("calls"))


def sessions(calls: DataFrame, user: str, at: str, gap: str) -> DataFrame:
    """Sessions of each user that end after ``gap`` without a call."""
    s = calls.groupBy(user, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("calls"))
    return s.select(user, F.col("s.start").alias("started"), "calls")


def chained(events: DataFrame, chain: str, order: str, body: Column) -> DataFrame:
    """chain, order, digest, previous, link: each link covers the link before it and the event's digest.

    An early event changes every later link, so links are folded in order, one chain at a time.
    """
    kinds = dict(events.dtypes)

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        before, previous, link = "", [], []
        for d in t["digest"].to_pylist():
            previous.append(before)
            before = hashlib.sha256((before + d).encode()).hexdigest()
            link.append(before)
        return t.append_column("previous", pa.array(previous, pa.string())).append_column("link", pa.array(link, pa.string()))

    sealed = events.select(chain, order, F.sha2(body, 256).alias("digest"))
    return sealed.groupBy(chain).applyInArrow(fold, f"{chain} {kinds[chain]}, {order} {kinds[order]}, digest string, previous string, link string")


def chain_breaks(stored: DataFrame, chain: str, order: str, body: Column) -> DataFrame:
    """chain, order of stored events (previous, link) that do not follow the link before them or do not have their own."""
    w = Window.partitionBy(chain).orderBy(order)
    rows = stored.withColumn("_before", F.coalesce(F.lag("link").over(w), F.lit("")))
    sound = (F.col("previous") == F.col("_before")) & (F.col("link") == F.sha2(F.concat("previous", F.sha2(body, 256)), 256))
    return rows.filter(~F.coalesce(sound, F.lit(False))).select(chain, order)


def null_sum(value: str) -> Column:
    """A sum that is null as soon as one value is."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))
