"""Streaming twins of the call-log aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Event files of a folder as a stream, in event time."""
    out = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def traffic(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls and failures of each tool and window; events later than ``late`` are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return w.agg(F.count("*").alias("calls"), F.count_if(F.col("value") < 10).alias("failed")).select(F.col("w.start").alias("bucket"), "event_type", "calls", "failed")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return w.agg(F.count("*").alias("calls")).select("user_id", F.col("s.start").alias("started"), "calls")


def first_seen(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, whatever its repeats within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
