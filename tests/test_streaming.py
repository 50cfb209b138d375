"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from groundwork.plans.service import traffic as batch_traffic
from groundwork.streaming import traffic


def run(frame, name, mode):
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return frame.sparkSession.sql(f"select * from {name}")


def test_traffic(spark, sf_dir):
    got = run(traffic.traffic(traffic.read_events(spark, sf_dir)), "traffic_stream", "complete")
    want = batch_traffic(spark, sf_dir)
    rows = lambda df: sorted((str(r.bucket), r.event_type, r.calls) for r in df.select(F.col("bucket"), "event_type", "calls").collect())
    assert rows(got) == rows(want)


def test_first_seen(spark, sf_dir):
    got = run(traffic.first_seen(traffic.read_events(spark, sf_dir)), "first_stream", "append")
    assert got.count() == spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").distinct().count()
