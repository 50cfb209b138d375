"""Incremental extraction: what of a run is reused, worked on again or superseded, and an atomic publish of the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEW, REUSED, RECOMPUTED, SUPERSEDED = "new", "reused", "recomputed", "superseded"


def decisions(items: DataFrame, existing: DataFrame, version: str, force: bool = False) -> DataFrame:
    """document_id, decision, reason for every id of either side.

    ``items``: document_id, raw_sha256 of the run; ``existing``: document_id, raw_sha256, status, extractor_version,
    imported of the records so far. A record stands in for a new extraction when its bytes are the same, it did not
    fail, and its extractor's version is this one or its text was imported. ``force`` reuses none. Ids of records only
    are superseded. Ids that repeat in the run count once.
    """
    mine = items.groupBy("document_id").agg(F.min("raw_sha256").alias("raw"))
    old = existing.select("document_id", F.col("raw_sha256").alias("old_raw"), "status", "extractor_version", F.coalesce("imported", F.lit(False)).alias("imported"), F.lit(True).alias("known"))
    rows = mine.withColumn("live", F.lit(True)).join(old, "document_id", "full_outer")
    reason = (
        F.when(F.lit(force), "forced").when(~F.col("old_raw").eqNullSafe(F.col("raw")), "bytes changed").when(F.col("status") == "extraction_failed", "failed before")
        .when(~F.col("extractor_version").eqNullSafe(F.lit(version)) & ~F.col("imported"), "extractor changed")
    )
    both = F.col("live") & F.col("known")
    decision = F.when(F.col("live").isNull(), SUPERSEDED).when(F.col("known").isNull(), NEW).when(reason.isNull(), REUSED).otherwise(RECOMPUTED)
    return rows.select("document_id", decision.alias("decision"), F.when(both, reason).alias("reason"))


def extracted(items: DataFrame, existing: DataFrame, version: str, extract: Callable[[DataFrame], DataFrame], prune: bool = False, force: bool = False) -> DataFrame:
    """The records after a run: ``extract`` applied to new and recomputed items only, reused records as they are, and,
    unless pruned, superseded ones; with ``superseded``. ``existing`` may carry that column, which is set anew."""
    plan = decisions(items, existing, version, force)
    of = lambda *what: plan.filter(F.col("decision").isin(*what)).select("document_id")
    fresh = extract(items.join(of(NEW, RECOMPUTED), "document_id", "left_semi")).withColumn("superseded", F.lit(False))
    kept = existing.drop("superseded").join(plan.select("document_id", "decision"), "document_id")
    kept = kept.filter(F.col("decision").isin(REUSED) if prune else F.col("decision").isin(REUSED, SUPERSEDED)).withColumn("superseded", F.col("decision") == SUPERSEDED)
    return kept.drop("decision").unionByName(fresh, allowMissingColumns=True)


def _file_context(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.getFileSystem(spark._jsc.hadoopConfiguration()).getUri()), where


def _swap(spark: SparkSession, folder: str, name: str) -> None:
    """Point ``folder`` at its table ``name``: one rename that replaces the pointer file."""
    jvm = spark._jvm
    context, pointer = _file_context(spark, f"{folder}/CURRENT")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT-{uuid.uuid4().hex}")
    out = fresh.getFileSystem(spark._jsc.hadoopConfiguration()).create(fresh, True)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, pointer, option)


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table published last, or none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(f"{folder}/{spark.read.text(f'{folder}/CURRENT').first()[0]}")


def publish(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``rows`` as a table of its own below ``folder``, then make it the current one. Whoever reads meanwhile, or
    after a loss at any point before the swap, has the table before; ``rows`` may be made from it."""
    name = f"table-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{name}")
    _swap(rows.sparkSession, folder, name)
    return rows.sparkSession.read.parquet(f"{folder}/{name}")


def unpublished(spark: SparkSession, folder: str) -> list[str]:
    """Tables below ``folder`` that are not the current one, to be deleted when nobody reads them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    now = spark.read.text(f"{folder}/CURRENT").first()[0]
    names = [s.getPath().getName() for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    return sorted(n for n in names if n.startswith("table-") and n != now)
