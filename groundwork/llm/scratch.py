"""Shared scratch tables: how operators cut lineage.

An intermediate result that is read more than once, or that is costly to recompute after an executor is
lost, is written as Parquet below the folder named by ``spark.checkpoint.dir``, which every executor can read.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder. Where it is unset, a local master gets a temporary folder; a cluster gets an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="groundwork-")
    return _OWN[app]


def _folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/groundwork/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, once the results that read them have been written."""
    _delete(spark, _folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh scratch table and return a frame that reads it."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(spark: SparkSession) -> None:
    """Between phases: let Spark drop the shuffle files of steps that nothing refers to any more.

    Its cleaner acts when the driver collects garbage, which a driver with little to do may put off for long, and
    until then the executors' disks hold every shuffle of a long job. A session without a JVM of its own skips this.
    """
    gc.collect()
    jvm = getattr(getattr(spark, "sparkContext", None), "_jvm", None) if hasattr(type(spark), "_instantiatedSession") else None
    if jvm is not None:
        jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the scratch table behind ``df``, once all that was read from it has been written."""
    _delete(df.sparkSession, df._scratch_path)
