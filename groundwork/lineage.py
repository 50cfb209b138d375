"""How long jobs cut their lineage: reliable checkpoints, or tables, in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the folder of ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary
    folder; a cluster gets an error."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df``, written as a table to the same folder. Of it a step reads the columns that it needs, and the shuffles that
    made it are dropped at once, where Spark would wait until the driver happens to collect its garbage."""
    spark, schema = df.sparkSession, df.schema
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind ``df``, once all that was read from it is written."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="groundwork-"))
    return context.getCheckpointDir()
