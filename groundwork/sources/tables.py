"""Readers of the knowledge tables: strict schemas, CSV calendars, place registers, call logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import parse_date
from ..functions.text import fold, one_line, place_key

CALENDAR = "key string, day date, location string"
CALLS = "at timestamp, tool string, status string, bytes int, ms double, release string, gap string, hits int, query string"
FACTS = "fact_id string, concept_id string, statement string, language string, jurisdiction string, condition map<string,string>, valid_from date, valid_through date, evidence_ids array<string>"


def read_json(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """A strict read: a record that does not fit the schema is an error."""
    return spark.read.schema(schema).option("multiLine", multiline).option("mode", "FAILFAST").json(path)


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """A call log of JSON lines; lines that cannot be read are left out."""
    rows = spark.read.schema(CALLS + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter("_corrupt is null and at is not null").drop("_corrupt")


def read_calendar(spark: SparkSession, path: str, key: str, day: str, location: str | None = None, sep: str = ";") -> tuple[DataFrame, DataFrame]:
    """Rows (key, day, location) of a CSV calendar, each once and in order, and the rows whose date cannot be read."""
    raw = spark.read.csv(path, header=True, sep=sep, encoding="UTF-8", quote='"')
    raw = raw.toDF(*(c.lstrip("﻿").strip('"') for c in raw.columns))
    rows = raw.select(
        one_line(F.col(f"`{key}`")).alias("key"), parse_date(F.col(f"`{day}`")).alias("day"), F.col(f"`{day}`").alias("written"),
        (one_line(F.col(f"`{location}`")) if location else F.lit(None).cast("string")).alias("location"),
    )
    good = rows.filter("day is not null and key is not null and key <> ''").select("key", "day", "location").dropDuplicates()
    return good.orderBy("key", "day", F.coalesce("location", F.lit(""))), rows.filter("day is null or key is null or key = ''")


def place_register(places: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """code, name, key for names and aliases, each key once per code; and aliases whose code is unknown."""
    names = places.select("code", "name", F.lit(0).alias("order")).unionByName(aliases.select("code", F.col("alias").alias("name"), F.lit(1).alias("order")))
    keyed = names.withColumn("key", place_key(fold(F.col("name"))))
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("code", "key").orderBy("order", "name"))).filter("n = 1")
    known = first.join(places.select("code"), "code", "left_semi").select("code", "name", "key")
    return known, aliases.join(places.select("code"), "code", "left_anti")


def write_partitioned(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("append").partitionBy(*by).parquet(path)
