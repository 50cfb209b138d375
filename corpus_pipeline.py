"""The corpus pipeline: quality, exact and near duplicates, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundwork.llm.exact_dedup import deduplicated
from groundwork.llm.mixing import mixed
from groundwork.llm.near_dedup import one_per_group
from groundwork.llm.packing import packed
from groundwork.llm.quality import accepted
from groundwork.llm.queries import tokenizer_path
from groundwork.llm.scratch import discard, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Null and empty texts get the score of the bias; an empty table stays empty."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the row with the largest id; of rows that repeat it, one."""
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id; texts without words all stay."""
    return one_per_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares by source, language and topic are the targets; null classes are classes."""
    return mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences and their token ids (little-endian unsigned 32-bit); null texts are the end id alone."""
    return packed(docs, tokenizer_path(), keep_ids=True)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: A trained classifier, hashing and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet before the next reads it; a table that was read is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
