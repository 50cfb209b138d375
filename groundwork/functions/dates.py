"""Dates, validity and freshness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """ISO, dd.mm.yyyy or dd/mm/yyyy, in that order; null for anything else."""
    formats = ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy")
    return F.coalesce(*(F.try_to_date(F.trim(text), f) for f in formats))


def valid_on(day: Column, valid_from: Column, valid_through: Column) -> Column:
    """Inclusive on both ends; a bound that is missing does not bind."""
    return F.coalesce(valid_from <= day, F.lit(True)) & F.coalesce(day <= valid_through, F.lit(True))


def stale(as_of: Column, stale_from: Column) -> Column:
    return F.coalesce(as_of >= stale_from, F.lit(False))


def bucket(at: Column, by: str) -> Column:
    return F.date_trunc(by, at)
