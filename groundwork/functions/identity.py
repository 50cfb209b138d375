"""Stable identifiers, hashes and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_id(source_url: Column, raw_sha256: Column) -> Column:
    return F.concat(F.lit("doc-"), F.substring(F.sha2(F.concat_ws("\n", source_url, raw_sha256), 256), 1, 20))


def representation_group(source_url: Column) -> Column:
    return F.concat(F.lit("source-"), F.substring(F.sha2(source_url, 256), 1, 20))


def block_id(document: Column, number: Column) -> Column:
    return F.concat(document, F.lit(":b"), F.lpad(number.cast("string"), 5, "0"))


def block_number(block: Column) -> Column:
    return F.element_at(F.split(block, ":b"), -1).cast("int")


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def source_filename(url: Column) -> Column:
    return F.element_at(F.split(path_of(url), "/"), -1)


def url_language(url: Column, codes: tuple[str, ...] = ("de", "en", "fr", "it", "rm")) -> Column:
    """A language code as a path segment, else as the suffix of the file's name."""
    segment = F.filter(F.split(F.lower(path_of(url)), "/"), lambda s: s.isin(*codes))
    suffix = F.regexp_extract(F.lower(source_filename(url)), "[_.-]([a-z]{2})(?:\\.[a-z0-9]+)?$", 1)
    return F.coalesce(F.get(segment, F.lit(0)), F.when(suffix.isin(*codes), suffix))


def in_paths(path: Column, prefix: Column) -> Column:
    """Whole path segments only: /a holds /a and /a/b, not /ab."""
    p = F.regexp_replace(prefix, "/+$", "")
    return (path == p) | F.startswith(path, F.concat(p, F.lit("/"))) | (p == "")


def redact_query(url: Column) -> Column:
    return F.regexp_replace(url, r"\?[^#]*", "?…")
