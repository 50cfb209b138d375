"""Bytes of responses to text: byte order mark, valid UTF-8, declared by the response, declared in the page, fallback.

Valid UTF-8, which is nearly all there is, is decoded by built-in functions. Only other bytes go through an Arrow
function that knows the names of character sets.
"""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes at the start of a page that are searched for a declaration.
HEAD = 8192
_DECLARED = r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)"


def declared(text: Column) -> Column:
    """The character set that a header or the start of a page names."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), _DECLARED, 1), F.lit(""))


def _named(raw: bytes, http: str | None, meta: str | None) -> tuple[str, str, list[str]]:
    warnings = []
    for source, name in (("http", http), ("meta", meta)):
        if name:
            try:
                return raw.decode(name), codecs.lookup(name).name, warnings
            except (LookupError, UnicodeDecodeError):
                warnings.append(f"declared_charset_failed:{source}:{name}")
    warnings.append("character_encoding_fallback")
    try:
        return raw.decode("windows-1252"), "windows-1252", warnings
    except UnicodeDecodeError:
        return raw.decode("latin-1"), "latin-1", warnings


def _other(raw: pd.Series, http: pd.Series, meta: pd.Series) -> pd.DataFrame:
    rows = [(None, None, []) if r is None else _named(bytes(r), h, m) for r, h, m in zip(raw, http, meta)]
    return pd.DataFrame(rows, columns=["text", "encoding", "warnings"])


def decoded(rows: DataFrame, raw: str, content_type: str | None = None) -> DataFrame:
    """``rows`` with text, encoding, declared_http, declared_meta, warnings. Null bytes give nulls; bytes that are valid
    UTF-8 are that whatever is declared; nothing is replaced silently."""
    data, none = F.col(raw), F.array().cast("array<string>")
    head = F.hex(F.substring(data, 1, 3))
    http = declared(F.col(content_type)) if content_type else F.lit(None).cast("string")
    meta = declared(F.decode(F.substring(data, 1, HEAD), "ISO-8859-1"))
    kind = F.when(head == "EFBBBF", "utf-8-sig").when(head.rlike("^(FFFE|FEFF)"), "utf-16").when(F.is_valid_utf8(data.cast("string")), "utf-8")
    rows = rows.withColumns({"declared_http": http, "declared_meta": meta, "_kind": kind})
    rows = rows.withColumn("_other", F.pandas_udf(_other, "text string, encoding string, warnings array<string>")(F.when(F.col("_kind").isNull(), data), "declared_http", "declared_meta"))
    text = (
        F.when(F.col("_kind") == "utf-8-sig", F.substr(data.cast("string"), F.lit(2))).when(F.col("_kind") == "utf-16", F.decode(data, "UTF-16"))
        .when(F.col("_kind") == "utf-8", data.cast("string")).otherwise(F.col("_other.text"))
    )
    out = {"text": text, "encoding": F.when(data.isNotNull(), F.coalesce("_kind", "_other.encoding")), "warnings": F.when(data.isNotNull() & F.col("_kind").isNull(), F.col("_other.warnings")).otherwise(none)}
    return rows.withColumns(out).drop("_kind", "_other")
