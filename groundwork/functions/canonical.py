"""Canonical JSON of columns, and digests of rows and collections that depend on nothing but their values.

Text as ``json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))`` writes it, built by column
functions that follow the type of the column. Doubles have the fewest digits that give them back; beyond 1e17, where Java
before 19 rounds its own text, and below 1e-307, where numbers have fewer digits than others, a few differ in the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _quoted(c: Column) -> Column:
    named = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rare = plain
    for code in range(32):
        rare = F.replace(rare, F.lit(chr(code)), F.lit(named.get(chr(code), f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f]"), rare).otherwise(plain), F.lit('"'))


def _number(c: Column) -> Column:
    """A double with the fewest digits that give it back, in positional notation from 1e-4 to below 1e16."""
    written = [F.format_string(f"%.{k}e", F.abs(c)) for k in (14, 15, 16)]
    text = F.coalesce(*(F.when(w.cast("double") == F.abs(c), w) for w in written), written[-1])
    body = F.regexp_replace(F.replace(F.regexp_extract(text, "^([0-9.]+)", 1), F.lit("."), F.lit("")), "0+$", "")
    exponent = F.regexp_extract(text, "e(.*)$", 1).try_cast("int") + 1  # value = 0.<body> * 10 ** exponent
    n, zeros = F.length(body), lambda k: F.repeat(F.lit("0"), k)
    whole = F.when(n <= exponent, F.concat(body, zeros(exponent - n), F.lit(".0"))).when(exponent > 0, F.concat(F.substr(body, F.lit(1), exponent), F.lit("."), F.substr(body, exponent + 1)))
    place = F.when(exponent > 0, whole).otherwise(F.concat(F.lit("0."), zeros(-exponent), body))
    e = exponent - 1
    power = F.concat(F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    science = F.concat(F.substr(body, F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(body, F.lit(2)))).otherwise(""), F.lit("e"), power)
    sign = F.when(c.cast("string").startswith("-"), "-").otherwise("")
    special = F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity").when(c == 0, F.concat(sign, F.lit("0.0")))
    return F.coalesce(special, F.concat(sign, F.when((exponent > -4) & (exponent <= 16), place).otherwise(science)))


def canonical_json(c: Column, kind: T.DataType, drop: frozenset[str] = frozenset()) -> Column:
    """``c`` of type ``kind`` as canonical JSON, null included. Members of structs named in ``drop`` are left out where
    they are null or empty, which keeps digests of values from before those members existed."""
    if isinstance(kind, T.StructType):
        parts = []
        for f in sorted(kind.fields, key=lambda f: f.name):
            name = '"' + f.name.replace("\\", "\\\\").replace('"', '\\"') + '":'
            part = F.concat(F.lit(name), canonical_json(c[f.name], f.dataType, drop))
            if f.name in drop:
                empty = F.size(c[f.name]) <= 0 if isinstance(f.dataType, (T.ArrayType, T.MapType)) else F.lit(False)
                part = F.when(c[f.name].isNotNull() & ~empty, part)
            parts.append(part)
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts) if parts else F.lit(""), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_json(x, kind.elementType, drop)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pair = lambda e: F.concat(_quoted(e["key"].cast("string")), F.lit(":"), canonical_json(e["value"], kind.valueType, drop))
        entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("key"), pair(e).alias("text"))), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: e["text"]), ","), F.lit("}"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = _number(c.cast("double"))
    elif isinstance(kind, T.IntegralType):
        text = c.cast("string")
    elif isinstance(kind, T.BooleanType):
        text = F.when(c, "true").otherwise("false")
    else:  # text, dates, decimals
        text = _quoted(c.cast("string"))
    return F.when(c.isNull(), "null").otherwise(text)


def row_json(df: DataFrame, drop: frozenset[str] = frozenset()) -> Column:
    """The whole row of ``df`` as canonical JSON."""
    return canonical_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), df.schema, drop)


def summed_hashes(rows: DataFrame, sha256: str, *by: str) -> DataFrame:
    """rows, sha256 of each group of hashes ``by``: their sums in eight parts of 32 bits, hashed."""
    parts = [F.sum(F.conv(F.substring(sha256, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"_p{k}") for k in range(8)]
    summed = rows.groupBy(*by).agg(F.count("*").alias("rows"), *parts)
    sums = F.concat_ws(",", F.col("rows").cast("string"), *(F.coalesce(F.col(f"_p{k}").cast("string"), F.lit("0")) for k in range(8)))
    return summed.select(*by, "rows", F.sha2(sums, 256).alias("sha256"))


def collection_digest(df: DataFrame, drop: frozenset[str] = frozenset()) -> DataFrame:
    """rows, sha256 of a collection: rows in any order and layout give the same, and a row that is there twice counts
    twice. Hashes are summed partly before any shuffle; no task and no text holds the collection."""
    return summed_hashes(df.select(F.sha2(row_json(df, drop), 256).alias("_h")), "_h")
