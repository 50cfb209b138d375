"""Selection, review queues, coverage and acceptance of curated records."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Causes of a failed download, most specific first, with whether a retry can help.
GAP_CLASSES = (
    ("mailto-redirect", False), ("access-denied", False), ("dns-failure", False), ("tls-certificate", True), ("not-found", False),
    ("redirect-out-of-scope", False), ("oversized", True), ("rate-limited", True), ("server-error", True), ("transient-network", True),
    ("robots-unavailable", True), ("unclassified", True), ("not-attempted", True),
)

# What the text of a failed attempt says, in the order in which it is asked.
FAILURE_PATTERNS = (
    ("mailto-redirect", "mailto:"), ("access-denied", "robots-disallowed|http (?:error )?403|forbidden"), ("dns-failure", "getaddrinfo|name or service not known|nodename nor servname"),
    ("tls-certificate", "certificate|ssl"), ("not-found", "http (?:error )?(?:404|410)"), ("redirect-out-of-scope", "redirect-out-of-scope|redirect limit|redirect to unreviewed"),
    ("oversized", "response-too-large|response-limit|exceeds"), ("rate-limited", "http (?:error )?429|rate-limit"), ("server-error", r"http (?:error )?5\d\d|server-unavailable"),
    ("transient-network", "timed out|timeout|request-failed|connection|urlerror|oserror|10060|10061"), ("robots-unavailable", "robots-unavailable"), ("not-attempted", "^pending$"),
)


def failure_class(detail: Column) -> Column:
    """The class of a failed attempt by what it says; null text was not attempted."""
    return gap_class(detail, list(FAILURE_PATTERNS))


def gap_class(reason: Column, patterns: list[tuple[str, str]]) -> Column:
    """The first class whose pattern a failure text matches, in the fixed order; null text was not attempted."""
    order = [name for name, _ in GAP_CLASSES]
    out = F.lit("unclassified")
    for name, pattern in sorted(patterns, key=lambda p: -order.index(p[0])):
        out = F.when(F.lower(reason).rlike(pattern), name).otherwise(out)
    return F.when(reason.isNull(), "not-attempted").otherwise(out)


def most_specific(rows: DataFrame, key: str, cause: str) -> DataFrame:
    """The most specific cause among the attempts of each key."""
    rank = F.create_map(*(F.lit(x) for i, (name, _) in enumerate(GAP_CLASSES) for x in (name, i)))
    return rows.groupBy(key).agg(F.min_by(cause, F.coalesce(rank[F.col(cause)], F.lit(len(GAP_CLASSES)))).alias(cause))


def first_of_each(rows: DataFrame, key: str, order: list[Column], limit: int | None = None) -> DataFrame:
    """One row per key by order, then the first ``limit`` rows by the same order."""
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
    return once.orderBy(*order).limit(limit) if limit else once


def page_of(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, page - 1) * size).limit(size)


def sampled(rows: DataFrame, key: str, item: str, most: int, seed: str) -> DataFrame:
    """At most ``most`` items per key, those of the smallest digests: the same in every run and on every cluster."""
    rows = rows.withColumn("_h", F.sha2(F.concat(F.lit(seed), F.col(item).cast("string")), 256))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_h", item))).filter(F.col("_n") <= most).drop("_n", "_h")


def shared(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """The fields whose value all rows of a key have; null where they differ."""
    one = lambda f: F.when(F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("\0"))) == 1, F.first(f)).alias(f)
    return rows.groupBy(key).agg(*(one(f) for f in fields))


def sequence_positions(rows: DataFrame, item: str, order: str, value: str, wanted: list[str]) -> DataFrame:
    """Where the values ``wanted`` follow each other, by item and place of the first."""
    w = Window.partitionBy(item).orderBy(order)
    hit = F.lit(True)
    ahead = {f"_a{k}": F.lead(value, k).over(w) for k in range(1, len(wanted))}
    rows = rows.withColumns(ahead) if ahead else rows
    for k, v in enumerate(wanted):
        hit = hit & ((F.col(value) if k == 0 else F.col(f"_a{k}")) == v)
    return rows.filter(hit).select(item, F.col(order).alias("at"))


def edge_lines(pages: DataFrame, document: str, page: str, text: str, least: int = 3) -> DataFrame:
    """First and last lines that stand on at least ``least`` pages and half of a document's: headers and footers."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    ends = pages.select(document, page, lines.alias("l")).filter(F.size("l") > 0)
    sides = F.array(F.struct(F.lit("first").alias("side"), F.element_at("l", 1).alias("line")), F.struct(F.lit("last").alias("side"), F.element_at("l", -1).alias("line")))
    each = ends.select(document, page, F.explode(sides).alias("e")).select(document, page, "e.side", "e.line")
    n = pages.groupBy(document).agg(F.countDistinct(page).alias("_pages"))
    found = each.groupBy(document, "side", "line").agg(F.countDistinct(page).alias("pages")).join(n, document)
    return found.filter((F.col("pages") >= least) & (2 * F.col("pages") >= F.col("_pages"))).drop("_pages")


def aligned(pairs: DataFrame, key: str) -> DataFrame:
    """Steps that turn one sequence of block hashes into another, for rows of key, old and new arrays."""

    def diff(batches):
        for pdf in batches:
            out = []
            for k, old, new in zip(pdf[key], pdf["old"], pdf["new"]):
                for step, a, b, c, d in difflib.SequenceMatcher(None, list(old), list(new), autojunk=False).get_opcodes():
                    out.append((k, step, a, b, c, d))
            yield pd.DataFrame(out, columns=[key, "step", "old_from", "old_to", "new_from", "new_to"])

    return pairs.select(key, "old", "new").mapInPandas(diff, f"{key} bigint, step string, old_from int, old_to int, new_from int, new_to int")


def evidence_spans(rows: DataFrame, item: str, text: str, most: int = 500) -> DataFrame:
    """Spans of at most ``most`` characters that tile a text, cut at the last space of a span's second half."""

    def cut(batches):
        for pdf in batches:
            out = []
            for i, t in zip(pdf[item], pdf[text]):
                at, n, t = 0, 0, t or ""
                while at < len(t):
                    end = min(at + most, len(t))
                    if end < len(t):
                        space = t.rfind(" ", at + most // 2, end)
                        end = space + 1 if space > 0 else end
                    out.append((i, n, at, end))
                    at, n = end, n + 1
            yield pd.DataFrame(out, columns=[item, "span", "start", "end"])

    return rows.select(item, text).mapInPandas(cut, f"{item} bigint, span int, start int, end int")


def place_candidates(names: DataFrame, register: DataFrame, name_key: str) -> DataFrame:
    """Each name with its codes at the first stage that finds any: as written, by key, by key without generic words.

    ``register``: code, name, key, loose. ``names``: name, key, loose. More than one code at that stage is ambiguous.
    """
    stages = [("name", "name"), ("key", "key"), ("loose", "loose")]
    found = None
    for n, (left, right) in enumerate(stages):
        hit = names.select(name_key, F.col(left).alias("_k")).join(register.select("code", F.col(right).alias("_k")).distinct(), "_k").select(name_key, F.lit(n).alias("stage"), "code")
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(name_key, "stage").agg(F.sort_array(F.collect_set("code")).alias("codes")).groupBy(name_key).agg(F.min_by("codes", "stage").alias("codes"))
    out = names.join(best, name_key, "left")
    status = F.when(F.col("codes").isNull(), "not recognised").when(F.size("codes") > 1, "ambiguous").otherwise("found")
    return out.select(name_key, status.alias("status"), F.when(F.size("codes") == 1, F.col("codes")[0]).alias("code"))
