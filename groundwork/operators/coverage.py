"""Coverage of pages by what cites them: units, decisions about them, and roll-ups by document and source."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks of a document that meet the units over them in one group.
BIN = 64


def cited_units(units: DataFrame, cited: DataFrame) -> DataFrame:
    """document_id, unit of the units (first_block to last_block) that hold a cited block (``cited``: document_id, block).
    Both sides meet by bins of blocks, so a unit meets the citations near it only."""
    bins = F.explode(F.sequence(F.floor(F.col("first_block") / BIN), F.floor(F.col("last_block") / BIN)))
    over = units.select("document_id", "unit", "first_block", "last_block", bins.alias("bin"))
    at = cited.select("document_id", "block", F.floor(F.col("block") / BIN).alias("bin")).distinct()
    return over.join(at, ["document_id", "bin"]).filter(F.col("block").between(F.col("first_block"), F.col("last_block"))).select("document_id", "unit").distinct()


def under_prefix(documents: DataFrame, rules: DataFrame) -> DataFrame:
    """document_id, number of every rule (number, url_prefix) whose prefix the document's source_url has. Addresses are cut
    to the lengths that prefixes have, of which there are no more than characters in the longest, and joined on equality."""
    lengths = sorted(r.n for r in rules.select(F.length("url_prefix").alias("n")).distinct().collect())
    cuts = F.explode(F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("source_url")), lambda n: F.substring(F.col("source_url"), F.lit(1), n)))
    return documents.select("document_id", cuts.alias("url_prefix")).join(rules.select("number", "url_prefix"), "url_prefix").select("document_id", "number")


def classified(units: DataFrame, documents: DataFrame, cited: DataFrame, dispositions: DataFrame, min_pages: int) -> DataFrame:
    """document_id, unit, status, kind: every unit in one class.

    ``units``: document_id, unit, first_block, last_block, section_ids, text; ``documents``: document_id, source_url, host;
    ``dispositions``: number, kind, document_id or url_prefix, section_ids (null or empty for all of a document). A unit is
    "cited" if a fact cites one of its blocks; "dispositioned" if its document, one of its sections or a rule over its
    address is, with the kind of the first of those in that order; "boilerplate" if its text stands on ``min_pages``
    documents of its host; else "unclassified".
    """
    u = units.select("document_id", "unit", "first_block", "last_block", "section_ids", "text")
    hit = cited_units(u, cited).withColumn("_cited", F.lit(True))
    own, all_ = dispositions.filter("document_id is not null"), F.size(F.coalesce("section_ids", F.array().cast("array<string>"))) == 0
    first = F.min(F.struct("number", "kind"))
    whole = own.filter(all_).groupBy("document_id").agg(first.alias("_whole"))
    # of a section that several dispositions name, the last one holds
    named = own.filter(~all_).select("document_id", "number", "kind", F.explode("section_ids").alias("section"))
    named = named.groupBy("document_id", "section").agg(F.max(F.struct("number", "kind")).alias("d"))
    part = u.select("document_id", "unit", F.posexplode("section_ids").alias("at", "section")).join(named, ["document_id", "section"])
    part = part.groupBy("document_id", "unit").agg(F.min(F.struct("at", F.col("d.kind").alias("kind"))).alias("_part"))
    rules = dispositions.filter("document_id is null")
    ruled = under_prefix(documents, rules).join(rules.select("number", "kind"), "number").groupBy("document_id").agg(first.alias("_rule"))
    hosted = u.filter("text <> ''").join(documents.select("document_id", "host"), "document_id").select("document_id", "unit", "host", F.sha2("text", 256).alias("_text"))
    many = hosted.groupBy("host", "_text").agg(F.count_distinct("document_id").alias("pages")).filter(F.col("pages") >= min_pages)
    repeated = hosted.join(many, ["host", "_text"]).select("document_id", "unit", F.lit(True).alias("_repeated"))
    rows = u.select("document_id", "unit").join(hit, ["document_id", "unit"], "left").join(whole, "document_id", "left").join(part, ["document_id", "unit"], "left")
    rows = rows.join(ruled, "document_id", "left").join(repeated, ["document_id", "unit"], "left")
    kind = F.coalesce("_whole.kind", "_part.kind", "_rule.kind")
    status = F.when(F.col("_cited"), "cited").when(kind.isNotNull(), "dispositioned").when(F.col("_repeated"), "boilerplate").otherwise("unclassified")
    return rows.select("document_id", "unit", status.alias("status"), F.when(status == "dispositioned", kind).alias("kind"))


_COUNTS = ("cited", "dispositioned", "boilerplate", "unclassified")


def _counted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("status").alias("units"), *(F.count_if(F.col("status") == s).alias(s) for s in _COUNTS))


def by_document(classes: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, units, cited, dispositioned, boilerplate, unclassified, status of every document."""
    rows = _counted(documents.select("document_id").join(classes, "document_id", "left"), "document_id")
    asked = F.col("units") - F.col("boilerplate")
    status = (
        F.when(F.col("units") == 0, "empty").when((F.col("unclassified") > 0) & (F.col("cited") > 0), "partly_cited").when(F.col("unclassified") > 0, "unclassified")
        .when(asked == 0, "boilerplate_only").when(F.col("cited") == asked, "cited").when(F.col("cited") > 0, "cited_and_dispositioned").otherwise("dispositioned")
    )
    return rows.withColumn("status", status)


def by_source(classes: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id, documents, units (without boilerplate), the counts and a status of every source (``sources``: source_id)
    and of every other one that a document (source_ids) names; documents without any are "(discovered)"."""
    ids = F.when(F.size(F.coalesce("source_ids", F.array().cast("array<string>"))) > 0, F.col("source_ids")).otherwise(F.array(F.lit("(discovered)")))
    of = documents.select("document_id", F.explode(F.array_distinct(ids)).alias("source_id"))
    per = _counted(of.join(classes, "document_id", "left"), "source_id").drop("units")
    n = of.groupBy("source_id").agg(F.count_distinct("document_id").alias("documents"))
    rows = sources.select("source_id").distinct().join(n.join(per, "source_id"), "source_id", "full_outer").na.fill(0)
    units = F.col("cited") + F.col("dispositioned") + F.col("unclassified")
    status = (
        F.when(F.col("documents") == 0, "no_documents").when((F.col("unclassified") > 0) & (F.col("cited") + F.col("dispositioned") > 0), "partly_covered").when(F.col("unclassified") > 0, "nothing")
        .when(F.col("cited") > 0, "cited").when(units == 0, "boilerplate_only").otherwise("dispositioned")
    )
    return rows.select("source_id", "documents", units.alias("units"), *_COUNTS, status.alias("status"))


def findings(dispositions: DataFrame, documents: DataFrame, known: DataFrame, today: date, out_of_scope: list[str]) -> DataFrame:
    """finding, number, target of dispositions that no longer fit.

    ``dispositions``: number, kind, document_id, url_prefix, reaffirm_by, out_of_scope_entry, known_documents;
    ``documents``: those asked for (document_id, source_url); ``known``: all ids. Deferred ones whose day has passed are
    "expired"; an entry that no scope statement has is "unknown_out_of_scope_entry"; ids that are gone are "stale"; documents
    that came under a rule since are "new_under_rule"; a rule over none is "unused_rule".
    """
    d, target = dispositions, F.coalesce("document_id", "url_prefix")
    said = F.lit("\n".join(s.lower() for s in out_of_scope))
    phrase = F.lower(F.trim(F.coalesce("out_of_scope_entry", F.lit(""))))
    absent = ~F.exists(F.split(said, "\n"), lambda s: F.contains(s, phrase)) if out_of_scope else F.lit(True)
    one = lambda rows, name: rows.select(F.lit(name).alias("finding"), "number", target.alias("target"))
    rules = d.filter("document_id is null")
    under = under_prefix(documents, rules)
    new = under.join(rules.select("number", F.coalesce("known_documents", F.array().cast("array<string>")).alias("k")), "number").filter(~F.array_contains("k", F.col("document_id").cast("string")))
    return (
        one(d.filter((F.col("kind") == "deferred") & (F.col("reaffirm_by") < F.lit(today))), "expired")
        .unionAll(one(d.filter((F.col("kind") == "out_of_scope") & absent), "unknown_out_of_scope_entry"))
        .unionAll(one(d.filter("document_id is not null").join(known.select("document_id"), "document_id", "left_anti"), "stale"))
        .unionAll(new.select(F.lit("new_under_rule"), "number", F.col("document_id").cast("string")))
        .unionAll(one(rules.join(under.select("number").distinct(), "number", "left_anti"), "unused_rule"))
    )
