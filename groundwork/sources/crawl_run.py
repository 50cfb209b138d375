"""A saved crawl run as frames: plan, manifests, snapshots with their attribution, responses checked against them.

A run folder holds ``plan.json``, ``pages/<id>/latest.json`` with attempt folders beside it, and the same below
``<plugin>-documents``. Manifests are read with a fixed schema in one scan, responses as binary files whose size and
hash are computed where they are read; only those meet the manifests, so bytes are neither shuffled nor sent to the
driver until somebody asks for those of chosen snapshots.

Nothing raises while frames are built. What can't be used is in ``refused``, with its reason; ``strict`` turns that into
an error.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLAN = (
    "catalogue_sha256 string, targets array<struct<url:string,registry_entries:array<struct<definition:struct<source_id:string>>>,"
    "attribution:struct<kind:string,source_ids:array<string>,advertised_languages:array<string>,reasons:array<string>>>>"
)
SNAPSHOT = "struct<relative_path:string,sha256:string,bytes_downloaded:bigint,requested_url:string,final_url:string,content_type:string,retrieved_at:string,review_flags:array<string>>"
MANIFEST = (
    "url string, status string, http_status int, error string, last_error string, source_page_url string, version_uri string, language string, "
    f"references string, registry_entries string, discoveries string, imported_from string, snapshots array<{SNAPSHOT}>"
)
#: Kinds of attribution that are worked on unless the caller asks for all.
ATTRIBUTED = ("catalogue", "in-scope", "language-variant", "plugin-document")


class Run(NamedTuple):
    targets: DataFrame  # url, source_ids, attribution
    snapshots: DataFrame  # one row per snapshot that may be read
    unavailable: DataFrame  # manifests without a snapshot
    refused: DataFrame  # pointer, reason


class RunError(ValueError):
    pass


def _root(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().getPath()


def _relative(root: str) -> Column:
    """A file's path below the run folder."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.substr(F.regexp_replace(path, r"^[A-Za-z0-9+.-]+:(//[^/]*)?", ""), F.lit(len(root.rstrip("/")) + 2))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """url, source_ids, attribution of every planned address. A plan that is not one is an error."""
    plan = spark.read.schema(PLAN).option("multiLine", True).option("mode", "FAILFAST").json(f"{path}/plan.json")
    t = plan.select(F.explode("targets").alias("t")).select("t.*")
    own = F.transform(F.coalesce("registry_entries", F.array()), lambda e: e["definition"]["source_id"])
    ids = F.filter(F.concat(own, F.coalesce("attribution.source_ids", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    return t.select("url", F.array_sort(F.array_distinct(ids)).alias("source_ids"), "attribution")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Every ``latest.json`` of the run: pointer, plugin_id (null for ordinary pages), folder, its fields, _corrupt."""
    root = _root(spark, path)
    rows = spark.read.schema(MANIFEST + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt")
    rows = rows.option("recursiveFileLookup", True).option("pathGlobFilter", "latest.json").json(path).withColumn("pointer", _relative(root))
    plugin = F.regexp_extract("pointer", r"^(?:([^/]+)-documents/)?pages/[^/]+/latest\.json$", 1)
    rows = rows.filter(F.col("pointer").rlike(r"^(?:[^/]+-documents/)?pages/[^/]+/latest\.json$"))
    return rows.withColumn("plugin_id", F.nullif(plugin, F.lit(""))).withColumn("folder", F.when(plugin == "", "").otherwise(F.concat(plugin, F.lit("-documents/"))))


def attribution(plugin: Column, planned: Column, given: Column, own_sources: Column, page_sources: Column, page_url: Column) -> Column:
    """What a response belongs to: a plugin's page, what the plan says, a catalogue entry, or nothing planned."""
    none, null = F.array().cast("array<string>"), F.lit(None).cast("string")

    def kind(name: Column, sources: Column, plugin_id: Column = null, resolved: Column = null, languages: Column = none, reasons: Column = none) -> Column:
        return F.struct(
            name.alias("kind"), F.coalesce(sources, none).alias("source_ids"), plugin_id.alias("plugin_id"), resolved.alias("resolved_from"),
            F.coalesce(languages, none).alias("advertised_languages"), F.coalesce(reasons, none).alias("reasons"),
        )

    stated = kind(F.coalesce(given["kind"], F.lit("out-of-scope")), F.array_sort(given["source_ids"]), languages=given["advertised_languages"], reasons=given["reasons"])
    return (
        F.when(plugin.isNotNull(), kind(F.lit("plugin-document"), page_sources, plugin, page_url))
        .when(planned.isNull(), kind(F.lit("unplanned"), none)).when(given.isNotNull(), stated).otherwise(kind(F.lit("catalogue"), own_sources))
    )


def attributed(manifests: DataFrame, targets: DataFrame) -> DataFrame:
    """``manifests`` (url, plugin_id, source_page_url) with ``attribution``, ``source_url``, and ``reason`` where the plan
    does not allow them: an ordinary page must be a target, a plugin's document must come from one."""
    own = targets.select(F.col("url"), F.col("url").alias("_planned"), F.col("source_ids").alias("_own"), F.col("attribution").alias("_given"))
    page = targets.select(F.col("url").alias("source_page_url"), F.col("url").alias("_page"), F.col("source_ids").alias("_page_sources"))
    rows = manifests.join(own, "url", "left").join(page, "source_page_url", "left")
    reason = F.when(F.col("plugin_id").isNull() & F.col("_planned").isNull(), "page outside the plan").when(F.col("plugin_id").isNotNull() & F.col("_page").isNull(), "plugin document without a planned page")
    what = attribution(F.col("plugin_id"), F.col("_planned"), F.col("_given"), F.col("_own"), F.col("_page_sources"), F.col("source_page_url"))
    return rows.withColumn("attribution", what).withColumn("source_url", F.coalesce(F.nullif("source_page_url", F.lit("")), "url")).withColumn("reason", reason).drop("_planned", "_own", "_given", "_page", "_page_sources")


def unsafe(path: Column) -> Column:
    """Whether a relative path is absolute, empty, or leaves its folder."""
    return path.isNull() | (path == "") | F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, r"[/\\]"), "..")


def document_id(source_url: Column, raw_sha256: Column) -> Column:
    return F.concat(F.lit("doc-"), F.substring(F.sha2(F.concat(source_url, F.lit("\n"), raw_sha256), 256), 1, 20))


def read_run(spark: SparkSession, path: str) -> Run:
    targets, manifests = read_targets(spark, path), read_manifests(spark, path)
    whole = attributed(manifests.filter("_corrupt is null and url is not null"), targets)
    allowed = whole.filter("reason is null")
    empty = F.size(F.coalesce("snapshots", F.array())) == 0
    unavailable = allowed.filter(empty).select("url", "source_url", "plugin_id", "status", F.coalesce("error", "last_error").alias("error"), "pointer", "attribution")
    each = allowed.filter(~empty).select("*", F.posexplode("snapshots").alias("number", "snapshot"))
    bad = unsafe(F.col("snapshot.relative_path"))
    relative = F.col("snapshot.relative_path")
    snapshots = each.filter(~bad).select(
        "pointer", "plugin_id", "url", "source_url", F.coalesce(F.nullif("snapshot.final_url", F.lit("")), "url").alias("document_url"),
        F.coalesce(F.nullif("snapshot.requested_url", F.lit("")), "url").alias("requested_url"), "version_uri", "language", "references", "registry_entries", "discoveries",
        "imported_from", "status", "http_status", "number", F.concat("folder", relative).alias("path"), F.nullif(F.regexp_extract(relative, r"(?:^|/)(attempt-[^/]*)", 1), F.lit("")).alias("attempt"),
        F.col("snapshot.sha256").alias("raw_sha256"), F.col("snapshot.bytes_downloaded").alias("bytes"), F.col("snapshot.content_type").alias("content_type"),
        F.col("snapshot.retrieved_at").alias("retrieved_at"), F.col("snapshot.review_flags").alias("review_flags"), document_id(F.col("source_url"), F.col("snapshot.sha256")).alias("document_id"), "attribution",
    )
    corrupt = manifests.filter("_corrupt is not null or url is null").select("pointer", F.lit("corrupt manifest").alias("reason"))
    refused = corrupt.unionAll(whole.filter("reason is not null").select("pointer", "reason")).unionAll(each.filter(bad).select("pointer", F.lit("unsafe path").alias("reason")))
    return Run(targets, snapshots, unavailable, refused)


def strict(run: Run) -> Run:
    """The run, or an error that names the first things refused."""
    found = run.refused.orderBy("pointer", "reason").take(5)
    if found:
        raise RunError("; ".join(f"{r.reason}: {r.pointer}" for r in found))
    return run


def selected(snapshots: DataFrame, scope: str = "attributed", kinds: list[str] | None = None, sources: list[str] | None = None, document_ids: list[str] | None = None) -> DataFrame:
    """Snapshots by scope ("attributed" or "all"), kind, source and document id."""
    if scope not in ("attributed", "all"):
        raise RunError(f"unknown scope {scope}")
    kind, keep = F.col("attribution.kind"), F.lit(True)
    if scope == "attributed":
        keep = keep & kind.isin(*ATTRIBUTED)
    if kinds:
        keep = keep & kind.isin(*kinds)
    if sources:
        keep = keep & F.arrays_overlap("attribution.source_ids", F.array(*map(F.lit, sources)))
    if document_ids:
        keep = keep & F.col("document_id").isin(*document_ids)
    return snapshots.filter(keep)


def first_of_each(snapshots: DataFrame) -> DataFrame:
    """One snapshot per document id: a plugin's before an ordinary page's, then by pointer and number."""
    order = F.struct(F.col("plugin_id").isNull().alias("late"), F.coalesce("plugin_id", F.lit("")).alias("plugin"), "pointer", "number")
    return snapshots.groupBy("document_id").agg(F.min_by(F.struct(*snapshots.columns), order).alias("s")).select("s.*")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """path (below the run), length, sha256 and content of every file in attempt folders. Without ``content`` selected,
    a row is a path and two values."""
    root = _root(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(_relative(root).alias("path"), F.octet_length("content").cast("bigint").alias("length"), F.sha2("content", 256).alias("sha256"), "content")
    return files.filter(F.col("path").rlike(r"^(?:[^/]+-documents/)?pages/"))


def verified(snapshots: DataFrame, responses: DataFrame) -> DataFrame:
    """``snapshots`` with ``verdict``: intact, missing, size differs, hash differs."""
    there = responses.select("path", F.col("length").alias("_length"), F.col("sha256").alias("_sha256"))
    verdict = F.when(F.col("_sha256").isNull(), "missing").when(~F.col("_length").eqNullSafe(F.col("bytes")), "size differs").when(~F.col("_sha256").eqNullSafe(F.col("raw_sha256")), "hash differs").otherwise("intact")
    return snapshots.join(there, "path", "left").withColumn("verdict", verdict).drop("_length", "_sha256")


def intact_bytes(snapshots: DataFrame, responses: DataFrame) -> DataFrame:
    """``snapshots`` with ``content``, those only whose response is what the manifest says."""
    same = responses.select("path", F.col("length").alias("bytes"), F.col("sha256").alias("raw_sha256"), "content")
    return snapshots.join(same, ["path", "bytes", "raw_sha256"])
