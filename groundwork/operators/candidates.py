"""Candidates that a model proposed, checked against the records that they quote and packaged with their citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EVIDENCE = "array<struct<evidence_id:string,block_id:string,block_number:bigint,start:bigint,end:bigint,quote:string,text_sha256:string>>"


def _blank(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\s*$"), F.lit(True))


def evidence_issues(candidates: DataFrame, records: DataFrame, blocks: DataFrame) -> DataFrame:
    """candidate_id, reason, ranges: why the evidence of a candidate doesn't hold, or the ranges of blocks that it cites.

    ``candidates``: candidate_id, document_id, evidence; ``records``: document_id, content_text, content_sha256; ``blocks``:
    document_id, block_number, block_id, start, end, text, text_sha256. Spans are checked in their order, and of each the
    number, the place, the id that follows from its offsets, then text and hashes; the first that fails is the reason.
    Quotes are checked against blocks, and blocks against their records, so a record's text meets its blocks only.
    """
    intact = records.select("document_id", (F.sha2("content_text", 256) == F.col("content_sha256")).alias("intact"))
    asked = candidates.select("candidate_id", "document_id", "evidence").join(intact, "document_id", "left")
    none = F.size(F.coalesce("evidence", F.array().cast(EVIDENCE))) == 0
    early = F.when(F.col("intact").isNull(), "no record").when(~F.coalesce("intact", F.lit(False)), "content hash").when(none, "no evidence")
    asked = asked.withColumn("early", early)
    spans = asked.filter("early is null").select("candidate_id", "document_id", F.posexplode("evidence").alias("at", "e"))
    place = F.substring(F.col("content_text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    sound = blocks.join(records.select("document_id", "content_text"), "document_id").select(
        "document_id", "block_number", "block_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"), "text", "text_sha256", (place & (F.sha2("text", 256) == F.col("text_sha256"))).alias("sound"),
    )
    met = spans.withColumn("block_number", F.col("e.block_number")).join(sound, ["document_id", "block_number"], "left")
    left, right = F.col("e.start") - F.col("b_start"), F.col("e.end") - F.col("b_start")
    inside = (left >= 0) & (left < right) & (F.col("e.end") <= F.col("b_end"))
    number = F.col("block_number").cast("string")
    identity = F.concat(F.lit("b"), F.lpad(number, F.greatest(F.lit(5), F.length(number)), F.lit("0")), F.lit(":"), left.cast("string"), F.lit(":"), right.cast("string"))
    same = (F.col("e.block_id") == F.col("block_id")) & (F.col("e.text_sha256") == F.col("text_sha256")) & (F.col("e.quote") == F.substring(F.col("text"), left + 1, right - left)) & F.col("sound")
    reason = (
        F.when(F.col("b_start").isNull(), "block number").when(~F.coalesce(inside, F.lit(False)), "outside block")
        .when(~F.coalesce(F.col("e.evidence_id") == identity, F.lit(False)), "evidence id").when(~F.coalesce(same, F.lit(False)), "evidence changed")
    )
    met = met.withColumn("reason", reason)
    # runs of consecutive blocks: the places where a number has none before it
    numbers = F.array_sort(F.collect_set("block_number"))
    per = met.groupBy("candidate_id").agg(F.min(F.when(F.col("reason").isNotNull(), F.struct("at", "reason"))).alias("first"), numbers.alias("n"))
    firsts = F.filter("n", lambda x: ~F.array_contains("n", x - 1))
    lasts = F.filter("n", lambda x: ~F.array_contains("n", x + 1))
    ranges = F.when(F.col("first").isNull(), F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first_block"), b.alias("last_block"))))
    per = per.select("candidate_id", F.col("first.reason").alias("late"), ranges.alias("ranges"))
    return asked.join(per, "candidate_id", "left").select("candidate_id", F.coalesce("early", "late").alias("reason"), "ranges")


def packaged(candidates: DataFrame, records: DataFrame, blocks: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """candidate_id, reason, concept_id, ranges of every candidate: the first reason that keeps it out, or its id and citations.

    ``candidates`` have candidate_id, document_id, preferred_label, description, confidence, validation_state, decision, issue,
    review_reason, language and evidence. Ids are made of labels; of several the first has the plain one, by candidate_id, and
    the others a number.
    """
    c = F.col
    reason = (
        F.when(~F.coalesce((c("validation_state") == "CANDIDATE") & (c("decision") == "supported") & (c("issue") == "none"), F.lit(False)) | _blank(c("review_reason")), "no supported review")
        .when(~F.coalesce(c("confidence").between(0, 1) & ~F.isnan("confidence"), F.lit(False)), "confidence").when(c("confidence") < min_confidence, "low confidence")
        .when(_blank(c("preferred_label")) | _blank(c("description")), "label or description")
        .when(~F.coalesce(F.lower(F.regexp_extract("language", "^([^_-]*)", 1)).rlike("^[a-z]{2}$"), F.lit(False)), "language")
    )
    rows = candidates.withColumn("_own", reason)
    checked = evidence_issues(rows.filter("_own is null"), records, blocks)
    rows = rows.select("candidate_id", "preferred_label", "_own").join(checked, "candidate_id", "left").withColumn("reason", F.coalesce("_own", "reason"))
    slug = F.trim(F.regexp_replace(F.lower("preferred_label"), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))
    good = rows.filter("reason is null").select("candidate_id", F.coalesce(F.nullif(slug, F.lit("")), F.lit("concept")).alias("slug"))
    good = good.withColumn("nth", F.row_number().over(Window.partitionBy("slug").orderBy("candidate_id")))
    ids = good.select("candidate_id", F.when(c("nth") == 1, c("slug")).otherwise(F.concat("slug", F.lit("-"), c("nth").cast("string"))).alias("concept_id"))
    return rows.join(ids, "candidate_id", "left").select("candidate_id", "reason", "concept_id", "ranges")
