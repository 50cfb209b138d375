"""Anchors: block ranges that evidence is pinned to, and where they are in a newer version of their record."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.window import Window


def pinned(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """anchor_id, document, hashes, heading_path, start, end of ranges (anchor_id, document, first_block, last_block)."""
    inside = ranges.join(blocks, "document").filter(F.col("block_no").between(F.col("first_block"), F.col("last_block")))
    ordered = F.sort_array(F.collect_list(F.struct("block_no", "text_sha256", "heading_path", "start", "end")))
    got = inside.groupBy("anchor_id", "document").agg(ordered.alias("b"))
    return got.select("anchor_id", "document", F.transform("b", lambda x: x["text_sha256"]).alias("hashes"), F.col("b")[0]["heading_path"].alias("heading_path"), F.col("b")[0]["start"].alias("start"), F.element_at("b", -1)["end"].alias("end"))


def relocated(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """anchor_id, outcome, block_no of anchors (anchor_id, document, hashes, heading_path, block_no) in newer blocks.

    same-text: the sequence is where it was, or only there; moved: once elsewhere; ambiguous: more than once and
    the heading does not decide; changed: nowhere.
    """
    w = Window.partitionBy("document").orderBy("block_no")
    first = anchors.select("anchor_id", "document", "hashes", F.col("heading_path").alias("old_path"), F.col("block_no").alias("old_no"), F.col("hashes")[0].alias("text_sha256"), F.size("hashes").alias("n"))
    numbered = blocks.select("document", "block_no", "text_sha256", "heading_path", F.row_number().over(w).alias("at"))
    starts = first.join(numbered, ["document", "text_sha256"]).select("anchor_id", "document", "hashes", "old_path", "old_no", "n", "at", "block_no", "heading_path")
    # each start asks for the blocks that follow it, by place: an equi-join on the expanded places
    asked = starts.select("anchor_id", "document", "at", F.posexplode("hashes").alias("k", "want")).withColumn("place", F.col("at") + F.col("k"))
    seen = numbered.select("document", F.col("at").alias("place"), F.col("text_sha256").alias("have"))
    whole = asked.join(seen, ["document", "place"]).filter("want = have").groupBy("anchor_id", "at").agg(F.count("*").alias("m"))
    hits = starts.join(whole, ["anchor_id", "at"]).filter("m = n")
    same = (F.col("block_no") == F.col("old_no")) & F.col("heading_path").eqNullSafe(F.col("old_path"))
    found = hits.groupBy("anchor_id").agg(
        F.count("*").alias("hits"), F.max(F.when(same, F.col("block_no"))).alias("same_no"),
        F.count_if(F.col("heading_path").eqNullSafe(F.col("old_path"))).alias("n_path"),
        F.min(F.when(F.col("heading_path").eqNullSafe(F.col("old_path")), F.col("block_no"))).alias("path_no"), F.min("block_no").alias("any_no"),
    )
    out = anchors.select("anchor_id").join(found, "anchor_id", "left")
    outcome = F.when(F.col("hits").isNull(), "changed").when(F.col("same_no").isNotNull(), "same-text").when((F.col("hits") == 1) | (F.col("n_path") == 1), "moved").otherwise("ambiguous")
    place = F.when(F.col("same_no").isNotNull(), F.col("same_no")).when(F.col("hits") == 1, F.col("any_no")).when(F.col("n_path") == 1, F.col("path_no"))
    return out.select("anchor_id", outcome.alias("outcome"), place.alias("block_no"))


def text_positions(rows: DataFrame, text: str, excerpt: str, out: str = "positions") -> DataFrame:
    """``rows`` with the places (code points, from 0) where the excerpt begins in the text, overlapping ones too."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t, e in zip(b.column(b.schema.get_field_index(text)).to_pylist(), b.column(b.schema.get_field_index(excerpt)).to_pylist()):
                at, own = (t or "").find(e) if e else -1, []
                while at >= 0:
                    own.append(at)
                    at = t.find(e, at + 1)
                found.append(own)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], [*b.schema.names, out])

    return rows.mapInArrow(find, type(rows.schema)([*rows.schema.fields]).add(out, ArrayType(LongType())))


def relocated_by_excerpt(changed: DataFrame, records: DataFrame, blocks: DataFrame) -> DataFrame:
    """anchor_id, outcome, start, end, first_block, last_block for anchors whose block sequence is nowhere.

    ``changed``: anchor_id, document, excerpt; ``records``: document, content; ``blocks``: document, block_no, start,
    end. An excerpt that stands once in the newer text is moved, into the blocks that cover it (they were merged or
    split); several times is ambiguous, never is changed.
    """
    found = text_positions(changed.join(records, "document", "left"), "content", "excerpt").drop("content")
    n = F.size("positions")
    outcome = F.when(n == 1, "moved").when(n > 1, "ambiguous").otherwise("changed")
    start = F.when(n == 1, F.get("positions", F.lit(0)))
    rows = found.select("anchor_id", "document", outcome.alias("outcome"), start.alias("start"), (start + F.length("excerpt")).alias("end"))
    near = rows.filter("start is not null").join(blocks.select("document", "block_no", F.col("start").alias("s"), F.col("end").alias("e")), "document").filter("s < end and start < e")
    cover = near.groupBy("anchor_id").agg(F.min("block_no").alias("first_block"), F.max("block_no").alias("last_block"))
    return rows.join(cover, "anchor_id", "left").drop("document")


def closest_blocks(changed: DataFrame, blocks: DataFrame, limit: int = 3) -> DataFrame:
    """anchor_id, rank, block_no, ratio: for excerpts (anchor_id, document, excerpt) that changed, the blocks of the newer record that read most like them."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ratios = [round(difflib.SequenceMatcher(None, x, y).ratio(), 3) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ratios, pa.float64())], ["anchor_id", "block_no", "ratio"])

    pairs = changed.join(blocks.select("document", "block_no", "text"), "document").select(F.col("anchor_id").cast("bigint"), F.col("block_no").cast("bigint"), "excerpt", "text")
    rated = pairs.mapInArrow(rate, "anchor_id bigint, block_no bigint, ratio double")
    w = Window.partitionBy("anchor_id").orderBy(F.desc("ratio"), "block_no")
    return rated.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("anchor_id", "rank", "block_no", "ratio")
