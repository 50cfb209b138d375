"""Importance resampling towards a target corpus, by inverted postings in ranges of buckets.

Features are the runs of one to ``MOST`` words, hashed to buckets. Each block of documents sends, to each range of
buckets, its postings (bucket, document, count), packed; where postings meet the counts that both corpora have in the
buckets of their range, each bucket's gain, the log ratio of its smoothed shares, is computed once and the documents'
contributions are summed. A document's weight is the floored mean of its features' gains. Documents are drawn without
replacement with probabilities that follow their weights: the greatest sums of weight and Gumbel noise, the noise being
a hash of the seed and the id.

Of a bucket that every document holds, the postings are dealt to parts: the counts of a range, at most as many as it has
buckets, are copied to ``parts`` groups of blocks, so that a task has one range and at most ``PART_BLOCKS`` blocks.

Defined results: null and empty texts have no features and weight 0; a null id is drawn with the noise of an empty id;
rows that repeat an id share their noise and are ranked in the order of their blocks; other columns, whatever their
names, are ignored; an empty table gives no rows; without a target text all buckets count 0 there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import blocks_of, pack, unpack
from .scratch import release, written

BUCKETS, MOST, SHARE, MIN_WORDS, SEED = 10_000, 2, 25, 20, 7
BLOCK_CHARS = 4_000_000
#: Ranges of buckets, and blocks of documents, whose postings meet in one task.
RANGES, PART_BLOCKS = 16, 256
#: Bytes that are no part of words are blanks, A-Z lower-cased.
_PLAIN = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def features(texts: list[bytes], buckets: int = BUCKETS, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; text and bucket of each feature."""
    words, sizes = [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        own = t.translate(_PLAIN).split()
        sizes[k] = len(own)
        words += own
    doc = np.repeat(np.arange(len(texts)), sizes)
    sums = list(map(crc32, words))
    docs, found = [doc], [np.array(sums, np.int64)]
    spaced = [b" " + w for w in words]
    for n in range(2, most + 1):  # the checksum of a run goes on from that of the run without its last word
        sums = list(map(crc32, spaced[n - 1 :], sums))
        inside = doc[: len(sums)] == doc[n - 1 :]
        docs.append(doc[: len(sums)][inside])
        found.append(np.array(sums, np.int64)[inside])
    return sizes, np.concatenate(docs), np.concatenate(found) % buckets


_POSTINGS = "block bigint, nth bigint, doc_id bigint, n_words bigint, n_features bigint, range int, counts array<bigint>, postings binary"


def _posted(docs: DataFrame, buckets: int, most: int, ranges: int) -> DataFrame:
    """A row per document, with its place in its block; a row per block and range, with counts by bucket and postings."""
    names = [c.split()[0] for c in _POSTINGS.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.list_(pa.int64()), pa.binary()]
    edges = [-(-buckets * k // ranges) for k in range(ranges + 1)]

    def rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[n].cast(k) if n in columns else pa.nulls(size, k) for n, k in zip(names, kinds)], names)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, t in blocks_of(batches, "text", BLOCK_CHARS):
            n = t.num_rows
            sizes, doc, bucket = features([x or b"" for x in t["text"].cast(pa.binary()).to_pylist()], buckets, most)
            yield rows(n, block=pa.array(np.full(n, block)), nth=pa.array(np.arange(n)), doc_id=t["doc_id"].combine_chunks(), n_words=pa.array(sizes), n_features=pa.array(np.bincount(doc, minlength=n)))
            posting, count = np.unique(bucket * n + doc, return_counts=True)  # by bucket, then document
            bucket, doc = posting // n, posting % n
            per, total = np.bincount(bucket, minlength=buckets), np.bincount(bucket, count, minlength=buckets).astype(np.int64)
            cut = np.searchsorted(bucket, edges)
            small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
            packed = [pack(small(per[a:b]), small(doc[i:j]), small(count[i:j])) for a, b, i, j in zip(edges, edges[1:], cut, cut[1:])]
            counts = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(total))
            yield rows(ranges, block=pa.array(np.full(ranges, block)), range=pa.array(np.arange(ranges)), counts=counts, postings=pa.array(packed, pa.binary()))

    return docs.mapInArrow(post, _POSTINGS)


def _by_bucket(posted: DataFrame, name: str) -> DataFrame:
    """Counts by range and bucket of it: at most a row a bucket from each task."""
    return posted.filter("range is not null").select("range", F.posexplode("counts").alias("bucket", "n")).groupBy("range", "bucket").agg(F.sum("n").alias(name))


def gain(s: int, t: int, all_s: int, all_t: int, buckets: int = BUCKETS) -> int:
    """Of a bucket with ``s`` of the corpus's and ``t`` of the target's features: 1000 times its smoothed log ratio, floored."""
    return math.floor(1000 * math.log((float(t) + 1) * (float(all_s) + buckets) / ((float(s) + 1) * (float(all_t) + buckets))))


def _contributed(posted: DataFrame, counts: DataFrame, all_s: int, all_t: int, buckets: int, part_blocks: int) -> DataFrame:
    """block, nth, gains: what each range of buckets adds to each document."""

    def contribute(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        gains = np.array([gain(s, t, all_s, all_t, buckets) for s, t in zip(right["s"].to_pylist(), right["t"].to_pylist())], np.int64)
        blocks, sums = [], []
        for block, raw in zip(left["block"].to_pylist(), left["postings"].to_pylist()):
            per, doc, count = unpack(raw)
            total = np.bincount(doc, weights=np.repeat(gains[: len(per)], per) * count.astype(np.int64)).astype(np.int64)  # exact below 2**53
            blocks.append(block), sums.append(pack(total))
        return pa.table({"block": pa.array(blocks, pa.int64()), "sums": pa.array(sums, pa.binary())})

    part = F.floor(F.xxhash64("block") % F.lit(1 << 20)).cast("bigint")
    parts = max(1, -(-posted.filter("range = 0").count() // part_blocks))
    left = posted.filter("range is not null").select("range", F.pmod(part, F.lit(parts)).alias("part"), "block", "postings")
    right = counts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    return left.groupBy("range", "part").cogroup(right.groupBy("range", "part")).applyInArrow(contribute, "block bigint, sums binary")


def _weighed(contributed: DataFrame, posted: DataFrame) -> DataFrame:
    """The documents with the sums of their gains."""

    def reduce(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        total = np.zeros(left.num_rows, np.int64)
        for raw in right["sums"].to_pylist():
            (part,) = unpack(raw)
            total[: len(part)] += part
        left = left.sort_by("nth")
        n = left["n_features"].to_numpy()
        weight = np.where(n > 0, total // np.maximum(n, 1), 0)
        return left.append_column("weight", pa.array(weight)).select(["block", "nth", "doc_id", "n_words", "n_features", "weight"])

    docs = posted.filter("nth is not null").select("block", "nth", "doc_id", "n_words", "n_features")
    return docs.groupBy("block").cogroup(contributed.groupBy("block")).applyInArrow(reduce, "block bigint, nth bigint, doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """``rank`` of the ``most`` first rows by falling score, then id, block and place: positions of a range sort."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "block", "nth"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("slice", F.shiftright("at", 33)), "importance-order")
    slices = placed.groupBy("slice").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # a row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = slices.select("slice", "first", before.alias("before")).filter(F.col("before") < most)
    ranked = placed.join(F.broadcast(starts), "slice").withColumn("rank", F.col("before") + F.col("at") - F.col("first") + 1)
    return ranked.filter(F.col("rank") <= most).select("block", "nth", "rank")


def resampled(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", share: int = SHARE, min_words: int = MIN_WORDS,
    seed: int = SEED, buckets: int = BUCKETS, most: int = MOST, ranges: int = RANGES, part_blocks: int = PART_BLOCKS,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document, and the rank of those drawn: ``share`` percent of
    the documents of at least ``min_words`` words."""
    posted = written(_posted(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), buckets, most, ranges), "postings")
    aim = _posted(target.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(target_text).alias("text")), buckets, most, ranges)
    aim = aim.filter("range is not null").select("range", "counts")
    every = docs.sparkSession.range(ranges).select(F.col("id").cast("int").alias("range"))
    every = every.select("range", F.expr(f"explode(sequence(0, int(ceil({buckets} * (range + 1) / {ranges}) - ceil({buckets} * range / {ranges})) - 1))").alias("bucket"))
    counts = every.join(_by_bucket(posted, "s"), ["range", "bucket"], "left").join(_by_bucket(aim, "t"), ["range", "bucket"], "left").na.fill(0)
    counts = written(counts, "bucket-counts")  # a row a bucket
    totals = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    weighed = _weighed(_contributed(posted, counts, totals.s, totals.t, buckets, part_blocks), posted)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed.withColumn("score", F.col("weight") + noise), "importance")
    release(docs.sparkSession)
    able = scored.filter(F.col("n_words") >= min_words)
    drawn = _ranked(able.select("block", "nth", "doc_id", "score"), share * able.count() // 100)
    return scored.join(drawn, ["block", "nth"], "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")
