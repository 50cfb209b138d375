"""Best-fit packing planned on the length histogram.

Texts are tokenised once; longer documents are cut into pieces of at most ``capacity`` tokens (all full but the
first). Only the histogram of piece lengths, at most ``capacity`` counts, reaches the driver. Best-fit decreasing
runs over counts there: lengths from long to short, each taking the tightest open sequences first. The plan is a
short table of slot ranges per length, and a piece takes the slot of its rank among the pieces of its length.

Defined results: a null text counts as empty and is one piece holding the end id alone; rows that repeat are
packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import written

CAPACITY = 1024
END_ID = 2
#: Counts by block and length up to which they are broadcast (about 50 MB); more are joined in a shuffle.
BROADCAST_COUNTS = 500_000


_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Texts of these characters only are split here as the tokenizer splits them; all others it splits itself.
_USUAL = re.compile(f"[\\t\\n\\r\x20-\x7e{_LETTERS}¡¿«»–—‘’“”…]*\\Z")
# The commonest kinds come first: letters and digits begin no other kind
_WORDS = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_ASCII_WORDS = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


class WordEncoder:
    """Ids of texts from the merges of a byte-level tokenizer file, one lookup per word.

    Merges never cross words, so a word's ids are those it has alone: distinct words go through the tokenizer in
    batches and are kept; texts are then joined from them.
    """

    KEEP = 800_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.single = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.whole, self.single):
            t.encode_special_tokens = True  # their strings in a text are ordinary text
        self.single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        known = self.known
        if len(known) > self.KEEP:
            known.clear()
        split = [(_ASCII_WORDS if t.isascii() else _WORDS).findall(t) if _USUAL.match(t) else None for t in texts]
        new = list(set(chain.from_iterable(ws for ws in split if ws)).difference(known))
        for w, e in zip(new, self.single.encode_batch_fast(new, add_special_tokens=False)):
            known[w] = array("I", e.ids).tobytes()
        return [
            np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4") if ws is None else np.frombuffer(b"".join(map(known.__getitem__, ws)), "<u4")
            for t, ws in zip(texts, split)
        ]


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for all tasks that a Python worker runs, so that words seen before are known."""
    return WordEncoder(path)


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, block int, nth bigint"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: its place in the document, checksum and rank within (block, length).

    A block is what one task reads, so ``nth`` is counted while the pieces are made. ``keep_ids`` adds the ids.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, encoder, count = TaskContext.get().partitionId(), word_encoder(tokenizer_path), defaultdict(int)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    n = -(-len(ids) // capacity)
                    ends = [len(ids) - capacity * k for k in range(n - 1, -1, -1)]
                    for k, (start, end) in enumerate(zip([0, *ends], ends)):
                        raw = ids[start:end].tobytes()
                        out.append((doc_id, k, start, end - start, zlib.crc32(raw), block, count[end - start], *([raw] if keep_ids else [])))
                        count[end - start] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *([pa.binary()] if keep_ids else [])]
                columns = list(zip(*out)) or [[] for _ in kinds]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth", *(["ids"] if keep_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.mapInArrow(cut, _PIECES + (", ids binary" if keep_ids else ""))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slot ranges (length, first rank, end rank, per sequence, first sequence, offset) of best-fit decreasing.

    ``histogram``: pieces by length. Sequences with equal room left are kept as ranges, so the work depends on
    the number of lengths only.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: ranges (first sequence, count)
    slots, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            fit = min((r for r, ranges in room.items() if r >= length and ranges), default=None)
            if fit is None:
                per = capacity // length
                fresh = -(-left // per)
                room[capacity].append((opened, fresh))
                opened, fit = opened + fresh, capacity
            first, count = room[fit].pop()
            per = fit // length
            full = min(count, left // per)
            for sequences, each in ((full, per), (1 if full < count and left - full * per else 0, min(per, left - full * per))):
                if sequences:
                    slots.append((length, rank, rank + sequences * each, each, first, capacity - fit))
                    room[fit - each * length].append((first, sequences))
                    rank, left, first, count = rank + sequences * each, left - sequences * each, first + sequences, count - sequences
            if count:
                room[fit].append((first, count))
    return slots


_SLOTS = T.StructType([T.StructField(c, T.LongType()) for c in ("length", "rank_from", "rank_to", "per", "sequence_from", "offset_from")])


def packed(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece (and its ids, if kept)."""
    spark = docs.sparkSession
    cut = written(pieces(docs.select(F.col(doc_id).cast("bigint"), text), tokenizer_path, capacity, end_id, keep_ids), "pieces")
    per_block = written(cut.groupBy("block", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in per_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots = spark.createDataFrame(plan(histogram, capacity), _SLOTS)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    few = per_block.count() <= BROADCAST_COUNTS
    ranked = cut.join(F.broadcast(starts) if few else starts.hint("merge"), ["block", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    # The plan has a few ranges per length, whatever the number of documents
    took = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & ranked["rank"].between(slots["rank_from"], slots["rank_to"] - 1))
    nth = F.col("rank") - F.col("rank_from")
    return took.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("sequence_from") + F.floor(nth / F.col("per"))).cast("bigint").alias("sequence_id"),
        (F.col("offset_from") + F.pmod(nth, F.col("per")) * ranked["length"]).cast("bigint").alias("offset"),
        *(["ids"] if keep_ids else []),
    )
