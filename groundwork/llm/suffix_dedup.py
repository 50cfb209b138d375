"""Removal of long strings that an earlier document holds, by distributed prefix doubling.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. Places are ranked
by their first 8 bytes, which are their own rank; a rank of h bytes and that of the place h further on name the 2h bytes
there, and two of 32 bytes, 18 apart, name the 50 of the threshold. Names are 64 bits (96 where a decision rests on one
alone); Spark brings equal ones together in ranges of names, and places whose rank is unique take no further part.

Three things keep a rank from being sent for each byte and doubling:

- Of the ranks of 32 bytes only each window's least is sent, a sample of a tenth of all places that equal windows share.
  The windows with one sample are its segment; the name of the segment, the bytes that all its windows cover, goes along.
- A rank that one document holds ends there. If all places of a rank have one segment, the smallest document keeps it
  and all others lose it, so copies are settled without their windows.
- Only where a rank has several segments, at the ends of repeats, are the ranks of ``length`` bytes of each window sent.

Blocks of documents send each distinct rank once, with the least id that has it, so a passage of every document costs an
entry a block. A segment cut by the slices that a long text is worked on in differs from others and is settled by windows.

Defined results: null texts are empty; null ids come after all others, and neither they nor rows that share an id take
from each other; a text shorter than ``length`` stays; what is left may end within a character, so it is bytes; other
columns, whatever their names, are ignored; an empty table gives no rows. The result does not depend on file layout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import pack, shard_bounds, unpack
from .scratch import release, written

LENGTH = 50
#: Bytes of text in a block, in a range of names, and worked on at a time.
BLOCK_BYTES, RANGE_BYTES, SLICE_BYTES = 4_000_000, 8_000_000, 500_000
_GRAM = 32
_NULL_ID = np.iinfo(np.int64).max
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xC2B2AE3D27D4EB4F)]
_HALF, _SHIFT = np.uint64(32), np.uint64(29)


def _name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a pair of ranks."""
    h = a * _M[0]
    h ^= h >> _HALF
    h += b
    h *= _M[1]
    h ^= h >> _SHIFT
    return h


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _HALF)) * _M[2]
    return h ^ (h >> _SHIFT)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys."""
    done = 1
    while 2 * done <= width:
        keys, done = np.minimum(keys[:-done], keys[done:]), 2 * done
    return np.minimum(keys[: len(keys) - (width - done)], keys[width - done :]) if done < width else keys


def _checks(words: dict[int, np.ndarray], length: int) -> np.ndarray:
    """A second, shorter name of windows, from the words of 8 bytes at each place in them."""
    h = np.full(len(words[0]), _M[2])
    for k in [*range(0, length - 8, 8), length - 8]:
        h = (h ^ words[k]) * _M[1]
        h ^= h >> _HALF
    return h


class _Slice:
    """Windows of ``length`` bytes of the documents that end at ``ends``, and their segments, for a slice of a block."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, start: int, stop: int, length: int):
        data, n = np.r_[data[start : stop + length - 1], np.zeros(8, np.uint8)], min(stop, len(data) - length + 1) - start
        self.words = np.ascontiguousarray(np.ndarray(len(data) - 7, "<u8", data, strides=(1,)))
        rank = _name(self.words[:-8], self.words[8:])
        self.rank = rank = _name(rank[:-16], rank[16:])
        places = np.arange(len(rank), dtype=np.uint64)
        least = _least(((rank >> _HALF) << _HALF) | places, length - _GRAM + 1)[:n]
        held = np.diff(np.clip(ends - start, 0, len(least)), prepend=0)  # places of each document
        some = np.flatnonzero(held)
        doc = np.repeat(some, held[some])
        self.at = np.flatnonzero(np.arange(start + length, start + length + len(doc)) <= np.repeat(ends[some], held[some]))
        self.doc, self.length = doc[self.at], length
        sample = (least[self.at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (sample[1:] != sample[:-1]) | (self.doc[1:] != self.doc[:-1])][: len(sample)])
        self.first, self.last = self.at[first], self.at[np.r_[first[1:], len(sample)][: len(first)] - 1]
        # least ranks crowd at the low end; a bijection spreads them over the ranges of names
        self.owner, self.key = self.doc[first], _spread(rank[sample[first]])

    def segments(self) -> np.ndarray:
        ends_of = _name(self.windows(self.first), self.windows(self.last))
        return _name(ends_of, (self.last - self.first).astype(np.uint64))

    def windows(self, at: np.ndarray) -> np.ndarray:
        return _name(self.rank[at], self.rank[at + self.length - _GRAM])

    def checks(self, at: np.ndarray) -> np.ndarray:
        return _checks({k: self.words[at + k] for k in [*range(0, self.length - 8, 8), self.length - 8]}, self.length)


def _windows_at(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the windows that begin at ``at``, and second, shorter names of the same bytes."""
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    part = {k: words[at + k] for k in sorted({*range(0, length - 8, 8), *range(length - _GRAM, length, 8)})}
    ranks = [_name(_name(part[k], part[k + 8]), _name(part[k + 16], part[k + 24])) for k in (0, length - _GRAM)]
    return _name(*ranks), _checks(part, length)


class _Block:
    """The texts of a block, one after another, and the ids of their rows in order."""

    def __init__(self, payload: bytes):
        raw = zstandard.ZstdDecompressor().decompress(payload)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        self.ids, sizes = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(2, n)
        self.data, self.ends = np.frombuffer(raw, np.uint8, -1, 8 + 16 * n), np.cumsum(sizes)

    @staticmethod
    def payload(ids: list[int | None], texts: list[bytes]) -> bytes:
        head = np.array([len(ids), *(_NULL_ID if i is None else i for i in ids), *map(len, texts)], "<i8")
        return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(texts))


def _slices(block: _Block, length: int, size: int) -> Iterator[tuple[int, _Slice]]:
    for start in range(0, len(block.data) - length + 1, size):
        yield start, _Slice(block.data, block.ends, start, start + size, length)


def _blocks(docs: DataFrame, most: int) -> DataFrame:
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, size = TaskContext.get().partitionId() << 24, [], [], 0

        def block() -> pa.RecordBatch:
            columns = [pa.array([number]), pa.array([size]), pa.array([_Block.payload(ids, texts)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", "n_bytes", "payload"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                ids.append(doc_id)
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= most or len(ids) >= most // 16:
                    yield block()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield block()

    return docs.mapInArrow(gather, "block bigint, n_bytes bigint, payload binary")


_ENTRIES = "shard bigint, block bigint, entries binary"


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows by ``keys`` (the last one first) and where in it each distinct first key begins."""
    order = np.lexsort(keys)
    k = keys[-1][order]
    return order, np.r_[True, k[1:] != k[:-1]][: len(k)]


def _rows(block: int, n: int, by: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    edge = shard_bounds(by, n)
    return [(k, block, pack(*(c[edge[k] : edge[k + 1]] for c in (by, *columns)))) for k in range(n) if edge[k + 1] > edge[k]]


def _ranks_of(block: _Block, length: int, size: int) -> tuple[np.ndarray, ...]:
    """Distinct ranks of a block in order: rank, segment, whether it has several, the least id."""
    parts = [(s.key, s.segments(), block.ids[s.owner]) for _, s in _slices(block, length, size)]
    key, segment, ids = (np.concatenate(c) for c in zip(*parts)) if parts else (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64))
    order, new = _distinct(ids, segment, key)
    at = np.flatnonzero(new)
    segment = segment[order]
    several = np.logical_or.reduceat(segment != np.repeat(segment[at], np.diff(np.r_[at, len(order)])), at) if len(at) else np.empty(0, bool)
    return key[order][at], segment[at], several, np.minimum.reduceat(ids[order], at) if len(at) else ids


def _ranked(blocks: DataFrame, n: int, length: int, size: int) -> DataFrame:
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, payload in zip(b.column("block").to_pylist(), b.column("payload")):
                key, *rest = _ranks_of(_Block(payload.as_py()), length, size)
                rows = _rows(number, n, key, *rest)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["shard", "block", "entries"])

    return blocks.select("block", "payload").mapInArrow(rank, _ENTRIES)


_UNIQUE, _EARLIER, _SEVERAL = 0, 1, 2


def _settled(entries: DataFrame, segments: bool) -> DataFrame:
    """By block and shard, of each entry: the least id of all is its own, an earlier one, or there are several segments."""

    def settle(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        parts = [unpack(x) for x in t["entries"].to_pylist()]
        cut = np.cumsum([0, *(len(p[0]) for p in parts)])
        key, other, *several, ids = (np.concatenate(c) for c in zip(*parts))
        del parts
        order = np.argsort(key, kind="stable") if segments else np.lexsort((other, key))
        key, other, ids = key[order], other[order], ids[order]
        new = np.r_[True, key[1:] != key[:-1]]
        if not segments:
            new[1:] |= other[1:] != other[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.r_[at, len(key)])
        state = np.where(np.repeat(np.minimum.reduceat(ids, at), size) < ids, _EARLIER, _UNIQUE).astype(np.uint8)
        if segments:
            differ = np.logical_or.reduceat((other != np.repeat(other[at], size)) | several[0][order], at)
            state[np.repeat(differ, size)] = _SEVERAL
        out = np.empty(len(order), np.uint8)
        out[order] = state
        return pa.table({"block": t["block"], "shard": t["shard"], "states": pa.array([pack(out[i:j]) for i, j in zip(cut, cut[1:])], pa.binary())})

    return entries.groupBy("shard").applyInArrow(settle, "block bigint, shard bigint, states binary")


def _states(t: pa.Table) -> np.ndarray:
    rows = sorted(zip(t["shard"].to_pylist(), t["states"].to_pylist()))
    return np.concatenate([np.empty(0, np.uint8), *(unpack(x)[0] for _, x in rows)])


def _opened(block: _Block, known: np.ndarray, length: int, size: int) -> tuple[np.ndarray, ...]:
    """Windows that a block is known to lose, as first and last places of runs; the open ones' place and the number of
    their name; the distinct names in order, with the least id of each."""
    parts = [(s.key, start + s.first, start + s.last, block.ids[s.owner]) for start, s in _slices(block, length, size)]
    key, begin, end, own = (np.concatenate(c) for c in zip(*parts)) if parts else (np.empty(0, k) for k in (np.uint64, np.int64, np.int64, np.int64))
    del parts
    order = np.argsort(key, kind="stable")
    ranks = key[order]
    new = np.r_[True, ranks[1:] != ranks[:-1]][: len(ranks)]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    ids = np.minimum.reduceat(own[order], np.flatnonzero(new)) if len(order) else own
    state = known[of]
    gone = (state == _EARLIER) | ((state == _UNIQUE) & (own > ids[of]))
    first, last = begin[gone], end[gone]
    several = np.flatnonzero(state == _SEVERAL)
    count = end[several] - begin[several] + 1
    at, docs = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - begin[several], count), np.repeat(own[several], count)
    names, checks = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
    for i in range(0, len(at), size):
        names[i : i + size], checks[i : i + size] = _windows_at(block.data, at[i : i + size], length)
    order = np.lexsort((docs, checks, names))
    a, b = names[order], checks[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    lead = order[new]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    # A window of a document after the block's first one goes whatever other blocks hold
    later = docs > docs[lead][of]
    return np.r_[first, at[later]], np.r_[last, at[later]], at[~later], of[~later], names[lead], checks[lead], docs[lead]


def _windows(blocks: DataFrame, states: DataFrame, n: int, length: int, size: int) -> DataFrame:
    def open_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        *_, names, checks, ids = _opened(_Block(left["payload"][0].as_py()), _states(right), length, size)
        columns = list(zip(*_rows(key[0].as_py(), n, names, checks, ids))) or [[], [], []]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["shard", "block", "entries"])

    return blocks.select("block", "payload").groupBy("block").cogroup(states.groupBy("block")).applyInArrow(open_up, _ENTRIES)


_KEPT = "doc_id bigint, n_bytes bigint, kept binary, removed array<struct<start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _kept(blocks: DataFrame, states: DataFrame, opened: DataFrame, length: int, size: int) -> DataFrame:
    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block, of_windows = _Block(left["payload"][0].as_py()), right["opened"].combine_chunks()
        known, late = _states(right.filter(pa.compute.invert(of_windows))), _states(right.filter(of_windows))
        first, last, at, of, *_ = _opened(block, known, length, size)
        at = at[late[of] == _EARLIER]
        edge = np.zeros(len(block.data) + 1, np.int32)
        for i, j in ((first, last), (at, at)):
            np.add.at(edge, i, 1)
            np.add.at(edge, j + length, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        begin = np.r_[0, block.ends[:-1]]
        fresh = gone.copy()
        fresh[1:] &= ~gone[:-1]
        fresh[begin[begin < len(gone)]] = gone[begin[begin < len(gone)]]  # a span ends with its document
        start = np.flatnonzero(fresh)
        stop = np.flatnonzero(np.r_[gone[:-1] & (~gone[1:] | fresh[1:]), gone[-1:]]) + 1
        owner = np.searchsorted(block.ends, start, side="right")
        kept, left_of = block.data[~gone].tobytes(), np.r_[0, np.cumsum(~gone)]
        cuts = pa.array(np.searchsorted(owner, np.arange(len(block.ids) + 1)), pa.int32())
        spans = pa.StructArray.from_arrays([pa.array(start - begin[owner]), pa.array(stop - begin[owner])], ["start", "end"])
        pieces = [kept[i:j] for i, j in zip(left_of[begin].tolist(), left_of[block.ends].tolist())]
        ids = pa.array(block.ids, mask=block.ids == _NULL_ID)
        return pa.table([ids, pa.array(block.ends - begin), pa.array(pieces, pa.binary()), pa.ListArray.from_arrays(cuts, spans).cast(_SPANS)], ["doc_id", "n_bytes", "kept", "removed"])

    both = states.withColumn("opened", F.lit(False)).unionByName(opened.withColumn("opened", F.lit(True)))
    return blocks.select("block", "payload").groupBy("block").cogroup(both.groupBy("block")).applyInArrow(cut, _KEPT)


def _settle_disks(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of the phase before. It holds on to a query's plan until the next one has begun."""
    spark.range(1).collect()
    release(spark)


def without_earlier_strings(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that are left) and removed (spans of the old text's bytes) of every row."""
    if not _GRAM + 8 <= length <= 2 * _GRAM:
        raise ValueError(f"length must be {_GRAM + 8} to {2 * _GRAM}")
    spark = docs.sparkSession
    blocks = written(_blocks(docs.select(F.col(doc_id).cast("bigint"), F.col(text)), block_bytes), "suffix-blocks")
    n = max(1, -(-(blocks.agg(F.sum("n_bytes")).first()[0] or 0) // range_bytes))
    states = written(_settled(_ranked(blocks, n, length, slice_bytes), segments=True), "suffix-states")
    _settle_disks(spark)
    opened = written(_settled(_windows(blocks, states, n, length, slice_bytes), segments=False), "suffix-windows")
    _settle_disks(spark)
    return _kept(blocks, states, opened, length, slice_bytes)
