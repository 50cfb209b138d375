"""Blocks of documents, and packed exchanges between blocks and hash ranges.

Statistics over words or passages of a whole corpus meet in hash ranges (shards). Before anything is shuffled,
each block of documents, of about ``BLOCK_CHARS`` characters, reduces its own occurrences to distinct keys, so a
frequent key costs one entry a block. The entries of a block for a shard travel as one row of packed arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

#: Characters of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 12_000_000


def blocks_of(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, pa.Table]]:
    """(block number, rows) in the order read; numbers are unique over all tasks of a job."""
    from pyspark import TaskContext

    number, held, size = TaskContext.get().partitionId() << 24, [], 0
    for batch in batches:
        at = batch.schema.get_field_index(text)
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            held.append(part)
            size += sum(len(t or "") for t in part.column(at).to_pylist())
            if size >= limit:
                yield number, pa.Table.from_batches(held)
                number, held, size = number + 1, [], 0
    if held:
        yield number, pa.Table.from_batches(held)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, bytes of equal weight together."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize, ord(a.dtype.kind)))], "<i8")
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"" for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + body)


def unpack(raw: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    head, at, out = np.frombuffer(data, "<i8", 3 * n, 8).reshape(n, 3), 8 + 24 * n, []
    for size, width, kind in head:
        part = np.frombuffer(data, np.uint8, size * width, at).reshape(width, size).T
        out.append(np.ascontiguousarray(part).view(np.dtype(f"{chr(kind)}{width}")).reshape(size))
        at += size * width
    return out


def shard_bounds(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of 64-bit hashes begins in a sorted array (n + 1 places)."""
    edges = (np.arange(1, n, dtype=np.float64) * (2.0**64 / n)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]]).astype(np.int64)
