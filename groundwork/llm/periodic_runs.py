"""Maximal runs: stretches of words that repeat with a period, found on suffix trees.

A run of period q and length L >= max(min_length, 2 q) holds every word of it in a sequence of ``ceil(min_length / 2)``
words that occurs twice in the document. Words outside such sequences can't be part of a run, so only the others, cut
where words are missing, go into the tree; all of them may, where a document repeats throughout.

The tree is that of the suffix array with its longest common prefixes, inner nodes of several children folded child by
child. A branching tandem repeat of depth D is a leaf i whose partner i + D lies below the same node, but not the same
child. The leaves of the smaller side of each fold are listed and both partners, i + D and i - D, looked up by rank, so
a leaf is listed at most log2(n) times. A repeat is the last rotation of its run: rotations to the left, by common
prefixes of doubling lengths, give where the run begins, and repeats of one stretch merge into that of least period.

Defined results: null and empty texts have no words and no runs; words are compared byte by byte; a null id is an id
like others; rows that repeat give a row each; other columns, whatever their names, are ignored; an empty table gives no
rows. A document is worked on whole, by one task; short ones together, in blocks of about ``BLOCK_CHARS`` characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks_of

MIN_LENGTH = 12
BLOCK_CHARS = 3_000_000
#: Leaves listed at a time.
_LISTED = 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _repeating(codes: np.ndarray, doc: np.ndarray, gram: int) -> np.ndarray:
    """Whether a word is part of ``gram`` consecutive words that occur twice in its document (equal hashes count as that)."""
    n = len(codes) - gram + 1
    if n < 2:
        return np.zeros(len(codes), bool)
    h = (doc[:n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(gram):
        h = (h ^ codes[k : k + n].astype(np.uint64)) * _ODD
        h ^= h >> np.uint64(32)
    at = np.flatnonzero(doc[:n] == doc[gram - 1 :])
    ordered = np.sort(h[at])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(codes), bool)
    place = np.minimum(np.searchsorted(twice, h[at]), len(twice) - 1)
    at = at[twice[place] == h[at]]
    edge = np.zeros(len(codes) + 1, np.int64)
    edge[at] += 1
    edge[at + gram] -= 1
    return np.cumsum(edge[:-1]) > 0


def _ranks(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of ``x`` (whose last symbol is unique) and, by k, the rank of each place by its first 2**k symbols."""
    n = len(x)
    active, key = np.argsort(x, kind="stable"), np.sort(x)
    base, rank, levels, h = np.zeros(n, np.int64), np.empty(n, np.int32), [], 1
    while True:
        at = np.arange(len(active))
        new = np.r_[True, key[1:] != key[:-1]]
        within = np.r_[True, base[1:] != base[:-1]]
        rank = rank.copy()
        rank[active] = base + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(within, at, 0))
        levels.append(rank)
        active = active[~(new & np.r_[new[1:], True])]
        if not len(active):
            break
        key = rank[active].astype(np.int64) * (n + 1) + rank[np.minimum(active + h, n - 1)]
        order = np.argsort(key, kind="stable")
        active, key, h = active[order], key[order], 2 * h
        base = rank[active].astype(np.int64)
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, levels


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """Length of the longest common prefix at places ``a`` and ``b``, or of the longest common stretch before them."""
    size = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        p, q = (a - size - (1 << k), b - size - (1 << k)) if back else (a + size, b + size)
        fits = (np.minimum(p, q) >= 0) & (np.maximum(p, q) < len(levels[k]))
        size += (fits & (levels[k][np.where(fits, p, 0)] == levels[k][np.where(fits, q, 0)])).astype(np.int64) << k
    return size


def _folds(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fold r of the leaves r - 1 and r: the first leaf of its left side, the end of its right side."""
    left, right, open_, values = [0] * len(lcp), [len(lcp)] * len(lcp), [], lcp.tolist()
    for i, v in enumerate(values):
        while open_ and values[open_[-1]] > v:
            right[open_.pop()] = i
        if open_:
            left[i] = open_[-1]
        open_.append(i)
    return np.array(left, np.int64), np.array(right, np.int64)


def maximal_runs(x: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and least period of every run of ``x``, by start and period. The last symbol of ``x`` is unique."""
    suffixes, levels = _ranks(x)
    rank = levels[-1]
    lcp = np.r_[0, _common(levels[:-1], suffixes[:-1], suffixes[1:])]
    left, right = _folds(lcp)
    r = np.flatnonzero(lcp)
    left, right, depth = left[r], right[r], lcp[r]
    small = r - left <= right - r
    first, count = np.where(small, left, r), np.minimum(r - left, right - r)
    low, high = np.where(small, r, left), np.where(small, right, r)  # the other side
    total, found = np.r_[0, np.cumsum(count)], []
    cuts = np.unique(np.r_[np.searchsorted(total, np.arange(0, total[-1], _LISTED)), len(r)])
    for i, j in zip(cuts[:-1], cuts[1:]):
        fold = np.repeat(np.arange(i, j), count[i:j])
        leaf = suffixes[np.arange(len(fold)) + total[i] - total[fold] + first[fold]]
        for step in (depth[fold], -depth[fold]):
            other = leaf + step
            fits = (other >= 0) & (other < len(x))
            at = rank[np.where(fits, other, 0)]
            hit = fits & (at >= low[fold]) & (at < high[fold])
            found.append(np.stack([np.minimum(leaf, other)[hit], depth[fold][hit]]))
    at, period = np.concatenate(found, 1) if found else np.empty((2, 0), np.int64)
    start, end = at - _common(levels, at, at + period, back=True), at + 2 * period
    keep = end - start >= min_length
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    least = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    start, end, period = start[least], end[least], period[least]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _runs_of(words: list[bytes], sizes: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (word of the block), length and period of every run of documents of ``sizes`` words each."""
    codes = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy()
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(_repeating(codes, doc, -(-min_length // 2)))
    if not len(at):
        return (np.empty(0, np.int64),) * 3
    # Equal words of one document share a symbol; a symbol of its own stands where words are missing
    ends = np.r_[(at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]]), True]
    own = np.flatnonzero(ends)
    _, symbols = np.unique(doc[at] * (int(codes.max()) + 1) + codes[at], return_inverse=True)
    x = np.insert(symbols.reshape(-1).astype(np.int64), own + 1, symbols.max() + 1 + np.arange(len(own)))
    where = np.insert(at, own + 1, -1)
    start, end, period = maximal_runs(x, min_length)
    return where[start], end - start, period


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and text: the words between single spaces, without those that a
    run holds after its first period."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in blocks_of(batches, "text", BLOCK_CHARS):
            each = [(x or b"").split() for x in t["text"].cast(pa.binary()).to_pylist()]
            sizes = np.array([len(w) for w in each], np.int64)
            words = [w for ws in each for w in ws]
            start, length, period = _runs_of(words, sizes, min_length)
            before = np.r_[0, np.cumsum(sizes)]
            of = np.searchsorted(before, start, side="right") - 1
            cut = np.searchsorted(of, np.arange(len(sizes) + 1))
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            gone, kept = np.cumsum(edge[:-1]) > 0, []
            for k, ws in enumerate(each):
                if cut[k] < cut[k + 1]:
                    ws = [w for w, g in zip(ws, gone[before[k] : before[k + 1]].tolist()) if not g]
                kept.append(b" ".join(ws))
            runs = pa.StructArray.from_arrays([pa.array(c) for c in (start - before[of], length, period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [t["doc_id"].combine_chunks(), pa.array(sizes), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), runs).cast(_RUNS), pa.array(kept, pa.binary()).view(pa.string())],
                ["doc_id", "n_words", "runs", "text"],
            )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(find, "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string")
