"""Substring deduplication over sliding sentence spans.

Every run of ``RUN`` consecutive sentences is hashed, whatever its length in words, and so is every shorter run of at
least ``LONG_WORDS`` words, so that a long passage of one or two sentences counts too. Runs are compared by 128-bit
hashes of all their words, over the whole corpus, in hash ranges that get one entry per block of documents and hash.
The first place of a repeated span is the one with the smallest document id (of rows that share an id, the one with
the smallest text hash), then the first position; sentences covered by any other place are removed.

A passage may begin and end inside sentences. With ``passage`` (words), windows of half as many words are compared as
well: of all windows within any ``passage`` consecutive words, the one with the least hash. So whatever two places share
of that length, they share a window; its words go from all places but the first, whole sentences or not. Up to half a
passage at either end of what is shared may stay.

Sentences end at ``.``, ``!`` or ``?`` before white space, at other scripts' full stops and marks, or at a line end;
what has no words joins the sentence before it. A Chinese or Japanese character counts as a word of its own.
Sentences are compared by their words, A-Z lower-cased. Removal takes the white space after a sentence along.

Defined results: null and empty texts have no sentences and give an empty text; null ids come last in the order;
rows that repeat lose all spans but the first row's; texts that are shorter than a span stay; other columns,
whatever their names, are ignored; an empty table gives no rows. The result does not depend on file layout.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks_of, pack, shard_bounds, unpack
from .scratch import written

RUN, LONG_WORDS = 3, 50
#: Characters of text whose spans meet in one hash range, about.
RANGE_CHARS = 32_000_000
_END = re.compile(r"[.!?]+\s+|[。｡．！？।॥؟۔]+\s*|\n\s*")
_WIDE = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")
_LAST = np.iinfo(np.int64).max


def sentences(text: str) -> list[tuple[int, int, bytes]]:
    """(start, end, words between single spaces) that tile the text."""
    out: list[tuple[int, int, bytes]] = []
    at = 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        words = b" ".join(text[at:end].encode("utf-8", "surrogatepass").lower().split())
        if words:
            out.append((at if out else 0, end, words))
        elif out and end > at:
            out[-1] = (out[-1][0], end, out[-1][2])
        else:
            continue  # white space before the first sentence belongs to it
        at = end
    return out


def _size(sentence: str, words: bytes) -> int:
    """Words between white space and wide characters."""
    if sentence.isascii():
        return words.count(b" ") + 1
    rest, wide = _WIDE.subn(" ", sentence)
    return wide + len(rest.split()) if wide else words.count(b" ") + 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spans(text: str | None, run: int = RUN, long_words: int = LONG_WORDS) -> tuple[int, np.ndarray, np.ndarray]:
    """How many sentences a text has; (m, 2) runs as first and last sentence; (m, 2) halves of their hashes."""
    each = sentences(text) if text else []
    n = len(each)
    if not n:
        return 0, np.empty((0, 2), np.int64), np.empty((0, 2), np.uint64)
    h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for *_, w in each), "<u8").reshape(-1, 2).astype(np.uint64)
    total = np.concatenate([[0], np.cumsum([_size(text[i:j], w) for i, j, w in each])])
    runs, hashes = [], []
    for size in range(1, min(run, n) + 1):
        at = np.arange(n - size + 1)
        if size < run:
            at = at[total[at + size] - total[at] >= long_words]
        if len(at):
            v = np.full((len(at), 2), size, np.uint64)
            for k in range(size):
                v = _mix(v * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64) + h[at + k])
            runs.append(np.stack([at, at + size - 1], 1)), hashes.append(v)
    if not runs:
        return n, np.empty((0, 2), np.int64), np.empty((0, 2), np.uint64)
    return n, np.concatenate(runs), np.concatenate(hashes)


def windows(text: str | None, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """(m, 2) windows of half a passage as first and last word, in order; (m, 2) halves of their hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    size, n = max(1, passage // 2), len(words)
    if n < passage:
        return np.empty((0, 2), np.int64), np.empty((0, 2), np.uint64)
    v, m = np.repeat(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)[:, None], 2, 1), 1
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
    while m < size:
        step = min(m, size - m)
        v, m = _mix(v[:-step] * odd + v[step:]), m + step
    at = np.lib.stride_tricks.sliding_window_view(v[:, 0], passage - size + 1).argmin(1)
    at = np.unique(at + np.arange(len(at)))
    return np.stack([at, at + size - 1], 1), v[at] ^ np.uint64(size)


_FIRST = "block bigint, nth bigint, doc_id bigint, text string, shard bigint, entries binary"
_PLACES = -1  # the "shard" of the row that says where a block's spans are


def _dealt(docs: DataFrame, n: int, run: int, long_words: int, passage: int | None) -> DataFrame:
    """The documents with their block; each block's distinct spans for each shard; where in the block they are."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("shard", pa.int64()), ("entries", pa.binary())])

        def rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

        for block, t in blocks_of(batches, "text"):
            for i in range(0, t.num_rows, 1024):
                b = t.slice(i, 1024).combine_chunks().to_batches()[0]
                yield rows(b.num_rows, block=pa.array(np.full(b.num_rows, block)), nth=pa.array(np.arange(i, i + b.num_rows)), doc_id=b.column("doc_id"), text=b.column("text"))
            texts = t["text"].to_pylist()
            ids = np.array([_LAST if i is None else i for i in t["doc_id"].to_pylist()], np.int64)
            ties = np.array([xxhash.xxh3_64_intdigest((x or "").encode("utf-8", "surrogatepass")) for x in texts], np.uint64)
            order = np.lexsort((np.arange(len(ids)), ties, ids))
            each = [spans(texts[k], run, long_words) for k in order]
            held = [e[1:] for e in each] + ([windows(texts[k], passage) for k in order] if passage else [])
            of_doc = np.repeat(np.arange(len(held)) % len(order), [len(r) for r, _ in held])
            by_word = np.repeat(np.arange(len(held)) >= len(order), [len(r) for r, _ in held])
            doc = order[of_doc]
            runs, hashes = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            # spans of one document in the order of their places
            place = np.lexsort((runs[:, 1], runs[:, 0], of_doc))
            doc, runs, hashes, by_word = doc[place], runs[place], hashes[place], by_word[place]
            distinct, first, of, count = np.unique(hashes.view("u8,u8").reshape(-1), return_index=True, return_inverse=True, return_counts=True)
            h1, h2, of = distinct["f0"], distinct["f1"], of.reshape(-1)
            edge = shard_bounds(h1, n)
            kept = [k for k in range(n) if edge[k + 1] > edge[k]]
            own = [h1, h2, ids[doc[first]], ties[doc[first]], (count > 1).astype("u1")]
            packed = [pack(*(x[edge[k] : edge[k + 1]] for x in own)) for k in kept]
            sizes = np.zeros(len(order), np.int64)
            sizes[order] = [e[0] for e in each]
            places = pack(sizes.astype("<u4"), doc.astype("<u4"), runs[:, 0].astype("<u4"), runs[:, 1].astype("<u4"), of.astype("<u4"), by_word.astype("u1"))
            yield rows(1 + len(kept), block=pa.array(np.full(1 + len(kept), block)), shard=pa.array([_PLACES, *kept]), entries=pa.array([places, *packed], pa.binary()))

    return docs.mapInArrow(deal, _FIRST)


def _judged(entries: DataFrame) -> DataFrame:
    """By block and shard, for each distinct hash: 0 not repeated, 1 repeated with its first place in this block, 2 elsewhere."""

    def judge(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        parts = [unpack(x) for x in t["entries"].to_pylist()]
        sizes = [len(p[0]) for p in parts]
        h1, h2, ids, ties, again = (np.concatenate([p[k] for p in parts]) for k in range(5))
        block = np.repeat(np.arange(len(parts)), sizes)
        order = np.lexsort((block, ties, ids, h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        group = np.cumsum(new) - 1
        repeated = (np.bincount(group) > 1) | (np.bincount(group, again[order]) > 0)
        flags = np.zeros(len(order), np.uint8)
        flags[order] = np.where(repeated[group], np.where(new, 1, 2), 0)
        cut = np.cumsum([0, *sizes])
        return pa.table({"block": t["block"], "shard": t["shard"], "flags": pa.array([pack(flags[i:j]) for i, j in zip(cut, cut[1:])], pa.binary())})

    return entries.groupBy("shard").applyInArrow(judge, "block bigint, shard bigint, flags binary")


_CLEAN = "doc_id bigint, text string, n_sentences bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>"


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _without(text: str, runs: np.ndarray, n: int, words: np.ndarray) -> tuple[str, int, list[dict]]:
    """The text without the sentences that ``runs`` and the words that ``words`` cover; how many sentences lose any; the spans."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, runs[:, 0], 1)
    np.add.at(cover, runs[:, 1] + 1, -1)
    cover = np.cumsum(cover[:-1]) > 0
    where, pieces = sentences(text), []
    gone = [where[i][:2] for i in np.flatnonzero(cover).tolist()]
    if len(words):
        starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
        within = [(starts[i], starts[j + 1]) for i, j in words.tolist()]
        begin = np.array([i for i, *_ in where])
        for i, j in within:
            cover[np.searchsorted(begin, i, "right") - 1 if i >= begin[0] else 0 : np.searchsorted(begin, j)] = True
        gone = sorted(gone + within)
    for start, end in gone:
        if pieces and pieces[-1]["end"] >= start:
            pieces[-1]["end"] = max(end, pieces[-1]["end"])
        else:
            pieces.append({"start": start, "end": end})
    kept, at = [], 0
    for p in pieces:
        kept.append(text[at : p["start"]])
        at = p["end"]
    return "".join([*kept, text[at:]]), int(cover.sum()), pieces


def _cleaned(docs: DataFrame, flags: DataFrame) -> DataFrame:
    def clean(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        placed = pa.compute.is_valid(left["shard"])
        sizes, doc, first, last, of, by_word = unpack(left.filter(placed)["entries"][0].as_py())
        left = left.filter(pa.compute.invert(placed)).sort_by("nth")
        ids, texts = left["doc_id"].to_pylist(), left["text"].to_pylist()
        flag = np.concatenate([np.empty(0, np.uint8), *(unpack(x)[0] for _, x in sorted(zip(right["shard"].to_pylist(), right["flags"].to_pylist())))])[of]
        here = np.zeros(len(of), bool)
        here[np.unique(of, return_index=True)[1]] = True  # spans are in the order of their places
        gone = np.flatnonzero((flag == 2) | ((flag == 1) & ~here))
        runs = np.stack([first[gone], last[gone]], 1).astype(np.int64)
        by_word = by_word[gone] > 0
        gone = doc[gone]
        order = np.argsort(gone, kind="stable")
        cut = np.searchsorted(gone[order], np.arange(len(ids) + 1))
        out = []
        for k, (doc_id, text) in enumerate(zip(ids, texts)):
            own = order[cut[k] : cut[k + 1]]
            text, removed, pieces = _without(text, runs[own[~by_word[own]]], int(sizes[k]), runs[own[by_word[own]]]) if len(own) else (text or "", 0, [])
            out.append((doc_id, text, int(sizes[k]), removed, pieces))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        return pa.table({k: pa.array(c, kind) for k, c, kind in zip(("doc_id", "text", "n_sentences", "n_removed", "removed"), zip(*out), kinds)})

    return docs.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(clean, _CLEAN)


def without_repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, long_words: int = LONG_WORDS, passage: int | None = None) -> DataFrame:
    """doc_id, text without the removed sentences, n_sentences, n_removed (those that lose words), removed (spans of the old text)."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    both = written(_dealt(rows, max(1, -(-chars // RANGE_CHARS)), run, long_words, passage), "spans")
    flags = written(_judged(both.filter("shard >= 0").select("shard", "block", "entries")), "span-flags")
    return _cleaned(both.filter(f"shard is null or shard = {_PLACES}").select("block", "nth", "doc_id", "text", "shard", "entries"), flags)
