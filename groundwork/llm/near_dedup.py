"""Near duplicates: circulant MinHash, banding, and exact Jaccard similarity on full shingle sets.

1. Each text becomes its set of distinct 5-word shingles (64-bit hashes). Texts with equal sets are one node.
2. Circulant MinHash: one permutation scatters the set over a ring of 2**32 places, a second one, shifted by k
   places, gives coordinate k of the signature as a minimum. Bands of coordinates are bucket keys.
3. In every bucket each node is compared with the bucket's most central one only (a star, not all pairs), on
   full sets; links give components.
4. Nodes of buckets that still hold several components are joined on their rarest shingles. A link needs an
   overlap that bounds how far down in that order the first common shingle can be, so no link between
   components is lost, and pairs within one component are not made.

Defined results: null and empty texts, or texts of white space, have no shingles and link with nothing; a text
of fewer than five words is one shingle; rows that repeat, or whose ids are null, still count as rows, and a
component's id is its smallest id that is not null; an empty table gives no rows; other columns are kept by
``one_per_group``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pack, shard_bounds, unpack
from .graphs import components
from .joins import join_dealt, join_groups
from .scratch import discard, release, written

WORDS = 5
BANDS, ROWS = 32, 4
PERCENT = 75  # of the union, at least
#: Sets of a block and, about, shingles of a hash range when shingles are counted.
BLOCK_SETS, RANGE_SHINGLES = 2048, 4_000_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _fmix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text, A-Z lower-cased, words split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(words))
    s = h[: len(h) - n + 1] + np.uint64(n)
    for k in range(1, n):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return np.unique(_fmix64(s))


def _fmix32(v: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    v ^= v >> np.uint32(16)
    v *= np.uint32(0x85EBCA6B)
    v ^= v >> np.uint32(13)
    v *= np.uint32(0xC2B2AE35)
    v ^= v >> np.uint32(16)
    return v


def signature(s: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of a shingle set: coordinate k is the minimum of the second permutation shifted by k."""
    ring = _fmix32((s >> np.uint64(32)).astype(np.uint32) + np.uint32(0x5BD1E995))
    shift = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(ring), 2048):
        np.minimum(out, _fmix32(ring[None, i : i + 2048] - shift).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = _fmix64(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h.view(np.int64)


def _longs(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, uid, n_shingles, set_key, bands of ``docs`` (doc_id, text, row_key, uid)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                sets = [shingles(t, hashes) for t in part.column("text").to_pylist()]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                bands = _longs([band_keys(signature(s)) if len(s) else np.empty(0, np.int64) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "row_key", "uid")), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), bands],
                    ["doc_id", "row_key", "uid", "n_shingles", "set_key", "bands"],
                )

    return docs.mapInArrow(sketch, "doc_id bigint, row_key bigint, uid bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def with_sets(rows: DataFrame, *carry: str) -> DataFrame:
    """The shingle sets of ``rows`` (text, set_key and ``carry``) whose text has the set that is asked for."""
    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in carry) + ", set array<bigint>"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                sets = [shingles(t, hashes) for t in part.column("text").to_pylist()]
                same = pa.array([xxhash.xxh3_128_digest(s.tobytes()) == k for s, k in zip(sets, part.column("set_key").to_pylist())])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), _longs(sets)], [*carry, "set"]).filter(same)

    return rows.mapInArrow(make, schema)


def _linked(pairs: DataFrame) -> DataFrame:
    """a, b of the pairs (a, b, set_a, set_b) that are similar enough on full sets."""
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.withColumn("both", both).filter(100 * F.col("both") >= PERCENT * (F.size("set_a") + F.size("set_b") - F.col("both"))).select("a", "b")


_APART = "uid bigint, n bigint, component bigint, members bigint"


def _blocks(sets: DataFrame, n: int) -> DataFrame:
    """Blocks of sets (packed), and for each block and hash range the block's distinct shingles with their counts."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for b in batches:
            for i in range(0, b.num_rows, BLOCK_SETS):
                part = b.slice(i, BLOCK_SETS)
                flat, lengths = part.column("set").flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(part.column("set").offsets.to_numpy())
                distinct, count = np.unique(flat, return_counts=True)
                edge = shard_bounds(distinct, n)
                kept = [k for k in range(n) if edge[k + 1] > edge[k]]
                own = pack(*(np.array(part.column(c).to_pylist(), "<i8") for c in ("uid", "n", "component", "members")), lengths.astype("<u4"), flat)
                rows = {
                    "block": [number] * (1 + len(kept)), "range": [None, *kept], "sets": [own] + [None] * len(kept),
                    "entries": [None, *(pack(distinct[edge[k] : edge[k + 1]], count[edge[k] : edge[k + 1]].astype("<u4")) for k in kept)],
                }
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(rows.values(), kinds)], list(rows))
                number += 1

    return sets.select("uid", "n", "component", "members", "set").mapInArrow(deal, "block bigint, range bigint, sets binary, entries binary")


def _counted(entries: DataFrame) -> DataFrame:
    """By block and range: how many sets of all blocks hold each of the block's shingles."""

    def count(t: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in t["entries"].to_pylist()]
        distinct, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(of, np.concatenate([p[1] for p in parts]), len(distinct)).astype("<u4")
        cut = np.cumsum([0, *(len(p[0]) for p in parts)])
        return pa.table({"block": t["block"], "range": t["range"], "held": pa.array([pack(total[of[i:j]]) for i, j in zip(cut, cut[1:])], pa.binary())})

    return entries.groupBy("range").applyInArrow(count, "block bigint, range bigint, held binary")


def _prefixes(sets: DataFrame) -> DataFrame:
    """The rarest shingles of each set, as many as a link can need, with their place in that order.

    The order is by the exact number of sets that hold a shingle. Shingles of one set only take their places, but
    have no partner and so no row.
    """
    total = sets.agg(F.sum("n")).first()[0] or 0
    blocks = written(_blocks(sets, max(1, -(-total // RANGE_SHINGLES))), "near-blocks")
    counts = _counted(blocks.filter("entries is not null").select("block", "range", "entries"))

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        *columns, lengths, flat = unpack(left["sets"][0].as_py())
        held = np.concatenate([unpack(x)[0] for _, x in sorted(zip(right["range"].to_pylist(), right["held"].to_pylist()))])
        of = np.repeat(np.arange(len(lengths)), lengths)
        rarity = held[np.searchsorted(np.unique(flat), flat)]
        order = np.lexsort((flat, rarity, of))
        starts = np.cumsum(lengths, dtype=np.int64) - lengths
        place = np.arange(len(flat)) - starts[of]
        need = lengths.astype(np.int64) - -(-PERCENT * lengths.astype(np.int64) // 100) + 1
        take = order[(place < need[of]) & (rarity[order] > 1)]
        place = place[(place < need[of]) & (rarity[order] > 1)]
        rows = {"token": flat[take].view(np.int64), **{c: v[of[take]] for c, v in zip(("uid", "n", "component", "members"), columns)}, "place": place}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in rows.items()})

    left = blocks.filter("sets is not null").select("block", "sets")
    return left.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(cut, f"token bigint, {_APART}, place bigint")


def _size_class(n):
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.05)))


def _cross_pairs(sets: DataFrame) -> DataFrame:
    """Pairs a, b of different components that could be similar enough.

    ``sets``: uid, n, set, component, members. The first common shingle of a linked pair is among the first
    quarter of the larger set and, since the overlap is at least 6/7 of the smaller one, among the first seventh of
    the smaller set. Of each shingle's list, the rows of its largest component do not meet each other.
    """
    prefix = written(_prefixes(sets), "near-prefixes")
    lists = prefix.groupBy("token").agg(F.max(F.struct("members", "component")).alias("big"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("held"))
    lists = lists.filter("low < high").select("token", F.col("big.component").alias("big"), "held")
    rows = written(join_groups(prefix, lists, "token", "held", prefix.count()).withColumn("other", F.col("component") != F.col("big")), "near-lists")
    part = 100 + PERCENT
    n, place = F.col("n"), F.col("place")
    large = rows.withColumn("most", F.least(n, F.floor((part * (n - place) - PERCENT * n) / F.lit(PERCENT)))).withColumn("low", F.ceil(n * PERCENT / 100)).filter("low <= most")
    small = rows.filter(part * (n - place) >= 2 * PERCENT * n)
    ask = lambda x: x.withColumn("class", F.explode(F.sequence(_size_class(F.col("low")) - 1, _size_class(F.col("most")) + 1)))
    small = small.withColumn("class", _size_class(n))
    found = _met(ask(large.filter("other")), small).unionAll(_met(ask(large.filter("not other")), small.filter("other")))
    return found.distinct()


def _met(large: DataFrame, small: DataFrame) -> DataFrame:
    x, y = large.alias("x"), small.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    reach = F.least(n - F.col("x.place"), m - F.col("y.place"))
    fits = (F.col("x.token") == F.col("y.token")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.component") != F.col("y.component")) & ((100 + PERCENT) * reach >= PERCENT * (n + m)) & m.between(F.col("x.low"), F.col("x.most"))
    return x.join(y, fits).select(F.least("x.uid", "y.uid").alias("a"), F.greatest("x.uid", "y.uid").alias("b"))


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: rows (uid, doc_id, n_shingles, set_key, copies) and groups (set_key, copies, component, component_id, first_uid)."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
    sigs = written(sketched(rows.withColumn("uid", F.monotonically_increasing_id())), "near-sketches")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "uid", "row_key", "n_shingles")  # rows with ids first
    sets = sigs.filter("n_shingles > 0").groupBy("set_key").agg(F.min(place).alias("r"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    sets = written(sets.select("set_key", "copies", "bands", F.col("r.uid").alias("uid"), F.col("r.doc_id").alias("min_doc"), F.col("r.row_key").alias("row_key"), F.col("r.n_shingles").alias("n")), "near-sets")

    # Buckets that nodes share, and in each the node that shares most
    bands = sets.select("uid", F.explode("bands").alias("bucket"))
    n_bands = BANDS * sets.count()
    shared = bands.groupBy("bucket").agg(F.count("*").alias("held")).filter("held > 1")
    bucketed = written(bands.join(shared, "bucket"), "near-buckets")  # a plain join, so Spark splits the rows of a hot bucket
    central = bucketed.groupBy("uid").agg(F.sum("held").alias("weight"))
    weighed = bucketed.join(central, "uid")
    hub = weighed.groupBy("bucket").agg(F.max_by("uid", F.struct("weight", -F.col("uid"))).alias("hub"), F.max("held").alias("size"))
    stars = written(join_groups(bucketed, hub, "bucket", "size", n_bands).select("uid", "hub").distinct(), "near-stars")
    release(rows.sparkSession)
    hubs = stars.groupBy("uid").agg(F.collect_set("hub").alias("hubs"))  # at most one for each band

    # Full sets of the nodes that share a bucket
    asked = sets.join(hubs, "uid").select("row_key", "set_key", "uid", "n", "hubs")
    full = with_sets(rows.join(asked, "row_key").select("text", "set_key", "uid", "n", "hubs"), "uid", "n", "hubs")
    full = written(full, "near-full")
    release(rows.sparkSession)
    away = stars.filter("uid <> hub")
    centre = full.join(away.select(F.col("hub").alias("uid")).distinct(), "uid", "left_semi").select(F.col("uid").alias("b"), F.col("set").alias("set_b"))
    spokes = full.select(F.col("uid").alias("a"), F.col("set").alias("set_a"), F.explode("hubs").alias("b")).filter("a <> b")
    links = written(_linked(join_dealt(spokes, centre, "b", "a", away.count())).distinct(), "near-links")

    # What the stars left apart within a bucket
    found = components(links)
    named = bucketed.select("uid").distinct().join(found, F.col("uid") == F.col("node"), "left").select("uid", F.coalesce("component", "uid").alias("component"))
    named = written(named, "near-named")
    n_named = named.count()
    split = bucketed.join(named, "uid").groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("held").alias("size")).filter("low < high").select("bucket", "size")
    open_ = join_groups(bucketed, split, "bucket", "size", n_bands).select("uid").distinct()
    members = named.groupBy("component").agg(F.count("*").alias("members"))
    apart = join_groups(named.join(open_, "uid", "left_semi"), members, "component", "members", n_named)
    apart = full.select("uid", "n", "set").join(apart, "uid").select("uid", "n", "set", "component", "members")
    pairs = written(_cross_pairs(written(apart, "near-apart")), "near-pairs")
    n_pairs = pairs.count()
    release(rows.sparkSession)
    final = named
    if n_pairs:
        one = full.select(F.col("uid").alias("a"), F.col("set").alias("set_a"))
        two = full.select(F.col("uid").alias("b"), F.col("set").alias("set_b"))
        more = written(_linked(join_dealt(join_dealt(pairs, one, "a", "b", n_pairs), two, "b", "a", n_pairs)), "near-more")
        ends = [named.select(F.col("uid").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b")]
        met = components(more.join(ends[0], "a").join(ends[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
        met = met.select(F.col("node").alias("was"), F.col("component").alias("now"))
        after = members.withColumnRenamed("component", "was").join(met, "was", "left").select("was", "members", F.coalesce("now", "was").alias("component"))
        final = join_groups(named.withColumnRenamed("component", "was"), after, "was", "members", n_named).select("uid", "component")

    joined = sets.select("set_key", "copies", "uid", "min_doc").join(final, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    first = joined.groupBy("component").agg(F.min(F.struct(F.col("min_doc").isNull(), "min_doc", "uid")).alias("f"), F.count("*").alias("size")).select("component", F.col("f.min_doc").alias("component_id"), F.col("f.uid").alias("first_uid"), "size")
    groups = join_groups(joined, first, "component", "size", n_bands // BANDS)
    groups = written(groups.select("set_key", "copies", "component", "component_id", "first_uid"), "near-groups")
    for done in (sets, bucketed, stars, full, links, named, pairs):
        discard(done)
    release(rows.sparkSession)
    return sigs, groups


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    sigs, groups = near_components(docs, doc_id, text)
    rows = sigs.select("doc_id", "n_shingles", "set_key")
    some = join_groups(rows.filter("set_key is not null"), groups, "set_key", "copies", sigs.count()).select("doc_id", "n_shingles", "component_id")
    none = rows.filter("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = some.unionByName(none)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each group: the one with the smallest id. Rows without words stay."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = {c: f"c{i}" for i, c in enumerate(names)}
    sigs, groups = near_components(plain, at["doc_id"], at["text"])
    stays = groups.select(F.col("first_uid").alias("uid")).distinct().unionAll(sigs.filter("set_key is null").select("uid"))
    kept = sigs.join(stays, "uid", "left_semi").select("row_key")
    keyed = plain.withColumn("row_key", F.xxhash64(F.col(at["doc_id"]).cast("bigint"), at["text"]))
    out = keyed.join(kept.distinct(), "row_key", "left_semi")
    if not sigs.groupBy("row_key").count().filter("count > 1").isEmpty():  # rows that repeat id and text
        alone = sigs.filter("set_key is not null").select("row_key").distinct()
        out = out.join(alone, "row_key", "left_semi").dropDuplicates(["row_key"]).unionByName(out.join(alone, "row_key", "left_anti"))
    return out.select(*at.values()).toDF(*names)
