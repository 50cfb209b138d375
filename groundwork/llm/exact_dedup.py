"""Exact deduplication against history through a sharded minimal perfect hash.

The distinct digests of the history are dealt to shards of a few thousand. Each shard gets a minimal perfect
hash (hash and displace): its n slots hold the n full digests and, for each, the locator of the row that stays.
Incoming digests, aggregated before they are shuffled, look up one slot each and compare all 32 bytes: equal
ones are repeats of the history, all others are grouped among themselves.

Defined results: a null text counts as empty; a null id sorts below every id; of rows that repeat id and text,
one stays; an empty table gives an empty result; other columns, whatever their names, are kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import join_groups
from .scratch import written

#: Digests in a shard, about.
SHARD_KEYS = 4096
_SEED_TRIES = 64


def normalised_digest(text: str | None) -> bytes:
    """SHA-256 of the text in UTF-8 with A-Z lower-cased; null counts as empty."""
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass").lower()).digest()


def with_digest(docs: DataFrame, text: str = "text", digest: str = "_digest") -> DataFrame:
    """``docs`` with the 32-byte digest of its normalised text."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [normalised_digest(x) for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.binary())], [*b.schema.names, digest])

    schema = docs.schema
    return docs.mapInArrow(add, type(schema)([*schema.fields]).add(digest, "binary"))


def _words(digests: np.ndarray) -> np.ndarray:
    """(n, 4) little-endian words of (n, 32) bytes."""
    return np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)


def build_mph(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements by bucket and the slot of every digest; ``digests``: (n, 32) distinct rows of bytes.

    Large buckets are placed first by trying displacements; a bucket of one digest takes a free slot directly,
    which a negative displacement records.
    """
    n = len(digests)
    w, n_buckets = _words(digests), max(1, n // 4)
    bucket = (w[:, 0] % np.uint64(n_buckets)).astype(np.int64)
    first, step = w[:, 1] % np.uint64(n), w[:, 2] % np.uint64(n)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    displacement, slot = np.zeros(n_buckets, np.int64), np.full(n, -1, np.int64)
    free = np.ones(n, bool)
    sizes = np.diff(bounds)
    for b in np.argsort(-sizes, kind="stable"):
        keys = order[bounds[b] : bounds[b + 1]]
        if len(keys) < 2:
            break
        tried = 0
        while True:
            d = np.arange(tried, tried + _SEED_TRIES, dtype=np.uint64)
            # a second word breaks ties between digests that share first and step
            at = ((first[keys, None] + d * step[keys, None] + ((w[keys, 3, None] >> (d % np.uint64(61))) * (d // np.uint64(n)))) % np.uint64(n)).astype(np.int64)
            fits = free[at].all(axis=0)
            if len(keys) > 1:
                ordered = np.sort(at, axis=0)
                fits &= (ordered[1:] != ordered[:-1]).all(axis=0)
            if fits.any():
                k = int(np.argmax(fits))
                displacement[b], slot[keys] = tried + k, at[:, k]
                free[at[:, k]] = False
                break
            tried += _SEED_TRIES
    left = iter(np.flatnonzero(free))
    for b in np.flatnonzero(sizes == 1):
        key, at = order[bounds[b]], next(left)
        displacement[b], slot[key] = -1 - at, at
    return displacement, slot


def find_slots(digests: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    """The only slot in which each digest can be."""
    w = _words(digests)
    d = displacement[(w[:, 0] % np.uint64(len(displacement))).astype(np.int64)]
    u = np.maximum(d, 0).astype(np.uint64)
    at = ((w[:, 1] % np.uint64(n) + u * (w[:, 2] % np.uint64(n)) + (w[:, 3] >> (u % np.uint64(61))) * (u // np.uint64(n))) % np.uint64(n)).astype(np.int64)
    return np.where(d < 0, -1 - d, at)


_INDEX = "shard bigint, displacement binary, digests binary, ids array<bigint>, rows array<bigint>, sizes array<bigint>"


def _bytes32(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def build_index(groups: DataFrame) -> DataFrame:
    """One row per shard: the perfect hash of its digests and, by slot, digest, winner's id and row, group size.

    ``groups``: shard, _digest (distinct), id, row, n.
    """

    def build(t: pa.Table) -> pa.Table:
        digests = _bytes32(t["_digest"])
        displacement, slot = build_mph(digests)
        by_slot = np.argsort(slot)
        take = {c: [t[c].combine_chunks().take(pa.array(by_slot))] for c in ("id", "row", "n")}
        return pa.table(
            {
                "shard": t["shard"].slice(0, 1),
                "displacement": [displacement.astype("<i8").tobytes()],
                "digests": [digests[by_slot].tobytes()],
                "ids": pa.array([take["id"][0].to_pylist()], pa.list_(pa.int64())),
                "rows": pa.array([take["row"][0].to_pylist()], pa.list_(pa.int64())),
                "sizes": pa.array([take["n"][0].to_pylist()], pa.list_(pa.int64())),
            }
        )

    return groups.groupBy("shard").applyInArrow(build, _INDEX)


_GROUPS = "_digest binary, keep_id bigint, keep_row bigint, group_size bigint, repeats_history boolean"


def look_up(incoming: DataFrame, index: DataFrame) -> DataFrame:
    """All groups of history and incoming digests, with the row of the largest id in each.

    ``incoming``: shard, _digest (distinct), id, row, n.
    """

    def probe(key: tuple, new: pa.Table, old: pa.Table) -> pa.Table:
        slots: dict[str, list] = {"_digest": [], "keep_id": [], "keep_row": [], "group_size": [], "repeats_history": []}
        if old.num_rows:
            o = old.to_pylist()[0]
            held = np.frombuffer(o["digests"], np.uint8).reshape(-1, 32)
            slots = {"_digest": [x.tobytes() for x in held], "keep_id": o["ids"], "keep_row": o["rows"], "group_size": o["sizes"], "repeats_history": [False] * len(held)}
        if new.num_rows:
            digests = _bytes32(new["_digest"])
            member, at = np.zeros(len(digests), bool), np.zeros(len(digests), np.int64)
            if old.num_rows:
                at = find_slots(digests, np.frombuffer(o["displacement"], "<i8"), len(held))
                member = (held[at] == digests).all(axis=1)
            for i, (d, key_id, row, n) in enumerate(zip(*(new[c].to_pylist() for c in ("_digest", "id", "row", "n")))):
                if member[i]:
                    k = int(at[i])
                    rank = lambda x, r: (x is not None, x or 0, r)
                    if rank(key_id, row) > rank(slots["keep_id"][k], slots["keep_row"][k]):
                        slots["keep_id"][k], slots["keep_row"][k] = key_id, row
                    slots["group_size"][k] += n
                    slots["repeats_history"][k] = True
                else:
                    for c, v in zip(slots, (d, key_id, row, n, False)):
                        slots[c].append(v)
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(slots.items(), kinds)})

    return incoming.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(probe, _GROUPS)


def _grouped(keyed: DataFrame, n_shards: int) -> DataFrame:
    best = F.max(F.struct("id", "row")).alias("best")
    groups = keyed.groupBy("_digest").agg(best, F.count("*").alias("n"))
    shard = F.pmod(F.xxhash64("_digest"), F.lit(n_shards)).alias("shard")
    return groups.select(shard, "_digest", F.col("best.id").alias("id"), F.col("best.row").alias("row"), "n")


def duplicate_groups(keyed: DataFrame, n_rows: int) -> DataFrame:
    """One row per distinct text of ``keyed`` (_digest, id, row, historical)."""
    n_shards = max(64, n_rows // SHARD_KEYS)
    index = build_index(_grouped(keyed.filter("historical"), n_shards))
    return look_up(_grouped(keyed.filter("not historical"), n_shards), index)


def _historical(docs: DataFrame, doc_id: str):
    """The older half of the rows by id is the history, what follows is the batch that comes in; null ids come in."""
    middle = docs.agg(F.percentile_approx(doc_id, 0.5)).first()[0]
    return F.lit(False) if middle is None else F.coalesce(F.col(doc_id) < F.lit(middle), F.lit(False))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    keyed = with_digest(docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"), _historical(docs, doc_id).alias("historical")))
    keyed = written(keyed.select("id", "_digest", "historical", F.monotonically_increasing_id().alias("row")), "exact-keys")
    n_rows = keyed.count()
    groups = written(duplicate_groups(keyed, n_rows), "exact-groups")
    out = join_groups(keyed, groups, "_digest", "group_size", n_rows)
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"), "repeats_history"
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts, the one with the largest id."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names)))) if names else docs
    at = {c: f"c{i}" for i, c in enumerate(names)}
    full = with_digest(plain.withColumn("historical", _historical(plain, at[doc_id])), at[text])
    full = written(full.withColumn("row", F.monotonically_increasing_id()), "exact-rows")
    keyed = full.select(F.col(at[doc_id]).cast("bigint").alias("id"), "_digest", "historical", "row")
    winners = duplicate_groups(keyed, full.count()).select(F.col("keep_row").alias("row"))
    return full.join(winners, "row", "left_semi").select(*at.values()).toDF(*names)
