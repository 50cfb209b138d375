"""Approximate nearest neighbours by cross-polytope hashing, largest inner product first.

Vectors fall into classes of about equal length (powers of two). Where the lengths of a class differ, its vectors are
scaled by its longest and lifted by one coordinate to unit length, so that the largest inner product is the nearest
direction; one long vector moves no other class. In each table a fast pseudo-rotation (three times random signs, then
a Hadamard transform) maps a vector to its nearest signed axis, its bucket. In every class a query probes the
``probes`` buckets of all tables on whose axes its projection is largest; all their rows are compared with it exactly,
on the original vectors in double precision. A query that finds fewer than ``k`` searches all rows, in blocks.

Equal vectors are searched once: each keeps its ``k + 1`` smallest ids, which is all that a result can hold. Large
buckets are dealt to parts of about ``PART_ROWS`` rows, and a query visits every part.

Defined results: vectors that are null, zero, of another length than most rows' or with null or non-finite
components take no part; ties go to the smaller id; ids that repeat are ranked once for each distinct vector; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import join_groups
from .scratch import written

K, TABLES, PROBES, PART_ROWS, GROUP = 20, 8, 104, 4096, 16
#: Lengths of a class that are this close to its longest need no lift.
EQUAL = 0.999


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, of orthonormal scale."""
    rows, n = x.shape
    h = 1
    while h < n:
        y = x.reshape(rows, n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(rows, n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """A pseudo-rotation of rows, padded to a power of two."""
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([41, table])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], n))
    return y


def lifted(v: np.ndarray, longest: float) -> np.ndarray:
    scaled = v / longest
    return np.column_stack([scaled, np.sqrt(np.maximum(0.0, 1 - (scaled**2).sum(1)))])


def signed(y: np.ndarray) -> np.ndarray:
    """Projections on the signed axes: 2i for +i, 2i + 1 for -i."""
    return np.stack([y, -y], 2).reshape(len(y), -1)


def probed(each: list[np.ndarray], probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, table, code) of the ``probes`` largest projections of each row over all tables."""
    flat = np.concatenate(each, 1)
    probes, width = min(probes, flat.shape[1]), each[0].shape[1]
    top = np.argpartition(-flat, probes - 1, axis=1)[:, :probes].reshape(-1)
    return np.repeat(np.arange(len(flat)), probes), top // width, top % width


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, vector (doubles) of the rows that take part."""
    v = F.col("vector")
    out = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).filter("vec_id is not null and vector is not null")
    out = out.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    sizes = out.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return out.filter(F.size(v) == (sizes[0].n if sizes else 0))


def _hashed(rows: DataFrame, classes: dict[int, tuple[float, bool]], carry: list[str], probes: int | None) -> DataFrame:
    """One row for each table and bucket: size_class, table, code and the carried columns.

    ``classes``: the longest length of each size class and whether it is lifted. With ``probes`` the rows are queries
    that probe every class, else they lie in one bucket of each table.
    """
    kinds = dict(rows.dtypes)

    def add(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                v = _matrix(part.column("vector"))
                length = np.linalg.norm(v, axis=1, keepdims=True)
                own = np.rint(np.log2(length[:, 0])).astype(np.int64)
                found = []
                for c, (longest, lift) in classes.items():
                    of = np.arange(len(v)) if probes else np.flatnonzero(own == c)
                    if not len(of):
                        continue
                    if not lift:
                        x = v[of] / length[of]
                    else:
                        x = np.column_stack([v[of] / length[of], np.zeros(len(of))]) if probes else lifted(v[of], longest)
                    each = [signed(rotate(x, table)) for table in range(TABLES)]
                    if probes:
                        row, table, code = probed(each, probes)
                    else:
                        row, table, code = np.tile(np.arange(len(of)), TABLES), np.repeat(np.arange(TABLES), len(of)), np.concatenate([e.argmax(1) for e in each])
                    found.append((of[row], np.full(len(row), c), table, code))
                row, c, table, code = (np.concatenate(x) for x in zip(*found))
                take = pa.array(row)
                columns = [pa.array(x.astype(np.int32)) for x in (c, table, code)]
                yield pa.RecordBatch.from_arrays([*columns, *(part.column(k).take(take) for k in carry)], ["size_class", "table", "code", *carry])

    return rows.mapInArrow(add, "size_class int, table int, code int, " + ", ".join(f"{c} {kinds[c]}" for c in carry))


def _best(rows: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group, cut within tasks before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= most)


def nearest(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = K, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: for every id divisible by ``every``, the ``k`` nearest others found."""
    good = written(usable(rows, vec_id, vector).distinct(), "vectors")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    sizes = good.select(length.alias("n")).groupBy(F.rint(F.log2("n")).cast("int").alias("c")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    classes = {r.c: (r.high, r.low < EQUAL * r.high) for r in sizes.collect()}  # at most the exponents of a double
    # Equal vectors: the smallest ids of each, k + 1 of them
    few = _best(good, "vector", ["vec_id"], k + 1)
    held_by = good.groupBy("vector").agg(F.count("*").alias("copies"))
    unique = few.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    unique = written(unique.join(held_by, "vector"), "unique-vectors")
    n = good.count()
    asked = join_groups(good.filter(F.col("vec_id") % every == 0), unique.select("vector", "rep", "copies"), "vector", "copies", n)
    asked = written(asked.select("vec_id", "rep"), "queries")

    key = ["size_class", "table", "shelf"]
    shelf = F.floor(F.col("code") / GROUP).cast("int")
    held = written(_hashed(unique.select("rep", "vector"), classes, ["rep", "vector"], None).withColumn("shelf", shelf), "buckets")
    parts = held.groupBy(*key).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))  # classes times tables times shelves
    parts = written(parts, "bucket-parts")
    held = held.join(F.broadcast(parts), key).withColumn("part", F.pmod(F.hash("rep"), F.col("parts"))).drop("parts")
    ask = unique.select("rep", "vector").join(asked.select("rep").distinct(), "rep", "left_semi")
    ask = _hashed(ask, classes, ["rep", "vector"], probes).withColumn("shelf", shelf)
    ask = ask.groupBy(*key, "rep").agg(F.collect_set("code").alias("codes"), F.first("vector").alias("vector"))  # at most GROUP codes
    ask = ask.join(F.broadcast(parts), key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def search(key: tuple, q: pa.Table, d: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if q.num_rows and d.num_rows:
            q, d = q.combine_chunks(), d.combine_chunks()
            reps, ids = q["rep"].to_numpy(), d["rep"].to_numpy()
            codes = d["code"].to_numpy() % GROUP
            x = _matrix(d["vector"].combine_chunks())
            y = _matrix(q["vector"].combine_chunks())
            wants = np.zeros((len(reps), GROUP), bool)
            lists = q["codes"].combine_chunks()
            wants[np.repeat(np.arange(len(reps)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy() % GROUP] = True
            got = []
            for c in range(GROUP):
                asks, has = np.flatnonzero(wants[:, c]), np.flatnonzero(codes == c)
                if not len(has):
                    continue
                for i in range(0, len(asks), 512):
                    score = y[asks[i : i + 512]] @ x[has].T
                    rest = max(0, score.shape[1] - (k + 1))
                    least = np.partition(score, rest, axis=1)[:, rest]  # of the best k + 1
                    at, col = np.nonzero(score >= least[:, None])
                    got.append((asks[i + at], has[col], score[at, col]))
            if got:
                q_at, d_at, score = (np.concatenate(f) for f in zip(*got))
                order = np.lexsort((ids[d_at], -score, q_at))
                q_at, d_at, score = q_at[order], d_at[order], score[order]
                first = np.searchsorted(q_at, q_at)
                best = np.arange(len(q_at)) - first <= k
                out = [reps[q_at[best]], ids[d_at[best]], score[best]]
        return pa.table({"rep": pa.array(out[0], pa.int64()), "near": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    def found(ask: DataFrame, held: DataFrame, by: list[str]) -> DataFrame:
        pairs = ask.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(search, "rep bigint, near bigint, score double")
        pairs = pairs.groupBy("rep", "near").agg(F.max("score").alias("score"))  # the same pair from several tables
        pairs = _best(pairs, "rep", [F.desc("score"), "near"], k + 1).drop("rank")
        each = pairs.join(unique.select(F.col("rep").alias("near"), "ids"), "near").select("rep", "score", F.explode("ids").alias("vec_id"))
        return written(_best(each, "rep", [F.desc("score"), "vec_id"], k + 1).drop("rank"), "neighbours")

    each = found(ask, held, [*key, "part"])
    # Who found too few searches all rows
    most = min(k + 1, n)
    short = written(asked.select("rep").distinct().join(each.groupBy("rep").agg(F.count("*").alias("n")).filter(F.col("n") >= most), "rep", "left_anti"), "short")
    if not short.isEmpty():
        blocks = -(-n // PART_ROWS)
        code = F.lit(0).alias("code")
        all_rows = unique.select("rep", "vector", code, F.pmod(F.hash("rep"), F.lit(blocks)).alias("part"))
        again = unique.join(short, "rep", "left_semi").select(F.col("rep").alias("rep"), F.col("vector").alias("vector"), F.array(code).alias("codes"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"))
        each = each.join(short, "rep", "left_anti").unionByName(found(again, all_rows, ["part"]))
    each = each.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("found"))  # k + 1 at most
    each = each.join(unique.select("rep", "copies"), "rep")
    out = join_groups(asked.select(F.col("vec_id").alias("query_id"), "rep"), each, "rep", "copies", n)
    own = F.filter("found", lambda f: f["vec_id"] != F.col("query_id"))
    return out.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "f")).select("query_id", (F.col("at") + 1).alias("rank"), "f.vec_id", (-F.col("f.minus")).alias("score"))
