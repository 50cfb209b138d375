"""Lexical ranking, fusion and evaluation as joins on tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S


def document_frequency(tokens: DataFrame, item: str) -> DataFrame:
    """token, df, idf of (item, token) rows; df counts an item once over all its fields."""
    total = tokens.agg(F.countDistinct(item).alias("total"))
    df = tokens.groupBy("token").agg(F.countDistinct(item).alias("df"))
    return df.join(F.broadcast(total)).withColumn("idf", S.idf(F.col("total").cast("double"), F.col("df")))  # one row


def lexical_hits(queries: DataFrame, fields: DataFrame, query: str, item: str, limit: int = 3, prior: DataFrame | None = None) -> DataFrame:
    """query, item, score, rank, share and weight of the best items.

    ``queries``: query, token. ``fields``: item, field, token. A token counts once per item, at its best field;
    items must match in an anchor field; common tokens neither anchor nor score. Scores are rounded before they are
    ranked, so that ties do not hang on the order of addition.
    """
    weights = F.create_map(*(F.lit(x) for kv in S.FIELD_WEIGHTS.items() for x in kv))
    # Only tokens that someone asks for are kept; frequencies come from the same aggregate as the matches
    wanted = fields.join(queries.select("token").distinct(), "token", "left_semi")
    best = wanted.groupBy(item, "token").agg(F.max(weights[F.col("field")]).alias("field_weight"), F.bool_or(F.col("field").isin(*S.ANCHOR_FIELDS)).alias("anchor"))
    n = fields.select(item).distinct().agg(F.count("*").alias("n"))
    df = best.groupBy("token").agg(F.count("*").alias("df"))
    useful = queries.join(df, "token", "left").crossJoin(F.broadcast(n))  # one row
    common = (F.col("n") >= S.COMMON_TOKEN_MIN) & (F.col("df") >= S.COMMON_TOKEN_SHARE * F.col("n"))
    most = F.log1p(F.col("n").cast("double"))
    asked = useful.filter(~F.coalesce(common, F.lit(False))).withColumn("idf", F.coalesce(S.idf(F.col("n").cast("double"), F.col("df")), most))
    mass = asked.groupBy(query).agg(F.sum("idf").alias("mass"), F.max(F.log1p(F.col("n").cast("double"))).alias("rarest"))
    hits = asked.select(query, "token", "idf").join(best, "token")
    scored = hits.groupBy(query, item).agg(F.round(F.sum(F.col("field_weight") * F.col("idf")), 9).alias("score"), F.sum(F.when(F.col("anchor"), F.col("idf"))).alias("anchored"))
    scored = scored.filter(F.col("anchored").isNotNull())
    if prior is not None:
        scored = scored.join(prior, item, "left").withColumn("score", F.col("score") * F.coalesce("prior", F.lit(1.0)))
    order = Window.partitionBy(query).orderBy(F.desc("score"), item)
    # the first rows of each query are cut within tasks, before they are shuffled
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    floor = F.max("score").over(Window.partitionBy(query))
    top = top.withColumn("best", floor).filter(F.col("score") >= S.RELATIVE_SCORE_FLOOR * F.col("best")).drop("best")
    return top.join(mass, query).select(query, item, "score", "rank", (F.col("anchored") / F.col("mass")).alias("share"), (F.col("anchored") / F.col("rarest")).alias("weight"))


def fuse(lists: list[DataFrame], key: list[str]) -> DataFrame:
    """Reciprocal rank fusion of (key, rank) lists."""
    both = lists[0].select(*key, S.rank_share(F.col("rank")).alias("part"))
    for other in lists[1:]:
        both = both.unionByName(other.select(*key, S.rank_share(F.col("rank")).alias("part")))
    return both.groupBy(*key).agg(F.sum("part").alias("score"))


#: Rows of a block of queries and of a block of rows that are compared with each other at once.
QUERY_BLOCK, ROW_BLOCK = 1024, 16_384


def _block_scores(left: pa.Table, right: pa.Table, query: str, item: str, limit: int) -> pa.Table:
    """The best ``limit`` rows of each query of one pair of blocks."""
    matrix = lambda t, c: np.array(t[c].to_pylist(), np.float64).reshape(t.num_rows, -1)
    out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    if left.num_rows and right.num_rows:
        q, r = matrix(left, "query_vector"), matrix(right, "vector")
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = (q @ r.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(r, axis=1)[None])
        cosine[~(cosine >= S.SEMANTIC_FLOOR)] = -np.inf
        ids = right[item].to_numpy()
        order = np.lexsort((np.broadcast_to(ids, cosine.shape), -cosine), axis=1)[:, :limit]
        score = np.take_along_axis(cosine, order, 1)
        row, at = np.nonzero(score > -np.inf)
        out = [left[query].to_numpy()[row], ids[order[row, at]], score[row, at]]
    return pa.table({query: pa.array(out[0], pa.int64()), item: pa.array(out[1], pa.int64()), "cosine": pa.array(out[2], pa.float64())})


def cosine_top(queries: DataFrame, rows: DataFrame, on: str | None, query: str, item: str, limit: int = S.SEMANTIC_LIMIT) -> DataFrame:
    """The rows of cosine at least the floor, best first, within each ``on`` or, for a query set of any size, among all.

    Among all, blocks of queries meet blocks of rows and send on the best ``limit`` of each pair of blocks; ids are longs.
    """
    if on:
        pairs = rows.join(queries, on).withColumn("cosine", S.cosine(F.col("query_vector"), F.col("vector"))).filter(F.col("cosine") >= S.SEMANTIC_FLOOR)
    else:
        n_q, n_r = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (rows, ROW_BLOCK)))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = queries.select(F.col(query).cast("bigint").alias(query), "query_vector", F.pmod(F.hash(query), F.lit(n_q)).alias("qb"), every(n_r).alias("rb"))
        right = rows.select(F.col(item).cast("bigint").alias(item), "vector", F.pmod(F.hash(item), F.lit(n_r)).alias("rb"), every(n_q).alias("qb"))
        best = lambda q, r: _block_scores(q, r, query, item, limit)
        pairs = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(best, f"{query} bigint, {item} bigint, cosine double")
    order = Window.partitionBy(query).orderBy(F.desc("cosine"), item)
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(query, item, "cosine", "rank")
