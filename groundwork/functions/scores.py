"""Vectors, ranks and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of ranking and verdict.
FIELD_WEIGHTS = {"label": 3.0, "aliases": 3.0, "questions": 2.0, "description": 1.0, "statements": 0.5}
ANCHOR_FIELDS = ("label", "aliases", "questions")
COMMON_TOKEN_SHARE, COMMON_TOKEN_MIN = 0.75, 8
RELATIVE_SCORE_FLOOR = 0.2
STRONG_WEIGHT, PARTIAL_WEIGHT, STRONG_SHARE = 1.5, 1.0, 0.5
SEMANTIC_STRONG, SEMANTIC_PARTIAL, SEMANTIC_VETO = 0.7, 0.6, 0.45
SEMANTIC_FLOOR, SEMANTIC_LIMIT = 0.5, 10
FUSION = 60
BASIS_WEIGHTS = {"act": 1.0, "ordinance": 1.0, "treaty": 1.0, "directive": 0.95, "guidance": 0.9, "directory": 0.9, "summary": 0.75}
PROVENANCE_WEIGHTS = {"curated": 1.0, "section": 0.9, "candidate": 0.8}
REVIEW_WEIGHTS = {"human": 1.0, "automated": 0.8, "assistant": 0.7, "derived": 0.6}
PRIOR_FLOOR = 0.7


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Between -1 and 1; null where a vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / length)))


def idf(total: Column, df: Column) -> Column:
    return F.log1p(total / df)


def rank_share(rank: Column) -> Column:
    """One list's part of a fused score; absent from a list counts nothing."""
    return F.coalesce(1.0 / (FUSION + rank), F.lit(0.0))


def verdict(share: Column, weight: Column, best: Column) -> Column:
    """strong or weak; a best cosine below the veto is weak whatever the words say."""
    strong = (weight >= STRONG_WEIGHT) | (share >= STRONG_SHARE) | (best >= SEMANTIC_STRONG) | ((weight >= PARTIAL_WEIGHT) & (best >= SEMANTIC_PARTIAL))
    return F.when(best < SEMANTIC_VETO, "weak").when(F.coalesce(strong, F.lit(False)), "strong").otherwise("weak")


def weight_of(kind: Column, weights: dict[str, float]) -> Column:
    """1 where the kind is absent or unknown."""
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    return F.coalesce(table[kind], F.lit(1.0))


def recall_at(expected: Column, actual: Column, k: int) -> Column:
    """Share of the expected that is among the first k; null when nothing is expected."""
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(expected, F.slice(actual, 1, k))) / F.size(expected))


def contains_place(outer: Column, inner: Column) -> Column:
    """Codes are paths: CH holds CH-ZH, which holds CH-ZH-261."""
    return (inner == outer) | F.startswith(inner, F.concat(outer, F.lit("-")))
