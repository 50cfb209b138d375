"""Search, evidence and coverage over the tables of a release: concepts, facts, evidence, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S
from ..functions.text import FACET_WORDS, fold, tokens_of
from .retrieval import fuse, lexical_hits


def concept_fields(concepts: DataFrame, facts: DataFrame) -> DataFrame:
    """concept_id, field, token of label, aliases, questions, description and statements."""
    said = facts.groupBy("concept_id").agg(F.array_join(F.sort_array(F.collect_set("statement")), "\n").alias("statements"))
    wide = concepts.join(said, "concept_id", "left")
    text = {
        "label": F.col("label"), "aliases": F.array_join("aliases", "\n"), "questions": F.array_join("questions", "\n"),
        "description": F.col("description"), "statements": F.col("statements"),
    }
    each = wide.select("concept_id", F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.coalesce(v, F.lit("")).alias("text")) for k, v in text.items()))).alias("f"))
    folded = each.select("concept_id", "f.field", fold(F.col("f.text")).alias("folded"))
    return folded.select("concept_id", "field", F.explode(tokens_of(F.col("folded"))).alias("token"))


def query_tokens(queries: DataFrame) -> DataFrame:
    """query_id, token of (query_id, text); words for a property of a subject are marked."""
    folded = queries.select("query_id", fold(F.col("text")).alias("folded"))
    facets = tokens_of(fold(F.lit(" ".join(FACET_WORDS))))
    each = folded.select("query_id", F.explode(tokens_of(F.col("folded"))).alias("token"), facets.alias("facets"))
    return each.select("query_id", "token", F.array_contains("facets", F.col("token")).alias("facet"))


def applies(jurisdictions: Column, place: Column) -> Column:
    """A concept applies when one of its jurisdictions holds the place or lies below it; without a place, always."""
    near = F.exists(jurisdictions, lambda j: S.contains_place(j, place) | S.contains_place(place, j))
    return F.coalesce(near, F.lit(True))


def semantic_hits(queries: DataFrame, vectors: DataFrame, allowed: DataFrame, prior: DataFrame) -> DataFrame:
    """query_id, concept_id, cosine, rank, best. The floor acts on the raw cosine, the rank on cosine times prior."""
    pairs = allowed.join(queries, "query_id").join(vectors, "concept_id").withColumn("cosine", S.cosine(F.col("query_vector"), F.col("vector")))
    scored = pairs.join(prior, "concept_id", "left").withColumn("weighed", F.col("cosine") * F.coalesce("prior", F.lit(1.0)))
    best = scored.groupBy("query_id").agg(F.max("cosine").alias("best"))
    order = Window.partitionBy("query_id").orderBy(F.desc("weighed"), "concept_id")
    top = scored.filter(F.col("cosine") >= S.SEMANTIC_FLOOR).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= S.SEMANTIC_LIMIT)
    return top.select("query_id", "concept_id", "cosine", "rank").join(best, "query_id", "right")


def authority(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """concept_id, prior: the floor and the rest by the strongest fact; facts weigh basis, provenance and review."""
    held = facts.select("concept_id", "fact_id", "provenance", "review", F.explode_outer("evidence_ids").alias("evidence_id"))
    weighed = held.join(evidence.select("evidence_id", S.weight_of(F.col("basis"), S.BASIS_WEIGHTS).alias("w")), "evidence_id", "left")
    fact = weighed.groupBy("concept_id", "fact_id").agg(
        (F.coalesce(F.max("w"), F.lit(1.0)) * S.weight_of(F.first("provenance"), S.PROVENANCE_WEIGHTS) * S.weight_of(F.first("review"), S.REVIEW_WEIGHTS)).alias("w")
    )
    return fact.groupBy("concept_id").agg((S.PRIOR_FLOOR + (1 - S.PRIOR_FLOOR) * F.max("w")).alias("prior"))


def applying(queries: DataFrame, concepts: DataFrame) -> DataFrame:
    """query_id, concept_id by ``applies``, as an equality join: a place and a jurisdiction expand to what holds them.

    Queries without a place meet every concept with jurisdictions, and concepts without a list meet every query.
    """
    one = lambda kind, key: F.array(F.struct(F.lit(kind).alias("kind"), key.alias("key")))
    none = F.array().cast("array<struct<kind:string,key:string>>")

    def held_by(code: Column) -> Column:
        parts = F.split(code, "-")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))

    as_keys = lambda kind, codes: F.transform(codes, lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("key")))
    place, js = F.col("place"), F.col("jurisdictions")
    asks = F.when(place.isNull(), F.concat(one("all", F.lit("")), one("any", F.lit("")))).otherwise(F.concat(as_keys("over", held_by(place)), one("under", place), one("any", F.lit(""))))
    over, under = as_keys("over", js), F.flatten(F.transform(js, lambda j: as_keys("under", held_by(j))))
    has = F.when(js.isNull(), one("any", F.lit(""))).otherwise(F.concat(over, under, F.when(F.size(js) > 0, one("all", F.lit(""))).otherwise(none)))
    keyed = lambda df, item, keys: df.select(item, F.explode(keys).alias("k")).select(item, "k.kind", "k.key")
    return keyed(queries, "query_id", asks).join(keyed(concepts, "concept_id", has), ["kind", "key"]).select("query_id", "concept_id").distinct()


def search(queries: DataFrame, concepts: DataFrame, facts: DataFrame, prior: DataFrame, query_vectors: DataFrame | None = None, vectors: DataFrame | None = None, limit: int = 3) -> DataFrame:
    """query_id, concept_id, rank, score, verdict for queries (query_id, text, place).

    Words alone rank by weight; with vectors, both lists are fused by reciprocal ranks. The verdict rests on the
    words that are not facets and, with vectors, on the best cosine of the concepts that apply.
    """
    allowed = applying(queries, concepts)
    fields, asked = concept_fields(concepts, facts), query_tokens(queries)
    every = concepts.count()
    hits = lexical_hits(asked.select("query_id", "token"), fields, "query_id", "concept_id", every, prior).join(allowed, ["query_id", "concept_id"], "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "concept_id")
    words = hits.withColumn("rank", F.row_number().over(order)).select("query_id", "concept_id", "score", "rank")
    strength = lexical_hits(asked.filter("not facet").select("query_id", "token"), fields, "query_id", "concept_id", every).groupBy("query_id").agg(F.max("share").alias("share"), F.max("weight").alias("weight"))
    best = None
    if vectors is not None and query_vectors is not None:
        near = semantic_hits(query_vectors, vectors, allowed, prior)
        best = near.groupBy("query_id").agg(F.max("best").alias("best"))
        fused = fuse([words, near.filter("concept_id is not null")], ["query_id", "concept_id"])
        ranked = fused.withColumn("rank", F.row_number().over(order)).withColumn("score", F.round("score", 6))
    else:
        ranked = words.withColumn("score", F.round("score", 2))
    top = ranked.filter(F.col("rank") <= limit).join(strength, "query_id", "left")
    top = top.join(best, "query_id", "left") if best is not None else top.withColumn("best", F.lit(None).cast("double"))
    verdict = S.verdict(F.coalesce("share", F.lit(0.0)), F.coalesce("weight", F.lit(0.0)), F.col("best"))
    return top.select("query_id", "concept_id", "rank", "score", verdict.alias("verdict"))


def evidence_of(requests: DataFrame, facts: DataFrame, evidence: DataFrame, limit: int = 5) -> DataFrame:
    """request_id, place, evidence for ids (request_id, ids) that name evidence or, failing that, facts; first ``limit``, each once."""
    asked = requests.select("request_id", F.posexplode("ids").alias("at", "id"))
    direct = asked.join(evidence.select(F.col("evidence_id").alias("id")), "id").select("request_id", "at", F.lit(0).alias("part"), F.col("id").alias("evidence_id"))
    others = asked.join(evidence.select(F.col("evidence_id").alias("id")), "id", "left_anti")
    through = others.join(facts.select(F.col("fact_id").alias("id"), F.posexplode("evidence_ids").alias("part", "evidence_id")), "id").select("request_id", "at", "part", "evidence_id")
    first = direct.unionByName(through).groupBy("request_id", "evidence_id").agg(F.min(F.struct("at", "part")).alias("o"))
    order = Window.partitionBy("request_id").orderBy("o")
    return first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("request_id", "place", "evidence_id")


def citations(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """fact_id, url, excerpts, basis: evidence of a fact by page, with the page's strongest basis, the first of equals."""
    held = facts.select("fact_id", F.posexplode("evidence_ids").alias("at", "evidence_id")).join(evidence, "evidence_id")
    weight = S.weight_of(F.col("basis"), S.BASIS_WEIGHTS)
    return held.groupBy("fact_id", "url").agg(F.count("*").alias("excerpts"), F.max_by("basis", F.struct(weight, -F.col("at"))).alias("basis"), F.min("at").alias("first"))


def coverage_page(topics: DataFrame, concepts: DataFrame) -> DataFrame:
    """topic_id, concepts, jurisdictions of each topic, those without concepts too."""
    each = concepts.select("topic_id", "concept_id", F.explode_outer("jurisdictions").alias("j"))
    n = each.groupBy("topic_id").agg(F.countDistinct("concept_id").alias("concepts"), F.sort_array(F.collect_set("j")).alias("jurisdictions"))
    return topics.select("topic_id").join(n, "topic_id", "left").select("topic_id", F.coalesce("concepts", F.lit(0)).alias("concepts"), F.coalesce("jurisdictions", F.array().cast("array<string>")).alias("jurisdictions"))
