"""Checks of a whole knowledge release as issue rows: identities, references, hashes, declared values, bases."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import BASIS_WEIGHTS, contains_place, weight_of
from .places import level_of

# Identifiers, languages, kinds that name a norm, and the words of levels.
IDENTIFIER, LANGUAGE = r"^[A-Za-z0-9][A-Za-z0-9._-]*$", "^[a-z]{2,3}$"
NORM_KINDS = ("act", "ordinance", "treaty", "directive")
LEVELS = ("federal", "cantonal", "municipal")
BASIS = "struct<level:string,kind:string,norm:string,refers_to:string,label:string>"


class Release(NamedTuple):
    documents: DataFrame  # document_id, institution_id, accessed_on, content_sha256, raw_sha256
    topics: DataFrame  # topic_id
    concepts: DataFrame  # concept_id, topic_id, label, description, fact_ids, jurisdictions, required_context, context_schema (map of a field to its values or null)
    facts: DataFrame  # fact_id, concept_id, statement, jurisdiction, valid_from, valid_through, condition (map), evidence_ids, kind, review_status, basis
    evidence: DataFrame  # evidence_id, document_id, start, end, excerpt, excerpt_sha256, language, content_sha256, raw_sha256, institution_id, basis
    institutions: DataFrame  # institution_id, name, level, jurisdiction


class Manifest(NamedTuple):
    jurisdictions: list[str]
    languages: list[str]
    snapshot_date: date
    provenance_kinds: dict[str, int]
    review_statuses: dict[str, int]
    institution_levels: dict[str, int]
    basis_kinds: dict[str, int]


def basis_label(level: Column, kind: Column, norm: Column, refers_to: Column) -> Column:
    """What an excerpt rests on, in words; null for a kind that needs a norm and has none, or that isn't known."""
    word = F.initcap(level)
    named = F.when(F.trim(norm) != "", norm)
    text = (
        F.when(kind.isin("act", "ordinance"), F.concat(word, F.lit(" "), kind, F.lit(": "), named)).when(kind == "treaty", F.concat(F.lit("International agreement: "), named))
        .when(kind == "directive", F.concat(word, F.lit(" directive: "), named)).when(kind == "guidance", F.concat(word, F.lit(" authority guidance")))
        .when(kind == "directory", F.concat(word, F.lit(" authority directory"))).when(kind == "summary", F.concat(F.lit("Portal summary of "), level, F.lit(" rules")))
    )
    return F.concat(text, F.coalesce(F.concat(F.lit(", referring to "), F.when(refers_to != "", refers_to)), F.lit("")))


def basis_of(own: Column, page_rule: Column, institution_level: Column, article: Column, annex: Column) -> Column:
    """level, kind, norm, refers_to, label, rule and error of a citation's basis.

    ``own`` and ``page_rule`` are structs of level, kind, norm and refers_to, null where not given: the citation's own comes
    first, then that of the page's longest rule, then guidance of a page with an institution. A law's article follows the
    norm of a page rule that names none; next to a norm that a citation writes itself it is not added.
    """
    default = institution_level.isNotNull()
    pick = lambda f: F.when(own.isNotNull(), own[f]).when(page_rule.isNotNull(), page_rule[f])
    rule = F.when(own.isNotNull(), "citation").when(page_rule.isNotNull(), "page rule").when(default, "default").otherwise("none")
    kind = F.coalesce(pick("kind"), F.when(rule == "default", "guidance"))
    level = F.coalesce(pick("level"), F.when(rule != "none", institution_level))
    law = kind.isin("act", "ordinance", "treaty") & article.isNotNull() & (rule != "citation")
    norm = F.when(law, F.concat_ws(", ", pick("norm"), F.concat(F.lit("Annex "), annex), article)).otherwise(pick("norm"))
    error = F.when((rule != "none") & level.isNull(), "no level").when(kind.isin(*NORM_KINDS) & (F.coalesce(F.trim(norm), F.lit("")) == ""), "no norm")
    return F.struct(level.alias("level"), kind.alias("kind"), norm.alias("norm"), pick("refers_to").alias("refers_to"), basis_label(level, kind, norm, pick("refers_to")).alias("label"), rule.alias("rule"), error.alias("error"))


def _found(rows: DataFrame, key: str, **bad: Column) -> DataFrame:
    """The rules, each by its condition, that rows break, all in one pass."""
    broken = F.array_compact(F.array(*(F.when(condition, rule.replace("__", ".")) for rule, condition in bad.items())))
    return rows.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def _without(rows: DataFrame, rule: str, key: str, on: str, known: DataFrame) -> DataFrame:
    return rows.join(known.select(F.col(on)).distinct(), on, "left_anti").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def _counts(rows: DataFrame, by: Column, stated: dict[str, int], rule: str) -> DataFrame:
    """One issue where the counts of a field, which has a handful of values, are not those stated."""
    have = rows.filter(by.isNotNull()).groupBy(by.cast("string").alias("k")).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.concat_ws("=", "k", F.col("n").cast("string"))))
    want = F.array_sort(F.array(*(F.lit(f"{k}={n}") for k, n in stated.items()))) if stated else F.array().cast("array<string>")
    return have.agg(pairs.alias("have")).filter(F.col("have") != want).select(F.lit(rule).alias("rule"), F.lit("manifest").alias("key"))


def issue_parts(r: Release, m: Manifest, jurisdiction: str) -> Iterator[DataFrame]:
    """The issues of ``release_issues`` in parts, each with shuffles of its own: written one after another, no more than
    those of one part lie on the executors' disks at a time.

    Every rule is a filter, an anti join or a count; parts meet by their ids, so none is held by one task or the driver.
    """
    c, listed = F.col, lambda a: F.coalesce(a, F.array().cast("array<string>"))
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    b = lambda f: c(f"basis.{f}")

    def ids(name: str, rows: DataFrame) -> DataFrame:
        key = f"{name}_id"
        return _found(rows.groupBy(key).agg(F.count("*").alias("n")), key, **{f"{name}__duplicate": c("n") > 1, f"{name}__id": ~c(key).rlike(IDENTIFIER)})

    out = [ids("document", r.documents), ids("topic", r.topics), ids("concept", r.concepts), ids("institution", r.institutions)]
    names = r.concepts.select(c("concept_id").alias("by"), F.explode(listed(c("fact_ids"))).alias("fact_id"))
    of = r.facts.select("fact_id", "concept_id", "jurisdiction")
    met = names.join(of, "fact_id", "left")
    out += [_without(r.concepts, "concept.topic", "concept_id", "topic_id", r.topics), _found(met, "by", concept__fact=c("concept_id").isNull()), _found(met, "fact_id", fact__concept=c("by") != c("concept_id"))]
    own = met.filter(c("by") == c("concept_id")).groupBy("by").agg(F.array_sort(F.collect_set("jurisdiction")).alias("have"))
    held = r.concepts.join(own, c("concept_id") == c("by"), "left").withColumn("have", listed(c("have")))
    fields = F.map_keys(F.coalesce("context_schema", F.create_map().cast("map<string,array<string>>")))
    out.append(_found(
        held, "concept_id", concept__text=blank("label") | blank("description"), concept__jurisdictions=c("have") != F.array_sort(listed(c("jurisdictions"))),
        concept__context=F.size(F.array_except(listed(c("required_context")), fields)) > 0,
    ))

    schema = r.concepts.select("concept_id", "context_schema", F.lit(True).alias("known")).dropDuplicates(["concept_id"])
    pairs = names.select(c("by").alias("concept_id"), "fact_id", F.lit(True).alias("listed")).distinct()
    formed = c("jurisdiction").rlike(jurisdiction)
    facts = r.facts.join(schema, "concept_id", "left").join(pairs, ["concept_id", "fact_id"], "left")
    out += [ids("fact", r.facts), _found(
        facts, "fact_id", fact__unknown_concept=c("known").isNull(), fact__unlisted=c("known") & c("listed").isNull(), fact__jurisdiction=~formed, fact__undeclared_jurisdiction=formed & ~c("jurisdiction").isin(m.jurisdictions),
        fact__statement=blank("statement"), fact__validity=c("valid_through") < c("valid_from"),
    )]
    allowed = F.try_element_at(c("context_schema"), c("field"))
    has = F.coalesce(F.array_contains(F.map_keys("context_schema"), c("field")), F.lit(False))
    conditions = r.facts.select("fact_id", "concept_id", F.explode("condition").alias("field", "value")).join(schema, "concept_id", "left")
    out.append(_found(conditions, "fact_id", fact__condition_field=~has, fact__condition_value=has & allowed.isNotNull() & ~F.array_contains(allowed, c("value"))))
    yield _all(out)

    i = r.institutions
    levels = F.element_at(F.array(*map(F.lit, LEVELS)), level_of(c("jurisdiction")) + 1)
    named = r.documents.filter("institution_id is not null")
    cited = r.facts.select("fact_id", c("jurisdiction").alias("of"), F.posexplode(listed(c("evidence_ids"))).alias("at", "evidence_id"))
    speaking = r.evidence.filter("institution_id is not null").select("evidence_id", "institution_id").join(i.select("institution_id", c("jurisdiction").alias("speaks")), "institution_id")
    yield _all([
        ids("evidence", r.evidence), _found(cited.join(speaking, "evidence_id"), "fact_id", fact__institution=~contains_place(c("speaks"), c("of"))),
        _found(i, "institution_id", institution__jurisdiction=~formed, institution__level=formed & (levels != c("level")), institution__name=blank("name")),
        _without(i, "institution.uncited", "institution_id", "institution_id", named), _without(named, "document.institution", "document_id", "institution_id", i),
        _without(r.documents, "document.uncited", "document_id", "document_id", r.evidence), _found(r.documents, "document_id", document__accessed=c("accessed_on") > F.lit(m.snapshot_date)),
        r.documents.filter("institution_id is null").join(i.limit(1).select(F.lit(True).alias("any")), F.lit(True), "left_semi").select(F.lit("document.no_institution").alias("rule"), c("document_id").cast("string").alias("key")),
        _counts(r.facts, c("kind"), m.provenance_kinds, "manifest.provenance_kinds"), _counts(r.facts, c("review_status"), m.review_statuses, "manifest.review_statuses"),
        _counts(r.facts, b("kind"), m.basis_kinds, "manifest.basis_kinds"), _counts(r.documents.join(i, "institution_id"), c("level"), m.institution_levels, "manifest.institution_levels"),
    ])

    # what a row of evidence says by itself needs no document
    spoken, lacks = c("language").rlike(LANGUAGE), b("kind").isin(*NORM_KINDS) & blank(b("norm"))
    docs = r.documents.select("document_id", c("content_sha256").alias("d_content"), c("raw_sha256").alias("d_raw"), c("institution_id").alias("d_institution"), F.lit(True).alias("known"))
    known = c("known").isNotNull()
    yield _all([
        _found(
            r.evidence, "evidence_id", evidence__offsets=(c("end") <= c("start")) | (F.length("excerpt") != c("end") - c("start")), evidence__excerpt_hash=F.sha2("excerpt", 256) != c("excerpt_sha256"),
            evidence__language=~spoken, evidence__undeclared_language=spoken & ~c("language").isin(m.languages), evidence__basis=c("basis").isNull() & c("institution_id").isNotNull(), evidence__norm=lacks,
            evidence__label=c("basis").isNotNull() & ~F.coalesce(lacks, F.lit(False)) & ~b("label").eqNullSafe(basis_label(b("level"), b("kind"), b("norm"), b("refers_to"))),
        ),
        _found(
            r.evidence.select("evidence_id", "document_id", "content_sha256", "raw_sha256", "institution_id").join(docs, "document_id", "left"), "evidence_id", evidence__document=~known,
            evidence__content_hash=c("content_sha256") != c("d_content"), evidence__raw_hash=c("raw_sha256") != c("d_raw"), evidence__institution=known & ~c("institution_id").eqNullSafe(c("d_institution")),
        ),
    ])

    yield _without(r.evidence, "evidence.uncited", "evidence_id", "evidence_id", cited)
    yield _without(cited, "fact.evidence", "fact_id", "evidence_id", r.evidence)

    met = cited.select("fact_id", "at", "evidence_id").join(r.evidence.filter("basis is not null").select("evidence_id", "basis"), "evidence_id")
    best = met.groupBy("fact_id").agg(F.max_by("basis", F.struct(weight_of(b("kind"), BASIS_WEIGHTS), -c("at"))).alias("best"))
    rests = r.facts.select("fact_id", "jurisdiction", "basis").join(best, "fact_id", "left")
    yield _found(rests, "fact_id", fact__basis=~c("basis").eqNullSafe(c("best")), fact__federal_basis=(level_of(c("jurisdiction")) == 0) & (b("level") != "federal"))


def release_issues(r: Release, m: Manifest, jurisdiction: str) -> DataFrame:
    """rule, key of everything that a release has wrong. ``jurisdiction`` is the pattern of its codes."""
    return _all(list(issue_parts(r, m, jurisdiction)))


def _all(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for rows in parts[1:]:
        every = every.unionAll(rows)
    return every
