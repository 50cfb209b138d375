"""Acceptance of answers by kind of step, claims on what was served, and verdicts on cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise

RESULT = "struct<status:string,gaps:array<string>,bases:array<string>>"
#: Columns of expectations (null: none) and of answers that ``step_issues`` reads.
STEPS = (
    "case_id string, step int, kind string, expect_concept string, expect_strength string, expect_elsewhere array<string>, retrieval string, expect_error string, expect_scope string, "
    "expect_not_recognised array<string>, expect_status map<string,string>, expect_gap map<string,string>, expect_basis map<string,string>, expect_day date"
)
ANSWERS = (
    "case_id string, step int, error string, error_paths array<string>, hits array<string>, mode string, strength string, elsewhere array<string>, scope string, not_recognised array<string>, "
    f"results map<string,{RESULT}>, served boolean, status string, gaps array<string>, days array<date>"
)


def _listed(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def step_issues(steps: DataFrame, answers: DataFrame) -> DataFrame:
    """case_id, step, judged, issues of every step.

    A search must find its concept, with the strength that is expected, and name what is published elsewhere without ranking
    it; one that is meant for hybrid retrieval is not judged in another mode. A resolution must run for the place, leave the
    parts unrecognised, and have for each concept the status, a gap and a basis that are expected, or be rejected on the path
    that is. A lookup, judged where a connector serves its data, must have status, gap and first day; the expectations of its
    own are those of key "". A step without an answer is rejected.
    """
    c = F.col
    rows = steps.join(answers.withColumn("_there", F.lit(True)), ["case_id", "step"], "left")
    rejected = c("error").isNotNull() | c("_there").isNull()
    differs = lambda want, have: c(want).isNotNull() & ~c(want).eqNullSafe(c(have))
    each = lambda expected, name, bad: F.transform(F.filter(F.map_entries(F.coalesce(c(expected), F.create_map().cast("map<string,string>"))), bad), lambda e: F.concat(F.lit(f"{name}:"), e["key"]))
    one = lambda condition, text: F.array_compact(F.array(F.when(condition, text)))
    apart = F.filter(_listed("expect_elsewhere"), lambda x: F.array_contains(_listed("hits"), x) | ~F.array_contains(_listed("elsewhere"), x))
    search = F.when(rejected, one(F.lit(True), "rejected")).otherwise(F.concat(
        one(c("expect_concept").isNotNull() & ~F.array_contains(_listed("hits"), c("expect_concept")), "concept"), one(differs("expect_strength", "strength"), "strength"), F.transform(apart, lambda x: F.concat(F.lit("elsewhere:"), x)),
    ))
    asked_for = (c("error") == "INVALID_ARGUMENT") & F.array_contains(_listed("error_paths"), c("expect_error"))
    result = lambda e: F.try_element_at(c("results"), e["key"])
    lists = lambda r, field: F.coalesce(r[field], F.array().cast("array<string>"))
    resolve = F.when(rejected, one(~F.coalesce(asked_for, F.lit(False)), "rejected")).otherwise(F.concat(
        one(c("expect_error").isNotNull(), "not rejected"), one(differs("expect_scope", "scope"), "scope"),
        one(c("expect_not_recognised").isNotNull() & (F.array_sort(_listed("not_recognised")) != F.array_sort(_listed("expect_not_recognised"))), "not recognised"),
        each("expect_status", "status", lambda e: ~result(e)["status"].eqNullSafe(e["value"])), each("expect_gap", "gap", lambda e: ~F.array_contains(lists(result(e), "gaps"), e["value"])),
        each("expect_basis", "basis", lambda e: ~F.exists(lists(result(e), "bases"), lambda b: F.startswith(b, e["value"]))),
    ))
    own = lambda expected: F.try_element_at(c(expected), F.lit(""))
    lookup = F.when(rejected, one(F.lit(True), "rejected")).otherwise(F.concat(
        one(own("expect_status").isNotNull() & ~own("expect_status").eqNullSafe(c("status")), "status"), one(own("expect_gap").isNotNull() & ~F.array_contains(_listed("gaps"), own("expect_gap")), "gap"),
        one(c("expect_day").isNotNull() & ~F.get("days", F.lit(0)).eqNullSafe(c("expect_day")), "first day"),
    ))
    judged = F.when((c("kind") == "search") & (c("retrieval") == "hybrid"), rejected | (c("mode") == "hybrid")).when(c("kind") == "lookup", rejected & c("_there").isNull() | F.coalesce(c("served"), F.lit(False)))
    judged = F.coalesce(judged, F.lit(True))
    found = F.when(c("kind") == "search", search).when(c("kind") == "lookup", lookup).otherwise(resolve)
    return rows.select("case_id", "step", judged.alias("judged"), F.when(judged, found).otherwise(F.array().cast("array<string>")).alias("issues"))


def _phrases(claims: DataFrame, column: str) -> DataFrame:
    each = claims.select("claim_id", F.explode(column).alias("p"))
    return each.select("claim_id", normalise(F.col("p")).alias("phrase")).distinct()


def claim_issues(claims: DataFrame, served: DataFrame, excerpts: DataFrame) -> DataFrame:
    """claim_id, issue (null where the claim holds).

    ``claims``: claim_id, case_id, concept, fact_id (null for any fact of the concept), statement_contains, excerpt_contains;
    ``served``: case_id, concept, fact_id, statement; ``excerpts``: fact_id, excerpt. A served fact must state all phrases
    ("not served", "not stated"), and one excerpt of such a fact must have all of the others ("not backed"). Texts are compared
    without regard to case, width, soft hyphens and spacing, and each is brought to that form once.
    """
    facts = served.select("case_id", "concept", "fact_id", normalise(F.col("statement")).alias("said")).distinct()
    asked = claims.select("claim_id", "case_id", "concept", F.col("fact_id").alias("pinned"))
    met = asked.join(facts, ["case_id", "concept"]).filter(F.col("pinned").isNull() | (F.col("pinned") == F.col("fact_id")))
    n = lambda column: F.size(F.array_distinct(F.coalesce(F.col(column), F.array().cast("array<string>"))))

    def having(rows: DataFrame, text: str, column: str, *by: str) -> DataFrame:
        """Of claims with phrases in ``column``, the rows whose text has every one."""
        phrases = _phrases(claims, column)
        all_ = phrases.groupBy("claim_id").agg(F.count("*").alias("n"))
        hits = rows.join(phrases, "claim_id").filter(F.contains(text, F.col("phrase"))).groupBy("claim_id", *by).agg(F.count_distinct("phrase").alias("m"))
        return hits.join(all_, "claim_id").filter("m = n").select("claim_id", *by)

    plain = met.join(claims.filter(n("statement_contains") == 0).select("claim_id"), "claim_id", "left_semi").select("claim_id", "fact_id")
    stated = having(met, "said", "statement_contains", "fact_id").unionByName(plain).distinct()
    quoted = excerpts.select("fact_id", normalise(F.col("excerpt")).alias("quote")).distinct()
    backed = having(stated.join(quoted, "fact_id"), "quote", "excerpt_contains", "fact_id", "quote").select("claim_id").distinct()
    mark = lambda rows, name: rows.select("claim_id", F.lit(True).alias(name)).distinct()
    rows = claims.join(mark(met, "_served"), "claim_id", "left").join(mark(stated, "_stated"), "claim_id", "left").join(mark(backed, "_backed"), "claim_id", "left")
    issue = (
        F.when(F.col("_served").isNull() & F.col("fact_id").isNotNull(), "not served").when(F.col("_stated").isNull(), "not stated")
        .when((n("excerpt_contains") > 0) & F.col("_backed").isNull(), "not backed")
    )
    return rows.select("claim_id", issue.alias("issue"))


def case_verdicts(cases: DataFrame, steps: DataFrame, claims: DataFrame, served: DataFrame) -> DataFrame:
    """case_id, blocking, passed, n_issues of every case (case_id, blocking, must_not_serve, not_served).

    ``steps``: case_id, issues; ``claims``: case_id, issue; ``served``: case_id, concept, fact_id, not_served (what the concept
    says it does not serve). A fact that a case excludes must not be served; of each concept, phrases that a case says are
    declared as not served must be (``not_served``: array of concept and phrase).
    """
    n_steps = steps.groupBy("case_id").agg(F.sum(F.size("issues")).alias("s"))
    n_claims = claims.groupBy("case_id").agg(F.count("issue").alias("c"))
    barred = cases.select("case_id", F.explode("must_not_serve").alias("fact_id")).distinct().join(served.select("case_id", "fact_id").distinct(), ["case_id", "fact_id"]).groupBy("case_id").agg(F.count("*").alias("b"))
    declared = served.select("case_id", "concept", F.explode("not_served").alias("d")).distinct().select("case_id", "concept", normalise(F.col("d")).alias("d"))
    wanted = cases.select("case_id", F.explode("not_served").alias("w")).select("case_id", F.col("w.concept").alias("concept"), normalise(F.col("w.phrase")).alias("w")).distinct()
    named = wanted.join(declared, ["case_id", "concept"]).filter(F.contains("d", F.col("w"))).select("case_id", "concept", "w").distinct()
    unnamed = wanted.join(named, ["case_id", "concept", "w"], "left_anti").groupBy("case_id").agg(F.count("*").alias("u"))
    rows = cases.select("case_id", "blocking")
    for part in (n_steps, n_claims, barred, unnamed):
        rows = rows.join(part, "case_id", "left")
    total = sum((F.coalesce(F.col(k), F.lit(0)) for k in "scbu"), F.lit(0)).cast("bigint")
    return rows.select("case_id", "blocking", (total == 0).alias("passed"), total.alias("n_issues"))
