"""Acquisition runs, reviews, acceptance replays and regression roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut
from .curation import GAP_CLASSES

# What a saved page can look like by its flags, the first that holds; the gap, and whether trying again can help.
SAVED_GAPS = (
    ("error_page_title", "soft-error-page", True), ("javascript_application_shell", "javascript-shell", False), ("possible_access_challenge", "access-challenge", True),
    ("unexpected_media_type", "unexpected-media-type", True), ("browser-rendered-dom-not-raw-http-response", "rendered-dom", False),
)


def target_gaps(targets: DataFrame, attempts: DataFrame, covered: DataFrame) -> DataFrame:
    """url, status, attempts, saved_attempts, gap, retriable: one verdict for every target.

    ``targets``: url, needs_review; ``attempts``: url, attempt, status, flags (a set of what a saved page looks like),
    failure (the class of an attempt that failed; one that isn't listed is unclassified); ``covered``: url of shells
    whose documents a plugin has. The latest attempt says whether the target is saved; the first flag that holds, or the
    most specific failure of any attempt, is its gap. A target that needs review is not tried again while it has a gap.
    """
    rank = F.create_map(*(F.lit(x) for k, (name, _) in enumerate(GAP_CLASSES) for x in (name, k)))
    again = F.create_map(*(F.lit(x) for pair in GAP_CLASSES for x in pair), *(F.lit(x) for _, gap, retry in SAVED_GAPS for x in (gap, retry)))
    known = F.when(rank[F.col("failure")].isNull(), "unclassified").otherwise(F.col("failure"))
    per = attempts.groupBy("url").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("status") == "saved").alias("saved_attempts"),
        F.max_by(F.struct("status", "flags"), "attempt").alias("latest"), F.min(F.when(F.col("status") != "saved", F.struct(rank[known].alias("rank"), known.alias("failure")))).alias("worst"),
    )
    rows = targets.join(per, "url", "left").join(covered.select("url", F.lit(True).alias("covered")).distinct(), "url", "left")
    status, flags = F.coalesce("latest.status", F.lit("pending")), F.coalesce("latest.flags", F.array().cast("array<string>"))
    look = F.coalesce(*(F.when(F.array_contains(flags, flag), gap) for flag, gap, _ in SAVED_GAPS), F.lit("none"))
    look = F.when((look == "javascript-shell") & F.col("covered").isNotNull(), "javascript-shell-resolved").otherwise(look)
    gap = F.when(status == "saved", look).otherwise(F.coalesce("worst.failure", F.lit("not-attempted")))
    retry = F.coalesce(F.try_element_at(again, gap), F.lit(False)) & ~F.coalesce("needs_review", F.lit(False))
    return rows.select("url", status.alias("status"), F.coalesce("attempts", F.lit(0).cast("bigint")).alias("attempts"), F.coalesce("saved_attempts", F.lit(0).cast("bigint")).alias("saved_attempts"), gap.alias("gap"), retry.alias("retriable"))


def decided(rows: DataFrame, decisions: DataFrame, *fields: str) -> DataFrame:
    """``rows`` with the latest decision on the same fingerprint of ``fields``, however old; decisions on other states
    of an item only are stale."""
    mark = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)), 256)
    same = decisions.groupBy("item", "fingerprint").agg(F.max_by("decision", "at").alias("_same"))
    any_ = decisions.select("item", F.lit(True).alias("_any")).distinct()
    out = rows.withColumn("fingerprint", mark).join(same, ["item", "fingerprint"], "left").join(any_, "item", "left")
    return out.withColumn("review", F.when(F.col("_same").isNotNull(), F.col("_same")).when(F.col("_any"), "stale").otherwise("open")).drop("_same", "_any")


def next_attempts(attempts: DataFrame, urls: DataFrame) -> DataFrame:
    """url, attempt: the number that each address's next attempt has."""
    last = attempts.groupBy("url").agg(F.max("attempt").alias("last"))
    return urls.join(last, "url", "left").select("url", (F.coalesce("last", F.lit(0)) + 1).cast("bigint").alias("attempt"))


def first_of(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def merged(drafts: DataFrame, keys: list[str], values: str, order: str, confidence: str, most: int) -> DataFrame:
    """Drafts of equal ``keys`` as one: values in order of first appearance, at most ``most``, the highest confidence."""
    first = drafts.groupBy(*keys, values).agg(F.min(order).alias("_at"))
    w = Window.partitionBy(*keys).orderBy("_at", values)
    kept = first.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    lists = kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", values))), lambda x: x[values]).alias(values))
    n = drafts.groupBy(*keys).agg(F.count("*").alias("drafts"), F.max(confidence).alias(confidence))
    return n.join(lists, keys, "left")


def reached(edges: DataFrame, seeds: DataFrame, a: str, b: str) -> DataFrame:
    """node of everything that ``seeds`` (node) reach along ``edges``; rounds end when nothing new is found, which they
    do after as many as the longest of the shortest ways. Each round's nodes are checkpointed in the shared folder."""
    found = frontier = cut(seeds.select("node").distinct())
    while True:
        step = cut(edges.join(frontier, F.col(a) == F.col("node"), "left_semi").select(F.col(b).alias("node")).distinct().join(found, "node", "left_anti"))
        if step.isEmpty():
            return found
        found, frontier = cut(found.unionByName(step)), step


def case_issues(steps: DataFrame, answers: DataFrame) -> DataFrame:
    """case_id, step, issues of every step of an acceptance case: what differs from what it expects.

    ``steps``: case_id, step, kind, status, gap, first_day, facts (those it must serve), forbidden (those it must not);
    ``answers``: case_id, step, got_status, got_gap, got_day, got_facts. Null expectations do not bind.
    """
    rows = steps.join(answers, ["case_id", "step"], "left")
    got = F.coalesce("got_facts", F.array().cast("array<bigint>"))
    differs = lambda want, have: F.col(want).isNotNull() & ~F.col(want).eqNullSafe(F.col(have))
    checks = [
        F.when(F.col("got_status").isNull(), "no answer"), F.when(F.col("got_status").isNotNull() & differs("status", "got_status"), "status"),
        F.when(F.col("got_status").isNotNull() & differs("gap", "got_gap"), "gap"), F.when((F.col("kind") == "lookup") & F.col("got_status").isNotNull() & differs("first_day", "got_day"), "first day"),
        F.when(F.size(F.array_except(F.coalesce("facts", F.array().cast("array<bigint>")), got)) > 0, "facts missing"), F.when(F.arrays_overlap(F.coalesce("forbidden", F.array().cast("array<bigint>")), got), "forbidden facts"),
    ]
    return rows.select("case_id", "step", F.array_compact(F.array(*checks)).alias("issues"))


def regression(results: DataFrame, mode: str, case: str, passed: str, blocking: str) -> DataFrame:
    """mode, cases, passed, failed, quarantined, quarantined_passing, ok of every retrieval mode's replay."""
    ok, must = F.col(passed), F.col(blocking)
    out = results.groupBy(mode).agg(F.count("*").alias("cases"), F.count_if(ok).alias("n_passed"), F.count_if(must & ~ok).alias("failed"), F.count_if(~must).alias("quarantined"), F.count_if(~must & ok).alias("quarantined_passing"))
    return out.withColumn("ok", F.col("failed") == 0)


def answer_verdicts(cases: DataFrame, grades: DataFrame, repetitions: int, pass_rate: float) -> DataFrame:
    """case_id, passed, reason of graded sessions. ``grades``: case_id, graded, trap_held, criteria_pass."""
    rows = cases.join(grades, "case_id", "left")
    graded = F.coalesce("graded", F.lit(0))
    reasons = F.array_compact(F.array(F.when(graded < repetitions, "few sessions"), F.when(F.col("trap_held") != graded, "trap"), F.when(F.col("criteria_pass") / graded < pass_rate, "criteria")))
    reason = F.when(graded == 0, "no graded session").otherwise(F.array_join(reasons, "; "))
    return rows.select("case_id", (reason == "").alias("passed"), reason.alias("reason"))


def benchmark_summary(samples: DataFrame, mode: str, language: str, case: str, metric: str, millis: str) -> DataFrame:
    """mode, language, case, n, mean metric without nulls, nearest-rank p95: by mode, by mode and language, by mode and case."""
    m, l, c = (F.col(x) for x in (mode, language, case))
    p95 = F.expr(f"round(percentile_disc(0.95) WITHIN GROUP (ORDER BY {millis}), 3)").alias("p95")
    return samples.groupingSets([[m], [m, l], [m, c]], m, l, c).agg(F.count("*").alias("n"), F.round(F.avg(metric), 6).alias("mean"), p95)
