"""Resolution of facts for a place, a day and a context; keyed calendars; status roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import stale, valid_on

SUPPORTED, NEEDS_CONTEXT, OUT_OF_COVERAGE, STALE = "SUPPORTED", "NEEDS_CONTEXT", "OUT_OF_COVERAGE", "STALE"
PRIORITY = {NEEDS_CONTEXT: 4, STALE: 3, SUPPORTED: 2, OUT_OF_COVERAGE: 1}


def missing_context(required: Column, context: Column) -> Column:
    """Required keys that are absent or empty."""
    return F.filter(F.coalesce(required, F.array().cast("array<string>")), lambda k: F.coalesce(context[k], F.lit("")) == "")


def condition_holds(condition: Column, context: Column) -> Column:
    """Every entry of a condition equals the request's; no condition always holds."""
    return F.coalesce(F.forall(F.map_entries(condition), lambda e: F.coalesce(context[e["key"]] == e["value"], F.lit(False))), F.lit(True))


def resolved(requests: DataFrame, concepts: DataFrame, facts: DataFrame) -> DataFrame:
    """request_id, concept_id, status, gap, fact_ids.

    ``requests``: request_id, concept_id, place, as_of, context. ``concepts``: concept_id, required_context,
    stale_from. ``facts``: concept_id, fact_id, jurisdiction, condition, valid_from, valid_through, reviewed.
    Gates apply in order: unknown concept, place, context, condition, window, review. A request meets the facts of the
    places that lead to its own, by equality.
    """
    asked = requests.join(concepts, "concept_id", "left")
    held = facts.select("concept_id", "fact_id", "jurisdiction", "condition", "valid_from", "valid_through", "reviewed", F.lit(True).alias("held"))
    parts = F.split("place", "-")
    upward = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "-"))
    each = asked.withColumn("jurisdiction", F.explode_outer(F.when(F.col("place").isNotNull(), upward))).join(held, ["concept_id", "jurisdiction"], "left")
    here = F.col("held").isNotNull()
    fits = here & condition_holds(F.col("condition"), F.col("context"))
    now = fits & valid_on(F.col("as_of"), F.col("valid_from"), F.col("valid_through"))
    good = now & F.col("reviewed")
    counts = each.groupBy("request_id", "concept_id").agg(
        F.first(F.col("stale_from").isNull() & F.col("required_context").isNull()).alias("unknown"),
        F.first(F.size(missing_context(F.col("required_context"), F.col("context")))).alias("missing"),
        F.first(stale(F.col("as_of"), F.col("stale_from"))).alias("old"),
        *(F.count_if(c).alias(n) for n, c in (("n_here", here), ("n_fits", fits), ("n_now", now), ("n_good", good))),
        F.sort_array(F.collect_list(F.when(good, F.col("fact_id")))).alias("fact_ids"),
    )
    gap = (
        F.when(F.col("unknown"), "concept").when(F.col("n_here") == 0, "jurisdiction").when(F.col("missing") > 0, "context")
        .when(F.col("n_fits") == 0, "condition").when(F.col("n_now") == 0, "validity").when(F.col("n_good") == 0, "review")
    )
    status = F.when(gap == "context", NEEDS_CONTEXT).when(gap.isNotNull(), OUT_OF_COVERAGE).when(F.col("old"), STALE).otherwise(SUPPORTED)
    return counts.select("request_id", "concept_id", status.alias("status"), gap.alias("gap"), "fact_ids")


def rolled_up(rows: DataFrame, key: str, status: str = "status") -> DataFrame:
    """The status of highest priority in each key."""
    order = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    return rows.groupBy(key).agg(F.max_by(status, order[F.col(status)]).alias("status"))


def calendar(requests: DataFrame, events: DataFrame, periods: DataFrame, limit: int = 3) -> DataFrame:
    """request_id, gap, n_events, truncated, first_day for requests (request_id, key, from_day, to_day).

    ``events``: key, day. ``periods``: period_from, period_to of the calendar, one row; more are an error.
    """
    period = periods.select("period_from", "period_to").take(2)
    if len(period) != 1:
        raise ValueError(f"a calendar has one period, not {len(period)}")
    known = events.select("key").distinct().withColumn("known", F.lit(True))
    asked = requests.join(known, "key", "left").withColumns({c: F.lit(period[0][c]) for c in ("period_from", "period_to")})
    in_range = events.select("key", "day").join(requests, "key").filter(F.col("day").between(F.col("from_day"), F.col("to_day")))
    found = in_range.groupBy("request_id").agg(F.count("*").alias("n"), F.min("day").alias("first_day"))
    gap = (
        F.when(F.col("known").isNull(), "key")
        .when((F.col("to_day") < F.col("period_from")) | (F.col("from_day") > F.col("period_to")), "period")
        .when(F.coalesce("n", F.lit(0)) == 0, "empty")
    )
    out = asked.join(found, "request_id", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("request_id", gap.alias("gap"), F.least(n, F.lit(limit)).alias("n_events"), (n > limit).alias("truncated"), "first_day")


def top_rows(rows: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= limit)
