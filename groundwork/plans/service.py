"""Resolution, calendars, constraints and operations on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import valid_on
from ..functions.scores import weight_of
from ..operators import operations as O
from ..operators import quality as Q
from ..operators import records, resolution, rules
from .registry import query, table


@query("""
    SELECT event_type, count(*) AS calls, count(*) FILTER (value < 10) AS failed,
           round(quantile_disc(value, 0.5), 1) AS p50, round(quantile_disc(value, 0.95), 1) AS p95, round(quantile_disc(value, 0.99), 1) AS p99
    FROM events GROUP BY event_type
""")
def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.latency(table(spark, sf_dir, "events"), "event_type", "value", F.col("value") < 10)


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, event_type, count(*) AS calls FROM events GROUP BY ALL")
def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.traffic(table(spark, sf_dir, "events"), "ts", "event_type")


@query("""
    WITH s AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s)
    SELECT user_id, min(ts) AS started, count(*) AS calls FROM n GROUP BY user_id, session
""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")


@query("""
    SELECT event_type, weekday, count(*) AS calls FROM (SELECT event_type, dayofweek(ts)::INT + 1 AS weekday FROM events)
    GROUP BY GROUPING SETS ((event_type), (weekday), (event_type, weekday))
""")
def gap_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("weekday", F.dayofweek("ts"))
    both = [F.col("event_type"), F.col("weekday")]
    return rows.groupingSets([[both[0]], [both[1]], both], *both).agg(F.count("*").alias("calls"))


@query("""
    SELECT user_id, event_type, count(*) AS calls FROM events GROUP BY ALL ORDER BY calls DESC, user_id, event_type LIMIT 20
""")
def top_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "user_id", "event_type").limit(20)


_CHAIN = """
    e AS (SELECT user_id, event_id, sha256(event_id || '|' || event_type || '|' || props) AS digest, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    l AS (SELECT user_id, event_id, digest, n, '' AS previous, sha256(digest) AS link FROM e WHERE n = 1
          UNION ALL SELECT e.user_id, e.event_id, e.digest, e.n, l.link, sha256(l.link || e.digest) FROM l JOIN e ON e.user_id = l.user_id AND e.n = l.n + 1)
"""


@query(f"WITH RECURSIVE {_CHAIN} SELECT user_id, event_id, digest, previous, link FROM l")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")
    return O.chained(table(spark, sf_dir, "events"), "user_id", "event_id", body)


@query("SELECT user_id, event_id FROM events WHERE event_id % 501 = 7")
def chain_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain with some events altered after they were sealed: those and no others break it."""
    events = table(spark, sf_dir, "events")
    body = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")
    stored = O.chained(events, "user_id", "event_id", body).select("user_id", "event_id", "previous", "link")
    altered = events.withColumn("props", F.when(F.col("event_id") % 501 == 7, F.concat("props", F.lit(" "))).otherwise(F.col("props")))
    return O.chain_breaks(stored.join(altered, ["user_id", "event_id"]), "user_id", "event_id", body)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a code of region, nation and themselves."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    code = F.concat_ws("-", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(code.alias("code"), "c_custkey", "c_acctbal")


@query("""
    WITH c AS (SELECT n_regionkey || '-' || n_nationkey || '-' || c_custkey AS code, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
    o AS (SELECT c_acctbal, unnest([code, regexp_replace(code, '-[0-9]+$', ''), regexp_extract(code, '^[0-9]+')]) AS outer_code FROM c)
    SELECT outer_code AS "outer", count(*) AS held, round(sum(c_acctbal), 2) AS balance FROM o GROUP BY outer_code
""")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _places(spark, sf_dir)
    held = places.join(rules.holders(places, "code"), "code")
    return held.groupBy("outer").agg(F.count("*").alias("held"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""
    SELECT o_orderstatus, count(*) FILTER (coalesce(o_orderdate <= DATE '1996-06-30', true) AND coalesce(DATE '1996-06-30' <= until, true)) AS valid, count(*) AS facts
    FROM (SELECT o_orderstatus, o_orderdate::DATE AS o_orderdate, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE + 365 END AS until FROM orders) GROUP BY ALL
""")
def validity_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as facts: valid from their date, for a year when finished, else without end."""
    start = F.to_date("o_orderdate")
    until = F.when(F.col("o_orderstatus") == "F", F.date_add(start, 365))
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(valid_on(F.to_date(F.lit("1996-06-30")), start, until)).alias("valid"), F.count("*").alias("facts"))


_STATUS = "CASE o_orderstatus WHEN 'P' THEN 'NEEDS_CONTEXT' WHEN 'O' THEN 'STALE' WHEN 'F' THEN 'SUPPORTED' ELSE 'OUT_OF_COVERAGE' END"


@query(f"""
    WITH s AS (SELECT o_custkey, {_STATUS} AS status FROM orders)
    SELECT o_custkey, arg_max(status, CASE status WHEN 'NEEDS_CONTEXT' THEN 4 WHEN 'STALE' THEN 3 WHEN 'SUPPORTED' THEN 2 ELSE 1 END) AS status FROM s GROUP BY o_custkey
""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.rolled_up(table(spark, sf_dir, "orders").select("o_custkey", F.expr(_STATUS).alias("status")), "o_custkey")


@query("""
    WITH k AS (SELECT c_custkey AS key, DATE '1995-01-01' + (c_custkey % 2500)::INT AS from_day FROM customer),
    p AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders),
    n AS (SELECT key, count(*) AS n, min(o_orderdate)::DATE AS first_day FROM k JOIN orders ON o_custkey = key AND o_orderdate::DATE BETWEEN from_day AND from_day + 180 GROUP BY key)
    SELECT key AS request_id, CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = key) THEN 'key'
                WHEN from_day + 180 < a OR from_day > b THEN 'period' WHEN coalesce(n, 0) = 0 THEN 'empty' END AS gap,
           least(coalesce(n, 0), 3) AS n_events, coalesce(n, 0) > 3 AS truncated, first_day
    FROM k LEFT JOIN n USING (key), p
""")
def calendar_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("day"))
    start = F.date_add(F.to_date(F.lit("1995-01-01")), (F.col("c_custkey") % 2500).cast("int"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("key"), start.alias("from_day"), F.date_add(start, 180).alias("to_day"))
    return resolution.calendar(asked, events, events.agg(F.min("day").alias("period_from"), F.max("day").alias("period_to")))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def newest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.newest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")


@query("""
    SELECT 'lineitem.order' AS rule, l_orderkey::VARCHAR AS key, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY ALL
    UNION ALL SELECT 'orders.customer', o_custkey::VARCHAR, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY ALL
    UNION ALL SELECT 'labels.document', doc_id::VARCHAR, count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY ALL
    UNION ALL SELECT 'documents.label', doc_id::VARCHAR, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL
""")
def fk_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return Q.all_issues(
        Q.orphans(t("lineitem"), t("orders"), "lineitem.order", "l_orderkey", "o_orderkey"),
        Q.orphans(t("orders"), t("customer"), "orders.customer", "o_custkey", "c_custkey"),
        Q.orphans(t("labels"), t("documents"), "labels.document", "doc_id", "doc_id"),
        Q.orphans(t("documents"), t("labels"), "documents.label", "doc_id", "doc_id"),
    )


@query("""
    SELECT 'documents.text' AS rule, sha256(text) AS key, count(*) AS n FROM documents GROUP BY sha256(text) HAVING count(*) > 1
    UNION ALL SELECT 'documents.id', doc_id::VARCHAR, count(*) FROM documents GROUP BY doc_id HAVING count(*) > 1
    UNION ALL SELECT 'orders.id', o_orderkey::VARCHAR, count(*) FROM orders GROUP BY o_orderkey HAVING count(*) > 1
    UNION ALL SELECT 'lineitem.id', l_orderkey || '/' || l_linenumber, count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def pk_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return Q.all_issues(
        Q.duplicate_keys(docs.select(F.sha2("text", 256).alias("h")), "documents.text", "h"),
        Q.duplicate_keys(docs, "documents.id", "doc_id"),
        Q.duplicate_keys(table(spark, sf_dir, "orders"), "orders.id", "o_orderkey"),
        Q.duplicate_keys(table(spark, sf_dir, "lineitem"), "lineitem.id", "l_orderkey", "l_linenumber"),
    )


@query("""
    SELECT 'documents.n_chars' AS rule, doc_id::VARCHAR AS key, 1::BIGINT AS n FROM documents WHERE coalesce(n_chars <> length(text), true)
    UNION ALL SELECT 'events.value', event_id::VARCHAR, 1 FROM events WHERE NOT coalesce(value BETWEEN 1 AND 200, false)
    UNION ALL SELECT 'customer.balance', c_custkey::VARCHAR, 1 FROM customer WHERE NOT coalesce(c_acctbal >= 0, false)
""")
def domain_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.all_issues(
        Q.violations(table(spark, sf_dir, "documents"), "documents.n_chars", "doc_id", F.col("n_chars") == F.length("text")),
        Q.violations(table(spark, sf_dir, "events"), "events.value", "event_id", F.col("value").between(1, 200)),
        Q.violations(table(spark, sf_dir, "customer"), "customer.balance", "c_custkey", F.col("c_acctbal") >= 0),
    )


@query("""
    SELECT c_nationkey, count(DISTINCT o_orderkey) AS facts, count(*) AS evidence, min(l_shipdate)::DATE AS first_accessed
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey
""")
def citation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence (lineitem) to facts (orders) to the bodies that publish them (customers by nation)."""
    facts = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    bodies = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min(F.to_date("l_shipdate")).alias("day"))
    rows = per_order.join(facts, F.col("l_orderkey") == F.col("o_orderkey")).join(bodies, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_nationkey").agg(F.count("*").alias("facts"), F.sum("n").alias("evidence"), F.min("day").alias("first_accessed"))


_KINDS = {"R": "summary", "A": "guidance", "N": "act"}


@query("""
    SELECT l_orderkey, max(CASE l_returnflag WHEN 'N' THEN 1.0::DOUBLE WHEN 'A' THEN 0.9::DOUBLE WHEN 'R' THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END) AS authority,
           arg_max(l_linenumber, (CASE l_returnflag WHEN 'N' THEN 1.0 WHEN 'A' THEN 0.9 WHEN 'R' THEN 0.75 ELSE 1.0 END, -l_linenumber)) AS strongest
    FROM lineitem GROUP BY l_orderkey
""")
def authority_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of the strongest basis of each fact, and which piece of evidence has it, the first of equals."""
    kind = F.create_map(*(F.lit(x) for kv in _KINDS.items() for x in kv))[F.col("l_returnflag")]
    from ..functions.scores import BASIS_WEIGHTS

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", weight_of(kind, BASIS_WEIGHTS).alias("w"))
    return rows.groupBy("l_orderkey").agg(F.max("w").alias("authority"), F.max_by("l_linenumber", F.struct("w", -F.col("l_linenumber"))).alias("strongest"))


@query("""
    WITH e AS (
        SELECT c_custkey, o_orderkey IS NOT NULL AS here, o_orderdate::DATE <= DATE '1996-06-30' AS now,
               CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN o_orderstatus = 'F' ELSE o_orderstatus = 'O' END AS fits
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey
    ), n AS (
        SELECT c_custkey, count(*) FILTER (here) AS n_here, count(*) FILTER (here AND fits) AS n_fits, count(*) FILTER (here AND fits AND now) AS n_now FROM e GROUP BY ALL
    )
    SELECT c_custkey AS request_id, CASE WHEN n_here = 0 THEN 'concept' WHEN n_fits = 0 THEN 'condition' WHEN n_now = 0 THEN 'validity' END AS gap,
           CASE WHEN n_now > 0 THEN 'SUPPORTED' ELSE 'OUT_OF_COVERAGE' END AS status, n_now AS facts
    FROM n
""")
def resolve_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ask for their own orders: as a concept each, with a condition on the status and a date of validity."""
    orders = table(spark, sf_dir, "orders")
    place = F.lit("CH")
    asked = F.col("c_custkey") % 3
    context = F.create_map(F.lit("status"), F.when(asked == 1, "F").when(asked == 2, "O").otherwise("any"))
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("concept_id"), place.alias("place"), F.to_date(F.lit("1996-06-30")).alias("as_of"), context.alias("context"))
    concepts = orders.select(F.col("o_custkey").alias("concept_id")).distinct().select("concept_id", F.array().cast("array<string>").alias("required_context"), F.lit(None).cast("date").alias("stale_from"))
    both = F.array(F.create_map(F.lit("status"), F.col("o_orderstatus")), F.create_map(F.lit("status"), F.lit("any")))
    facts = orders.select(
        F.col("o_custkey").alias("concept_id"), F.col("o_orderkey").alias("fact_id"), F.lit("CH").alias("jurisdiction"), F.explode(both).alias("condition"),
        F.to_date("o_orderdate").alias("valid_from"), F.lit(None).cast("date").alias("valid_through"), F.lit(True).alias("reviewed"),
    )
    out = resolution.resolved(requests, concepts, facts)
    return out.select("request_id", "gap", "status", F.size("fact_ids").cast("bigint").alias("facts"))
