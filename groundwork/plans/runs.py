"""Runs, reviews, acceptance and regression on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs as U
from .registry import query, table

_FLAGS = """
    filter(array(if(value < 12, 'browser-rendered-dom-not-raw-http-response', NULL), if(value < 25, 'javascript_application_shell', NULL), if(event_id % 11 = 0, 'error_page_title', NULL),
                 if(value BETWEEN 20 AND 28, 'possible_access_challenge', NULL), if(event_id % 17 = 0, 'unexpected_media_type', NULL), if(event_id % 19 = 0, 'odd', NULL)), x -> x IS NOT NULL)
"""
_FAILURE = "CASE event_id % 7 WHEN 0 THEN 'rate-limited' WHEN 1 THEN 'dns-failure' WHEN 2 THEN 'server-error' WHEN 3 THEN 'never heard of' WHEN 4 THEN 'not-found' WHEN 5 THEN 'transient-network' ELSE 'oversized' END"


@query(f"""
    WITH a AS (SELECT user_id AS url, event_id AS attempt, value, event_id % 3 <> 0 AS saved, {_FAILURE} AS failure FROM events),
    l AS (SELECT url, count(*) AS attempts, count(*) FILTER (saved) AS saved_attempts, max(attempt) AS last,
                 min(CASE failure WHEN 'dns-failure' THEN 1 WHEN 'not-found' THEN 2 WHEN 'oversized' THEN 3 WHEN 'rate-limited' THEN 4 WHEN 'server-error' THEN 5 WHEN 'transient-network' THEN 6 ELSE 7 END) FILTER (NOT saved) AS worst
          FROM a GROUP BY url),
    t AS (SELECT c_custkey AS url, attempts, saved_attempts, worst, saved, attempt, value FROM customer LEFT JOIN l ON l.url = c_custkey LEFT JOIN a ON a.url = l.url AND attempt = last),
    g AS (SELECT *, CASE WHEN saved THEN CASE WHEN attempt % 11 = 0 THEN 'soft-error-page' WHEN value < 25 THEN CASE WHEN url % 2 = 0 THEN 'javascript-shell-resolved' ELSE 'javascript-shell' END
                                              WHEN value BETWEEN 20 AND 28 THEN 'access-challenge' WHEN attempt % 17 = 0 THEN 'unexpected-media-type' WHEN value < 12 THEN 'rendered-dom' ELSE 'none' END
                         ELSE coalesce(['dns-failure', 'not-found', 'oversized', 'rate-limited', 'server-error', 'transient-network', 'unclassified'][worst], 'not-attempted') END AS gap FROM t)
    SELECT url, CASE WHEN saved THEN 'saved' WHEN attempts IS NULL THEN 'pending' ELSE 'failed' END AS status, coalesce(attempts, 0)::BIGINT AS attempts, coalesce(saved_attempts, 0)::BIGINT AS saved_attempts, gap,
           url % 7 <> 0 AND gap NOT IN ('none', 'dns-failure', 'not-found', 'javascript-shell', 'javascript-shell-resolved', 'rendered-dom') AS retriable FROM g
""")
def target_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as targets, events as attempts on them."""
    k = F.col("c_custkey")
    targets = table(spark, sf_dir, "customer").select(k.alias("url"), (k % 7 == 0).alias("needs_review"))
    attempts = table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), F.col("event_id").alias("attempt"), F.when(F.col("event_id") % 3 == 0, "failed").otherwise("saved").alias("status"), F.expr(_FLAGS).alias("flags"), F.expr(_FAILURE).alias("failure"))
    return U.target_gaps(targets, attempts, targets.filter("url % 2 = 0"))


@query("""
    WITH r AS (SELECT o_orderkey AS item, sha256(concat_ws('|', o_orderstatus, o_orderpriority)) AS fingerprint FROM orders),
    d AS (SELECT o_orderkey AS item, sha256(concat_ws('|', o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 'old' ELSE o_orderpriority END)) AS mark, CASE WHEN o_orderkey % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS decision, 1 AS seq FROM orders WHERE o_orderkey % 3 = 0
          UNION ALL SELECT o_orderkey, sha256(concat_ws('|', o_orderstatus, 'changed')), 'accepted', 2 FROM orders WHERE o_orderkey % 4 = 0
          UNION ALL SELECT o_orderkey, sha256(concat_ws('|', o_orderstatus, o_orderpriority)), 'deferred', 3 FROM orders WHERE o_orderkey % 10 = 0),
    s AS (SELECT item, mark, arg_max(decision, seq) AS decision FROM d GROUP BY ALL)
    SELECT coalesce(decision, CASE WHEN r.item IN (SELECT item FROM d) THEN 'stale' ELSE 'open' END) AS review, count(*) AS n FROM r LEFT JOIN s ON s.item = r.item AND mark = fingerprint GROUP BY ALL
""")
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on orders by what they saw; some orders have changed since, some have changed and changed back."""
    k, orders = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    seen = F.sha2(F.concat_ws("|", "o_orderstatus", F.when(k % 5 == 0, "old").otherwise(F.col("o_orderpriority"))), 256)
    mark = lambda priority: F.sha2(F.concat_ws("|", "o_orderstatus", priority), 256).alias("fingerprint")
    decisions = orders.filter(k % 3 == 0).select(k.alias("item"), seen.alias("fingerprint"), F.when(k % 2 == 0, "accepted").otherwise("rejected").alias("decision"), F.lit(1).alias("at"))
    decisions = decisions.unionAll(orders.filter(k % 4 == 0).select(k, mark(F.lit("changed")), F.lit("accepted"), F.lit(2))).unionAll(orders.filter(k % 10 == 0).select(k, mark("o_orderpriority"), F.lit("deferred"), F.lit(3)))
    rows = orders.select(k.alias("item"), "o_orderstatus", "o_orderpriority")
    return U.decided(rows, decisions, "o_orderstatus", "o_orderpriority").groupBy("review").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS url, (coalesce(max(event_id), 0) + 1)::BIGINT AS attempt FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey")
def next_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), F.col("event_id").alias("attempt"))
    return U.next_attempts(attempts, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url")))


@query("""
    SELECT source, lang, doc_id FROM (SELECT doc_id, source, lang FROM documents)
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY lang = 'en' DESC, doc_id) = 1
""")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a source: the first English one, else the first."""
    return U.first_of(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), "source", (F.col("lang") == "en").desc(), F.col("doc_id").asc())


@query("""
    WITH d AS (SELECT o_custkey, o_orderstatus, o_orderpriority AS value, o_orderkey, o_totalprice FROM orders),
    f AS (SELECT o_custkey, o_orderstatus, value, min(o_orderkey) AS seen FROM d GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY seen, value) AS r FROM f QUALIFY r <= 3),
    l AS (SELECT o_custkey, o_orderstatus, string_agg(value, '|' ORDER BY r) AS value FROM k GROUP BY ALL)
    SELECT o_custkey, o_orderstatus, count(*) AS drafts, max(o_totalprice) AS o_totalprice, any_value(l.value) AS value FROM d JOIN l USING (o_custkey, o_orderstatus) GROUP BY ALL
""")
def merged_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer and status as drafts of one candidate; priorities in order of first appearance."""
    drafts = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.col("o_orderpriority").alias("value"), "o_orderkey", "o_totalprice")
    return U.merged(drafts, ["o_custkey", "o_orderstatus"], "value", "o_orderkey", "o_totalprice", 3).withColumn("value", F.array_join("value", "|"))


@query("""
    WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey * 2 AS b FROM part WHERE p_size % 5 <> 0 UNION ALL SELECT p_partkey, p_partkey * 3 FROM part WHERE p_size % 7 = 0),
    r AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 50 = 1 UNION SELECT b FROM r JOIN e ON a = node)
    SELECT node FROM r
""")
def language_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages, links to their doubles and triples as language links: all that an allowlist reaches."""
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    edges = part.filter("p_size % 5 <> 0").select(k.alias("a"), (k * 2).alias("b")).unionAll(part.filter("p_size % 7 = 0").select(k, k * 3))
    return U.reached(edges, part.filter(k % 50 == 1).select(k.alias("node")), "a", "b")


@query("""
    WITH s AS (SELECT o_custkey AS case_id, o_orderkey AS step, CASE WHEN o_orderkey % 2 = 0 THEN 'lookup' ELSE 'resolve' END AS kind, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS status,
                      CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS gap, o_orderdate::DATE AS first_day, [o_orderkey % 5, o_orderkey % 3] AS facts, [o_orderkey % 11] AS forbidden FROM orders),
    a AS (SELECT o_custkey AS case_id, o_orderkey AS step, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS got_status, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderpriority END AS got_gap,
                 o_orderdate::DATE + (CASE WHEN o_orderkey % 14 = 0 THEN 1 ELSE 0 END) AS got_day, [0, 1, 2, o_orderkey % 5] AS got_facts FROM orders WHERE o_orderkey % 13 <> 0)
    SELECT case_id, step, concat_ws(',', CASE WHEN got_status IS NULL THEN 'no answer' END, CASE WHEN got_status IS NOT NULL AND status <> got_status THEN 'status' END,
                CASE WHEN got_status IS NOT NULL AND gap IS NOT NULL AND gap IS DISTINCT FROM got_gap THEN 'gap' END, CASE WHEN kind = 'lookup' AND got_status IS NOT NULL AND first_day IS DISTINCT FROM got_day THEN 'first day' END,
                CASE WHEN len(list_filter(facts, lambda f: NOT list_contains(coalesce(got_facts, []), f))) > 0 THEN 'facts missing' END, CASE WHEN list_has_any(forbidden, coalesce(got_facts, [])) THEN 'forbidden facts' END) AS issues
    FROM s LEFT JOIN a USING (case_id, step)
""")
def case_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as steps of their customers' cases, answered with some differences; every thirteenth has no answer."""
    k, orders = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    big = lambda *c: F.array(*(x.cast("bigint") for x in c))
    day = F.to_date("o_orderdate")
    steps = orders.select(F.col("o_custkey").alias("case_id"), k.alias("step"), F.when(k % 2 == 0, "lookup").otherwise("resolve").alias("kind"), F.when(k % 6 != 0, F.col("o_orderstatus")).alias("status"), F.when(k % 4 == 0, F.col("o_orderpriority")).alias("gap"), day.alias("first_day"), big(k % 5, k % 3).alias("facts"), big(k % 11).alias("forbidden"))
    answers = orders.filter(k % 13 != 0).select(F.col("o_custkey").alias("case_id"), k.alias("step"), F.when(k % 10 == 0, "X").otherwise(F.col("o_orderstatus")).alias("got_status"), F.when(k % 8 != 0, F.col("o_orderpriority")).alias("got_gap"), F.date_add(day, F.when(k % 14 == 0, 1).otherwise(0)).alias("got_day"), big(F.lit(0), F.lit(1), F.lit(2), k % 5).alias("got_facts"))
    return U.case_issues(steps, answers).withColumn("issues", F.array_join("issues", ","))


@query("""
    SELECT event_type AS mode, count(*) AS cases, count(*) FILTER (value >= 20) AS n_passed, count(*) FILTER (user_id % 9 <> 0 AND value < 20) AS failed, count(*) FILTER (user_id % 9 = 0) AS quarantined,
           count(*) FILTER (user_id % 9 = 0 AND value >= 20) AS quarantined_passing, count(*) FILTER (user_id % 9 <> 0 AND value < 20) = 0 AS ok FROM events GROUP BY ALL
""")
def regression_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), "event_id", (F.col("value") >= 20).alias("passed"), (F.col("user_id") % 9 != 0).alias("blocking"))
    return U.regression(results, "mode", "event_id", "passed", "blocking")


@query("""
    WITH g AS (SELECT user_id AS case_id, count(*) AS graded, count(*) FILTER (value >= 5) AS trap_held, count(*) FILTER (value >= 15) AS criteria_pass FROM events GROUP BY ALL),
    r AS (SELECT c_custkey AS case_id, coalesce(graded, 0) AS graded, CASE WHEN coalesce(graded, 0) = 0 THEN 'no graded session' ELSE concat_ws('; ', CASE WHEN graded < 15 THEN 'few sessions' END, CASE WHEN trap_held <> graded THEN 'trap' END, CASE WHEN criteria_pass / graded < 0.8 THEN 'criteria' END) END AS reason
          FROM customer LEFT JOIN g ON g.case_id = c_custkey)
    SELECT case_id, reason = '' AS passed, reason FROM r
""")
def answer_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases, their events as graded sessions."""
    grades = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("case_id")).agg(F.count("*").alias("graded"), F.count_if(F.col("value") >= 5).alias("trap_held"), F.count_if(F.col("value") >= 15).alias("criteria_pass"))
    return U.answer_verdicts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id")), grades, 15, 0.8)


@query("""
    SELECT event_type AS mode, language, bucket, count(*) AS n, round(avg(metric), 6) AS mean, round(quantile_disc(value, 0.95), 3) AS p95
    FROM (SELECT event_type, CASE user_id % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' ELSE 'it' END AS language, user_id % 10 AS bucket, CASE WHEN event_id % 4 <> 0 THEN (event_id % 7)::DOUBLE END AS metric, value FROM events)
    GROUP BY GROUPING SETS ((event_type), (event_type, language), (event_type, bucket))
""")
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    samples = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.when(u % 3 == 0, "de").when(u % 3 == 1, "fr").otherwise("it").alias("language"), (u % 10).alias("bucket"), F.when(e % 4 != 0, (e % 7).cast("double")).alias("metric"), "value")
    return U.benchmark_summary(samples, "mode", "language", "bucket", "metric", "value")
