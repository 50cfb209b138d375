"""Curation, coverage and review on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import curation as C
from ..operators import operations as O
from ..operators import records as R
from .registry import query, table
from .search import _HITS, lexical_topk


@query("""
    WITH d AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS copy, quality FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, CASE WHEN n_chars < 40 THEN 'not_extractable' WHEN copy > 1 THEN 'superseded' WHEN quality = 0 THEN 'secondary_representation'
                        WHEN lang NOT IN ('en', 'de') THEN 'language_variant' END AS reason
    FROM d
""")
def candidate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies are found by joining each text's digest with its first document, so that no window gathers a hot text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    rows = docs.join(first, "h").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rules = [
        ("not_extractable", F.col("n_chars") < 40), ("superseded", F.col("doc_id") != F.col("first")),
        ("secondary_representation", F.col("quality") == 0), ("language_variant", ~F.col("lang").isin("en", "de")),
    ]
    return rows.select("doc_id", R.candidate_reason(rules).alias("reason"))


@query("""
    WITH u AS (SELECT source, CASE WHEN quality IS NULL THEN 'open' WHEN quality = 1 AND toxic = 0 THEN 'covered' WHEN quality = 1 THEN 'excluded' ELSE 'deferred' END AS unit, n_chars
               FROM documents LEFT JOIN labels USING (doc_id))
    SELECT source, unit, count(*) AS units, sum(n_chars)::BIGINT AS chars FROM u GROUP BY GROUPING SETS ((source, unit), (source), ())
""")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    unit = F.when(q.isNull(), "open").when((q == 1) & (t == 0), "covered").when(q == 1, "excluded").otherwise("deferred")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("source", unit.alias("unit"), "n_chars")
    # rollup (source, unit): both, source alone, all
    return rows.rollup("source", "unit").agg(F.count("*").alias("units"), F.sum("n_chars").alias("chars"))


@query("""
    SELECT source, CASE WHEN count(*) FILTER (quality IS NULL) = count(*) THEN 'untouched' WHEN count(*) FILTER (quality IS NULL) = 0 THEN 'complete' ELSE 'partial' END AS status,
           count(*) FILTER (quality = 1) AS accepted, count(*) AS documents
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
""")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n, open_ = F.count("*"), F.count_if(F.col("quality").isNull())
    return rows.groupBy("source").agg(
        F.when(open_ == n, "untouched").when(open_ == 0, "complete").otherwise("partial").alias("status"), F.count_if(F.col("quality") == 1).alias("accepted"), n.alias("documents")
    )


@query("""
    WITH planned AS (SELECT DISTINCT c_nationkey AS k FROM customer), seen AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
    SELECT n_name AS nation, planned.k IS NOT NULL AS planned, seen.k IS NOT NULL AS observed
    FROM nation LEFT JOIN planned ON planned.k = n_nationkey LEFT JOIN seen ON seen.k = n_nationkey
""")
def source_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue sources against those observed, either way round."""
    planned = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct().withColumn("planned", F.lit(True))
    seen = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).distinct().withColumn("observed", F.lit(True))
    both = planned.join(seen, "k", "full_outer")
    out = table(spark, sf_dir, "nation").join(both, F.col("n_nationkey") == F.col("k"), "left")
    return out.select(F.col("n_name").alias("nation"), F.coalesce("planned", F.lit(False)).alias("planned"), F.coalesce("observed", F.lit(False)).alias("observed"))


@query("""
    WITH h AS (SELECT o_custkey, o_orderkey, sha256('review-1' || o_orderkey) AS h FROM orders)
    SELECT o_custkey, o_orderkey FROM h QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY h, o_orderkey) <= 3
""")
def sample_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sampled(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3, "review-1")


@query("""
    SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS l_returnflag, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS l_linestatus
    FROM lineitem GROUP BY l_orderkey
""")
def shared_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.shared(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linestatus")


@query("""
    WITH s AS (SELECT user_id, event_id, event_type, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    top AS (SELECT event_type FROM events GROUP BY 1 ORDER BY event_type LIMIT 2)
    SELECT user_id, event_id AS "at" FROM s WHERE event_type = (SELECT min(event_type) FROM top) AND b = (SELECT max(event_type) FROM top) AND c = (SELECT min(event_type) FROM top)
""")
def sequence_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two event types follow each other to and fro: the two first by name."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    a, b = (r.event_type for r in events.select("event_type").distinct().orderBy("event_type").limit(2).collect())
    return C.sequence_positions(events, "user_id", "event_id", "event_type", [a, b, a])


@query("""
    WITH e AS (SELECT lang, source, doc_id, n_chars FROM documents WHERE lang IN ('en', 'de') AND n_chars BETWEEN 200 AND 20000)
    SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM e) WHERE n = 1 ORDER BY n_chars DESC, doc_id LIMIT 10
""")
def select_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest eligible document of each source, and of those the first ten: a report of fixed size."""
    rows = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars").filter(F.col("lang").isin("en", "de") & F.col("n_chars").between(200, 20000))
    return C.first_of_each(rows, "source", [F.desc("n_chars"), F.asc("doc_id")], 10).select("source", "doc_id", "n_chars")


@query("""
    SELECT o_orderdate::DATE AS accessed_on, count(*) AS documents, (DATE '1999-01-01' - o_orderdate::DATE)::INT AS age, o_orderdate::DATE + 60 <= DATE '1996-01-01' AS stale FROM orders GROUP BY ALL
""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").groupBy(day.alias("accessed_on")).agg(F.count("*").alias("documents"))
    return rows.select("accessed_on", "documents", F.datediff(F.to_date(F.lit("1999-01-01")), "accessed_on").alias("age"), (F.date_add("accessed_on", 60) <= F.to_date(F.lit("1996-01-01"))).alias("stale"))


@query("""
    SELECT o_custkey, CASE WHEN count(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) = count(*) THEN round(sum(o_totalprice), 2) END AS tokens, count(*) AS reports FROM orders GROUP BY o_custkey
""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that are unknown as soon as one part is."""
    rows = table(spark, sf_dir, "orders").withColumn("used", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return rows.groupBy("o_custkey").agg(F.round(O.null_sum("used"), 2).alias("tokens"), F.count("*").alias("reports"))


@query("""
    WITH n AS (SELECT user_id, event_type, count(*) AS calls, max(ts) AS last FROM events GROUP BY ALL),
    q AS (SELECT *, CASE WHEN calls >= 20 THEN 1 WHEN calls >= 15 THEN 2 WHEN calls >= 10 THEN 3 WHEN calls >= 5 THEN 4 ELSE 5 END AS priority FROM n)
    SELECT user_id, event_type, priority, calls FROM q ORDER BY priority, last DESC, user_id, event_type LIMIT 25 OFFSET 25
""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a queue by priority, newest first."""
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("calls"), F.max("ts").alias("last"))
    calls = F.col("calls")
    p = F.when(calls >= 20, 1).when(calls >= 15, 2).when(calls >= 10, 3).when(calls >= 5, 4).otherwise(5)
    rows = n.withColumn("priority", p)
    return C.page_of(rows, [F.asc("priority"), F.desc("last"), F.asc("user_id"), F.asc("event_type")], 2, 25).select("user_id", "event_type", "priority", "calls")


@query(f"""
    WITH {_HITS}, truth AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
    SELECT item_id, item_id IN (SELECT item_id FROM hits JOIN truth USING (item_id, doc_id)) AS passed FROM benchmark
""")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage as a case: passed when a document that holds it is among the hits."""
    from .search import contamination

    hits = lexical_topk(spark, sf_dir)
    good = hits.join(contamination(spark, sf_dir), ["item_id", "doc_id"], "left_semi").select("item_id").distinct().withColumn("passed", F.lit(True))
    cases = table(spark, sf_dir, "benchmark").select("item_id")
    return cases.join(good, "item_id", "left").select("item_id", F.coalesce("passed", F.lit(False)).alias("passed"))


@query("""
    WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text <> ''),
    w AS (
        SELECT doc_id, -1 AS span, 0::BIGINT AS start, 0::BIGINT AS "end" FROM t
        UNION ALL
        SELECT doc_id, span + 1, "end", CASE WHEN "end" + 500 >= n THEN n WHEN contains(substring(text, "end" + 251, 250), ' ') THEN "end" + 501 - strpos(reverse(substring(text, "end" + 251, 250)), ' ') + 1 - 1 ELSE "end" + 500 END
        FROM w JOIN t USING (doc_id) WHERE "end" < n
    )
    SELECT doc_id, span, start, "end" FROM w WHERE span >= 0
""")
def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.evidence_spans(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def block_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against the one before it, as two versions of one record."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("h"))
    seq = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "h"))), lambda t: t["h"]).alias("hashes"))
    old = seq.select((F.col("conv_id") + 1).alias("conv_id"), F.col("hashes").alias("old"))
    return C.aligned(seq.withColumnRenamed("hashes", "new").join(old, "conv_id"), "conv_id")


@query("""
    SELECT n_name AS name, CASE WHEN r.code IS NULL THEN 'not recognised' ELSE 'found' END AS status, r.code
    FROM nation LEFT JOIN (SELECT n_name AS name, any_value(n_regionkey || '-' || n_nationkey) AS code FROM nation GROUP BY n_name HAVING count(*) = 1) r ON r.name = n_name
""")
def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    key = F.lower(F.trim("n_name"))
    loose = F.trim(F.regexp_replace(key, r"\b(united|kingdom|states|of|the)\b", ""))
    code = F.concat_ws("-", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"))
    register = nation.select(code.alias("code"), F.col("n_name").alias("name"), key.alias("key"), loose.alias("loose"))
    return C.place_candidates(nation.select(F.col("n_name").alias("name"), key.alias("key"), loose.alias("loose")), register, "name")


@query("""
    SELECT l.lang, s.source, count(d.doc_id) AS n
    FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s LEFT JOIN documents d ON d.lang = l.lang AND d.source = s.source
    GROUP BY l.lang, s.source
""")
def coverage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and source, a row for every pair of a language and a source that there are; Spark refuses
    more than spark.sql.pivotMaxValues (10,000) sources."""
    return table(spark, sf_dir, "documents").groupBy("lang").pivot("source").count().na.fill(0).unpivot("lang", None, "source", "n")


@query("""
    SELECT p_brand, p_type, count(*) AS pages, list_sort(list(p_partkey))[1:50]::VARCHAR AS first_parts FROM part GROUP BY ALL
""")
def discovered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each group with its first fifty members by id; members beyond are cut within tasks."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey")
    n = rows.groupBy("p_brand", "p_type").agg(F.count("*").alias("pages"))
    w = Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")
    few = rows.withColumn("n", F.row_number().over(w)).filter("n <= 50").groupBy("p_brand", "p_type").agg(F.sort_array(F.collect_list("p_partkey")).alias("parts"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("parts", lambda p: p.cast("string")), ", "), F.lit("]"))
    return n.join(few, ["p_brand", "p_type"]).select("p_brand", "p_type", "pages", listed.alias("first_parts"))
