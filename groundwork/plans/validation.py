"""A whole release made of the shared tables, with faults, and all that its checks find."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import discard, stored
from ..operators import validation as V
from .registry import query, table

_PLACE = r"^CH(-[A-Z]{2}(-[0-9]{1,4})?)?$"


@query("""
    WITH f AS (
        SELECT o_orderkey AS k, 'f' || o_orderkey AS fact_id, 'c' || o_custkey AS concept_id, o_custkey AS cust, CASE WHEN o_orderkey % 90 = 0 THEN 'ch' WHEN o_orderkey % 3 = 0 THEN 'CH' WHEN o_orderkey % 3 = 1 THEN 'CH-AA' ELSE 'CH-BB' END AS j FROM orders
    ), e AS (
        SELECT DISTINCT 'e' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || l_returnflag AS evidence_id, l_orderkey AS k, l_linenumber AS n, l_partkey AS part, l_suppkey AS supp, l_returnflag AS flag FROM lineitem
    ), held AS (SELECT cust, list(DISTINCT j ORDER BY j) AS have, list(DISTINCT j ORDER BY j) FILTER (k % 60 <> 0) AS listed FROM f GROUP BY cust
    ), b AS (SELECT k, max(CASE flag WHEN 'N' THEN 3 WHEN 'A' THEN 2 ELSE 1 END) AS best FROM e GROUP BY k
    ), r AS (
        SELECT 'concept.topic' AS rule, 'c' || c_custkey AS key FROM customer WHERE c_nationkey = 7
        UNION ALL SELECT 'concept.text', 'c' || c_custkey FROM customer WHERE c_custkey % 50 = 0
        UNION ALL SELECT 'concept.fact', 'c' || c_custkey FROM customer WHERE c_custkey % 40 = 0
        UNION ALL SELECT 'concept.jurisdictions', 'c' || c_custkey FROM customer LEFT JOIN held ON cust = c_custkey
                  WHERE coalesce(listed, []) <> CASE WHEN c_custkey % 30 = 0 THEN [] ELSE coalesce(have, []) END
        UNION ALL SELECT 'fact.unlisted', fact_id FROM f WHERE k % 60 = 0
        UNION ALL SELECT 'fact.jurisdiction', fact_id FROM f WHERE j = 'ch'
        UNION ALL SELECT 'fact.undeclared_jurisdiction', fact_id FROM f WHERE j = 'CH-BB'
        UNION ALL SELECT 'fact.statement', fact_id FROM f WHERE k % 70 = 0
        UNION ALL SELECT 'fact.validity', fact_id FROM f WHERE k % 80 = 0
        UNION ALL SELECT 'fact.condition_field', fact_id FROM f WHERE k % 33 = 0
        UNION ALL SELECT 'fact.condition_value', fact_id FROM f WHERE k % 33 <> 0 AND k % 34 = 0
        UNION ALL SELECT 'evidence.offsets', evidence_id FROM e WHERE part % 90 = 0
        UNION ALL SELECT 'evidence.excerpt_hash', evidence_id FROM e WHERE part % 85 = 0
        UNION ALL SELECT 'evidence.language', evidence_id FROM e WHERE supp % 60 = 0
        UNION ALL SELECT 'evidence.undeclared_language', evidence_id FROM e WHERE supp % 60 = 1
        UNION ALL SELECT 'evidence.content_hash', evidence_id FROM e WHERE part % 75 = 0 AND part IN (SELECT p_partkey FROM part)
        UNION ALL SELECT 'evidence.document', evidence_id FROM e WHERE part NOT IN (SELECT p_partkey FROM part)
        UNION ALL SELECT 'evidence.label', evidence_id FROM e WHERE supp % 45 = 2 AND NOT (flag = 'N' AND part % 95 = 0)
        UNION ALL SELECT 'evidence.norm', evidence_id FROM e WHERE flag = 'N' AND part % 95 = 0
        UNION ALL SELECT 'document.uncited', 'd' || p_partkey FROM part WHERE p_partkey NOT IN (SELECT part FROM e)
        UNION ALL SELECT 'fact.federal_basis', fact_id FROM f JOIN b USING (k) WHERE j IN ('CH', 'ch')
        UNION ALL SELECT 'manifest.review_statuses', 'manifest'
        UNION ALL SELECT 'manifest.basis_kinds', 'manifest'
    )
    SELECT rule, key FROM r
""")
def release_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as topics, customers as concepts, orders as facts, their lines as evidence from parts as documents.

    Lines meet their orders once, by the few columns that everything else follows from, and stay together as stored. The
    issues are then written part by part, so that the shuffles of one part are dropped before the next begins.
    """
    k, c = F.col("k"), F.col("c_custkey")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    words = "array<string>"
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    told = orders.select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderdate").repartition("k").groupBy("k").agg(F.collect_list(F.struct("o_custkey", "o_orderdate")).alias("orders"))
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag"))
    per = lines.select(F.col("l_orderkey").alias("k"), line.alias("line")).repartition("k").groupBy("k").agg(F.collect_set("line").alias("lines"))
    both = stored(told.join(per, "k", "full_outer"))

    kind = lambda x: F.when(x["flag"] == "N", "act").when(x["flag"] == "A", "guidance").otherwise("summary")
    name = lambda x: text("e", k, "-", x["n"], "-", x["part"], "-", x["supp"], x["flag"])
    level, null = F.lit("cantonal"), F.lit(None).cast("string")

    def basis(x: Column) -> Column:
        norm = F.when((kind(x) == "act") & (x["part"] % 95 != 0), "n")
        label = F.when(x["supp"] % 45 == 2, "x").otherwise(V.basis_label(level, kind(x), norm, null))
        return F.when(x.isNotNull(), F.struct(level.alias("level"), kind(x).alias("kind"), norm.alias("norm"), null.alias("refers_to"), label.alias("label")))

    x = F.col("x")
    excerpt = F.concat(x["flag"], F.lit("x"))
    evidence = both.select("k", F.explode("lines").alias("x")).select(
        name(x).alias("evidence_id"), text("d", x["part"]).alias("document_id"), F.lit(0).alias("start"), F.when(x["part"] % 90 == 0, 3).otherwise(2).alias("end"),
        excerpt.alias("excerpt"), F.when(x["part"] % 85 == 0, "0").otherwise(F.sha2(excerpt, 256)).alias("excerpt_sha256"), F.when(x["supp"] % 60 == 0, "German").when(x["supp"] % 60 == 1, "rm").otherwise("de").alias("language"),
        F.when(x["part"] % 75 == 0, "x").otherwise(text("h", x["part"])).alias("content_sha256"), text("r", x["part"]).alias("raw_sha256"), null.alias("institution_id"), basis(x).alias("basis"),
    )
    # the strongest basis, the first of equals in the order of the ids
    first = F.array_min(F.transform("lines", lambda x: F.struct(-V.weight_of(kind(x), V.BASIS_WEIGHTS), name(x), x.alias("x"))))["x"]
    place = F.when(k % 90 == 0, "ch").when(k % 3 == 0, "CH").when(k % 3 == 1, "CH-AA").otherwise("CH-BB")
    day = F.to_date("o.o_orderdate")
    condition = F.when(k % 33 == 0, F.create_map(F.lit("age"), F.lit("1"))).when(k % 34 == 0, F.create_map(F.lit("status"), F.lit("odd"))).when(k % 5 == 0, F.create_map(F.lit("status"), F.lit("a")))
    facts = both.select("k", "lines", F.explode("orders").alias("o")).withColumn("x", first).select(
        text("f", k).alias("fact_id"), text("c", F.col("o.o_custkey")).alias("concept_id"), F.when(k % 70 == 0, " ").otherwise("s").alias("statement"), place.alias("jurisdiction"), day.alias("valid_from"),
        F.when(k % 80 == 0, F.date_sub(day, 1)).alias("valid_through"), condition.alias("condition"), F.sort_array(F.array_compact(F.transform("lines", name))).alias("evidence_ids"), F.lit("curated-statement").alias("kind"), F.lit("human-reviewed").alias("review_status"), basis(x).alias("basis"),
    )
    ids = orders.select("o_custkey", F.col("o_orderkey").alias("k")).groupBy(F.col("o_custkey").alias("cust")).agg(F.collect_list(F.when(k % 60 != 0, text("f", k))).alias("ids"), F.collect_set(place).alias("places"))
    none = F.array().cast(words)
    listed = F.coalesce("ids", none)
    concepts = stored(table(spark, sf_dir, "customer").join(ids, c == F.col("cust"), "left").select(
        text("c", c).alias("concept_id"), text("t", F.col("c_nationkey")).alias("topic_id"), F.when(c % 50 == 0, "").otherwise("l").alias("label"), F.lit("d").alias("description"),
        F.when(c % 40 == 0, F.array_append(listed, text("f", "-", c))).otherwise(listed).alias("fact_ids"), F.when(c % 30 == 0, none).otherwise(F.coalesce("places", none)).alias("jurisdictions"), none.alias("required_context"),
        F.create_map(F.lit("status"), F.array(F.lit("a"), F.lit("b"))).alias("context_schema"),
    ))
    p = F.col("p_partkey")
    documents = table(spark, sf_dir, "part").select(text("d", p).alias("document_id"), null.alias("institution_id"), F.lit(date(2026, 1, 1)).alias("accessed_on"), text("h", p).alias("content_sha256"), text("r", p).alias("raw_sha256"))
    topics = table(spark, sf_dir, "nation").filter("n_nationkey <> 7").select(text("t", F.col("n_nationkey")).alias("topic_id"))
    institutions = spark.createDataFrame([], "institution_id string, name string, level string, jurisdiction string")
    manifest = V.Manifest(["CH", "CH-AA"], ["de"], date(2026, 1, 1), {"curated-statement": orders.count()}, {"human-reviewed": 1}, {}, {"treaty": 1})
    release = V.Release(documents, topics, concepts, facts, evidence, institutions)
    found = [stored(part) for part in V.issue_parts(release, manifest, _PLACE)]
    discard(both)
    discard(concepts)
    return reduce(DataFrame.unionAll, found)
