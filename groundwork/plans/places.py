"""Places of the shared tables: regions as countries, nations as cantons, customers as municipalities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import places as P
from .registry import query, table

_REGISTER = """
    place AS (
        SELECT 'R' || r_regionkey AS code, 0 AS lvl, r_name AS name FROM region
        UNION ALL SELECT 'R' || n_regionkey || '-N' || n_nationkey, 1, n_name FROM nation
        UNION ALL SELECT 'R' || n_regionkey || '-N' || n_nationkey || '-' || c_custkey, 2, c_mktsegment || ' ' || (c_custkey % 40) FROM customer JOIN nation ON c_nationkey = n_nationkey
    )
"""


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name"""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    canton = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit("-N"), F.col("n_nationkey").cast("string"))
    city = F.concat(canton, F.lit("-"), F.col("c_custkey").cast("string"))
    named = F.concat("c_mktsegment", F.lit(" "), (F.col("c_custkey") % 40).cast("string"))
    cities = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    out = region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("code"), F.col("r_name").alias("name"))
    return out.unionAll(nation.select(canton, "n_name")).unionAll(cities.select(city, named))


@query(f"""
    WITH {_REGISTER}, ask AS (
        SELECT s_suppkey AS request_id,
               CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN lower(r_name) WHEN 2 THEN 'r' || r_regionkey WHEN 3 THEN r_name ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'Atlantis' ELSE 'x9' END END AS country,
               CASE WHEN s_suppkey % 11 = 0 THEN 'Nowhere' ELSE CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN lower(n_name) WHEN 2 THEN 'n' || n_nationkey ELSE 'R1-N' || n_nationkey END END AS canton,
               CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'BUILDING ' || (s_suppkey % 40) ELSE CASE WHEN s_suppkey % 2 = 0 THEN '' WHEN s_suppkey % 7 = 3 THEN 'R' || (s_suppkey % 5) || '-N' || n_nationkey || '-' ELSE 'N' || n_nationkey || '-' END || (s_suppkey % 150) END AS city
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    ), c0 AS (
        SELECT *, CASE WHEN country IS NULL THEN 'R1' ELSE coalesce((SELECT any_value(code) FROM place WHERE lvl = 0 AND code = upper(country)), (SELECT min(code) FROM place WHERE lvl = 0 AND lower(name) = lower(country))) END AS cc FROM ask
    ), c1 AS (
        SELECT *, regexp_extract(upper(canton), '^(?:([A-Z0-9]+)-)?([A-Z0-9]+)$', 1) AS own, regexp_extract(upper(canton), '^(?:([A-Z0-9]+)-)?([A-Z0-9]+)$', 2) AS short,
               regexp_extract(upper(city), '^(?:(?:([A-Z0-9]+)-)?([A-Z][A-Z0-9]*)-)?([0-9]+)$', 2) AS given, CASE WHEN regexp_extract(upper(city), '^(?:(?:([A-Z0-9]+)-)?([A-Z][A-Z0-9]*)-)?([0-9]+)$', 1) IN ('', cc) THEN regexp_extract(upper(city), '^(?:(?:([A-Z0-9]+)-)?([A-Z][A-Z0-9]*)-)?([0-9]+)$', 3) ELSE '' END AS number FROM c0
    ), c2 AS (
        SELECT *, (SELECT any_value(code) FROM place WHERE lvl = 1 AND short <> '' AND own IN ('', cc) AND code = cc || '-' || short) AS by_code,
               (SELECT list(code) FROM place WHERE lvl = 1 AND lower(name) = lower(canton) AND starts_with(code, cc || '-')) AS cs FROM c1
    ), c3 AS (
        SELECT *, coalesce(by_code, CASE WHEN len(cs) = 1 THEN cs[1] END) AS canton_code, by_code IS NULL AND coalesce(len(cs), 0) > 1 AS many,
               canton IS NOT NULL AND by_code IS NULL AND coalesce(len(cs), 0) = 0 AS lost FROM c2
    ), c4 AS (
        SELECT *, CASE WHEN number <> '' THEN (SELECT list(code) FROM place WHERE lvl = 2 AND code = CASE WHEN given <> '' THEN cc || '-' || given ELSE canton_code END || '-' || ltrim(number, '0'))
                       ELSE (SELECT list(code) FROM place WHERE lvl = 2 AND lower(name) = lower(city) AND starts_with(code, cc || '-')) END AS cities FROM c3
    ), c5 AS (
        SELECT *, cc IS NOT NULL AS served, coalesce(len(cities), 0) AS n, coalesce(len(list_filter(cities, lambda c: canton_code IS NULL OR starts_with(c, canton_code || '-'))), 0) AS inside,
               list_filter(cities, lambda c: canton_code IS NULL OR starts_with(c, canton_code || '-'))[1] AS one FROM c4
    ), c6 AS (
        SELECT *, CASE WHEN served AND many THEN 'canton fits several' WHEN served AND city IS NOT NULL AND n > 0 AND inside = 0 THEN 'city lies elsewhere' WHEN served AND city IS NOT NULL AND inside > 1 THEN 'city fits several' END AS error FROM c5
    ), c7 AS (SELECT *, CASE WHEN served AND error IS NULL AND inside = 1 THEN one END AS municipality FROM c6)
    SELECT request_id, served, coalesce(cc, CASE WHEN regexp_matches(country, '^[A-Za-z][A-Za-z0-9]$') THEN upper(country) END) AS country_code, CASE WHEN served AND error IS NULL THEN coalesce(canton_code, regexp_replace(municipality, '-[0-9]+$', '')) END AS canton_code, municipality,
           CASE WHEN error IS NULL THEN concat_ws(',', CASE WHEN served AND lost THEN 'canton' END, CASE WHEN served AND city IS NOT NULL AND n = 0 THEN 'city' END) ELSE '' END AS not_recognised, error
    FROM c7
""")
def place_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where suppliers ask from: names in any case, codes, numbers, and some places that do not exist."""
    k, text = F.col("s_suppkey"), lambda c: F.col(c).cast("string")
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    country = F.when(k % 5 == 1, F.lower("r_name")).when(k % 5 == 2, F.concat(F.lit("r"), text("r_regionkey"))).when(k % 5 == 3, F.col("r_name")).when((k % 5 == 4) & (k % 2 == 0), "Atlantis").when(k % 5 == 4, "x9")
    canton = F.when(k % 11 == 0, "Nowhere").when(k % 4 == 1, F.lower("n_name")).when(k % 4 == 2, F.concat(F.lit("n"), text("n_nationkey"))).when(k % 4 == 3, F.concat(F.lit("R1-N"), text("n_nationkey")))
    foreign = F.concat(F.lit("R"), (k % 5).cast("string"), F.lit("-N"), text("n_nationkey"), F.lit("-"))
    before = F.when(k % 2 == 0, "").when(k % 7 == 3, foreign).otherwise(F.concat(F.lit("N"), text("n_nationkey"), F.lit("-")))
    city = F.when(k % 3 == 1, F.concat(F.lit("BUILDING "), (k % 40).cast("string"))).when(k % 3 == 2, F.concat(before, (k % 150).cast("string")))
    out = P.resolved(rows.select(k.alias("request_id"), country.alias("country"), canton.alias("canton"), city.alias("city")), register(spark, sf_dir), "R1")
    return out.withColumn("not_recognised", F.array_join("not_recognised", ","))


@query(f"""
    WITH {_REGISTER}
    SELECT code, lvl AS level, CASE lvl WHEN 0 THEN code || ' (federal)' WHEN 1 THEN code || ' (canton of ' || name || ')' ELSE code || ' (municipality of ' || name || ')' END AS label FROM place
""")
def place_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register(spark, sf_dir).select("code", P.level_of(F.col("code")).alias("level"), P.label(F.col("code"), F.col("name")).alias("label"))


@query(f"""
    WITH {_REGISTER}, bad AS (
        SELECT code, CASE WHEN lvl = 2 AND hash % 50 = 0 THEN '' ELSE name END AS name, lvl FROM (SELECT *, regexp_extract(code, '[0-9]+$', 0)::INT AS hash FROM place) WHERE NOT (lvl = 1 AND hash = 3)
        UNION ALL SELECT code, name, lvl FROM place WHERE lvl = 2 AND regexp_extract(code, '[0-9]+$', 0)::INT % 40 = 7
    )
    SELECT 'place.code' AS rule, code AS key, count(*) AS n FROM bad GROUP BY code HAVING count(*) > 1
    UNION ALL SELECT 'place.malformed', code, 1 FROM bad WHERE NOT regexp_matches(code, '^[A-Z][A-Z0-9]+(-[A-Z][A-Z0-9]+(-[1-9][0-9]*)?)?$')
    UNION ALL SELECT 'place.parent', code, 1 FROM bad WHERE lvl > 0 AND regexp_replace(code, '-[^-]+$', '') NOT IN (SELECT code FROM bad)
    UNION ALL SELECT 'place.name', code, 1 FROM bad WHERE trim(name) = ''
""")
def place_register_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register with a lost canton, some blank names and some codes twice."""
    code = F.col("code")
    number, level = F.regexp_extract(code, "[0-9]+$", 0).cast("int"), P.level_of(code)
    good = register(spark, sf_dir)
    bad = good.filter(~((level == 1) & (number == 3))).withColumn("name", F.when((level == 2) & (number % 50 == 0), "").otherwise(F.col("name")))
    return P.register_issues(bad.unionAll(good.filter((level == 2) & (number % 40 == 7))))


@query(f"""
    WITH {_REGISTER}, fact AS (SELECT DISTINCT 't' || (o_orderkey % 7) AS topic, CASE o_orderkey % 3 WHEN 0 THEN 'R' || n_regionkey WHEN 1 THEN 'R' || n_regionkey || '-N' || n_nationkey ELSE 'R' || n_regionkey || '-N' || n_nationkey || '-' || c_custkey END AS j
                 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    ask AS (SELECT code AS request_id, code AS place, 't' || (lvl + length(code)) % 7 AS topic FROM place),
    per AS (SELECT request_id, place, j, len(string_split(j, '-')) - 1 AS lvl, starts_with(place || '-', j || '-') AS over, starts_with(j, place || '-') AS under FROM ask JOIN fact USING (topic)),
    agg AS (SELECT request_id, place, max(lvl) FILTER (over) AS level, count(*) FILTER (over) AS n_applying, count(*) FILTER (under) AS n_narrower, list(j) AS held FROM per GROUP BY ALL)
    SELECT request_id, level::INT AS level, n_applying, n_narrower,
           CASE WHEN n_narrower = 0 THEN len(list_filter(held, lambda j: len(string_split(j, '-')) - 1 > coalesce(level, -1) AND NOT starts_with(place || '-', j || '-')))::BIGINT END AS elsewhere
    FROM agg
""")
def applying_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as facts of topics, published for a region, a nation or a customer; places ask for a topic each."""
    nation, k, text = table(spark, sf_dir, "nation"), F.col("o_orderkey"), lambda c: F.col(c).cast("string")
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    region = F.concat(F.lit("R"), text("n_regionkey"))
    canton = F.concat(region, F.lit("-N"), text("n_nationkey"))
    where = F.when(k % 3 == 0, region).when(k % 3 == 1, canton).otherwise(F.concat(canton, F.lit("-"), text("c_custkey")))
    facts = orders.select(F.concat(F.lit("t"), (k % 7).cast("string")).alias("topic"), where.alias("jurisdiction"))
    code, level = F.col("code"), P.level_of(F.col("code"))
    asked = register(spark, sf_dir)
    return P.applying_level(facts, asked.select(code.alias("request_id"), code.alias("place"), F.concat(F.lit("t"), ((level + F.length(code)) % 7).cast("string")).alias("topic")))


@query("""
    WITH m AS (SELECT c_nationkey, list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS s FROM customer GROUP BY ALL)
    SELECT c_nationkey, CASE len(s) WHEN 1 THEN s[1] ELSE array_to_string(s[:-2], ', ') || ' and ' || s[-1] END AS names FROM m
""")
def named_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("s"))
    return segments.select("c_nationkey", P.named_list(F.col("s")).alias("names"))
