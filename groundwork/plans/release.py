"""Citations, attribution, coverage units and release checks on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identity import host_of
from ..operators import anchors as A
from ..operators import records as O
from ..operators import release as R
from ..operators import validation as V
from .registry import query, table


@query("""
    WITH t AS (SELECT doc_id, source, list_transform(string_split(text, chr(10)), lambda x: sha256(x)) AS hashes, sha256(text) AS content FROM documents),
    r AS (SELECT *, doc_id % 10 <> 3 AS current, doc_id % 23 <> 1 AS eligible, doc_id % 3 <> 0 AS preferred FROM t),
    c AS (SELECT doc_id AS citation_id, CASE WHEN doc_id % 4 = 1 THEN doc_id + 1000000000 ELSE doc_id END AS document_id, source AS url, 1 + doc_id % len(hashes) AS first_block,
                 CASE WHEN doc_id % 9 = 5 THEN content ELSE 'other' END AS content_hash,
                 CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN [sha256('x')] WHEN 2 THEN hashes[-1:] ELSE hashes[1 + doc_id % len(hashes):2 + doc_id % len(hashes)] END AS anchor FROM t),
    newest AS (SELECT source AS url, arg_max(r, doc_id) AS n FROM r WHERE current AND eligible AND preferred GROUP BY source),
    j AS (SELECT c.*, o.hashes IS NOT NULL AS here, o.content AS own_content, n, coalesce(o.hashes, n.hashes) AS blocks
          FROM c LEFT JOIN (SELECT * FROM r WHERE current AND eligible) o ON o.doc_id = c.document_id LEFT JOIN newest USING (url)),
    f AS (SELECT *, list_filter(range(1, len(blocks) - len(anchor) + 2), lambda i: blocks[i:i + len(anchor) - 1] = anchor) AS places FROM j),
    o AS (SELECT *, CASE WHEN here THEN CASE WHEN (anchor IS NULL AND first_block <= len(blocks)) OR list_contains(places, first_block) THEN 'same-snapshot' WHEN anchor IS NOT NULL AND own_content = content_hash THEN 'same-text'
                                             WHEN anchor IS NOT NULL AND len(places) = 1 THEN 'moved' ELSE 'dropped' END
                         WHEN anchor IS NULL OR n IS NULL THEN 'dropped' WHEN n.content = content_hash THEN 'same-text' WHEN len(places) = 1 THEN 'moved' WHEN len(places) > 1 THEN 'ambiguous' ELSE 'changed' END AS outcome FROM f)
    SELECT citation_id, outcome, CASE WHEN outcome <> 'dropped' THEN CASE WHEN here THEN document_id ELSE n.doc_id END END AS found,
           CASE WHEN outcome IN ('same-snapshot', 'same-text') THEN first_block WHEN outcome = 'moved' THEN places[1] END::BIGINT AS first_block
    FROM o
""")
def citation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is cited by some of its lines; some ids are gone, some records superseded, some lines elsewhere or changed."""
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(k, "source", F.transform(F.split("text", "\n"), lambda x: F.sha2(x, 256)).alias("hashes"), F.sha2("text", 256).alias("content"))
    records = docs.select(k.alias("document_id"), F.col("source").alias("url"), F.col("content").alias("content_hash"), "hashes", k.alias("retrieved"), (k % 10 != 3).alias("current"), (k % 23 != 1).alias("eligible"), (k % 3 != 0).alias("preferred"))
    first = (1 + k % F.size("hashes")).cast("int")
    anchor = F.when(k % 5 == 1, F.array(F.sha2(F.lit("x"), 256))).when(k % 5 == 2, F.slice("hashes", -1, 1)).when(k % 5 > 2, F.slice("hashes", first, F.lit(2)))
    content = F.when(k % 9 == 5, F.col("content")).otherwise("other")
    cited = docs.select(k.alias("citation_id"), F.when(k % 4 == 1, k + 1000000000).otherwise(k).alias("document_id"), F.col("source").alias("url"), first.alias("first_block"), anchor.alias("anchor"), content.alias("content_hash"))
    return R.citations_resolved(cited, records)


@query(r"""
    WITH p AS (SELECT page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1) AS host, CASE WHEN page_id % 3 = 0 THEN 'office ' || (page_id % 5) END AS authority FROM pages),
    q AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'www.' || host ELSE host END AS host, authority FROM p),
    known AS (SELECT DISTINCT host, 'publisher of ' || host AS publisher FROM p WHERE length(host) % 2 = 0)
    SELECT page_id, coalesce(a.publisher, b.publisher, authority) AS publisher,
           CASE WHEN a.publisher IS NOT NULL THEN 'host' WHEN b.publisher IS NOT NULL THEN 'bare host' WHEN authority IS NOT NULL THEN 'authority' ELSE 'none' END AS rule
    FROM q LEFT JOIN known a ON a.host = q.host LEFT JOIN known b ON b.host = regexp_replace(q.host, '^www\.', '')
""")
def page_publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, every other one under www, and a registry of some hosts."""
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select(k, host_of(F.col("url")).alias("host"), F.when(k % 3 == 0, F.concat(F.lit("office "), (k % 5).cast("string"))).alias("authority"))
    registry = pages.filter(F.length("host") % 2 == 0).select("host", F.concat(F.lit("publisher of "), "host").alias("publisher")).distinct()
    asked = pages.withColumn("host", F.when(k % 2 == 0, F.concat(F.lit("www."), "host")).otherwise(F.col("host")))
    return R.publishers(asked, registry, "page_id", "host", "authority")


_KIND = "CASE l_returnflag WHEN 'N' THEN 'act' WHEN 'A' THEN 'guidance' ELSE 'summary' END"


@query(f"""
    WITH b AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'federal' WHEN 1 THEN 'cantonal' ELSE 'municipal' END AS level, {_KIND} AS kind, CASE WHEN l_linenumber > 2 THEN 'Art. ' || l_linenumber END AS norm, l_linestatus = 'F' AS refers FROM lineitem)
    SELECT DISTINCT level, kind, CASE kind WHEN 'act' THEN upper(level[1]) || level[2:] || ' act: ' || norm WHEN 'guidance' THEN upper(level[1]) || level[2:] || ' authority guidance' ELSE 'Portal summary of ' || level || ' rules' END
           || CASE WHEN refers THEN ', referring to the rules' ELSE '' END AS label
    FROM b
""")
def basis_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as excerpts: what they rest on, in words; an act without a norm has none."""
    n = F.col("l_linenumber")
    level = F.when(n % 3 == 0, "federal").when(n % 3 == 1, "cantonal").otherwise("municipal")
    kind, norm = F.expr(_KIND), F.when(n > 2, F.concat(F.lit("Art. "), n.cast("string")))
    text = V.basis_label(level, kind, norm, F.when(F.col("l_linestatus") == "F", "the rules"))
    return table(spark, sf_dir, "lineitem").select(level.alias("level"), kind.alias("kind"), text.alias("label")).distinct()


@query("""
    WITH n AS (SELECT user_id, event_id, event_type, length(props) AS characters, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    s AS (SELECT *, (n <= 60 OR lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1)::INT AS new FROM n WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    u AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS unit FROM s)
    SELECT user_id, unit::BIGINT AS unit, min(event_id) AS first, max(event_id) AS last, count(*) AS sections, sum(characters)::BIGINT AS characters FROM u GROUP BY user_id, unit
""")
def coverage_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the sections of a user's document; long documents roll neighbours of one type up."""
    events = table(spark, sf_dir, "events").withColumn("characters", F.length("props"))
    return R.rolled_up(events, "user_id", "event_id", F.col("event_type"), 60)


@query("""
    WITH l AS (SELECT source AS host, doc_id AS document, sha256(line) AS text_hash FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 0),
    p AS (SELECT host, text_hash, count(DISTINCT document) AS pages FROM l GROUP BY ALL HAVING count(DISTINCT document) >= 3),
    c AS (SELECT text_hash, count(DISTINCT document) AS citing FROM l WHERE document % 5 = 0 GROUP BY ALL)
    SELECT host, text_hash, pages, CASE WHEN citing IS NULL THEN 'cited_nowhere' WHEN citing = 1 THEN 'cited_once' ELSE 'cited_on_several_pages' END AS status FROM p LEFT JOIN c USING (text_hash)
""")
def boilerplate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on three or more documents of a source, and whether every fifth document's lines, cited by facts, are among them."""
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("host"), F.col("doc_id").alias("document"), F.explode(F.split("text", "\n")).alias("line")).filter("length(line) > 0")
    units = lines.select("host", "document", F.sha2("line", 256).alias("text_hash"))
    return R.repeated_units(units, units.filter("document % 5 = 0"), 3)


@query("""
    SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS blocks
    FROM (SELECT o_custkey, o_orderkey, o_orderkey - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS island FROM (SELECT DISTINCT o_custkey % 7 AS o_custkey, o_orderkey FROM orders))
    GROUP BY o_custkey, island
""")
def citation_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited blocks (order keys of a bucket of customers) as ranges."""
    return R.ranges(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("o_custkey"), "o_orderkey"), "o_custkey", "o_orderkey")


@query(r"""
    WITH r AS (SELECT o_custkey AS dataset, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN '4-not specified' ELSE o_orderpriority END AS key, o_orderdate::DATE AS day FROM orders),
    m AS (SELECT c_custkey AS dataset, c_custkey % 30 AS row_count, CASE WHEN c_custkey % 12 <> 0 THEN c_mktsegment END AS title, CASE WHEN c_custkey % 15 = 0 THEN ' ' ELSE 'open' END AS licence, DATE '1992-06-01' AS a, DATE '1998-06-01' AS b, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'] AS keys FROM customer),
    s AS (SELECT *, lag(coalesce(key, '')) OVER w AS pk, lag(day) OVER w AS pd FROM r WINDOW w AS (PARTITION BY dataset ORDER BY position)),
    p AS (SELECT dataset, count(*) AS n, count(*) FILTER (pk > coalesce(key, '') OR pk = coalesce(key, '') AND pd > day) AS unsorted, count(*) - count(DISTINCT (coalesce(key, ''), day)) AS repeated, count(DISTINCT key) <> count(DISTINCT regexp_replace(lower(key), '[\s-]+', '', 'g')) AS alike,
                 count(*) FILTER (key IS NULL) AS keyless, list(DISTINCT key ORDER BY key) FILTER (key IS NOT NULL) AS have, min(day) AS low, max(day) AS high FROM s GROUP BY dataset)
    SELECT unnest(list_filter([CASE WHEN coalesce(n, 0) = 0 THEN 'dataset.empty' END, CASE WHEN coalesce(n, 0) <> row_count THEN 'dataset.row_count' END, CASE WHEN unsorted > 0 THEN 'dataset.unsorted' END,
                   CASE WHEN repeated > 0 THEN 'dataset.repeated' END, CASE WHEN keyless > 0 THEN 'dataset.keyless' END, CASE WHEN low < a OR high > b THEN 'dataset.period' END, CASE WHEN have <> keys THEN 'dataset.keys' END,
                   CASE WHEN alike THEN 'dataset.keys_alike' END, CASE WHEN title IS NULL THEN 'dataset.title' END, CASE WHEN trim(licence) = '' THEN 'dataset.licence' END], lambda x: x IS NOT NULL)) AS rule,
           dataset::VARCHAR AS key, 1::BIGINT AS n
    FROM m LEFT JOIN p USING (dataset)
""")
def dataset_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a bundle of dated rows, with manifests that often say something else."""
    k = F.col("o_orderkey")
    key = F.when(k % 97 == 0, F.lit(None)).when(k % 31 == 0, "4-not specified").otherwise(F.col("o_orderpriority"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(k))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dataset"), place.alias("position"), key.alias("key"), F.to_date("o_orderdate").alias("day"))
    keys = F.array(*(F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    c = F.col("c_custkey")
    manifests = table(spark, sf_dir, "customer").select(c.alias("dataset"), (c % 30).alias("row_count"), F.lit("1992-06-01").cast("date").alias("period_from"), F.lit("1998-06-01").cast("date").alias("period_to"), keys.alias("keys"), F.when(c % 12 != 0, F.col("c_mktsegment")).alias("title"), F.when(c % 15 == 0, " ").otherwise("open").alias("licence"))
    return R.dataset_issues(rows, manifests)


@query("""
    WITH l AS (SELECT doc_id, generate_subscripts(lines, 1) AS n, unnest(lines) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
    b AS (SELECT doc_id, n, length(line) AS len, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM l),
    s AS (SELECT doc_id, n, line, (coalesce(start, 0) + CASE WHEN (doc_id + n) % 13 = 0 THEN 1 ELSE 0 END)::BIGINT AS start, len FROM b)
    SELECT 'record.content_hash' AS rule, doc_id::VARCHAR AS key, 1::BIGINT AS n FROM documents WHERE doc_id % 17 = 0
    UNION ALL SELECT 'block.offsets', doc_id || ':b' || s.n, 1 FROM s JOIN documents USING (doc_id) WHERE substring(text, start + 1, len) <> line
    UNION ALL SELECT 'block.text_hash', doc_id || ':b' || s.n, 1 FROM s WHERE (doc_id + s.n) % 19 = 0
""")
def record_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records and their lines as blocks, with some offsets and hashes off."""
    docs, k, n = table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("n")
    records = docs.select(k.alias("document_id"), F.col("text").alias("content"), F.sha2(F.when(k % 17 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("content_hash"))
    lines = docs.select(k, F.posexplode(F.split("text", "\n")).alias("at", "text")).select(k, (F.col("at") + 1).alias("n"), "text")
    lines = O.with_offsets(lines, "doc_id", "n", "text", gap=1)
    start = F.col("start") + F.when((k + n) % 13 == 0, 1).otherwise(0)
    blocks = lines.select(k.alias("document_id"), F.concat(k.cast("string"), F.lit(":b"), n.cast("string")).alias("block_id"), start.alias("start"), (start + F.length("text")).alias("end"), "text", F.sha2(F.when((k + n) % 19 == 0, F.concat("text", F.lit("y"))).otherwise(F.col("text")), 256).alias("text_hash"))
    return R.record_issues(records, blocks)


@query("""
    WITH m AS (SELECT source AS url, 'p' || doc_id AS path, sha256(text) AS raw_hash FROM documents WHERE doc_id % 9 <> 0
               UNION ALL SELECT source, 'p' || doc_id, sha256(text) FROM documents WHERE doc_id % 14 = 0),
    r AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 11 = 0 THEN 'other' ELSE source END AS url, 'p' || doc_id AS path, CASE WHEN doc_id % 8 = 0 THEN sha256('z') ELSE sha256(text) END AS raw_hash FROM documents),
    h AS (SELECT path, list(DISTINCT raw_hash) AS hashes FROM m GROUP BY path), b AS (SELECT url, path, raw_hash, count(*) AS bound FROM m GROUP BY ALL),
    i AS (SELECT document_id, CASE WHEN hashes IS NULL THEN 'saved response missing' WHEN NOT list_contains(hashes, r.raw_hash) THEN 'saved response hash differs' WHEN coalesce(bound, 0) <> 1 THEN 'not bound to one manifest' END AS issue
          FROM r LEFT JOIN h USING (path) LEFT JOIN b ON b.url = r.url AND b.path = r.path AND b.raw_hash = r.raw_hash)
    SELECT document_id, issue FROM i WHERE issue IS NOT NULL
""")
def snapshot_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    path, body = F.concat(F.lit("p"), k.cast("string")).alias("path"), F.sha2("text", 256)
    saved = docs.select(k, F.col("source").alias("url"), path, body.alias("raw_hash"))
    manifests = saved.filter(k % 9 != 0).unionAll(saved.filter(k % 14 == 0)).drop("doc_id")
    records = docs.select(k.alias("document_id"), F.when(k % 11 == 0, "other").otherwise(F.col("source")).alias("url"), path, F.when(k % 8 == 0, F.sha2(F.lit("z"), 256)).otherwise(body).alias("raw_hash"))
    return R.snapshot_issues(records, manifests)


@query("""
    WITH h AS (SELECT event_type AS kind, count(*) AS counted FROM events GROUP BY ALL), m AS (SELECT kind, counted + length(kind) % 2 AS stated FROM h UNION ALL SELECT 'gone', 5)
    SELECT kind, coalesce(stated, 0)::BIGINT AS stated, coalesce(counted, 0)::BIGINT AS counted FROM m FULL JOIN h USING (kind) WHERE coalesce(stated, 0) <> coalesce(counted, 0)
""")
def manifest_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    stated = events.groupBy(F.col("event_type").alias("kind")).agg((F.count("*") + F.length(F.first("event_type")) % 2).cast("bigint").alias("stated"))
    gone = spark.createDataFrame([("gone", 5)], "kind string, stated long")
    return R.recount_issues(events, "event_type", stated.unionAll(gone))


@query("""
    WITH p AS (SELECT doc_id FROM documents), v AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 6 = 0 UNION ALL SELECT doc_id + 1000000000 FROM labels WHERE doc_id % 25 = 0),
    n AS (SELECT doc_id, count(*) AS n FROM v GROUP BY doc_id)
    SELECT CASE WHEN p.doc_id IS NULL THEN 'verdict.unknown' WHEN n IS NULL THEN 'verdict.missing' ELSE 'verdict.repeated' END AS rule, coalesce(p.doc_id, n.doc_id)::VARCHAR AS key, coalesce(n, 0)::BIGINT AS n
    FROM p FULL JOIN n ON p.doc_id = n.doc_id WHERE p.doc_id IS NULL OR n IS NULL OR n > 1
""")
def review_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as verdicts on documents: some twice, some on nothing, many missing."""
    given = table(spark, sf_dir, "labels").select("doc_id")
    verdicts = given.unionAll(given.filter("doc_id % 6 = 0")).unionAll(given.filter("doc_id % 25 = 0").select(F.col("doc_id") + 1000000000))
    return R.review_issues(table(spark, sf_dir, "documents").select("doc_id"), verdicts, "doc_id")


@query("""
    WITH a AS (SELECT doc_id AS anchor_id, CASE WHEN doc_id % 9 = 0 THEN 'never said ' || doc_id ELSE substring(text, 11, 60) END AS excerpt,
                      CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || text ELSE 'new opening' || chr(10) || text END AS content FROM documents WHERE length(text) >= 100),
    p AS (SELECT anchor_id, excerpt, content, list_filter(range(1, length(content) - length(excerpt) + 2), lambda i: substring(content, i, length(excerpt)) = excerpt) AS found FROM a),
    r AS (SELECT anchor_id, CASE len(found) WHEN 0 THEN 'changed' WHEN 1 THEN 'moved' ELSE 'ambiguous' END AS outcome, CASE WHEN len(found) = 1 THEN found[1] - 1 END AS s, length(excerpt) AS n, content FROM p)
    SELECT anchor_id, outcome, s::BIGINT AS start, (s + n)::BIGINT AS "end", (length(substring(content, 1, s)) - length(replace(substring(content, 1, s), chr(10), '')) + 1)::BIGINT AS first_block,
           (length(substring(content, 1, s + n - 1)) - length(replace(substring(content, 1, s + n - 1), chr(10), '')) + 1)::BIGINT AS last_block
    FROM r
""")
def excerpt_relocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of documents in newer versions that begin with another line or say everything twice; blocks are lines."""
    k, text = F.col("doc_id"), F.col("text")
    docs = table(spark, sf_dir, "documents").filter(F.length("text") >= 100)
    content = F.when(k % 5 == 0, F.concat(text, F.lit("\n"), text)).otherwise(F.concat(F.lit("new opening\n"), text))
    records = docs.select(k.alias("document"), content.alias("content"))
    anchors = docs.select(k.alias("anchor_id"), k.alias("document"), F.when(k % 9 == 0, F.concat(F.lit("never said "), k.cast("string"))).otherwise(F.substring("text", 11, 60)).alias("excerpt"))
    lines = O.with_offsets(records.select("document", F.posexplode(F.split("content", "\n")).alias("at", "line")), "document", "at", "line", gap=1)
    blocks = lines.select("document", (F.col("at") + 1).cast("bigint").alias("block_no"), "start", (F.col("end") + 1).alias("end"))  # a line and its end
    return A.relocated_by_excerpt(anchors, records, blocks)
