"""Runs, extraction and coverage on the shared tables: checked responses, reuse, articles, content hashes, classes of units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import canonical
from ..operators import acceptance, articles, candidates, chunks, coverage, incremental
from ..operators import records as R
from ..sources import crawl_run
from .registry import query, table


@query("""
    SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'plugin-document' WHEN page_id % 3 = 0 THEN 'in-scope' ELSE 'catalogue' END AS kind,
           CASE WHEN page_id % 5 = 0 THEN 'src ' || (page_id - page_id % 7) % 4 WHEN page_id % 3 = 0 THEN 'a,b' ELSE 'src ' || page_id % 4 END AS sources,
           'doc-' || sha256(CASE WHEN page_id % 5 = 0 THEN 'page ' || (page_id - page_id % 7) ELSE 'page ' || page_id END || chr(10) || CASE WHEN page_id % 13 = 0 THEN sha256(url) ELSE sha256(html) END)[1:20] AS document_id,
           CASE WHEN page_id % 17 = 0 THEN 'missing' WHEN page_id % 11 = 0 THEN 'size differs' WHEN page_id % 13 = 0 THEN 'hash differs' ELSE 'intact' END AS verdict
    FROM pages
""")
def run_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a saved run: a plan of all, manifests of all, every fifth as a plugin's document, some responses damaged."""
    k, pages = F.col("page_id"), table(spark, sf_dir, "pages")
    name = lambda c: F.concat(F.lit("page "), c.cast("string"))
    given = F.when(k % 3 == 0, F.struct(F.lit("in-scope").alias("kind"), F.array(F.lit("b"), F.lit("a")).alias("source_ids"), F.lit(None).cast("array<string>").alias("advertised_languages"), F.lit(None).cast("array<string>").alias("reasons")))
    targets = pages.select(name(k).alias("url"), F.array(F.concat(F.lit("src "), (k % 4).cast("string"))).alias("source_ids"), given.alias("attribution"))
    html = F.col("html").cast("binary")
    raw = F.when(k % 13 == 0, F.sha2("url", 256)).otherwise(F.sha2("html", 256))
    size = F.octet_length("html") + F.when(k % 11 == 0, 1).otherwise(0)
    manifests = pages.select(k, name(k).alias("url"), F.when(k % 5 == 0, "plugin").alias("plugin_id"), F.when(k % 5 == 0, name(k - k % 7)).alias("source_page_url"), F.concat(F.lit("pages/"), k.cast("string")).alias("path"), raw.alias("raw_sha256"), size.cast("bigint").alias("bytes"))
    responses = pages.filter(k % 17 != 0).select(F.concat(F.lit("pages/"), k.cast("string")).alias("path"), F.octet_length(html).cast("bigint").alias("length"), F.sha2(html, 256).alias("sha256"))
    out = crawl_run.verified(crawl_run.attributed(manifests, targets), responses)
    return out.select("page_id", F.col("attribution.kind").alias("kind"), F.array_join("attribution.source_ids", ",").alias("sources"), crawl_run.document_id(F.col("source_url"), F.col("raw_sha256")).alias("document_id"), "verdict")


@query("""
    WITH i AS (SELECT doc_id, sha256(text) AS raw FROM documents WHERE source <> (SELECT max(source) FROM documents)),
    e AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN sha256(lang) ELSE sha256(text) END AS raw, doc_id % 7 = 0 AS failed, lang = 'de' AS old, doc_id % 4 = 0 AS imported FROM documents WHERE lang <> 'fr')
    SELECT coalesce(i.doc_id, e.doc_id) AS document_id,
           CASE WHEN i.doc_id IS NULL THEN 'superseded' WHEN e.doc_id IS NULL THEN 'new' WHEN i.raw <> e.raw OR failed OR (old AND NOT imported) THEN 'recomputed' ELSE 'reused' END AS decision,
           CASE WHEN i.doc_id IS NULL OR e.doc_id IS NULL THEN NULL WHEN i.raw <> e.raw THEN 'bytes changed' WHEN failed THEN 'failed before' WHEN old AND NOT imported THEN 'extractor changed' END AS reason
    FROM i FULL JOIN e ON i.doc_id = e.doc_id
""")
def reuse_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a run against the records of an earlier one: one source is gone, one language is new."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    last = docs.agg(F.max("source")).first()[0]
    items = docs.filter(F.col("source") != last).select(k.alias("document_id"), F.sha2("text", 256).alias("raw_sha256"))
    raw = F.when(k % 10 == 0, F.sha2("lang", 256)).otherwise(F.sha2("text", 256))
    existing = docs.filter("lang <> 'fr'").select(k.alias("document_id"), raw.alias("raw_sha256"), F.when(k % 7 == 0, "extraction_failed").otherwise("extracted").alias("status"), F.when(F.col("lang") == "de", "v1").otherwise("v2").alias("extractor_version"), (k % 4 == 0).alias("imported"))
    return incremental.decisions(items, existing, "v2")


_GLUED = "l_linenumber::VARCHAR || CASE l_partkey % 4 WHEN 0 THEN (l_suppkey % 90)::VARCHAR WHEN 1 THEN '' ELSE (l_suppkey % 7)::VARCHAR END"


@query(f"""
    WITH RECURSIVE h AS (
        SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, CASE WHEN l_linenumber > 4 THEN 'II' END AS annex, {_GLUED} AS digits, CASE WHEN l_partkey % 5 = 0 THEN 'a' ELSE '' END AS suffix FROM lineitem
    ), walk AS (
        SELECT l_orderkey, 0::BIGINT AS n, NULL::VARCHAR AS annex, 0::BIGINT AS num, '' AS suffix, '' AS seen FROM (SELECT DISTINCT l_orderkey FROM h)
        UNION ALL
        SELECT l_orderkey, n, annex, CASE WHEN digits || suffix = seen THEN before
                                          ELSE coalesce(list_filter(list_transform(range(1, length(digits) + 1), lambda k: digits[1:k]::BIGINT), lambda x: x > before OR (suffix <> '' AND x >= before))[1], digits::BIGINT) END, suffix, digits || suffix
        FROM (SELECT h.*, CASE WHEN h.annex IS DISTINCT FROM w.annex THEN 0 ELSE num END AS before, CASE WHEN h.annex IS DISTINCT FROM w.annex THEN '' ELSE seen END AS seen
              FROM walk w JOIN h ON h.l_orderkey = w.l_orderkey AND h.n = w.n + 1)
    )
    SELECT l_orderkey, n AS block, annex, 'Art. ' || num || suffix AS article FROM walk WHERE n > 0
""")
def article_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as laws, their lines as articles whose headings have footnote numbers glued on; later lines are an annex."""
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    note = F.when(part % 4 == 0, (F.col("l_suppkey") % 90).cast("string")).when(part % 4 == 1, "").otherwise((F.col("l_suppkey") % 7).cast("string"))
    head = F.concat(F.lit("Art. "), n.cast("string"), note, F.when(part % 5 == 0, "a").otherwise(""), F.lit(" of it"))
    path = F.when(n > 4, F.array(F.lit("Law"), F.lit("Anhang II Lists"), head)).otherwise(F.array(F.lit("Law"), head))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("bigint")
    blocks = table(spark, sf_dir, "lineitem").select("l_orderkey", place.alias("block"), path.alias("heading_path"))
    return articles.with_articles(blocks, "l_orderkey", "block").drop("heading_path")


@query("""
    SELECT doc_id, sha256('{"flags":[' || CASE WHEN doc_id % 2 = 0 THEN 'true,null' ELSE '' END || '],"id":' || doc_id || ',"meta":{"lang":' || coalesce(to_json(lang)::VARCHAR, 'null') || ',"n":' || n_chars || CASE WHEN doc_id % 3 = 0 THEN ',"source":' || to_json(source)::VARCHAR ELSE '' END || '},"text":' || to_json(text)::VARCHAR || '}') AS sha256
    FROM documents
""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content hash of every document as a nested record; a source that is null is left out."""
    k = F.col("doc_id")
    flags = F.when(k % 2 == 0, F.array(F.lit(True), F.lit(None))).otherwise(F.array().cast("array<boolean>"))
    meta = F.struct(F.col("n_chars").alias("n"), F.when(k % 3 == 0, F.col("source")).alias("source"), "lang")
    rows = table(spark, sf_dir, "documents").select(F.col("text").alias("text"), meta.alias("meta"), flags.alias("flags"), k.alias("id"))
    return rows.select(F.col("id").alias("doc_id"), F.sha2(canonical.row_json(rows, frozenset({"source"})), 256).alias("sha256"))


_PARTS = ", ".join(f"sum(('0x' || h[{1 + 8 * k}:{8 + 8 * k}])::BIGINT)::HUGEINT AS p{k}" for k in range(8))
_SUMS = ", ".join(f"p{k}" for k in range(8))


@query(f"""
    WITH h AS (SELECT lang, sha256('{{"doc_id":' || doc_id || ',"text":' || to_json(text)::VARCHAR || '}}') AS h FROM documents),
    p AS (SELECT lang, count(*) AS rows, {_PARTS} FROM h GROUP BY lang)
    SELECT lang, rows, sha256(concat_ws(',', rows, {_SUMS})) AS sha256 FROM p
""")
def collection_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each language's documents that does not depend on their order."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    own = docs.select("doc_id", "text")
    hashed = docs.select("lang", F.sha2(canonical.row_json(own), 256).alias("_h"))
    return canonical.summed_hashes(hashed, "_h", "lang")


_COVERAGE = """
    lines AS (SELECT doc_id, lower(source) AS host, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)),
    units AS (SELECT doc_id, host, (n - 1) // 3 AS unit, min(n) AS a, max(n) AS b, lower(string_agg(line, ' ' ORDER BY n)) AS text FROM lines GROUP BY ALL),
    cited AS (SELECT DISTINCT doc_id, n FROM lines WHERE (doc_id * 7 + n) % 29 = 0),
    boiler AS (SELECT host, text FROM units WHERE text <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2),
    c AS (SELECT u.doc_id, u.unit, EXISTS (SELECT 1 FROM cited c WHERE c.doc_id = u.doc_id AND c.n BETWEEN a AND b) AS is_cited,
                 CASE WHEN l.toxic = 1 THEN 'out_of_scope' WHEN l.quality = 0 AND unit IN (0, 2) THEN 'deferred' WHEN d.lang = 'fr' AND d.source <> (SELECT min(source) FROM documents) THEN 'covered_elsewhere' END AS kind,
                 (u.host, u.text) IN (SELECT (host, text) FROM boiler) AS again
          FROM units u JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id)),
    classes AS (SELECT doc_id, unit, CASE WHEN is_cited THEN 'cited' WHEN kind IS NOT NULL THEN 'dispositioned' WHEN again THEN 'boilerplate' ELSE 'unclassified' END AS status, CASE WHEN NOT is_cited THEN kind END AS kind FROM c)
"""


def _coverage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Units of three lines, every 29th line or so cited; labels as decisions on documents and sections; French pages of
    all sources but one under rules."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    lines = docs.select(k.alias("document_id"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.select("document_id", (F.col("at") + 1).alias("n"), F.floor(F.col("at") / 3).alias("unit"), "line")
    text = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " "))
    units = lines.groupBy("document_id", "unit").agg(F.min("n").alias("first_block"), F.max("n").alias("last_block"), text.alias("text")).withColumn("section_ids", F.array(F.concat(F.lit("s"), F.col("unit").cast("string"))))
    cited = lines.filter((F.col("document_id") * 7 + F.col("n")) % 29 == 0).select("document_id", F.col("n").alias("block"))
    url = F.concat("source", F.lit("/"), "lang", F.lit("/"), k.cast("string"))
    documents = docs.select(k.alias("document_id"), url.alias("source_url"), F.lower("source").alias("host"), F.array("source").alias("source_ids"))
    labels = table(spark, sf_dir, "labels")
    null = F.lit(None)
    mine = labels.filter("toxic = 1").select(k.alias("number"), F.lit("out_of_scope").alias("kind"), k.alias("document_id"), null.cast("string").alias("url_prefix"), null.cast("array<string>").alias("section_ids"))
    parts = labels.filter("quality = 0").select(k, F.lit("deferred"), k, null.cast("string"), F.array(F.lit("s0"), F.lit("s2")))
    first = docs.agg(F.min("source")).first()[0]
    rules = docs.filter(F.col("source") != first).groupBy("source").agg(F.min(k).alias("number")).select("number", F.lit("covered_elsewhere"), null.cast("bigint"), F.concat("source", F.lit("/fr/")), null.cast("array<string>"))
    return coverage.classified(units, documents, cited, mine.unionAll(parts).unionAll(rules), 2), documents


@query(f"WITH {_COVERAGE} SELECT doc_id AS document_id, unit::BIGINT AS unit, status, kind FROM classes")
def coverage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir)[0]


@query(f"""
    WITH {_COVERAGE}, n AS (SELECT doc_id, count(*) AS units, count(*) FILTER (status = 'cited') AS cited, count(*) FILTER (status = 'dispositioned') AS dispositioned,
                                   count(*) FILTER (status = 'boilerplate') AS boilerplate, count(*) FILTER (status = 'unclassified') AS unclassified FROM classes GROUP BY doc_id)
    SELECT doc_id AS document_id, units, cited, dispositioned, boilerplate, unclassified,
           CASE WHEN unclassified > 0 AND cited > 0 THEN 'partly_cited' WHEN unclassified > 0 THEN 'unclassified' WHEN units = boilerplate THEN 'boilerplate_only'
                WHEN cited = units - boilerplate THEN 'cited' WHEN cited > 0 THEN 'cited_and_dispositioned' ELSE 'dispositioned' END AS status FROM n
""")
def coverage_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, documents = _coverage(spark, sf_dir)
    return coverage.by_document(classes, documents)


@query(f"""
    WITH {_COVERAGE}, n AS (SELECT source AS source_id, count(DISTINCT doc_id) AS documents, count(*) FILTER (status = 'cited') AS cited, count(*) FILTER (status = 'dispositioned') AS dispositioned,
                                   count(*) FILTER (status = 'boilerplate') AS boilerplate, count(*) FILTER (status = 'unclassified') AS unclassified FROM classes JOIN documents USING (doc_id) GROUP BY source
                            UNION ALL SELECT 'a source without pages', 0, 0, 0, 0, 0)
    SELECT source_id, documents, cited + dispositioned + unclassified AS units, cited, dispositioned, boilerplate, unclassified,
           CASE WHEN documents = 0 THEN 'no_documents' WHEN unclassified > 0 AND cited + dispositioned > 0 THEN 'partly_covered' WHEN unclassified > 0 THEN 'nothing' WHEN cited > 0 THEN 'cited'
                WHEN dispositioned = 0 THEN 'boilerplate_only' ELSE 'dispositioned' END AS status FROM n
""")
def coverage_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, documents = _coverage(spark, sf_dir)
    return coverage.by_source(classes, documents, spark.createDataFrame([("a source without pages",)], "source_id string"))



@query("SELECT doc_id, length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g')) AS characters, 0 AS wrong_quotes, 0 AS over FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def chunk_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk plan of all documents, each one block, counted again: characters that its spans cover, spans that are not
    where they say, chunks that cost too much."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    blocks = docs.select(F.col("doc_id").alias("document"), F.lit("s1").alias("section"), F.lit(1).alias("block_no"), F.lit(0).alias("start"), "text", F.lit(False).alias("link_only"))
    spans = chunks.chunk_plan(blocks).withColumnRenamed("document", "doc_id")
    sized = spans.groupBy("doc_id", "chunk").agg(F.sum(F.length("quote") + chunks.SPAN_FRAME).alias("cost")).groupBy("doc_id").agg(F.count_if(F.col("cost") > 6400).alias("over"))
    # spans overlap at the ends of chunks: what a span adds begins where those before it end
    w = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = spans.withColumn("before", F.greatest("start", F.coalesce(F.max("end").over(w), F.lit(0))))
    both = fresh.join(docs, "doc_id")
    wrong = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("quote")
    added = F.when(F.col("end") > F.col("before"), F.length(F.regexp_replace(F.substring(F.col("text"), F.col("before") + 1, F.col("end") - F.col("before")), r"[ \t\n\r\f\x0B]+", ""))).otherwise(0)
    per = both.groupBy("doc_id").agg(F.sum(added).alias("characters"), F.count_if(wrong).cast("int").alias("wrong_quotes"))
    return per.join(sized, "doc_id").select("doc_id", "characters", "wrong_quotes", F.col("over").cast("int").alias("over"))


_PACKAGE = """
    lines AS (SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    c AS (SELECT d.doc_id, d.lang, len(string_split(text, chr(10))) AS n, quality, toxic, line AS first_line FROM documents d LEFT JOIN labels USING (doc_id) JOIN lines l ON l.doc_id = d.doc_id AND l.n = 1)
"""


@query(f"""
    WITH {_PACKAGE}, r AS (
        SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 'no supported review' WHEN doc_id % 19 = 3 THEN 'confidence' WHEN quality = 0 THEN 'low confidence' WHEN doc_id % 23 = 5 THEN 'label or description'
                                  WHEN doc_id % 29 = 7 THEN 'content hash' WHEN doc_id % 10 = 1 THEN 'block number' WHEN length(first_line) < 4 THEN 'outside block' WHEN doc_id % 10 = 2 THEN 'evidence id' WHEN doc_id % 10 = 3 THEN 'evidence changed' END AS reason FROM c
    ), s AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY lang, reason IS NULL ORDER BY doc_id) END AS nth FROM r)
    SELECT doc_id, reason, CASE WHEN reason IS NULL THEN 'about-' || lang || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END END AS concept_id, CASE WHEN reason IS NULL THEN '1-1' END AS ranges FROM s
""")
def packaged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate per document that quotes its first line, some of them with a fault; lines are blocks."""
    k, lang = F.col("doc_id"), F.col("lang")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    lines = R.with_offsets(docs.select(k, F.posexplode(F.split("text", "\n")).alias("at", "text")), "doc_id", "at", "text", gap=1)
    blocks = lines.select(k.alias("document_id"), (F.col("at") + 1).cast("bigint").alias("block_number"), F.concat(k.cast("string"), F.lit(":b"), (F.col("at") + 1).cast("string")).alias("block_id"), "start", "end", "text", F.sha2("text", 256).alias("text_sha256"))
    records = docs.select(k.alias("document_id"), F.col("text").alias("content_text"), F.sha2(F.when(k % 29 == 7, "").otherwise(F.col("text")), 256).alias("content_sha256"))
    line = F.split("text", "\n")[0]
    size = F.greatest(F.length(line), F.lit(4)).cast("bigint")
    number = F.when(k % 10 == 1, F.size(F.split("text", "\n")) + 1).otherwise(1).cast("bigint")
    evidence = F.struct(
        F.concat(F.lit("b"), F.when(k % 10 == 2, "1").otherwise("00001"), F.lit(":0:"), size.cast("string")).alias("evidence_id"), F.concat(k.cast("string"), F.lit(":b1")).alias("block_id"), number.alias("block_number"),
        F.lit(0).cast("bigint").alias("start"), size.alias("end"), F.when(k % 10 == 3, "never said").otherwise(line).alias("quote"), F.sha2(line, 256).alias("text_sha256"),
    )
    proposed = docs.select(
        k.alias("candidate_id"), k.alias("document_id"), F.concat(F.lit(" About: "), lang, F.lit("!")).alias("preferred_label"), F.when(k % 23 == 5, " ").otherwise("text").alias("description"),
        F.when(k % 19 == 3, F.lit(1.5)).when(F.col("quality") == 0, F.lit(0.2)).otherwise(F.lit(0.9)).alias("confidence"), F.lit("CANDIDATE").alias("validation_state"),
        F.when(F.col("toxic") == 1, "rejected").otherwise("supported").alias("decision"), F.lit("none").alias("issue"), F.lit("ok").alias("review_reason"), F.concat(lang, F.lit("-CH")).alias("language"), F.array(evidence).alias("evidence"),
    )
    out = candidates.packaged(proposed, records, blocks, 0.5)
    listed = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["first_block"].cast("string"), r["last_block"].cast("string"))), ",")
    return out.select(F.col("candidate_id").alias("doc_id"), "reason", "concept_id", listed.alias("ranges"))


@query("""
    WITH f AS (SELECT doc_id, doc_id // 10 AS concept, split_part(text, chr(10), 1) AS said, text[1:300] AS quote FROM documents),
    c AS (SELECT doc_id, concept, doc_id % 3 = 0 AS pinned, [lower(said[2:14]), CASE WHEN doc_id % 7 = 0 THEN 'never said' ELSE lower(said[1:3]) END] AS phrases, CASE WHEN doc_id % 5 = 0 THEN 'no such words' WHEN doc_id % 4 = 0 THEN lower(quote[21:35]) END AS other FROM f),
    s AS (SELECT c.doc_id, f.doc_id AS fact, quote FROM c JOIN f ON f.concept = c.concept AND (NOT pinned OR f.doc_id = c.doc_id)
          WHERE f.doc_id % 11 <> 0 AND list_aggregate(list_transform(phrases, lambda p: contains(lower(regexp_replace(trim(said), '\\s+', ' ', 'g')), regexp_replace(trim(p), '\\s+', ' ', 'g'))), 'bool_and'))
    SELECT doc_id AS claim_id, CASE WHEN pinned AND doc_id % 11 = 0 THEN 'not served' WHEN doc_id NOT IN (SELECT doc_id FROM s) THEN 'not stated'
                WHEN other IS NOT NULL AND doc_id NOT IN (SELECT s.doc_id FROM s JOIN c USING (doc_id) WHERE contains(lower(regexp_replace(trim(quote), '\\s+', ' ', 'g')), regexp_replace(trim(other), '\\s+', ' ', 'g'))) THEN 'not backed' END AS issue
    FROM c
""")
def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim per document on the facts of its ten neighbours: first lines as statements, openings as excerpts; one in eleven
    is not served."""
    k, docs = F.col("doc_id"), table(spark, sf_dir, "documents")
    line, text = F.split("text", "\n")[0], F.col("text")
    concept = F.floor(k / 10).cast("string")
    served = docs.filter(k % 11 != 0).select(F.lit("case").alias("case_id"), concept.alias("concept"), k.alias("fact_id"), line.alias("statement"))
    excerpts = docs.select(k.alias("fact_id"), F.substring(text, 1, 300).alias("excerpt"))
    said = F.array(F.substring(line, 2, 13), F.when(k % 7 == 0, "never said").otherwise(F.substring(line, 1, 3)))
    other = F.when(k % 5 == 0, F.array(F.lit("no such words"))).when(k % 4 == 0, F.array(F.substring(F.substring(text, 1, 300), 21, 15)))
    claims = docs.select(k.alias("claim_id"), F.lit("case").alias("case_id"), concept.alias("concept"), F.when(k % 3 == 0, k).alias("fact_id"), said.alias("statement_contains"), other.alias("excerpt_contains"))
    return acceptance.claim_issues(claims, served, excerpts)
