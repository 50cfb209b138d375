"""Documents, pages and conversations as records, blocks and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import identity as I
from ..functions.text import line_key
from ..operators import quality as Q
from ..operators import records as R
from ..operators import rules
from .registry import query, table


@query("""
    SELECT sha256(text) AS sha256, count(*) AS members, min(doc_id) AS first_item FROM documents GROUP BY sha256(text) HAVING count(*) > 1
""")
def identical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.identical_groups(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1))"


@query(f"""
    SELECT 'source-' || left(sha256({_HOST}), 20) AS representation_group, count(*) AS pages,
           arg_min(page_id, (-length(html), page_id)) AS preferred
    FROM pages GROUP BY {_HOST}
""")
def representation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", I.host_of(F.col("url")).alias("host"), F.length("html").alias("n"))
    groups = pages.groupBy("host").agg(F.count("*").alias("pages"), F.min_by("page_id", F.struct(-F.col("n"), "page_id")).alias("preferred"))
    return groups.select(I.representation_group(F.col("host")).alias("representation_group"), "pages", "preferred")


@query("""
    WITH l AS (SELECT DISTINCT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT source, line, count(DISTINCT doc_id) AS pages FROM l WHERE length(line) >= 20 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2
""")
def repeated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= 20)
    return R.repeated_texts(lines, "source", "doc_id", "line")


@query("""
    WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    k AS (SELECT source, doc_id, length(line) AS n, regexp_replace(lower(trim(regexp_replace(line, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), '[0-9]', '#', 'g') AS key FROM l WHERE length(line) >= 20),
    b AS (SELECT source, key FROM k GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5)
    SELECT doc_id, sum(n)::BIGINT AS chars, coalesce(sum(n) FILTER (b.key IS NOT NULL), 0)::BIGINT AS repeated,
           coalesce(sum(n) FILTER (b.key IS NOT NULL), 0) >= 0.5 * sum(n) AS boilerplate
    FROM k LEFT JOIN b USING (source, key) GROUP BY doc_id
""")
def boilerplate_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= 20)
    lines = lines.select("source", "doc_id", F.length("line").alias("n"), line_key(F.col("line")).alias("key"))
    often = R.repeated_texts(lines, "source", "doc_id", "key", 5).select("source", "key", F.lit(True).alias("often"))
    marked = lines.join(often, ["source", "key"], "left")
    out = marked.groupBy("doc_id").agg(F.sum("n").cast("bigint").alias("chars"), F.coalesce(F.sum(F.when(F.col("often"), F.col("n"))), F.lit(0)).cast("bigint").alias("repeated"))
    return out.withColumn("boilerplate", F.col("repeated") >= 0.5 * F.col("chars"))


@query("""
    SELECT conv_id, turn, coalesce(sum(length(text) + 2) OVER w, 0)::BIGINT AS "start", (coalesce(sum(length(text) + 2) OVER w, 0) + length(text))::BIGINT AS "end"
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.with_offsets(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", "turn", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query("""
    WITH r AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER w AS new, row_number() OVER w = 1 AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT *, sum((new OR first)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM r)
    SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*) AS events FROM n GROUP BY user_id, run
""")
def heading_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    return out.groupBy("user_id", F.col("run").cast("bigint").alias("run")).agg(F.first("event_type").alias("event_type"), F.count("*").alias("events"))


@query(f"""
    SELECT {_HOST} AS host, count(*) AS pages, count(DISTINCT sha256(html)) AS distinct_pages, min(length(html))::BIGINT AS shortest, max(length(html))::BIGINT AS longest
    FROM pages GROUP BY {_HOST}
""")
def host_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(I.host_of(F.col("url")).alias("host"), F.sha2("html", 256).alias("h"), F.length("html").cast("bigint").alias("n"))
    return pages.groupBy("host").agg(F.count("*").alias("pages"), F.countDistinct("h").alias("distinct_pages"), F.min("n").alias("shortest"), F.max("n").alias("longest"))


@query(r"""
    SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1, 'i')), ''),
                             nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1, 'i')), ''), url) AS title
    FROM pages
""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    def first(tag: str):
        found = F.trim(F.regexp_extract("html", f"(?i)<{tag}[^>]*>([^<]*)</{tag}>", 1))
        return F.when(found != "", found)

    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(first("title"), first("h1"), F.col("url")).alias("title"))


@query("""
    SELECT lang, count(*) FILTER (quality = 1 AND toxic = 0) AS good, count(*) FILTER (quality = 0) AS poor, count(*) FILTER (toxic = 1) AS toxic,
           count(*) FILTER (quality IS NULL) AS unlabelled
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
""")
def language_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    q, t = F.col("quality"), F.col("toxic")
    counts = {"good": (q == 1) & (t == 0), "poor": q == 0, "toxic": t == 1, "unlabelled": q.isNull()}
    return rows.groupBy("lang").agg(*(F.count_if(c).alias(n) for n, c in counts.items()))


#: Rules of the example: the first path segment of a host decides
@query(f"""
    WITH p AS (SELECT page_id, url, {_HOST} AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM p),
    rules AS (
        SELECT DISTINCT host, '/' AS prefix, 'host' AS rule FROM s
        UNION ALL SELECT host, '/' || seg[1], 'section' FROM s WHERE len(seg) > 1 GROUP BY ALL HAVING count(*) >= 2
    ),
    hits AS (SELECT page_id, rule, r.prefix FROM s JOIN rules r ON s.host = r.host AND (r.prefix = '/' OR s.path = r.prefix OR starts_with('/' || array_to_string(seg, '/') || '/', r.prefix || '/')))
    SELECT p.page_id, p.url, arg_max(rule, length(hits.prefix)) AS rule, arg_max(hits.prefix, length(hits.prefix)) AS prefix FROM p LEFT JOIN hits USING (page_id) GROUP BY p.page_id, p.url
""")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    seg = F.filter(F.split(I.path_of(F.col("url")), "/"), lambda x: x != "")
    parts = pages.select(I.host_of(F.col("url")).alias("host"), seg.alias("seg"))
    top = parts.select("host").distinct().select("host", F.lit("/").alias("prefix"), F.lit("host").alias("rule"))
    own = parts.filter(F.size("seg") > 1).groupBy("host", F.concat(F.lit("/"), F.col("seg")[0]).alias("prefix")).count().filter("count >= 2")
    return rules.longest_prefix(pages, top.unionByName(own.select("host", "prefix", F.lit("section").alias("rule"))), "page_id", "url")


@query("""
    WITH old AS (SELECT doc_id // 2 AS k, lang, source FROM documents WHERE doc_id % 2 = 0), new AS (SELECT doc_id // 2 AS k, lang, source FROM documents WHERE doc_id % 2 = 1)
    SELECT k, CASE WHEN old.source IS NULL THEN 'added' WHEN new.source IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM old FULL JOIN new USING (k) WHERE old.source IS NULL OR new.source IS NULL OR old.lang IS DISTINCT FROM new.lang OR old.source IS DISTINCT FROM new.source
""")
def release_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even and odd ids stand for two versions of the same records; all rows are read."""
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 2).alias("k"), (F.col("doc_id") % 2).alias("v"), "lang", "source")
    return Q.diff(docs.filter("v = 0"), docs.filter("v = 1"), "k", "lang", "source")


_LABELS = """
    t AS (SELECT doc_id, source, list_sort(list_distinct(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z0-9]{4,}'))) AS tokens FROM documents),
    k AS (SELECT source, tokens, min(doc_id) AS rep, count(*) AS copies FROM t WHERE len(tokens) >= 2 GROUP BY ALL)
"""


def _label_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, tokens (sorted) of first lines with at least two words."""
    line = F.get(F.split("text", "\n"), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit("[a-z0-9]{4,}"), F.lit(0)))).alias("tokens"))
    return docs.filter(F.size("tokens") >= 2)


@query(f"WITH {_LABELS} SELECT doc_id, rep, copies FROM t JOIN k ON t.source IS NOT DISTINCT FROM k.source AND t.tokens = k.tokens")
def consolidation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source with equal first-line words: their class, named by its smallest id."""
    docs = _label_classes(spark, sf_dir).select("doc_id", "source", F.sha2(F.array_join("tokens", " "), 256).alias("h"))
    classes = docs.groupBy("source", "h").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    same = docs["source"].eqNullSafe(classes["source"]) & (docs["h"] == classes["h"])
    return docs.join(classes, same).select("doc_id", "rep", "copies")


@query(f"""
    WITH {_LABELS}
    SELECT a.rep AS a, b.rep AS b, a.copies AS copies_a, b.copies AS copies_b, len(list_intersect(a.tokens, b.tokens))::INT AS overlap
    FROM k a JOIN k b ON a.source IS NOT DISTINCT FROM b.source AND a.rep < b.rep
    WHERE len(list_intersect(a.tokens, b.tokens)) >= 2 AND 10 * len(list_intersect(a.tokens, b.tokens)) >= 6 * (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens)))
""")
def consolidation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of a source whose first lines share at least two words and 0.6 of their union.

    Such classes share one of their rarest words: of n words, the first n - ceil(0.6 n) + 1. All others never meet.
    """
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    classes = _label_classes(spark, sf_dir).groupBy(source.alias("source"), "tokens").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    each = classes.select("source", "rep", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    often = each.groupBy("source", "token").agg(F.count("*").alias("df")).filter("df > 1")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "token"))
    alone = F.coalesce("df", F.lit(1))
    prefix = each.join(often, ["source", "token"], "left").withColumn("df", alone).withColumn("place", place).filter("place <= n - ceil(n * 6 / 10) + 1 and df > 1")
    a, b = (prefix.select("source", "token", F.col("rep").alias(c), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))
    pairs = a.join(b, ["source", "token"]).filter("a < b and 10 * least(n_a, n_b) >= 6 * greatest(n_a, n_b)").select("a", "b").distinct()
    whole = lambda c, t: classes.select(F.col("rep").alias(c), F.col("tokens").alias(t), F.col("copies").alias(f"copies_{c}"))
    pairs = pairs.join(whole("a", "x"), "a").join(whole("b", "y"), "b").withColumn("overlap", F.size(F.array_intersect("x", "y")))
    fits = (F.col("overlap") >= 2) & (10 * F.col("overlap") >= 6 * (F.size("x") + F.size("y") - F.col("overlap")))
    return pairs.filter(fits).select("a", "b", "copies_a", "copies_b", "overlap")


@query("""
    WITH s AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    SELECT role, before, count(*) AS turns FROM s GROUP BY ALL
""")
def turn_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(w)).groupBy("role", "before").agg(F.count("*").alias("turns"))
