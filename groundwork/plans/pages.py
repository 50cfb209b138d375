"""Saved pages as blocks, sections, links and facts.

The SQL has no parser of markup: it splits the pages at the tags that they have and no others, which says the same
of these pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..operators import records as R
from ..operators import sections as S
from ..sources import charsets, html
from .registry import query, table

_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
_TAGS = "nav|ul|li|div|article|h1|p|footer|body"
_CLEAN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"""
_WALK = rf"""
    source AS (
        SELECT page_id, {_HOST} AS host, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<head>.*?</head>|<script>.*?</script>', '', 'g'), '\x{{00AD}}', '', 'g') AS h FROM pages
    ), tokens AS (
        SELECT page_id, host, generate_subscripts(c, 1) AS n, unnest(c) AS close, unnest(t) AS tag, unnest(x) AS inner_html FROM (
            SELECT page_id, host, regexp_extract_all(h, '<(/?)({_TAGS})\b[^>]*>([^<]*(?:</?(?:a|b|br)\b[^>]*>[^<]*)*)', 1) AS c,
                   regexp_extract_all(h, '<(/?)({_TAGS})\b[^>]*>([^<]*(?:</?(?:a|b|br)\b[^>]*>[^<]*)*)', 2) AS t,
                   regexp_extract_all(h, '<(/?)({_TAGS})\b[^>]*>([^<]*(?:</?(?:a|b|br)\b[^>]*>[^<]*)*)', 3) AS x FROM source)
    ), placed AS (
        SELECT *, {_CLEAN.format("regexp_replace(regexp_replace(inner_html, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')")} AS text,
               sum(CASE WHEN tag = 'nav' THEN CASE WHEN close = '' THEN 1 ELSE -1 END ELSE 0 END) OVER w > 0 AS in_nav,
               sum(CASE WHEN tag = 'footer' THEN CASE WHEN close = '' THEN 1 ELSE -1 END ELSE 0 END) OVER w > 0 AS in_footer
        FROM tokens WINDOW w AS (PARTITION BY page_id ORDER BY n)
    ), blocks AS (
        SELECT page_id, host, row_number() OVER w AS block_no, text, inner_html,
               CASE WHEN close = '' AND tag = 'p' THEN 'paragraph' WHEN close = '' AND tag = 'li' THEN 'list_item' WHEN close = '' AND tag = 'h1' THEN 'heading' ELSE 'text' END AS kind,
               CASE WHEN in_nav THEN 'nav' WHEN in_footer THEN 'footer' ELSE 'body' END AS region,
               coalesce(last_value(CASE WHEN close = '' AND tag = 'h1' THEN text END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), '') AS heading_path
        FROM placed WHERE text <> '' WINDOW w AS (PARTITION BY page_id ORDER BY n)
    )"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.blocks(table(spark, sf_dir, "pages"), url="url")


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", I.host_of(F.col("url")).alias("host"))


@query(f"""
    WITH {_WALK}
    SELECT page_id, block_no, kind, (kind = 'heading')::INT AS level, heading_path, region,
           CASE WHEN region = 'nav' AND kind = 'list_item' AND inner_html LIKE '%<a %' THEN 'link-only,navigation' WHEN region = 'nav' THEN 'navigation' WHEN region = 'footer' THEN 'footer' ELSE '' END AS furniture,
           coalesce(sum(length(text) + 2) OVER (PARTITION BY page_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
           (sum(length(text) + 2) OVER (PARTITION BY page_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) - 2)::BIGINT AS "end", sha256(text) AS text_sha256
    FROM blocks
""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = R.with_offsets(_blocks(spark, sf_dir), "page_id", "block_no", "text")
    path, labels = F.array_join("heading_path", " > ").alias("heading_path"), F.array_join("furniture", ",").alias("furniture")
    return b.select("page_id", "block_no", "kind", "level", path, "region", labels, "start", "end", F.sha2("text", 256).alias("text_sha256"))


_SECTIONS = f"""{_WALK}, numbered AS (
        SELECT *, kind <> 'heading' AND region = 'body' AS span,
               sum(fresh) OVER (PARTITION BY page_id ORDER BY block_no) AS section
        FROM (SELECT *, CASE WHEN heading_path IS DISTINCT FROM lag(heading_path) OVER (PARTITION BY page_id ORDER BY block_no) THEN 1 ELSE 0 END AS fresh FROM blocks)
    ), sections AS (
        SELECT page_id, host, section, heading_path, min(block_no) AS first_block, max(block_no) AS last_block, coalesce(sum(length(text)) FILTER (span), 0)::BIGINT AS characters,
               CASE WHEN count(*) FILTER (span) > 0 THEN NULL WHEN count(*) FILTER (region <> 'body') > 0 THEN 'region' ELSE 'no_spans' END AS reason,
               coalesce(string_agg(lower(text), ' ' ORDER BY block_no) FILTER (span), '') AS text
        FROM numbered GROUP BY page_id, host, section, heading_path
    )"""


@query(f"WITH {_SECTIONS} SELECT page_id, section, heading_path, first_block, last_block, characters, reason, sha256(text) AS text_sha256 FROM sections")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.sections(_blocks(spark, sf_dir))
    return s.select("page_id", "section", F.array_join("heading_path", " > ").alias("heading_path"), "first_block", "last_block", "characters", "reason", F.sha2("text", 256).alias("text_sha256"))


@query(f"""
    WITH {_SECTIONS}, n AS (SELECT host, text, count(DISTINCT page_id) AS pages FROM sections WHERE reason IS NULL AND text <> '' GROUP BY host, text HAVING count(DISTINCT page_id) > 1)
    SELECT page_id, section, first_block, last_block, pages FROM sections JOIN n USING (host, text) WHERE reason IS NULL
""")
def repeated_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content sections that several pages of a host share, on every page that has them."""
    return S.repeated(S.sections(_blocks(spark, sf_dir)), _hosts(spark, sf_dir)).drop("heading_path")


@query(f"""
    WITH {_WALK}, links AS (SELECT page_id, host, unnest(regexp_extract_all(inner_html, '<a href="([^"]*)"', 1)) AS href FROM blocks)
    SELECT host, href, count(DISTINCT page_id) AS pages, count(*) AS links FROM links GROUP BY host, href
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of each host's pages, with the pages that have it."""
    links = _blocks(spark, sf_dir).select("page_id", F.explode("links.href").alias("href")).join(_hosts(spark, sf_dir), "page_id")
    return links.groupBy("host", "href").agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("links"))


@query(f"""
    WITH {_WALK}, h1 AS (SELECT page_id, string_agg(text, ' | ' ORDER BY block_no) AS main_headings FROM blocks WHERE kind = 'heading' AND region = 'body' GROUP BY page_id)
    SELECT page_id, {_CLEAN.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, coalesce(main_headings, '') AS main_headings,
           'ordinary_page' AS page_kind, true AS whole
    FROM pages LEFT JOIN h1 USING (page_id)
""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = html.page_facts(html.located(html.walked(table(spark, sf_dir, "pages"), url="url")))
    return facts.withColumn("main_headings", F.array_join("main_headings", " | "))


@query("""
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' ELSE 'utf-16' END AS encoding,
           CASE WHEN page_id % 3 = 2 THEN NULL ELSE nullif(regexp_extract(html, 'charset="?([A-Za-z0-9_-]+)', 1), '') END AS declared, 0 AS warnings, sha256(html) AS text_sha256
    FROM pages
""")
def page_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as bytes in three encodings, decoded again."""
    text = F.col("html")
    raw = F.when(F.col("page_id") % 3 == 0, text.cast("binary")).when(F.col("page_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), text.cast("binary"))).otherwise(F.encode(text, "UTF-16"))
    out = charsets.decoded(table(spark, sf_dir, "pages").select("page_id", raw.alias("raw")), "raw")
    return out.select("page_id", "encoding", F.col("declared_meta").alias("declared"), F.size("warnings").alias("warnings"), F.sha2("text", 256).alias("text_sha256"))
