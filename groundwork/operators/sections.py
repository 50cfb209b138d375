"""Sections of pages: runs of blocks of one heading path, what of them is content, and which repeat on a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Headings below which a page says nothing of its subject.
FURNITURE_HEADINGS = (
    "kontakt", "contact", "contacts", "kontaktinformationen", "contact details", "zuständigkeit", "zuständiges amt", "suche", "search", "navigation",
    "inhaltsverzeichnis", "table of contents", "seite teilen", "share", "feedback", "war diese seite hilfreich?", "cookie-einstellungen", "auf dieser seite",
    "bitte geben sie uns feedback", "kontaktformular migrationsamt", "das könnte sie auch interessieren", "für dieses thema zuständig:", "breadcrumb", "seitenpfad (breadcrumb)",
)
FURNITURE_LABELS = (
    "navigation", "banner", "footer", "breadcrumb", "skiplinks", "share", "cookie-notice", "language-menu", "related-links", "anchor-navigation", "scroll-to-top", "chat-link",
)
NEWS_HEADINGS = ("news", "aktuell", "aktuelle meldungen", "neuigkeiten", "nachrichten")
LINK_HEADINGS = ("links", "weiterführende links", "weitere links", "related links", "useful links", "external links", "liens", "liens utiles", "collegamenti", "link")


def heading_key(heading: Column) -> Column:
    """A heading as lists of headings have it. Composed characters are assumed."""
    return F.lower(F.trim(heading))


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def block_exclusion(furniture: Column, region: Column, kind: Column, hidden: Column, footnote: Column) -> Column:
    """Why a block is no content, by the first rule that holds."""
    return (
        F.when(hidden, "hidden").when(region.isin("nav", "footer", "header", "form"), "region").when(F.arrays_overlap(furniture, F.array(*map(F.lit, FURNITURE_LABELS))), "furniture")
        .when(kind == "control", "control").when(F.arrays_overlap(furniture, F.array(F.lit("page-header"), F.lit("page-footer"))), "page-furniture").when(footnote, "footnote")
    )


def excluded(blocks: DataFrame, document: str = "page_id") -> DataFrame:
    """``blocks`` with ``reason``, null for content, and ``section``, the number of its run of equal heading paths.

    News below another heading, and furniture headings, exclude what is below them; the root of a longer path does
    not, and on a page whose only heading is that of a contact page it doesn't either.
    """
    w = Window.partitionBy(document).orderBy("block_no")
    keys = F.transform("heading_path", heading_key)
    rows = blocks.withColumns({"_keys": keys, "_new": (~F.col("heading_path").eqNullSafe(F.lag("heading_path").over(w))).cast("int")})
    all_ = Window.partitionBy(document)
    only = F.when(F.min(F.array_min("_keys")).over(all_) == F.max(F.array_max("_keys")).over(all_), F.max(F.array_max("_keys")).over(all_))
    rows = rows.withColumn("_contact", F.coalesce(only.isin("kontakt", "contact", "contacts"), F.lit(False)))
    n = F.size("_keys")
    below = F.slice("_keys", F.when(n > 1, 2).otherwise(1), F.greatest(n, F.lit(1)))
    news = F.arrays_overlap(F.slice("_keys", F.lit(2), F.greatest(n, F.lit(1))), F.array(*map(F.lit, NEWS_HEADINGS)))
    page = ~F.col("_contact") & F.arrays_overlap(below, F.array(*map(F.lit, FURNITURE_HEADINGS)))
    own = block_exclusion(F.col("furniture"), F.col("region"), F.col("kind"), F.col("hidden"), F.col("footnote"))
    section = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"reason": F.when(news, "embedded_news").when(page, "page_furniture_heading").otherwise(own), "section": section}).drop("_keys", "_new", "_contact")


def sections(blocks: DataFrame, document: str = "page_id") -> DataFrame:
    """document, section, heading_path, first_block, last_block, characters, reason (null for content), text.

    ``blocks``: as the HTML source gives them. A section is content when it keeps a block that is neither excluded nor
    a heading, and is not a bare list of links. ``text`` is what repetition compares: kept blocks, one space between
    words, lower case.
    """
    rows = excluded(blocks, document)
    span = F.col("reason").isNull() & (F.col("kind") != "heading") & (F.trim("text") != "")
    linked = _one_line(F.array_join(F.transform("links", lambda x: _one_line(x["text"])), " "))
    bare = (F.col("kind") == "list_item") & F.array_contains("furniture", "link-only")
    of_links = (F.size("links") > 0) & (_one_line(F.col("text")) == linked)
    texts = F.array_sort(F.collect_list(F.when(span, F.struct("block_no", F.lower(_one_line(F.col("text"))).alias("t")))))
    per = rows.groupBy(document, "section").agg(
        F.first("heading_path").alias("heading_path"), F.min("block_no").alias("first_block"), F.max("block_no").alias("last_block"), F.count_if(span).alias("spans"),
        F.coalesce(F.sum(F.when(span, F.length("text"))), F.lit(0)).cast("bigint").alias("characters"), F.count_if(span & ~bare).alias("_other"), F.count_if(span & ~of_links).alias("_unlinked"),
        F.min(F.when(F.col("reason").isNotNull(), F.struct("block_no", "reason"))).alias("_first"), F.array_join(F.transform(texts, lambda x: x["t"]), " ").alias("text"),
    )
    last = heading_key(F.get("heading_path", F.size("heading_path") - 1))
    links = (F.col("spans") > 0) & ((F.col("_other") == 0) | (F.coalesce(last.isin(*LINK_HEADINGS), F.lit(False)) & (F.col("_unlinked") == 0)))
    reason = F.when(F.col("spans") == 0, F.coalesce("_first.reason", F.lit("no_spans"))).when(links, "link_only")
    return per.select(document, "section", "heading_path", "first_block", "last_block", "characters", reason.alias("reason"), "text")


def repeated(sections_: DataFrame, hosts: DataFrame, document: str = "page_id") -> DataFrame:
    """document, section, heading_path, first_block, last_block, pages: content sections whose text stands on several
    pages of a host (``hosts``: document, host; its pages only). A text counts once per page."""
    kept = sections_.filter("reason is null and text <> ''").join(hosts, document).withColumn("_text", F.sha2("text", 256))
    n = kept.groupBy("host", "_text").agg(F.count_distinct(document).alias("pages")).filter("pages > 1")
    return kept.join(n, ["host", "_text"]).select(document, "section", "heading_path", "first_block", "last_block", "pages")


def counts(sections_: DataFrame, document: str = "page_id") -> DataFrame:
    """document, sections, content_sections, content_characters."""
    content = F.col("reason").isNull()
    return sections_.groupBy(document).agg(F.count("*").alias("sections"), F.count_if(content).alias("content_sections"), F.coalesce(F.sum(F.when(content, F.col("characters"))), F.lit(0)).cast("bigint").alias("content_characters"))
