"""Article numbers of laws from their heading paths, where footnote numbers are glued to them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How headings name articles and annexes.
ARTICLE, ANNEX = r"^Art\.\s*(\d+)([a-z]{0,3})\b", r"^Anhang\s+([IVXLC]+)"


def number_after(digits: str, previous: int, suffix: str) -> int:
    """The shortest prefix of ``digits`` that goes on from ``previous``; a suffixed article may repeat it."""
    for k in range(1, len(digits) + 1):
        n = int(digits[:k])
        if n > previous or suffix and n >= previous:
            return n
    return int(digits)


def with_articles(blocks: DataFrame, document: str = "page_id", order: str = "block_no") -> DataFrame:
    """``blocks`` (with heading_path) and ``annex`` and ``article``, null outside of one.

    Numbers go up within a document and start again in each annex, so they are read in order; only the places where the
    heading or the annex changes are, one row for each heading of a document, and blocks take the last one before them.
    """
    w = Window.partitionBy(document).orderBy(order)
    heads = F.filter("heading_path", lambda h: h.rlike(ARTICLE))
    annexes = F.filter(F.transform("heading_path", lambda h: F.regexp_extract(h, ANNEX, 1)), lambda a: a != "")
    rows = blocks.withColumns({"_head": F.get(heads, F.size(heads) - 1), "annex": F.get(annexes, F.lit(0))})
    changed = (F.row_number().over(w) == 1) | ~F.col("_head").eqNullSafe(F.lag("_head").over(w)) | ~F.col("annex").eqNullSafe(F.lag("annex").over(w))
    rows = rows.withColumn("_new", changed.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    events = rows.filter("_new = 1").select(F.col(document).alias("_document"), "_run", "annex", F.regexp_extract("_head", ARTICLE, 1).alias("digits"), F.regexp_extract("_head", ARTICLE, 2).alias("suffix"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, scope, previous = object(), None, 0  # handed on from batch to batch: a document's rows are in order
        for b in batches:
            out = []
            for of, annex, digits, suffix in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_document", "annex", "digits", "suffix"))):
                if of != last or annex != scope:
                    last, scope, previous = of, annex, 0
                if digits:
                    previous = number_after(digits, previous, suffix)
                out.append(f"Art. {previous}{suffix}" if digits else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["_document", "_run", "article"])

    kind = dict(blocks.dtypes)[document]
    ordered = events.repartition("_document").sortWithinPartitions("_document", "_run")
    numbered = ordered.mapInArrow(read, f"_document {kind}, _run bigint, article string")
    both = (F.col(document) == F.col("_document")) & (rows["_run"] == numbered["_run"])
    return rows.join(numbered, both, "left").select(*blocks.columns, "annex", "article")
