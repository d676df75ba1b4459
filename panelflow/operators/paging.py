"""Page-numbered text listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelflow.functions.text import strip
from panelflow.operators.sized import written
from panelflow.presets import PAGE_PLACEHOLDER, PAGE_TITLE



def with_position(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """``position`` of each page in its document, from 1, and the document's ``pages``.

    Pages are dealt by ranges of (document, page).  Each range numbers its own pages and starts
    from the pages of the same document in the ranges before, so a document of any length is split over tasks.  Pages of
    one number go in the order of their range.
    """
    dealt = written(pages.repartitionByRange(doc, page).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(doc, "_range").agg(F.count(F.lit(1)).alias("_here"))
    earlier = Window.partitionBy(doc).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        doc,
        "_range",
        F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_here").over(Window.partitionBy(doc)).alias("pages"),
    )
    own = F.row_number().over(Window.partitionBy(doc, "_range").orderBy(page))
    numbered = dealt.withColumn("_own", own)
    side = written(starts).withColumnsRenamed({doc: "_doc", "_range": "_at"})
    joined = numbered.join(side, F.col(doc).eqNullSafe(F.col("_doc")) & (F.col("_range") == F.col("_at")))
    return joined.withColumn("position", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before", "_doc", "_at")


def page_blocks(pages: DataFrame, doc: str, page: str, text: str, placeholder: str = PAGE_PLACEHOLDER) -> DataFrame:
    """One block per page: a header with the page's position, then the trimmed text or a placeholder."""
    placed = with_position(pages.select(doc, page, text), doc, page)
    body = F.coalesce(F.nullif(strip(text), F.lit("")), F.lit(placeholder))
    header = F.concat(F.lit("## --- SLIDE "), F.col("position").cast("string"), F.lit(" / "), F.col("pages").cast("string"), F.lit(" ---"))
    return placed.select(
        doc, F.col("position").alias("page_no"), "pages", F.concat(header, F.lit("\n\n"), body, F.lit("\n")).alias("block")
    )


def assemble_pages(
    pages: DataFrame, doc: str, page: str, text: str, placeholder: str = PAGE_PLACEHOLDER, title: str = PAGE_TITLE
) -> DataFrame:
    """The listing of each document as ordered rows (doc, page_no, pages, block).

    Pages are numbered by position, whatever their own numbers are.  The title stands before the
    first page.  A document's blocks in order, one per line break, are its listing; the sink joins them.
    """
    blocks = page_blocks(pages, doc, page, text, placeholder)
    first = F.concat(F.lit(title + "\n\n"), "block")
    return blocks.withColumn("block", F.when(F.col("page_no") == 1, first).otherwise(F.col("block")))
