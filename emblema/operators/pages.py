"""Joining the pages of a letter back into one text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text


def page_block(page_no: Column, text: Column) -> Column:
    return F.concat(F.lit("## Page "), page_no.cast("string"), F.lit("\n\n"), text)


def stitch_pages(
    pages: DataFrame,
    doc_id: str = "doc_id",
    page_no: str = "page_no",
    text: str = "text",
    pages_per_part: int | None = None,
) -> DataFrame:
    """One text per document: ``## Page N``, blank line, text; blank pages left out, numbers kept.

    With ``pages_per_part`` a document comes as several rows, ``part`` 0, 1, ...: no row and no group holds more than
    that many page numbers. Parts joined by a blank line are the whole text. Use it where a text outgrows one row.
    """
    page = F.col(page_no)
    blocks = pages.where(has_text(F.col(text))).select(
        F.col(doc_id),
        (F.lit(0) if pages_per_part is None else F.floor(page / pages_per_part)).cast("bigint").alias("part"),
        page.alias("page"),
        page_block(page, F.col(text)).alias("block"),
    )
    grouped = blocks.groupBy(doc_id, "part").agg(F.array_sort(F.collect_list(F.struct("page", "block"))).alias("b"))
    return grouped.select(
        doc_id, "part", F.array_join(F.col("b.block"), "\n\n").alias("text"), F.size("b").cast("bigint").alias("pages")
    )
