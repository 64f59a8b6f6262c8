"""What several operators of this folder share: tables, word counts, sums over Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fold(doc_id: Column, parts: int) -> Column:
    """Remainder of the CRC-32 of the id as text: which fold a labelled row belongs to. Null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns; further columns, whatever they are called, are left aside."""
    return docs.select(*[F.col(f"`{name}`") for name in names])
