"""Counts over the register."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_distribution(register: DataFrame) -> DataFrame:
    """Rows per status, nulls left out."""
    return register.where(F.col("status").isNotNull()).groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def register_stats(register: DataFrame) -> DataFrame:
    """Rows per status beside the row count of the whole register, in one pass."""
    by_status = register.groupBy("status").agg(F.count(F.lit(1)).alias("count"))
    # at most one row per status by now, so the sum over all of them is small
    total = F.sum("count").over(_everything())
    return by_status.select("status", "count", total.alias("total_records")).where(F.col("status").isNotNull())


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def class_listing(register: DataFrame) -> DataFrame:
    """Registered marks by class, one row per class and mark. A class can hold a large part of the register, so
    its names are rows, not one list."""
    return register.where(F.col("status") == "registered").select(
        F.explode(F.array_distinct("nice_classes")).alias("nice_class"), "application_number", "mark_name"
    )


def class_counts(register: DataFrame) -> DataFrame:
    return class_listing(register).groupBy("nice_class").agg(F.count(F.lit(1)).alias("registered_marks"))
