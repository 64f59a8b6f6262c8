"""The register as a Parquet table: open, create, append, and the base-plus-changes layout that upserts use.

Parquet has no merge. An upsert is therefore written as a change batch of its own folder, and the current register is
computed from base and changes when read; ``compact`` writes a new base. Nothing is overwritten while it is read, and
writing a batch again under its number gives the same state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.upsert import KEY, last_per_key
from ..schema import REGISTER, conform

BATCH = "batch_id"


def open_register(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTER).parquet(path)


def create_register(spark: SparkSession, path: str) -> DataFrame:
    """Opens the table, creating an empty one if there is none."""
    spark.createDataFrame([], REGISTER).write.mode("ignore").parquet(path)
    return open_register(spark, path)


def append_records(records: DataFrame, path: str) -> None:
    conform(records).write.mode("append").parquet(path)


def write_changes(records: DataFrame, path: str, batch_id: int) -> None:
    """Stores a batch of new and changed rows under its number; the same number again replaces it."""
    conform(records).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*REGISTER.fields, T.StructField(BATCH, T.LongType())])
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def current_register(
    base: DataFrame, changes: DataFrame, key: str = KEY, order: Sequence[str] = (BATCH, "scraped_at")
) -> DataFrame:
    """Base rows whose key has not changed, plus the latest change per key: later batch first, then later scrape."""
    latest = last_per_key(changes, key, order).select(*base.columns)
    return base.join(changes.select(key).distinct(), key, "left_anti").select(*base.columns).unionByName(latest)


def index_numbers(register: DataFrame, path: str, buckets: int, key: str = KEY) -> None:
    """Stores the register's numbers by bucket, so that a batch looks into the buckets of its own numbers only. Built once
    for each version of the register."""
    numbers = register.select(key).where(F.col(key).isNotNull()).withColumn("bucket", _bucket(key, buckets))
    numbers.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/numbers")
    register.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/size")


def known_numbers(spark: SparkSession, path: str, numbers: DataFrame, key: str = KEY) -> DataFrame:
    """Those of ``numbers`` that the index holds. Reads the buckets they fall into."""
    size = spark.read.parquet(f"{path}/size").first()["buckets"]
    asked = numbers.select(key).distinct().withColumn("bucket", _bucket(key, size))
    touched = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most the number of buckets
    held = spark.read.schema(f"{key} string, bucket int").parquet(f"{path}/numbers").where(F.col("bucket").isin(touched))
    return asked.join(held, [key, "bucket"], "left_semi").select(key)


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def compact(spark: SparkSession, base_path: str, changes_path: str, new_base_path: str, key: str = KEY) -> DataFrame:
    """Writes base and changes as a new base in a folder of its own and opens it."""
    merged = current_register(open_register(spark, base_path), read_changes(spark, changes_path), key)
    merged.select(*REGISTER.fieldNames()).write.mode("errorifexists").parquet(new_base_path)
    return open_register(spark, new_base_path)


def save_bucketed(register: DataFrame, name: str, buckets: int, key: str = KEY) -> None:
    """Saves the register as a table bucketed and sorted by key. An upsert or compaction of it then shuffles the
    changes only; the wide base rows stay where they are. Use at least as many buckets as shuffle partitions."""
    register.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def add_typed_dates(register: DataFrame) -> DataFrame:
    """Beside each ISO text date, its calendar date; null where the text names no day."""
    names = ("filing_date", "priority_date", "registration_date", "expiry_date")
    return register.withColumns({n.replace("_date", "_day"): F.try_to_date(F.col(n), "yyyy-MM-dd") for n in names})
