"""Keys and encoder inputs."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def cache_key(prefix: Column, text: Column) -> Column:
    """First 16 hex digits of SHA-256 over ``prefix:text``."""
    return F.substring(F.sha2(F.concat(prefix, F.lit(":"), text), 256), 1, 16)


def record_id(source: Column, application_number: Column) -> Column:
    """Stable id, so that reading a page again meets the same row."""
    return F.sha2(F.concat(source, F.lit(":"), application_number), 256)


def prefixed(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix + ": "), text)


def encoder_text(name: Column, nice_classes: Column) -> Column:
    """``name | Class a, Class b`` with classes in ascending order; the name alone without classes."""
    listed = F.array_join(F.transform(F.array_sort(nice_classes), lambda c: F.concat(F.lit("Class "), c)), ", ")
    return F.when(F.coalesce(F.size(nice_classes), F.lit(0)) > 0, F.concat_ws(" | ", name, listed)).otherwise(name)
