"""Arrays to rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each_element(df: DataFrame, keep, array: Column, name: str, position: str = "position") -> DataFrame:
    """A row per element of a computed array, with its position from 0.

    The outer form is used because for the plain one the optimizer adds a filter on the array's size further down,
    and that filter computes the array a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, name)).where(F.col(position).isNotNull())
    return rows.withColumn(position, F.col(position).cast("bigint"))
