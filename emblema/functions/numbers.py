"""One rounding rule for all scores."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int = 4) -> Column:
    """Halves away from zero by plain arithmetic, as tasks round scores and other engines round doubles."""
    scale = F.lit(10.0**digits)
    return F.sign(value) * F.floor(F.abs(value) * scale + 0.5) / scale
