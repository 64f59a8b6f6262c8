"""Vector arithmetic on array columns, in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has length zero or the sizes differ."""
    same_size = F.size(a) == F.size(b)
    return F.when(same_size, F.try_divide(dot(a, b), norm(a) * norm(b)))


def unit(vector: Column) -> Column:
    """Vector of length one; null for a zero vector and for one that is not all numbers."""

    def divided(length):
        return F.when((length > 0) & ~F.isnan(length), F.transform(as_double(vector), lambda x: x / length))

    # the length as the one element of an array: an expression inside a lambda would be computed per element
    return F.get(F.transform(F.array(norm(vector)), divided), F.lit(0))
