"""Filters on the register. A value left empty switches its filter off; the others are joined by AND."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import without_vectors


def has_all_classes(classes: Sequence[int], column: str = "nice_classes") -> Column:
    return reduce(Column.__and__, [F.array_contains(column, F.lit(int(c))) for c in classes])


def has_any_class(classes: Sequence[int], column: str = "nice_classes") -> Column:
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(int(c)) for c in classes]))


def contains_list(classes: Sequence[int], column: str = "nice_classes") -> Column:
    return F.size(F.array_except(F.array(*[F.lit(int(c)) for c in classes]), F.col(column))) == 0


def name_like(text: str, literal: bool = False, column: str = "mark_name") -> Column:
    """Substring match, case counts. Percent and underscore are wildcards unless ``literal``."""
    if literal:
        return F.contains(F.col(column), F.lit(text))
    escaped = text.replace("\\", "\\\\")  # a backslash stands for itself
    return F.col(column).like(f"%{escaped}%")


def register_condition(
    *,
    query_text: str = "",
    nice_classes: Sequence[int] = (),
    any_classes: Sequence[int] = (),
    status: str = "",
    statuses: Sequence[str] = (),
    country: str = "",
    filing_date_after: str = "",
    literal: bool = False,
) -> Column | None:
    """Conjunction of the filters that are switched on, or None. Dates compare as ISO text."""
    parts = []
    if nice_classes:
        parts.append(has_all_classes(nice_classes))
    if any_classes:
        parts.append(has_any_class(any_classes))
    if status:
        parts.append(F.col("status") == status)
    if statuses:
        parts.append(F.col("status").isin(*statuses))
    if country:
        parts.append(F.col("applicant_country") == country)
    if filing_date_after:
        parts.append(F.col("filing_date") >= filing_date_after)
    if query_text:
        parts.append(name_like(query_text, literal))
    return reduce(Column.__and__, parts) if parts else None


def filter_register(register: DataFrame, limit: int | None = None, **filters) -> DataFrame:
    """Filtered rows without vectors; with ``limit``, the first by application number and id."""
    condition = register_condition(**filters)
    return first_rows(without_vectors(register if condition is None else register.where(condition)), limit)


def first_rows(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.orderBy("application_number", "id").limit(limit)


def where_clause(register: DataFrame, clause: str, limit: int | None = None) -> DataFrame:
    """Rows that satisfy a condition written in SQL. The only place that takes one: use trusted text."""
    return first_rows(without_vectors(register.where(F.expr(clause))), limit)


def by_application_number(register: DataFrame, number: str) -> DataFrame:
    """The row with this number, or no row."""
    return first_rows(without_vectors(register.where(F.col("application_number") == number)), 1)
