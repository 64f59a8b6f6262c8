"""Office-action letters: Markdown layout, header fields and references to the law."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    CITING_PATTERN,
    DECISION_PATTERN,
    GUIDELINE_PATTERN,
    HEADING_MAX_CHARS,
    HEADING_STARTS,
    OBJECTION_PATTERN,
    REFERENCE,
)
from .text import strip

_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def capitalised(text: Column) -> Column:
    """Upper case after anything that is not a cased letter, lower case otherwise: also after an apostrophe."""
    pieces = F.split(F.lower(text), rf"(?<=[^{_CASED}])(?=[{_CASED}])")
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), ""
    )


def is_heading(line: Column) -> Column:
    return line.rlike(r"\p{Lu}") & ~line.rlike(r"[\p{Ll}\p{Lt}]") & (F.length(line) < HEADING_MAX_CHARS)


def format_line(text: Column) -> Column:
    """Markdown of a stripped line."""
    legal = None
    for start in HEADING_STARTS:
        legal = text.startswith(start) if legal is None else legal | text.startswith(start)
    return (
        F.when(is_heading(text), F.concat(F.lit("## "), capitalised(text)))
        .when(legal, F.concat(F.lit("**"), text, F.lit("**")))
        .otherwise(text)
    )


def format_letter(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), strip)
    return F.array_join(F.transform(lines, format_line), "\n")


def article_references(text: Column) -> Column:
    """Distinct articles referred to, such as ``7(1)(b)`` or ``94(1)``, without blanks, in order of first mention."""
    mentions = F.regexp_extract_all(text, F.lit(CITING_PATTERN), 0)
    each = F.flatten(F.transform(mentions, lambda m: F.regexp_extract_all(m, F.lit(REFERENCE), 0)))
    return F.array_distinct(F.transform(each, lambda r: F.regexp_replace(r, r"\s", "")))


def objection_codes(text: Column) -> Column:
    """Distinct objections under Articles 7 and 8, such as ``7(1)(b)``, in order of first mention."""
    return F.filter(article_references(text), lambda r: r.rlike(OBJECTION_PATTERN))


def article_numbers(text: Column) -> Column:
    return F.array_sort(
        F.array_distinct(
            F.transform(article_references(text), lambda r: F.regexp_extract(r, r"^\d+", 0).try_cast("int"))
        )
    )


def guideline_sections(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(GUIDELINE_PATTERN), 1)))


def decisions(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(DECISION_PATTERN), 1)))


def citations(text: Column) -> Column:
    """Distinct cited articles, guideline sections and appeal decisions, sorted."""
    articles = F.transform(article_references(text), lambda code: F.concat(F.lit("Article "), code))
    return F.array_sort(F.array_distinct(F.concat(articles, guideline_sections(text), decisions(text))))
