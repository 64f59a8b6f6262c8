"""Text helpers: stripping, labelled fields, dates, classes, statuses. Column in, Column out."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import NICE_MAX, NICE_MIN, STATUS_WORDING

# Whitespace as Unicode defines it, plus the four separator controls.
_SPACE = r"[\s\x1c-\x1f]"
_EDGES = rf"(?U)^{_SPACE}+|{_SPACE}+$"

# Case-blind in all scripts, Unicode classes, ^ and $ at lines, and only \n ends a line.
FIELD_FLAGS = "(?iuUmd)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def has_text(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def field(text: Column, pattern: str, default: str = "") -> Column:
    """Group 1 of the first match, stripped; ``default`` where the pattern is not found."""
    found = strip(F.regexp_extract(text, FIELD_FLAGS + pattern, 1))
    if default == "":
        return found
    return F.when(text.rlike(FIELD_FLAGS + pattern), found).otherwise(F.lit(default))


def field_list(text: Column, pattern: str) -> Column:
    """Group 1 of every match, stripped, empties left out, order kept."""
    every = F.regexp_extract_all(text, F.lit("(?iuUd)" + pattern), 1)
    return F.filter(F.transform(every, strip), lambda value: value != "")


def split_list(text: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(text, separator), strip), lambda value: value != "")


def _two_digits(text: Column) -> Column:
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def iso_date(text: Column) -> Column:
    """DD/MM/YYYY or DD-MM-YYYY to YYYY-MM-DD by position only; no calendar check."""
    parts = F.split(F.replace(text, F.lit("-"), F.lit("/")), "/")
    rebuilt = F.concat_ws(
        "-", F.get(parts, F.lit(2)), _two_digits(F.get(parts, F.lit(1))), _two_digits(F.get(parts, F.lit(0)))
    )
    return F.when((text != "") & (F.size(parts) == 3), rebuilt)


def calendar_date(iso: Column) -> Column:
    """Typed date; null where the text names no day of the calendar."""
    return F.try_to_date(iso, "yyyy-MM-dd")


def nice_list(text: Column) -> Column:
    """All whole numbers in the text that are Nice classes; order and repeats kept."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda n: n.try_cast("int"))
    return valid_classes(numbers)


def valid_classes(numbers: Column) -> Column:
    return F.filter(numbers, lambda n: n.between(NICE_MIN, NICE_MAX))


def status_from_wording(text: Column) -> Column:
    wording = F.lower(strip(text))
    result = None
    for needle, status in STATUS_WORDING:
        hit = F.contains(wording, F.lit(needle))
        result = F.when(hit, status) if result is None else result.when(hit, status)
    return result.otherwise("application")


def absolute_url(href: Column, base: str) -> Column:
    return F.when(href.startswith("http") | (href == ""), href).otherwise(F.concat(F.lit(base), href))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)
