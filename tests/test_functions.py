"""Text, name, key and vector functions against values worked out by hand."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emblema.constants import DEMO_BANDS, DETAIL_FIELDS
from emblema.functions import keys, names, text, vectors
from emblema.functions.numbers import rounded

NAMES = {
    "MarisTone": (0.4444, 0.0),
    "MarLux": (0.375, 0.0),
    "MarineLux": (0.5556, 0.0),
    "BrookLine": (0.1111, 0.0),
    "HelmCraft": (0.0, 0.7778),
    "TideMark": (0.0, 0.0),
    "LuxHarbour": (0.0, 0.1),
    "OpalMar": (0.0, 0.0),
    "QuartzSea": (0.0, 0.0),
    "HelmCrest": (0.0, 1.0),
    "IronVale": (0.0, 0.0),
    "MarelleLux": (0.4, 0.1),
}


def test_sound_similarity_of_sample_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], ["n"])
    got = df.select(
        "n",
        rounded(names.name_similarity(F.lit("MarinLux"), F.col("n"))),
        rounded(names.name_similarity(F.lit("HelmCrest"), F.col("n"))),
    ).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == NAMES


@pytest.mark.parametrize(
    "a, b, expected",
    [("Straße", "strasse", 1.0), ("Ä", "ae", 1.0), ("É-l", "el", 1.0), ("---", "x", 0.0), ("", "x", 0.0), ("", "--", 1.0)],
)
def test_sound_similarity_edges(evaluate, a, b, expected):
    assert evaluate({"a": a, "b": b}, names.name_similarity(F.col("a"), F.col("b"))) == expected


def plain_sound(a: str, b: str) -> float:
    if a == b:
        return 1.0
    return sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b))


@settings(max_examples=5, deadline=None)
@given(pairs=st.lists(st.tuples(st.text("abcxyz019", max_size=12), st.text("abcxyz019", max_size=12)), min_size=20, max_size=40))
def test_sound_similarity_properties(spark, pairs):
    df = spark.createDataFrame(pairs, ["a", "b"])
    ab, ba = names.sound_similarity(F.col("a"), F.col("b")), names.sound_similarity(F.col("b"), F.col("a"))
    for (a, b), row in zip(pairs, df.select(ab, ba).collect(), strict=True):
        assert row[0] == row[1] and 0.0 <= row[0] <= 1.0
        assert math.isclose(row[0], plain_sound(a, b))


def test_letter_similarity(evaluate):
    assert evaluate({"a": "moor", "b": "meor"}, names.letter_similarity(F.col("a"), F.col("b"))) == 0.75


def test_bands(spark):
    df = spark.createDataFrame([(0.81,), (0.80,), (0.66,), (0.65,), (0.85,), (0.86,), (0.6,)], ["s"])
    rows = df.select(names.band(F.col("s")), names.band(F.col("s"), DEMO_BANDS, ("high", "medium", "low"))).collect()
    assert [r[0] for r in rows] == ["HIGH", "MEDIUM", "MEDIUM", "LOW", "HIGH", "HIGH", "LOW"]
    assert [r[1] for r in rows] == ["medium", "medium", "medium", "medium", "medium", "high", "low"]


def test_name_checks(evaluate):
    assert evaluate({"n": "FastEcoRind"}, names.descriptive_terms(F.col("n"))) == ["eco", "fast"]
    assert evaluate({"n": "HelmCrest"}, names.descriptive_terms(F.col("n"))) == []
    assert evaluate({"n": "Abc"}, names.is_short(F.col("n"))) is True


@pytest.mark.parametrize(
    "wording, status",
    [
        ("Registered", "registered"),
        ("Application published", "application"),
        (" Surrendered ", "surrendered"),
        ("Filed", "application"),
        ("?", "application"),
        ("Registration pending", "registered"),
        ("unregistered", "registered"),
        ("Mark opposed", "opposed"),
    ],
)
def test_status(evaluate, wording, status):
    assert evaluate({"s": wording}, text.status_from_wording(F.col("s"))) == status


@pytest.mark.parametrize(
    "raw, iso",
    [("20/04/2026", "2026-04-20"), ("31-02-2026", "2026-02-31"), ("1/2/2026", "2026-02-01"), ("", None), ("2026", None)],
)
def test_dates(evaluate, raw, iso):
    assert evaluate({"d": raw}, text.iso_date(F.col("d"))) == iso


def test_calendar_date(evaluate):
    assert evaluate({"d": "2026-02-31"}, text.calendar_date(F.col("d"))) is None
    assert str(evaluate({"d": "2026-04-20"}, text.calendar_date(F.col("d")))) == "2026-04-20"


def test_nice_list_keeps_order_and_repeats(evaluate):
    assert evaluate({"c": "9, 35, 42, 46, 0, 9, 99999999999"}, text.nice_list(F.col("c"))) == [9, 35, 42, 9]


def test_strip_removes_all_unicode_space(evaluate):
    assert evaluate({"t": "\t  x y  \n"}, text.strip(F.col("t"))) == "x y"
    assert evaluate({"t": " \t"}, text.has_text(F.col("t"))) is False


def test_fields(evaluate):
    page = "mark NAME:  Çelik\x85Bar \nNice classes 9; 35\nReg. No: ٣٤\n"
    assert evaluate({"t": page}, text.field(F.col("t"), DETAIL_FIELDS["mark_name"])) == "Çelik\x85Bar"
    assert evaluate({"t": page}, text.field(F.col("t"), DETAIL_FIELDS["nice_classes"])) == "9; 35"
    assert evaluate({"t": page}, text.field(F.col("t"), DETAIL_FIELDS["registration_number"])) == "٣٤"
    assert evaluate({"t": page}, text.field(F.col("t"), r"Absent: (.+)", "none")) == "none"
    assert evaluate({"t": "Class 9: a; class 35:  ; Class 1: b"}, text.field_list(F.col("t"), r"class \d+:([^;]*)")) == ["a", "b"]


def test_absolute_url(evaluate):
    url = text.absolute_url(F.col("u"), "https://h.example")
    assert evaluate({"u": "/a"}, url) == "https://h.example/a"
    assert evaluate({"u": "http://b.example/c"}, url) == "http://b.example/c"


def test_keys(evaluate):
    assert evaluate({"t": "Murmeltier"}, keys.cache_key(F.lit("passage"), F.col("t"))) == "8b1fdbc6183d17eb"
    schema = "n string, c array<int>"
    built = keys.encoder_text(F.col("n"), F.col("c"))
    assert evaluate({"n": "Murmeltier", "c": [28, 7]}, built, schema=schema) == "Murmeltier | Class 7, Class 28"
    assert evaluate({"n": "Murmeltier", "c": []}, built, schema=schema) == "Murmeltier"
    assert evaluate({"n": "Murmeltier", "c": None}, built, schema=schema) == "Murmeltier"
    assert evaluate({"t": "x"}, keys.prefixed("query", F.col("t"))) == "query: x"


def test_vectors(evaluate):
    schema = "a array<float>, b array<float>"
    a, b = F.col("a"), F.col("b")
    assert evaluate({"a": [1.0, 2.0], "b": [3.0, 4.0]}, vectors.dot(a, b), schema=schema) == 11.0
    assert evaluate({"a": [3.0, 4.0], "b": [0.0, 0.0]}, vectors.cosine(a, b), schema=schema) is None
    assert evaluate({"a": [3.0, 4.0], "b": [3.0]}, vectors.cosine(a, b), schema=schema) is None
    assert evaluate({"a": [3.0, 4.0], "b": [6.0, 8.0]}, vectors.cosine(a, b), schema=schema) == 1.0
    assert evaluate({"a": [3.0, 4.0], "b": [0.0]}, vectors.unit(a), schema=schema) == [0.6, 0.8]
    assert evaluate({"a": [3.0, 4.0], "b": [0.0]}, vectors.unit(b), schema=schema) is None


def test_rounding_is_half_away_from_zero(spark):
    df = spark.createDataFrame([(0.00005,), (-0.00005,), (0.12344999,), (None,)], "x double")
    assert [r[0] for r in df.select(rounded(F.col("x"))).collect()] == [0.0001, -0.0001, 0.1234, None]
