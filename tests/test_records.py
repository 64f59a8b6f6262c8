"""Filters, upserts, the register table, ingest."""

import uuid

import pytest
from pyspark.sql import functions as F

from emblema.operators import filters, upsert
from emblema.plans import ingest, search, stats
from emblema.schema import REGISTER, conform, domain_violation
from emblema.session import fresh_path
from emblema.sources import register as table


@pytest.fixture(scope="module")
def marks(spark):
    rows = [
        ("1", "001", "Kornblume", [16, 25], "AT", "2019-07-09", "registered", [1.0, 0.0]),
        ("2", "002", "Kornhaus", [16, 30], "PT", "2018-02-28", "registered", [0.9, 0.1]),
        ("3", "003", "50%_Off", [41], "PT", None, "application", None),
        ("4", "004", "Weidenrose", [16, 25, 41], "FI", "2011-05-05", "published", [0.0, 1.0]),
    ]
    schema = "id string, application_number string, mark_name string, nice_classes array<int>, applicant_country string, filing_date string, status string, text_vector array<float>"
    return conform(spark.createDataFrame(rows, schema))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_filters(marks):
    assert ids(filters.filter_register(marks, nice_classes=[16, 25])) == ["1", "4"]
    assert ids(filters.filter_register(marks, any_classes=[30, 41])) == ["2", "3", "4"]
    assert ids(marks.where(filters.contains_list([16, 41]))) == ["4"]
    assert ids(filters.filter_register(marks, status="registered", country="PT")) == ["2"]
    assert ids(filters.filter_register(marks, filing_date_after="2018-02-28")) == ["1", "2"]
    assert ids(filters.filter_register(marks, query_text="Korn")) == ["1", "2"]
    assert ids(filters.filter_register(marks, query_text="korn")) == []
    assert ids(filters.filter_register(marks, query_text="_")) == ["1", "2", "3", "4"]
    assert ids(filters.filter_register(marks, query_text="%_", literal=True)) == ["3"]
    assert ids(filters.filter_register(marks, statuses=["published", "application"])) == ["3", "4"]
    assert ids(filters.filter_register(marks, limit=2)) == ["1", "2"]
    assert ids(filters.where_clause(marks, "mark_name LIKE 'K%' AND size(nice_classes) = 2", 1)) == ["1"]
    assert ids(filters.by_application_number(marks, "004")) == ["4"]
    assert ids(filters.by_application_number(marks, "4' OR '1'='1")) == []
    assert not {"text_vector", "image_vector"} & set(filters.filter_register(marks).columns)


def test_json_edge(marks):
    text = search.as_json(marks.where("id = '3'")).first()["json"]
    assert '"mark_name":"50%_Off"' in text and "vector" not in text


def test_stats(marks):
    rows = {r["status"]: (r["count"], r["total_records"]) for r in stats.register_stats(marks).collect()}
    assert rows == {"registered": (2, 4), "application": (1, 4), "published": (1, 4)}
    listed = {(r["nice_class"], r["mark_name"]) for r in stats.class_listing(marks).collect()}
    assert listed == {(16, "Kornblume"), (25, "Kornblume"), (16, "Kornhaus"), (30, "Kornhaus")}


def test_conform_fills_defaults(spark):
    row = conform(spark.createDataFrame([("7", "x")], ["application_number", "mark_name"])).first()
    assert row["mark_type"] == "word" and row["status"] == "application" and row["jurisdiction"] == "EU"
    assert row["languages"] == ["en"] and row["nice_classes"] == [] and row["text_vector"] is None
    assert conform(spark.createDataFrame([("7",)], ["id"])).schema.names == REGISTER.names


def test_domains(spark):
    rows = [("1", "a", "word", "surrendered"), ("1", "a", "smell", "expired"), ("1", "a", "word", "lost"), ("", "a", "word", "expired"), ("1", "", "word", "expired")]
    df = spark.createDataFrame(rows, ["application_number", "mark_name", "mark_type", "status"])
    assert [r[0] for r in df.select(domain_violation()).collect()] == [
        None, "unknown mark_type", "unknown status", "missing application_number", "missing mark_name",
    ]


def as_set(df):
    return {(r["application_number"], r["mark_name"], r["scraped_at"]) for r in df.collect()}


def test_upsert_takes_the_last_and_is_idempotent(spark):
    base = spark.createDataFrame([("1", "a", "t0"), ("2", "b", "t0")], ["application_number", "mark_name", "scraped_at"])
    copies = [("2", f"b{i}", f"t{i:04d}") for i in range(1, 500)]  # one key holds most of the batch
    fresh = spark.createDataFrame([*copies, ("3", "c", "t1"), ("3", "c0", None)], base.columns)
    once = upsert.upsert(base, fresh)
    assert as_set(once) == {("1", "a", "t0"), ("2", "b499", "t0499"), ("3", "c", "t1")}
    assert as_set(upsert.upsert(once, fresh)) == as_set(once)
    assert as_set(upsert.delete_keys(once, fresh.where("mark_name = 'c'"))) == {("1", "a", "t0"), ("2", "b499", "t0499")}
    assert as_set(upsert.delete_where(once, F.col("mark_name") == "a")) == as_set(once.where("mark_name <> 'a'"))


def test_copies_of_a_key_are_limited_before_the_shuffle(spark):
    rows = spark.range(100).selectExpr("CAST(id % 3 AS STRING) AS application_number", "CAST(id AS STRING) AS scraped_at")
    plan = upsert.last_per_key(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit", plan.index("Exchange")) > 0


def test_register_table(spark):
    path, changes = fresh_path(spark, "register"), fresh_path(spark, "changes")
    assert table.create_register(spark, path).count() == 0
    assert table.create_register(spark, path).count() == 0

    def records(*rows):
        return spark.createDataFrame(list(rows), ["id", "application_number", "mark_name", "scraped_at"])

    table.append_records(records(("1", "1", "a", "t0"), ("2", "2", "b", "t0")), path)
    table.write_changes(records(("2", "2", "b2", "t9"), ("3", "3", "c", "t1")), changes, 0)
    table.write_changes(records(("2", "2", "b3", "t1")), changes, 1)
    table.write_changes(records(("2", "2", "b3", "t1")), changes, 1)  # tried again
    now = table.current_register(table.open_register(spark, path), table.read_changes(spark, changes))
    expected = {("1", "a", "t0"), ("2", "b3", "t1"), ("3", "c", "t1")}
    assert as_set(now) == expected
    merged = table.compact(spark, path, changes, fresh_path(spark, "register"))
    assert as_set(merged) == expected and merged.schema.names == REGISTER.names


def test_bucketed_base_is_not_shuffled(spark):
    rows = spark.range(50).selectExpr("CAST(id AS STRING) AS application_number", "'m' AS mark_name", "'t' AS scraped_at")
    name = f"bucketed_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{fresh_path(spark, 'db')}'")
    table.save_bucketed(rows, f"{name}.register", 8)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = upsert.upsert(spark.table(f"{name}.register"), rows.where("application_number < '2'"))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        base_side = plan[plan.index("LeftAnti") : plan.index("FileScan")]
        assert "Exchange" not in base_side and "Bucketed: true" in plan
        assert kept.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_typed_dates(marks):
    rows = {r["id"]: r["filing_day"] for r in table.add_typed_dates(marks).collect()}
    assert str(rows["1"]) == "2019-07-09" and rows["3"] is None


BOLD = """# Trade mark details
**Application number:** 004418020
**Mark name:** Murmeltier
Status: Surrendered
**Nice classes:** 3, 46, 28, 31
Services: Toys; ; Seeds
Country: cz
**Filing date:** 03/11/2019
"""
PLAIN = "Trade mark: Hexerei\nApp. No.: 8803115\nReg No: 77\nRegistration date: 01/02/2020\nProprietor: Besen OY\nOrigin: EE\n"


def test_detail_pages(spark):
    pages = spark.createDataFrame([("u1", BOLD), ("u2", PLAIN), ("u3", "Mark: Lost\n"), ("u4", "")], ["url", "markdown"])
    parsed = ingest.parse_detail_pages(pages, scraped_at="2026-01-01T00:00:00")
    good = {r["raw_url"]: r for r in ingest.accepted(parsed).collect()}
    one, two = good["u1"], good["u2"]
    assert (one["mark_name"], one["application_number"], one["filing_date"]) == ("Murmeltier", "004418020", "2019-11-03")
    assert (one["nice_classes"], one["goods_services"]) == ([3, 28, 31], ["Toys", "Seeds"])
    assert (one["status"], one["applicant_country"], one["registration_number"]) == ("surrendered", "cz", None)
    assert (two["mark_name"], two["registration_number"], two["registration_date"]) == ("Hexerei", "77", "2020-02-01")
    assert (two["applicant_name"], two["applicant_country"], two["filing_date"]) == ("Besen OY", "EE", None)
    bad = {r["raw_url"]: r["reject_reason"] for r in ingest.rejected(parsed).collect()}
    assert bad == {"u3": "missing application_number", "u4": "missing application_number"}
    again = ingest.accepted(ingest.parse_detail_pages(pages)).select("id").collect()
    assert {r["id"] for r in again} == {r["id"] for r in good.values()}


def test_ingest_of_urls(spark):
    urls = spark.createDataFrame([("u1",), ("u1",), ("u2",), ("gone",)], ["url"])
    landed = spark.createDataFrame([("u1", BOLD), ("u1", BOLD), ("u2", "Mark: Lost"), ("u9", PLAIN)], ["url", "markdown"])
    parsed = ingest.ingest_urls(urls, landed)
    assert tuple(ingest.ingest_totals(parsed).first()) == (4, 2, 2)
    reasons = {r["raw_url"]: r["reject_reason"] for r in ingest.rejected(parsed).collect()}
    assert reasons == {"u2": "missing application_number", "gone": "no page"}
    register = ingest.ingest_into(conform(spark.createDataFrame([("0", "004418020", "Old")], ["id", "application_number", "mark_name"])), parsed)
    assert [r["mark_name"] for r in register.collect()] == ["Murmeltier"]
