"""Rows that must not go missing or be overwritten: keys that are null, records the watch meets, pages, references."""

import json

from pyspark.sql import functions as F

from emblema.functions.letters import article_references, citations, objection_codes
from emblema.operators import filters, upsert
from emblema.plans import bulletin, ingest, search
from emblema.schema import conform
from emblema.session import fresh_path
from emblema.sources.register import current_register, read_changes
from emblema.streaming import watch


def test_changes_without_a_key_are_handed_back(spark):
    base = spark.createDataFrame([("1", "a", "t0")], ["application_number", "mark_name", "scraped_at"])
    fresh = spark.createDataFrame([("1", "b", "t1"), (None, "c", "t1"), (None, "d", "t1")], base.schema)
    assert [tuple(r) for r in upsert.upsert(base, fresh).collect()] == [("1", "b", "t1")]
    assert {r["mark_name"] for r in upsert.without_key(fresh).collect()} == {"c", "d"}


def test_watch_leaves_full_records_alone(spark):
    home = fresh_path(spark, "watch")
    full = [("x", "0190000001", "Alpha", [9, 37], "registered", [1.0, 0.0])]
    base = conform(spark.createDataFrame(full, "id string, application_number string, mark_name string, nice_classes array<int>, status string, text_vector array<float>"))
    item = "<div class='bulletin-item'><a href='/t'>{} {}</a></div>"
    html = "".join(item.format(*m) for m in [("0190000001", "Alpha"), ("0190000002", "Beta")]) + item.format("", "Nameless")
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    pages.withColumn("landed_at", F.to_timestamp(F.lit("2026-01-01"))).write.parquet(f"{home}/pages")
    items = watch.stream_items(watch.stream_pages(spark, f"{home}/pages"))
    watch.watch_register(
        items, f"{home}/changes", f"{home}/checkpoint", register=lambda: base, known_path=f"{home}/known", run=2
    ).awaitTermination()
    watch.watch_rejects(items, f"{home}/rejects", f"{home}/checkpoint-rejects").awaitTermination()
    changes = read_changes(spark, f"{home}/changes")
    assert {r["batch_id"] for r in changes.collect()} == {2 * watch.BATCHES_PER_RUN}
    rows = {r["application_number"]: r for r in current_register(base, changes).collect()}
    kept = rows["0190000001"]
    assert (kept["id"], kept["status"], kept["nice_classes"], kept["text_vector"]) == ("x", "registered", [9, 37], [1.0, 0.0])
    assert rows["0190000002"]["status"] == "published" and len(rows) == 2
    assert [r["application_number"] for r in spark.read.parquet(f"{home}/known").collect()] == ["0190000001"]
    assert [r["mark_name"] for r in spark.read.parquet(f"{home}/rejects").collect()] == ["Nameless"]


def test_the_latest_landed_page_is_read(spark):
    page = "Mark name: A\nApplication number: 7\nStatus: {}\n"
    rows = [("u", page.format("Registered"), "2026-02-01"), ("u", page.format("Filed"), "2026-01-01"), ("v", "z", "2027-01-01")]
    landed = spark.createDataFrame(rows, ["url", "markdown", "landed_at"])
    read = ingest.ingest_urls(spark.createDataFrame([("u",), ("u",)], ["url"]), landed).collect()
    assert [(r["status"], r["requests"]) for r in read] == [("registered", 2)]


def test_a_value_stays_on_the_line_of_its_label(spark):
    pages = spark.createDataFrame([("u", "**Mark name:**  \n\nApp. No.: 000000003\n")], ["url", "markdown"])
    row = ingest.parse_detail_pages(pages).first()
    assert (row["mark_name"], row["application_number"], row["reject_reason"]) == ("", "000000003", "missing mark_name")


def test_forms_of_references(evaluate):
    text = "Articles 7(1)(b) and 7(1)(c), Art 7(1)(d), Article 7 (1) (g); Article 94(1). Articles 8(4), 8 (5), and 5. Smart 9"
    assert evaluate({"t": text}, article_references(F.col("t"))) == [
        "7(1)(b)", "7(1)(c)", "7(1)(d)", "7(1)(g)", "94(1)", "8(4)", "8(5)", "5",
    ]
    assert evaluate({"t": text}, objection_codes(F.col("t"))) == ["7(1)(b)", "7(1)(c)", "7(1)(d)", "7(1)(g)", "8(4)", "8(5)"]
    assert "Article 94(1)" in evaluate({"t": text}, citations(F.col("t")))


def test_backslash_is_a_letter_like_others(spark):
    marks = spark.createDataFrame([("a\\b",), ("ab",)], ["mark_name"])
    assert [r[0] for r in marks.where(filters.name_like("a\\b")).collect()] == ["a\\b"]


def test_json_keeps_nulls_and_says_what_failed(spark):
    rows = spark.createDataFrame([("1", None)], "id string, mark_name string")
    assert json.loads(search.as_json(rows).first()[0]) == {"id": "1", "mark_name": None}
    assert json.loads(search.failure(spark, "no register").first()[0]) == {
        "success": False, "error": "no register", "count": 0, "results": [],
    }


def test_every_link_of_a_long_listing(spark):
    html = "".join(f'<a href="/bulletin/{i}">n{i}</a>' for i in range(100))
    pages = spark.createDataFrame([(1, html)], ["page_id", "html"])
    assert bulletin.bulletin_links(pages).count() == 100
    assert bulletin.bulletin_links(pages, max_pages=3).count() == 60
