"""Named text files, the stream over them, numbers by bucket, hot numbers on the stream, and the chain to clearance."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emblema.operators import celltree, encode
from emblema.plans import ingest
from emblema.session import fresh_path
from emblema.sources import register as table
from emblema.sources import textfiles, texts
from emblema.streaming import watch


def test_a_file_for_each_row(spark, tmp_path):
    rows = [(f"sub{k % 3}/letter+{k} 100%.txt" if k % 2 else f"letter {k}.txt", f"täxt {k}\n\n") for k in range(40)] + [("empty.txt", None)]
    df = spark.createDataFrame(rows, "name string, text string").repartition(5)
    out = tmp_path / "files"
    textfiles.write_texts(df, f"file://{out}")
    assert {str(p.relative_to(out)): p.read_text() for p in out.rglob("*.txt")} == {n: t or "" for n, t in rows}
    assert (out / "_SUCCESS").read_text() == "41" and not list(out.rglob("*.tmp"))
    with pytest.raises(Exception, match="finished files"):
        textfiles.write_texts(df, str(out))
    textfiles.write_texts(df.limit(2), str(out), mode="overwrite")
    assert (out / "_SUCCESS").read_text() == "2"
    assert {r.source for r in texts.read_corpus(spark, str(out)).collect()} == {n for n, t in rows if t}


@pytest.mark.parametrize("name", ["../out.txt", "a//b", "", "/etc/x", None, "a/./b"])
def test_names_that_leave_the_folder_are_refused(spark, tmp_path, name):
    with pytest.raises(Exception, match="not a name of a file"):
        textfiles.write_texts(spark.createDataFrame([(name, "x")], "name string, text string"), str(tmp_path / "out"))
    assert not (tmp_path / "out" / "_SUCCESS").exists()


def test_a_stream_reads_each_file_once(spark, tmp_path):
    def land(*names):
        textfiles.write_texts(spark.createDataFrame([(n, f"text of {n}\nmore") for n in names], "name string, text string"), str(tmp_path / "in"), mode="overwrite")

    def run():
        stream = textfiles.stream_texts(spark, str(tmp_path / "in"), files_per_trigger=1)
        out = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint"))
        out.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect())

    land("a.txt", "b.txt")
    assert run() == ["text of a.txt\nmore", "text of b.txt\nmore"]
    land("c.txt")
    assert run() == ["text of a.txt\nmore", "text of b.txt\nmore", "text of c.txt\nmore"]


def test_landed_pages_keep_their_time(spark, tmp_path):
    page = "Mark name: {}\nApplication number: 00441{}\n"
    rows = [("u", page.format("Old", 1), datetime(2026, 1, 1)), ("u", page.format("New", 1), datetime(2026, 2, 1)), ("v", page.format("Only", 2), None)]
    spark.createDataFrame(rows, "url string, markdown string, landed_at timestamp").write.parquet(str(tmp_path / "pages"))
    asked = spark.createDataFrame([("u",), ("v",)], ["url"])
    read = ingest.ingest_urls(asked, texts.read_landed_pages(spark, str(tmp_path / "pages")))
    assert {(r.raw_url, r.mark_name) for r in read.collect()} == {("u", "New"), ("v", "Only")}


def test_numbers_by_bucket(spark):
    path = fresh_path(spark, "numbers")
    register = spark.createDataFrame([(f"{k:05d}",) for k in range(500)] + [(None,)], "application_number string")
    table.index_numbers(register, path, 16)
    asked = spark.createDataFrame([("00007",), ("00007",), ("00499",), ("00500",), (None,)], "application_number string")
    known = table.known_numbers(spark, path, asked)
    assert sorted(r[0] for r in known.collect()) == ["00007", "00499"]
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters:")[1][:200]


def landed(spark, path, marks, day):
    html = "".join(f"<div class='bulletin-item'><a href='/t'>{n} {m}</a></div>" for n, m in marks)
    pages = spark.createDataFrame([(int(day), "u", html, f"2026-01-{day}")], "page_id long, url string, html string, landed_at string")
    pages.withColumn("landed_at", F.to_timestamp("landed_at")).coalesce(1).write.mode("append").parquet(path)


def test_the_register_is_read_once_for_each_version(spark):
    home = fresh_path(spark, "watch")
    held, reads, now = [["0190000001"]], [], ["1"]

    def register():
        reads.append(now[0])
        return spark.createDataFrame([(n,) for n in held[0]], "application_number string")

    def run():
        items = watch.first_items(watch.stream_items(watch.stream_pages(spark, f"{home}/pages", files_per_trigger=1)))
        options = dict(register=register, version=lambda: now[0], known_path=f"{home}/known")
        watch.watch_register(items, f"{home}/changes", f"{home}/checkpoint", **options).awaitTermination()
        return {r["application_number"] for r in table.read_changes(spark, f"{home}/changes").collect()}

    for day in ("01", "02", "03"):
        landed(spark, f"{home}/pages", [("0190000001", "Known"), (f"01900000{day}", "New")], day)
    assert run() == {"0190000002", "0190000003"} and reads == ["1"]  # three batches
    held[0], now[0] = ["0190000001", "0190000004"], "2"
    landed(spark, f"{home}/pages", [("0190000004", "Known by now"), ("0190000005", "New")], "09")
    assert run() == {"0190000002", "0190000003", "0190000005"} and reads == ["1", "2"]
    assert {r[0] for r in spark.read.parquet(f"{home}/known").select("application_number").collect()} == {"0190000001", "0190000004"}


def test_a_number_that_fills_half_of_the_stream_is_spread(spark):
    home = fresh_path(spark, "watch")
    rows = [(k, k % 7, "019" if k % 2 else f"n{k % 500}", datetime(2026, 1, 1 + k % 5)) for k in range(4000)]
    items = spark.createDataFrame(rows, "page_id long, position long, application_number string, landed_at timestamp")
    items.write.parquet(f"{home}/in")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        stream = watch.first_items(spark.readStream.schema(items.schema).parquet(f"{home}/in"))
        run = stream.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    found = [r[0] for r in spark.read.parquet(f"{home}/out").select("application_number").collect()]
    assert sorted(found) == sorted({r[2] for r in rows})
    operators = [json.loads(str(p.json))["stateOperators"] for p in run.recentProgress]
    assert max(len(o) for o in operators) == 2
    salt = F.pmod(F.xxhash64("page_id", "position"), F.lit(watch.SALTS))
    task = F.pmod(F.hash("application_number", salt), F.lit(20))
    assert items.groupBy(task).count().agg(F.max("count")).first()[0] <= len(rows) / 10
    assert items.where("application_number = '019'").select(salt).distinct().count() == watch.SALTS


def test_alerts_through_an_index_that_is_refreshed(spark):
    encoder, home = encode.ngram_encoder(64), fresh_path(spark, "watch")
    schema = "id string, application_number string, mark_name string, nice_classes array<int>, status string, applicant_name string, applicant_country string"
    marks = [(str(k), str(k), n, [9], "registered", "", "") for k, n in enumerate(["Lanternhill", "Zephyranth", "Quastenfloss"])]
    watched = encode.embed_column(spark.createDataFrame(marks, schema), "mark_name", encoder)
    tree = celltree.build_tree(watched, f"{home}/tree", leaves=2)

    def run():
        stream = watch.stream_items(watch.stream_pages(spark, f"{home}/pages"))
        index = lambda: celltree.open_tree(spark, f"{home}/tree")
        watch.watch_alerts(stream, watched, encoder, f"{home}/alerts", f"{home}/checkpoint", levels=("HIGH", "MEDIUM"), index=index, nprobe=9).awaitTermination()
        return {(r["item"], r["mark_name"]) for r in spark.read.parquet(f"{home}/alerts").collect()}

    landed(spark, f"{home}/pages", [("0190000001", "Lanternhilt"), ("0190000002", "Murmelstein")], "01")
    assert run() == {("0190000001", "Lanternhill")}
    fresh = spark.createDataFrame([("9", "9", "Murmelstein", [9], "registered", "", "")], schema)
    celltree.upsert_rows(tree, encode.embed_column(fresh, "mark_name", encoder))
    landed(spark, f"{home}/pages", [("0190000003", "Murmelsteim")], "02")
    assert run() == {("0190000001", "Lanternhill"), ("0190000003", "Murmelstein")}


def test_items_are_cleared_by_what_is_known_best(spark):
    encoder = encode.ngram_encoder(64)
    schema = "id string, application_number string, mark_name string, nice_classes array<int>, status string, applicant_name string, applicant_country string"
    register = spark.createDataFrame([("r1", "1", "Birkenwald", [9], "registered", "", ""), ("r2", "2", "Birkenhain", [9], "registered", "", "")], schema)
    details = spark.createDataFrame([("d3", "3", "Birkenwalt", [9], "application", "", "")], schema)
    items = spark.createDataFrame([("i1", "1", "odd title"), ("i1b", "1", "other"), ("i3", "3", "title"), ("i4", "4", "Birkenhein"), ("i5", None, "Birkenwald"), ("i6", None, None)], "id string, application_number string, mark_name string")
    watched = encode.embed_marks(register, encoder)
    rows = watch.clear_items(items, details, register, watched, encoder, k=2).collect()
    found = {}
    for r in rows:
        found.setdefault((r["item"], r["origin"], r["candidate_name"]), []).append((r["rank"], r["application_number"]))
    assert {k: sorted(v) for k, v in found.items()} == {
        ("1", "register", "Birkenwald"): [(1, "2")],
        ("3", "detail", "Birkenwalt"): [(1, "1"), (2, "2")],
        ("4", "item", "Birkenhein"): [(1, "2"), (2, "1")],
        ("i5", "item", "Birkenwald"): [(1, "1"), (2, "2")],
    }


def test_items_to_clear_are_computed_once(spark):
    encoder, schema = encode.ngram_encoder(64), "id string, application_number string, mark_name string, nice_classes array<int>, status string, applicant_name string, applicant_country string"
    register = spark.createDataFrame([("p1", "1", "Birkenwald", [9], "registered", "", ""), ("p2", "2", "Birkenfeld", [9], "registered", "", "")], schema)
    seen = spark.sparkContext.accumulator(0)

    def count(name):
        seen.add(1)
        return name

    counted = F.udf(count, "string").asNondeterministic()
    items = spark.createDataFrame([(f"i{i}", str(i), "Birkenhein") for i in range(1, 21)], "id string, application_number string, mark_name string")
    found = watch.clear_items(items.withColumn("mark_name", counted("mark_name")), register.limit(0), register, encode.embed_marks(register, encoder), encoder, k=1)
    assert found.count() == 20 and seen.value == 20


def test_pages_that_landed_in_one_file_are_parsed_by_all_cores(spark, tmp_path):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("<p/>").alias("html"), F.current_timestamp().alias("landed_at"))
    pages.coalesce(1).write.parquet(f"{tmp_path}/in")
    read = watch.stream_pages(spark, f"{tmp_path}/in").select("page_id", F.spark_partition_id().alias("task"))
    run = read.writeStream.format("memory").queryName("dealt").trigger(availableNow=True).start()
    run.awaitTermination()
    dealt = spark.table("dealt")
    assert dealt.select("page_id").distinct().count() == dealt.count() == 40
    assert dealt.select("task").distinct().count() > 1


def test_many_small_files_are_read_in_few_tasks(spark, tmp_path):
    cores, home = spark.sparkContext.defaultParallelism, str(tmp_path)
    rows = spark.range(1000).select(F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.col("id").cast("string").alias("text"))
    textfiles.write_texts(rows, f"{home}/in")
    read = texts.read_corpus(spark, f"{home}/in")
    assert read.rdd.getNumPartitions() <= 2 * cores and read.count() == 1000
    stream = textfiles.stream_texts(spark, f"{home}/in", files_per_trigger=600).withColumn("task", F.spark_partition_id())
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    with textfiles.many_small_files(spark):
        run = stream.writeStream.format("memory").queryName("small").trigger(availableNow=True).start()
        run.awaitTermination()
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert [json.loads(str(p.json))["numInputRows"] for p in run.recentProgress] == [600, 400]
    found = spark.table("small")
    assert sorted(int(r["text"]) for r in found.collect()) == list(range(1000))
    assert found.select("task").distinct().count() <= 2 * cores


def test_the_log_of_a_stream_does_not_grow_with_the_square_of_its_files(spark, tmp_path):
    rows = [(f"{k:02d}.txt", f"text {k:02d}") for k in range(31)]
    textfiles.write_texts(spark.createDataFrame(rows, "name string, text string"), str(tmp_path / "in"))
    stream = textfiles.stream_texts(spark, str(tmp_path / "in"), files_per_trigger=1)

    def run():
        out = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint"))
        with textfiles.many_small_files(spark):
            out.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [t for _, t in rows]
    assert sorted(p.name for p in (tmp_path / "checkpoint/sources/0").glob("*.compact")) == ["19.compact", "29.compact"]
    textfiles.write_texts(spark.createDataFrame([("31.txt", "text 31")], "name string, text string"), str(tmp_path / "in"), mode="overwrite")
    assert run() == [*(t for _, t in rows), "text 31"]
