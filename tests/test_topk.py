"""Top-k scoring: scan, grid and cells against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emblema.operators import lexical, nearest, topk
from emblema.plans.search import fused_search, hybrid_search
from emblema.session import fresh_path

SCHEMA = "id string, name string, label int, text_vector array<float>"


def unit(v):
    return v / np.linalg.norm(v)


@pytest.fixture(scope="module")
def marks():
    """400 marks; a third are copies of one vector, so ties at the border of the top k are certain."""
    rng = np.random.default_rng(7)
    rows = []
    hot = rng.normal(size=8)
    for i in range(400):
        vector = hot if i % 3 == 0 else rng.normal(size=8)
        rows.append((f"m{i:03d}", f"name {i}", i % 5, [float(x) for x in vector.astype(np.float32)]))
    odd = [("z1", "none", 1, None), ("z2", "short", 1, [1.0, 2.0]), ("z3", "zero", 1, [0.0] * 8), ("z4", "nan", 1, [float("nan")] * 8)]
    return rows, odd, hot


@pytest.fixture(scope="module")
def asked(marks):
    rng = np.random.default_rng(8)
    _, _, hot = marks
    rows = [(q, [float(x) for x in (hot + 0.1 * rng.normal(size=8) if q < 3 else rng.normal(size=8))]) for q in range(6)]
    return rows


def brute(rows, asked, k, keep=lambda r: True):
    out = {}
    for q, v in asked:
        scored = []
        for r in rows:
            if keep(r):
                s = float(unit(np.array(r[3], dtype=np.float64)) @ unit(np.array(v)))
                scored.append((-float(topk.round_score(np.array([s]))[0]), r[0]))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def collected(df, item="id", score="similarity_score"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r[item], r[score]))
    return out


@pytest.fixture(scope="module")
def tables(spark, marks, asked):
    rows, odd, _ = marks
    register = spark.createDataFrame(rows + odd, SCHEMA).repartition(7)
    queries = spark.createDataFrame([*asked, (90, None), (91, [0.0] * 8)], "query_id int, query_vector array<double>")
    return register, queries


def test_scan_equals_brute_force(tables, marks, asked):
    register, queries = tables
    assert collected(nearest.nearest(register, queries, 10)) == brute(marks[0], asked, 10)


def test_scan_in_small_batches_keeps_the_same_rows(spark, tables, marks, asked):
    register, queries = tables
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert collected(nearest.nearest(register, queries, 10)) == brute(marks[0], asked, 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_grid_equals_scan(tables, marks, asked, monkeypatch):
    register, queries = tables
    monkeypatch.setattr(topk, "ITEMS_PER_BLOCK", 37)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 2)
    assert collected(nearest.nearest(register, queries, 10, scan_queries=1)) == brute(marks[0], asked, 10)


def test_filter_before_and_after(tables, marks, asked):
    register, queries = tables
    before = nearest.nearest(register, queries, 10, where=F.col("label") == 2)
    assert collected(before) == brute(marks[0], asked, 10, lambda r: r[2] == 2)
    every = collected(nearest.nearest(register, queries, 10))
    after = collected(nearest.nearest(register, queries, 10, where=F.col("label") == 2, prefilter=False))
    assert after and all(set(found) <= set(every[q]) for q, found in after.items())


def test_no_queries_and_no_rows(spark, tables):
    register, queries = tables
    assert nearest.nearest(register, queries.where("query_id < 0"), 5).count() == 0
    assert nearest.nearest(register.where("label = 77"), queries, 5).count() == 0


def test_cells(spark, tables, marks, asked, monkeypatch):
    register, queries = tables
    index = nearest.build_index(register, fresh_path(spark, "cells"), cells=6, dim=8)
    # the vectors of zeros and of no numbers have a cell, too, but never a score
    assert index.rows.count() == len(marks[0]) + 2
    everything = nearest.nearest_in_cells(index, queries, 10, len(index.centres), keep=["id"])
    assert collected(everything) == brute(marks[0], asked, 10)
    few = nearest.nearest_in_cells(index, queries, 10, 2, keep=["id"])
    exact = nearest.nearest(register, queries, 10, keep=["id"])
    shares = [r["recall"] for r in nearest.recall(few, exact).collect()]
    assert len(shares) == 6 and all(0 < s <= 1 for s in shares)
    monkeypatch.setattr(topk, "ITEMS_PER_BLOCK", 11)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 2)
    grid = nearest.nearest_in_cells(index, queries, 10, 2, keep=["id"], scan_queries=1)
    assert collected(grid) == collected(few)


def test_cells_are_pruned(spark, tables):
    register, queries = tables
    index = nearest.build_index(register, fresh_path(spark, "cells"), cells=6, dim=8)
    found = nearest.nearest_in_cells(index, queries.where("query_id = 0"), 3, 1, keep=["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "cell#" in plan.split("PartitionFilters:")[1][:60]


def test_index_only_when_asked_for(spark, tables):
    assert nearest.ensure_index(tables[0], fresh_path(spark, "cells"), mode="exact") is None
    with pytest.raises(ValueError):
        nearest.ensure_index(tables[0], fresh_path(spark, "cells"), mode="auto")
    assert [nearest.cells_for(n) for n in (1, 50, 10_000, 1_000_000)] == [1, 7, 100, 1000]
    assert [nearest.capped_cells(n) for n in (50, 10_000, 1_000_000)] == [1, 100, 256]
    assert [nearest.index_advised(n) for n in (9_999, 10_000)] == [False, True]


def test_index_of_one_cell(spark, tables, marks, asked):
    register, queries = tables
    index = nearest.build_index(register, fresh_path(spark, "cells"), cells=1, dim=8)
    assert len(index.centres) == 1
    assert collected(nearest.nearest_in_cells(index, queries, 10, 1, keep=["id"])) == brute(marks[0], asked, 10)


def test_filter_in_cells(spark, tables, marks, asked):
    register, queries = tables
    index = nearest.build_index(register, fresh_path(spark, "cells"), cells=6, dim=8)
    for prefilter in (True, False):
        options = dict(keep=["id"], where=F.col("label") == 2, prefilter=prefilter)
        through = nearest.search_vectors(register, queries, 10, index=index, nprobe=6, **options)
        assert collected(through) == collected(nearest.nearest(register, queries, 10, **options))


def test_sizes_are_never_guessed(spark):
    register = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, text_vector array<float>")
    queries = spark.createDataFrame(
        [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [None, 1.0])],
        "query_id int, query_vector array<double>",
    )
    with pytest.raises(ValueError):
        nearest.nearest(register, queries, 1)
    for scan in (100, 1):
        found = nearest.nearest(register, queries, 1, dim=2, scan_queries=scan)
        assert collected(found) == {2: [("a", 1.0)], 3: [("b", 1.0)]}
    reasons = {r["query_id"]: r["reason"] for r in nearest.unusable_queries(queries, 2).collect()}
    assert reasons == {
        1: "vector of another size", 4: "no vector", 5: "vector of length zero", 6: "vector without all its numbers",
    }


def test_index_keeps_rows_behind_a_run_of_other_sizes(spark):
    rows = [(f"x{i:04d}", [1.0]) for i in range(1000)] + [(f"y{i}", [1.0, float(i)]) for i in range(50)]
    register = spark.createDataFrame(rows, "id string, text_vector array<float>").coalesce(1)
    with pytest.raises(ValueError):
        nearest.build_index(register, fresh_path(spark, "cells"))
    assert nearest.build_index(register, fresh_path(spark, "cells"), dim=2).rows.count() == 50


def test_hybrid_search_needs_no_text_with_a_vector(tables, marks, asked):
    register, _ = tables
    register = register.withColumn("status", F.lit("registered")).withColumns(
        {"application_number": F.col("id"), "mark_name": F.col("name")}
    )
    found = hybrid_search(register, "no such name", asked[4][1], status="registered", limit=7)
    assert [(r["id"], r["similarity_score"]) for r in found.collect()] == brute(marks[0], asked, 7)[4]
    assert "text_vector" not in found.columns
    assert hybrid_search(register, "no such name").count() == 0
    assert hybrid_search(register, "", limit=9).count() == 9


DOCS = [
    (1, "solar panel on a solar roof"),
    (2, "wind turbine and solar farm"),
    (3, "Panel discussion"),
    (4, ""),
    (5, "roof tiles, ROOF beams, roof windows"),
    (6, "wind wind wind"),
]
ASKED = [(1, "solar roof"), (2, "the wind"), (3, "nothing here")]


def plain_bm25(docs, asked, k, k1=1.2, b=0.75):
    import math
    import re

    tokens = {d: re.findall(r"[^\W_]+", t.lower()) for d, t in docs}
    mean = sum(map(len, tokens.values())) / len(tokens)
    out = {}
    for q, t in asked:
        scores = {}
        for term in set(re.findall(r"[^\W_]+", t.lower())):
            holding = sum(term in ws for ws in tokens.values())
            idf = math.log(1 + (len(tokens) - holding + 0.5) / (holding + 0.5))
            for d, ws in tokens.items():
                tf = ws.count(term)
                if tf:
                    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ws) / mean))
                    scores[d] = scores.get(d, 0.0) + part
        ranked = sorted((-round(s, 4), d) for d, s in scores.items())[:k]
        if ranked:
            out[q] = [(d, -s) for s, d in ranked]
    return out


@pytest.mark.parametrize("scan", [100, 1])
def test_bm25(spark, scan, monkeypatch):
    monkeypatch.setattr(topk, "ITEMS_PER_BLOCK", 2)
    docs = spark.createDataFrame(DOCS, ["doc_id", "text"]).repartition(3)
    queries = spark.createDataFrame(ASKED, ["query_id", "query_text"])
    got = collected(lexical.bm25(docs, queries, 3, scan_queries=scan), "doc_id", "score")
    assert got == plain_bm25(DOCS, ASKED, 3)


def test_word_statistics(spark):
    docs = spark.createDataFrame(DOCS, ["doc_id", "text"])
    rows = {r["term"]: (r["texts"], r["total_words"]) for r in lexical.word_statistics(docs).collect()}
    assert rows[""] == (6, 6 + 5 + 2 + 0 + 6 + 3) and rows["roof"] == (2, 0) and rows["wind"] == (2, 0)
    wanted = spark.createDataFrame([("roof",), ("",)], ["term"])
    for small in (True, False):
        some = lexical.word_statistics(docs, vocabulary=wanted, small_vocabulary=small)
        assert {r["term"] for r in some.collect()} == {"", "roof"}


def test_fusion(spark):
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], ["query_id", "id", "rank"])
    two = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], ["query_id", "id", "rank"])
    rows = lexical.reciprocal_rank_fusion([one, two], 2).orderBy("rank").collect()
    assert [(r["id"], r["lists"]) for r in rows] == [("b", 2), ("a", 1)]
    assert rows[0]["fused_score"] == round(1 / 61 + 1 / 62, 6)


def test_fused_search(spark, tables):
    register, queries = tables
    queries = queries.where("query_id < 3").withColumn("query_text", F.lit("name 17"))
    rows = fused_search(register, queries, 5, depth=20, text="name").collect()
    assert {r["query_id"] for r in rows} == {0, 1, 2} and len(rows) == 15


def _traced(work):
    """What the work returns, and the most MB that NumPy held while it ran."""
    import tracemalloc

    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / (1 << 20)
    finally:
        tracemalloc.stop()


def _long_texts(many, words):
    import numpy as np
    import pyarrow as pa

    names = pa.array([f"w{k}" for k in range(300)])
    codes = np.random.default_rng(1).integers(0, 300, many * words)
    return pa.ListArray.from_arrays(pa.array(np.arange(many + 1, dtype=np.int32) * words), names.take(pa.array(codes)))


def test_a_batch_of_long_texts_is_scored_in_bounded_memory():
    import pyarrow as pa

    from emblema.operators.topk import WeightedTerms

    names = [f"w{k}" for k in range(300)]
    queries = pa.table({"_query": [*range(40)], "_terms": [names[k * 7 : k * 7 + 20] for k in range(40)], "_weights": [[1.0 + k] * 20 for k in range(40)]})
    kernel = WeightedTerms(queries, (1.2, 0.75, 400.0))
    batch = pa.RecordBatch.from_arrays([_long_texts(3000, 400)], names=["_tokens"])
    scores, peak = _traced(lambda: kernel.score(batch))
    for row in (0, 163, 164, 2999):
        assert str(scores[row].tolist()) == str(kernel.score(batch.slice(row, 1))[0].tolist())
    assert peak < 20


def test_a_batch_of_long_texts_is_counted_in_bounded_memory(spark):
    import pyarrow as pa

    from emblema.operators.postings import term_counts

    texts = _long_texts(2000, 400)
    tokens = spark.createDataFrame(pa.table({"doc_id": [*range(2000)], "t": texts}), "doc_id bigint, t array<string>").coalesce(1)
    counted = {r.doc_id: (r.length, dict(zip(r.terms, r.counts))) for r in term_counts(tokens, "t").collect()}
    assert len(counted) == 2000
    for doc in (0, 624, 625, 1999):
        want = {}
        for w in texts[doc].as_py():
            want[w] = want.get(w, 0) + 1
        assert counted[doc] == (400, want)

    from emblema.operators.postings import COUNTED_AT_ONCE, count_terms
    from emblema.operators.topk import stretches

    batch = pa.RecordBatch.from_arrays([texts], names=["t"])
    parts = list(stretches(texts, COUNTED_AT_ONCE))
    assert parts[0] == (0, 625) and parts[-1][1] == 2000 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    _, peak = _traced(lambda: [count_terms(batch.slice(a, b - a), "t", []).num_rows for a, b in parts])
    _, whole = _traced(lambda: count_terms(batch, "t", []).num_rows)
    assert peak < 0.5 * whole
