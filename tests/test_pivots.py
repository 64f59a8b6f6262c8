"""Batch nearest-neighbour joins by pivots beside brute force: clusters, copies, ties, odd vectors, many groups."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emblema.operators import nearest, pivots, topk


def table(spark, vectors, first=0, name="id"):
    rows = [(i + first, None if v is None else [float(x) for x in v], f"p{i}") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} int, vector array<float>, label string")


def brute(items, asked, k):
    out = {}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = topk.round_score(unit(np.array(asked, np.float32).astype(float)) @ unit(np.array(items, np.float32).astype(float)).T)
    for q, row in enumerate(scores):
        out[q] = [(int(i), float(row[i]), f"p{i}") for i in np.lexsort((np.arange(len(items)), -row))[:k]]
    return out


def found(items, asked, k):
    df = nearest.nearest(items, asked.withColumnRenamed("vector", "query_vector").withColumnRenamed("id", "query_id").drop("label"), k, vector="vector", keep=["id", "label"], scan_queries=0)
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["id"], r["similarity_score"], r["label"]))
    return out


def clusters(rng, many, size, dim, spread):
    return [c + spread * rng.normal(size=dim) for c in rng.normal(size=(many, dim)) for _ in range(size)]


@pytest.fixture
def never_held(monkeypatch):
    monkeypatch.setattr(pivots, "HELD_ITEMS", 0)


def test_items_that_are_sent_to_the_tasks(spark):
    rng = np.random.default_rng(2)
    items, asked = [*rng.normal(size=(300, 5)), *[np.ones(5)] * 100], [*rng.normal(size=(50, 5)), np.ones(5)]
    assert found(table(spark, items), table(spark, asked).repartition(4), 6) == brute(items, asked, 6)
    odd = [None, [0.0] * 5, [float("nan")] * 5, [1.0]]
    assert found(table(spark, items[:4] + odd), table(spark, asked), 6) == brute(items[:4], asked, 6)
    assert found(table(spark, odd), table(spark, asked), 6) == {}


@pytest.mark.parametrize(("spread", "group"), [(0.05, 20), (0.05, 16384), (1.0, 50)])
def test_join_equals_brute_force(spark, monkeypatch, never_held, spread, group):
    monkeypatch.setattr(topk, "ITEMS_PER_BLOCK", group)
    rng = np.random.default_rng(3)
    items = clusters(rng, 12, 40, 6, spread) + [np.ones(6)] * 200  # copies tie at every border
    asked = clusters(rng, 5, 4, 6, spread) + items[:40] + [np.ones(6)]
    assert found(table(spark, items).repartition(5), table(spark, asked), 7) == brute(items, asked, 7)


def test_rows_without_a_direction_take_no_part(spark, monkeypatch, never_held):
    monkeypatch.setattr(topk, "ITEMS_PER_BLOCK", 3)
    rng = np.random.default_rng(4)
    items = list(rng.normal(size=(30, 3)))
    odd = [None, [0.0] * 3, [float("nan")] * 3, [1.0, 2.0], [float("inf"), 0.0, 0.0]]
    assert found(table(spark, items + odd), table(spark, items[:5] + [[0.0] * 3]), 4) == brute(items, items[:5], 4)
    assert found(table(spark, odd[:3]), table(spark, items[:5]), 4) == {}
    assert found(table(spark, items).limit(0), table(spark, items[:5]), 4) == {}
    assert found(table(spark, items[:2]), table(spark, items[:5]), 9) == brute(items[:2], items[:5], 9)


def test_queries_skip_cells_that_cannot_help_and_items_move_once(spark, monkeypatch, never_held):
    monkeypatch.setattr(topk, "ITEMS_PER_BLOCK", 25)
    sent = []
    streamed = pivots._streamed

    def counted(items, queries, k, groups):
        sent.append((items.count(), queries.count()))
        return streamed(items, queries, k, groups)

    monkeypatch.setattr(pivots, "_streamed", counted)
    rng = np.random.default_rng(5)
    items = clusters(rng, 20, 50, 16, 0.01)
    asked = [items[i] + 0.001 * rng.normal(size=16) for i in range(0, 1000, 10)]
    assert found(table(spark, items), table(spark, asked), 3) == brute(items, asked, 3)
    (first_items, first), (again_items, again) = sent
    assert first_items == again_items == len(items) and first == len(asked)
    groups = len(items) / 25
    assert again < 0.25 * groups * len(asked)


def test_partial_results_are_merged_in_two_steps_from_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    items, asked = list(rng.normal(size=(90, 4))), list(rng.normal(size=(3, 4)))
    queries = table(spark, asked).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))

    def answer():
        df = nearest.nearest(table(spark, items).repartition(9), queries, 5, vector="vector", keep=["id", "label"])
        return sorted(tuple(r) for r in df.collect()), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    one, exchanges = answer()
    monkeypatch.setattr(topk, "MERGED_AT_ONCE", 4)
    two, more = answer()
    assert one == two and more == 2 * exchanges  # one exchange more, in the first plan and the final one


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch, tmp_path):
    """Items of small files stay where they are; what is sent is the table of cells, and the best only if they are few."""
    items = spark.range(200).select(F.col("id").cast("int").alias("_item"), F.array(F.lit(1.0)).alias("_vector"), (F.col("id") % 4).cast("int").alias("_cell"))
    items.write.parquet(f"{tmp_path}/items")
    held = spark.read.parquet(f"{tmp_path}/items")
    plan = pivots._item_rows(held, pivots._part_table(spark, {c: (c, 1) for c in range(4)}))._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    best = held.select(F.col("_item").alias("_query"), "_item", F.lit(1.0).alias("_score"), F.lit(1).alias("_rank"))
    for rows, join in ((200, "BroadcastHashJoin"), (199, "SortMergeJoin")):
        monkeypatch.setattr("emblema.session.BROADCAST_ROWS", rows)
        kept = pivots.with_payload(best, held, ["_item", "_vector"], "query_id", "score")
        assert join in kept._jdf.queryExecution().executedPlan().toString() and kept.count() == 200


def test_held_items_equal_brute_force_with_floors(monkeypatch):
    monkeypatch.setattr(pivots, "CELL", 16)
    monkeypatch.setattr(pivots, "BLOCK", 32)
    monkeypatch.setattr(pivots, "EXACT_AT_ONCE", 50)
    rng = np.random.default_rng(7)
    vectors = np.array(clusters(rng, 10, 30, 6, 0.1) + [np.ones(6)] * 150 + [[0.0] * 6, [np.nan] * 6])
    ids = [f"i{n}" for n in rng.permutation(len(vectors))]
    asked = np.array([*rng.normal(size=(40, 6)), np.ones(6), -np.ones(6), np.zeros(6)])
    held = pivots.Held(pa.array(ids), vectors, 5)
    scores = topk.round_score(topk._unit_rows(asked) @ topk._unit_rows(vectors).T)
    want = [sorted((-s, i) for s, i in zip(row.tolist(), ids) if s == s) for row in scores]

    def found(*floors):
        out = [[] for _ in asked]
        for row, number, score in zip(*held.best(asked, *floors)):
            out[row].append((-float(score), held.ids[int(number)].as_py()))
        return out

    assert found() == [w[:5] for w in want]
    # a floor with an id: nothing that comes after it; without one, all that reach its score
    floor = np.array([-w[2][0] if w else np.nan for w in want])
    assert found(floor, pa.array([w[2][1] if w else None for w in want])) == [w[:3] for w in want]
    reach = [[x for x in w if w and -x[0] >= -w[2][0]][:5] for w in want]
    assert found(floor, pa.array([None] * len(want), pa.string())) == reach


def test_copies_are_not_scored_one_by_one(monkeypatch):
    rng = np.random.default_rng(8)
    names, many = rng.normal(size=(20, 16)), []
    held = pivots.Held(pa.array(np.arange(20_000)), names[np.arange(20_000) % 20], 10)
    rounded = topk.round_score
    monkeypatch.setattr(topk, "round_score", lambda s: many.append(len(s)) or rounded(s))
    row, number, score = held.best(names)
    assert (number.reshape(20, 10) == np.arange(0, 200, 20) + np.arange(20)[:, None]).all() and (score == 1.0).all()
    assert sum(many) < 20 * 1000 / 10  # each query has 1,000 copies


def test_small_cells_share_a_group():
    counts = {0: 10, 1: 70, 2: 30, 3: 20, 4: 100, 5: 1}
    assert pivots._packed(counts, 50, [0, 1, 2, 3, 4, 5]) == {0: (0, 1), 1: (1, 2), 2: (3, 1), 3: (3, 1), 4: (4, 2), 5: (6, 1)}
