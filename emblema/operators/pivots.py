"""Nearest items for any number of queries, exact, by pivots: items move once, and queries only where they can find something.

Few items are sent to the tasks, and the queries are read past them. Otherwise:

Some items, chosen by the hash of their id, are pivots; every item belongs to the cell of its nearest pivot, and a cell
knows its largest angle to the pivot. Neighbouring cells share a group of bounded size, and a cell too large for one is
cut by hash into several. A query is first compared with the items of its own group, which gives it a floor: its k-th
best so far, score and id. By the triangle inequality no item of another cell is nearer to the query than the pivot's
angle less the cell's, so the query goes on only to the groups of cells that can still beat its floor.

A group is the work of one task at a time: the items are held, and the queries stream past them, sorted behind the
items, so their number has no bound. There the same inequality holds for blocks of a few hundred neighbours (``Held``). A
block that is not ruled out is scored in single precision, and exactly where that comes near the floor; of equal scores
an id above the floor's is passed over. Groups send ids and scores. These are merged by query and group first and then
by query, and kept columns are fetched for the best alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from ..session import broadcast_if_small, settled, spread
from . import topk

MOST_PIVOTS = 4096
#: Up to so many items, and 64 MB of them, are sent to the tasks instead.
HELD_ITEMS = 65_536
#: Groups there are at least, for each core, if there are items enough.
GROUPS_PER_CORE = 2
#: Vectors of a group at most.
GROUP_BYTES = 32 << 20
#: Cells for each group, and items of a cell within a group, about; items of a block at most.
CELLS_PER_GROUP, CELL, BLOCK = 16, 256, 1024
#: Queries that are looked at together, and pairs that are scored exactly at once.
AT_ONCE, EXACT_AT_ONCE = 8192, 65_536
MARGIN = 1e-4  # scores are compared after rounding to four digits
HALF = MARGIN / 2  # rounding moves a score by so much
SLACK = 1e-6  # of angles


def _angles(vectors: pa.Array, pivots: np.ndarray) -> Iterator[np.ndarray]:
    """Angles of some vectors after the other to all pivots."""
    step = max(1, topk.SCORES_AT_ONCE // max(1, len(pivots)))
    for start in range(0, len(vectors), step):
        yield np.arccos(np.clip(topk._unit_rows(topk.dense(vectors.slice(start, step))) @ pivots.T, -1.0, 1.0))


def choose_pivots(items: DataFrame, rows: int, cells: int) -> np.ndarray:
    """About so many unit vectors of items, picked by the hash of the id: the same ones however items are partitioned."""
    share = min(1.0, 2.0 * cells / max(rows, 1))
    picked = items.where(F.pmod(F.xxhash64("_item", F.lit(5)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    held = picked.select(F.xxhash64("_item", F.lit(5)).alias("h"), F.col("_vector").cast("array<double>").alias("v")).limit(4 * MOST_PIVOTS).toArrow()
    if held.num_rows == 0:
        held = items.select(F.lit(0).alias("h"), F.col("_vector").cast("array<double>").alias("v")).limit(1).toArrow()
    unit = topk._unit_rows(topk.dense(held.column("v")))
    order = np.argsort(held.column("h").to_numpy(), kind="stable")
    unit = unit[order][~np.isnan(unit[order]).any(axis=1)]
    return np.unique(unit, axis=0)[:MOST_PIVOTS] if len(unit) <= cells else np.unique(unit[:cells], axis=0)


def _with_cell(rows: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    """Adds ``_cell`` and ``_angle``; rows whose vector has no direction are left out."""
    shipped = rows.sparkSession.sparkContext.broadcast(pivots)

    @F.arrow_udf("struct<cell int, angle double>")
    def nearest_pivot(vectors: pa.Array) -> pa.Array:
        cell, least = np.zeros(len(vectors), np.int32), np.full(len(vectors), np.nan)
        start = 0
        for angles in _angles(vectors, shipped.value):
            stop = start + len(angles)
            known = ~np.isnan(angles).any(axis=1)
            cell[start:stop] = np.where(known, angles.argmin(axis=1), 0)
            least[start:stop] = np.where(known, angles.min(axis=1), np.nan)
            start = stop
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(least, mask=np.isnan(least))], names=["cell", "angle"])

    found = rows.withColumn("_n", nearest_pivot(F.col(vector).cast("array<double>")))
    return found.withColumns({"_cell": F.col("_n.cell"), "_angle": F.col("_n.angle")}).drop("_n").where("_angle IS NOT NULL")


def _parts(counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """First group and number of groups of each cell."""
    out, at = {}, 0
    for cell in sorted(counts):
        many = -(-counts[cell] // size)
        out[cell] = (at, many)
        at += many
    return out


def _part_table(spark, parts: dict[int, tuple[int, int]]) -> DataFrame:
    """A row for each cell. It is marked for broadcast: made of local rows it has no known size, and the optimizer would
    send the items or the queries to the tasks instead, whose files are small for what they hold."""
    rows = [(cell, first, many) for cell, (first, many) in parts.items()]
    return F.broadcast(spark.createDataFrame(rows, "_cell int, _first int, _many int"))


def _packed(counts: dict[int, int], size: int, order: Sequence[int]) -> dict[int, tuple[int, int]]:
    """The same, where cells that follow each other in ``order`` share a group if they fit into one."""
    out, at, room = {}, -1, 0
    for cell in order:
        many = -(-counts[cell] // size)
        if many > 1:
            out[cell], at, room = (at + 1, many), at + many, 0
            continue
        if counts[cell] > room:
            at, room = at + 1, size
        out[cell], room = (at, 1), room - counts[cell]
    return out


def _neighbours(pivots: np.ndarray, cells: Sequence[int], groups: int) -> list[int]:
    """The cells, those near the same few pivots one after the other."""
    some = pivots[cells][np.linspace(0, len(cells) - 1, min(len(cells), groups)).astype(np.int64)]
    near = (pivots[cells] @ some.T).argmax(axis=1)
    return [cells[i] for i in np.argsort(near, kind="stable")]


def _item_rows(items: DataFrame, parts: DataFrame) -> DataFrame:
    """``_group, _kind, _item, _vector``: items in their group."""
    group = F.col("_first") + F.pmod(F.xxhash64("_item"), F.col("_many")).cast("int")
    return items.join(parts, "_cell").select(group.alias("_group"), F.lit(0).alias("_kind"), "_item", "_vector")


def _query_rows(queries: DataFrame, last: str) -> DataFrame:
    """``_last`` is the id that an item with the floor's score must not be above, null if any will do; ``last`` its type."""
    known = F.col("_last") if "_last" in queries.columns else F.lit(None).cast(last)
    return queries.select("_group", F.lit(1).alias("_kind"), "_query", "_query_vector", "_floor", known.alias("_last"))


class Held:
    """Items that a task holds, in the order of their ids, and in blocks of neighbours."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, k: int):
        unit = topk._unit_rows(vectors)
        order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
        order = order[~np.isnan(unit[order]).any(axis=1)]
        self.k, self.ids, self.unit = k, ids.take(pa.array(order)), unit[order]
        many, size = self.unit.shape
        self.near = (size + 8) * 2.0**-23  # products in single precision differ by less, and so do their bounds
        self.known = None  # ids to look among, made when first needed
        centres = self.unit[np.linspace(0, many - 1, -(-many // CELL)).astype(np.int64)]
        cell, angle = np.empty(many, np.int64), np.empty(many)
        for start in range(0, many, AT_ONCE):
            products = self.unit[start : start + AT_ONCE] @ centres.T
            cell[start : start + AT_ONCE] = products.argmax(axis=1)
            angle[start : start + AT_ONCE] = products.max(axis=1)
        by = np.argsort(cell, kind="stable")
        bounds = np.searchsorted(cell[by], np.arange(len(centres) + 1))
        filled = np.flatnonzero(np.diff(bounds))
        self.centres = centres[filled]
        self.least = np.clip(np.minimum.reduceat(angle[by], bounds[filled]), -1.0, 1.0) if many else np.empty(0)
        # the blocks of each cell: the numbers of their items, ascending, and their vectors
        self.blocks = []
        for start, stop in zip(bounds[filled], bounds[filled + 1], strict=True):
            cuts = [by[at : min(at + BLOCK, stop)] for at in range(start, stop, BLOCK)]
            self.blocks.append([(numbers, np.ascontiguousarray(self.unit[numbers].T, np.float32)) for numbers in cuts])

    def upto(self, last: pa.Array) -> np.ndarray:
        """The number of the last item whose id is not above; of all items for null."""
        out = np.full(len(last), len(self.ids))
        given = np.flatnonzero(last.is_valid().to_numpy(zero_copy_only=False))
        if len(given):
            if self.known is None:
                self.known = self.ids.drop_null().to_numpy(zero_copy_only=False)
            wanted = last.take(pa.array(given)).to_numpy(zero_copy_only=False)
            out[given] = self.ids.null_count + np.searchsorted(self.known, wanted, side="right") - 1
        return out

    def best(self, vectors: np.ndarray, floors: np.ndarray | None = None, last: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, number and rounded score of each query's best k, by score and then number; with floors, of those that reach
        them."""
        if not len(self.ids) or not len(vectors):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        search = _Search(self, vectors, floors, last)
        search.run()
        row, place = np.nonzero(np.isfinite(search.score))
        return row, search.number[row, place], search.score[row, place]


class _Search:
    """A batch of queries among held items. ``score`` and ``number`` are the best k so far; an item counts if its rounded
    score is above ``floor``, or equal and its number not above ``last``."""

    def __init__(self, held: Held, vectors: np.ndarray, floors: np.ndarray | None, last: pa.Array | None):
        self.held, self.unit = held, topk._unit_rows(vectors)
        self.narrow, many = self.unit.astype(np.float32), len(vectors)
        self.floor = np.full(many, -np.inf) if floors is None else np.where(np.isnan(floors), -np.inf, floors)
        self.last = np.full(many, len(held.ids)) if last is None else held.upto(last)
        self.score = np.full((many, held.k), -np.inf)
        self.number = np.full((many, held.k), len(held.ids))

    def run(self) -> None:
        held = self.held
        products = np.clip(held.centres @ self.unit.T, -1.0, 1.0)
        nearest = products.argmax(axis=0)
        least = held.least[:, None]
        # the cosine of the angle to the centre less the cell's, and 1 within the cell
        reach = np.where(products >= least, 1.0, products * least + np.sqrt((1.0 - products * products) * (1.0 - least * least)))
        del products
        by = np.argsort(nearest, kind="stable")
        bounds = np.searchsorted(nearest[by], np.arange(len(held.blocks) + 1))
        for cell in np.flatnonzero(np.diff(bounds)):  # what is nearest gives the floor
            self._offer(by[bounds[cell] : bounds[cell + 1]], *held.blocks[cell][0])
        for cell in np.flatnonzero((reach >= self.floor - HALF - SLACK).any(axis=1)):
            near = reach[cell] + SLACK
            for place, (numbers, block) in enumerate(held.blocks[cell]):
                able = near >= self._bar(slice(None), numbers[0])
                if place == 0:
                    able &= nearest != cell
                rows = np.flatnonzero(able)
                if len(rows):
                    self._offer(rows, numbers, block)

    def _bar(self, rows, number) -> np.ndarray:
        """What a score must reach for this number, or one after it, to count."""
        return self.floor[rows] + np.where(self.last[rows] < number, HALF, -HALF)

    def _offer(self, rows: np.ndarray, numbers: np.ndarray, block: np.ndarray) -> None:
        step, k = max(1, topk.SCORES_AT_ONCE // len(numbers)), self.held.k
        for some in (rows[at : at + step] for at in range(0, len(rows), step)):
            scores = self.narrow[some] @ block
            bar = self._bar(some, numbers[0]) - self.held.near
            bare = np.flatnonzero(np.isneginf(bar))
            if len(bare) and len(numbers) > k:  # k items reach the k-th largest
                bar[bare] = np.partition(scores[bare], len(numbers) - k, axis=1)[:, len(numbers) - k] - 2 * (HALF + self.held.near)
            hits = np.flatnonzero(scores >= bar.astype(np.float32)[:, None])
            if not len(hits):
                continue
            row, column = np.divmod(hits, len(numbers))
            first = np.flatnonzero(np.diff(row, prepend=-1))
            place = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))
            # the first hits of a row set the bar for those after them
            query, number, close = some[row], numbers[column], scores.ravel()[hits]
            for wanted in (place < 2 * k, place >= 2 * k):
                at = np.flatnonzero(wanted)
                while len(at):
                    at = at[close[at] >= self._bar(query[at], number[at]) - self.held.near]
                    self._take(query[at[:EXACT_AT_ONCE]], number[at[:EXACT_AT_ONCE]])
                    at = at[EXACT_AT_ONCE:]

    def _take(self, query: np.ndarray, number: np.ndarray) -> None:
        """Scores these pairs exactly and keeps the best k of each query; its floor rises with them."""
        score = topk.round_score(np.einsum("ij,ij->i", self.unit[query], self.held.unit[number]))
        good = (score > self.floor[query]) | ((score == self.floor[query]) & (number <= self.last[query]))
        query, number, score, k = query[good], number[good], score[good], self.held.k
        if not len(query):
            return
        rows = np.unique(query)
        query = np.concatenate([np.repeat(rows, k), query])
        score = np.concatenate([self.score[rows].ravel(), score])
        number = np.concatenate([self.number[rows].ravel(), number])
        order = np.lexsort((number, -score, query))
        first = np.searchsorted(query[order], rows)
        kept = order[(first[:, None] + np.arange(k)).ravel()]
        self.score[rows], self.number[rows] = score[kept].reshape(-1, k), number[kept].reshape(-1, k)
        least, before = self.score[rows, -1], self.number[rows, -1] - 1
        same = least == self.floor[rows]
        self.last[rows] = np.where(least > self.floor[rows], before, np.where(same, np.minimum(self.last[rows], before), self.last[rows]))
        self.floor[rows] = np.maximum(self.floor[rows], least)


def _streamed(items: DataFrame, queries: DataFrame, k: int, groups: int) -> DataFrame:
    """``_query, _item, _score``: the best k of each query in each group it was sent to."""
    together = items.unionByName(_query_rows(queries, items.schema["_item"].dataType.simpleString()), allowMissingColumns=True)
    # a partition for each group: dealt by hash, some tasks had several groups and others none
    sorted_rows = together.repartitionById(max(1, groups), F.col("_group")).sortWithinPartitions("_group", "_kind")
    kinds = {f.name: f.dataType.simpleString() for f in together.schema.fields}
    output = f"_query {kinds['_query']}, _item {kinds['_item']}, _score double"

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting, held = None, [], None
        for batch in batches:
            codes, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_group", "_kind"))
            cuts = np.flatnonzero((np.diff(codes, prepend=codes[:1] - 1) != 0) | (np.diff(kind, prepend=0) != 0))
            for start, stop in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                part = batch.slice(start, stop - start)
                if codes[start] != group:
                    group, waiting, held = codes[start], [], None
                if kind[start] == 0:
                    waiting.append(part.select(["_item", "_vector"]))
                    continue
                if held is None and not waiting:
                    continue
                if held is None:
                    table = pa.Table.from_batches(waiting).combine_chunks()
                    held, waiting = Held(topk._one_chunk(table.column("_item")), topk.dense(table.column("_vector")), k), []
                for begin in range(0, part.num_rows, AT_ONCE):
                    some = part.slice(begin, AT_ONCE)
                    query, number, score = held.best(topk.dense(some.column("_query_vector")), some.column("_floor").to_numpy(zero_copy_only=False).astype(np.float64), some.column("_last"))
                    yield pa.RecordBatch.from_arrays([some.column("_query").take(pa.array(query)), held.ids.take(pa.array(number)), pa.array(score)], names=["_query", "_item", "_score"])

    return sorted_rows.mapInArrow(answered, output)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query, with ``_rank``. A query's partial results meet in 64 tasks before they meet in one."""
    columns = ["_query", "_item", "_score"]
    for keys in (["_query", F.pmod(F.xxhash64("_item"), F.lit(64))], ["_query"]):
        order = Window.partitionBy(*keys).orderBy(F.col("_score").desc(), F.col("_item"))
        found = found.select(*columns).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    return found


def with_payload(best: DataFrame, items: DataFrame, payload: Sequence[str], query_name: str, score_name: str) -> DataFrame:
    """Kept columns for the best items, fetched by id. The best are sent to the items only if they are counted to be few;
    sizes of files, by which the optimizer would decide, say little of rows that repeat."""
    wanted = [name for name in payload if name != "_item"]
    written = settled(best, "nearest-best")
    few = broadcast_if_small(written, "_item")
    kept = written.hint("merge") if few is None else few
    columns = [query_name, *wanted, F.col("_score").alias(score_name), F.col("_rank").alias("rank")]
    rows = items.select(F.col("_item").alias("_id"), *wanted).join(kept, F.col("_id").eqNullSafe(F.col("_item")))
    return rows.withColumnRenamed("_query", query_name).select(*columns)


def _most_items(numbers: int) -> int:
    """Items of a group at most. Queries are sent to each group they can find something in, so groups are as large as a
    task can well hold."""
    return max(1, min(topk.ITEMS_PER_BLOCK, GROUP_BYTES // (8 * max(1, numbers))))


def _group_size(spark, rows: int, numbers: int) -> int:
    return max(1, min(_most_items(numbers), -(-rows // (GROUPS_PER_CORE * spark.sparkContext.defaultParallelism))))


def _past_held_items(items: pa.Table, queries: DataFrame, k: int) -> DataFrame:
    """The same where the items were found to be few: they are sent to the tasks and the queries stream past them, so
    neither side is shuffled and a query's best are found in one place."""
    shipped = queries.sparkSession.sparkContext.broadcast(items.select(["_item", "_vector"]))
    kinds = queries.schema["_query"].dataType, items.schema.field("_item").type
    output = T.StructType([T.StructField("_query", kinds[0]), T.StructField("_item", from_arrow_type(kinds[1])), T.StructField("_score", T.DoubleType()), T.StructField("_rank", T.IntegerType())])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        held = Held(topk._one_chunk(table.column("_item").combine_chunks()), topk.dense(table.column("_vector")), k)
        for batch in batches:
            for begin in range(0, batch.num_rows if len(held.ids) else 0, AT_ONCE):
                some = batch.slice(begin, AT_ONCE)
                query, number, score = held.best(topk.dense(some.column("_query_vector")))
                place = np.arange(len(query)) - np.searchsorted(query, query)
                columns = [some.column("_query").take(pa.array(query)), held.ids.take(pa.array(number)), pa.array(score), pa.array(place.astype(np.int32) + 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["_query", "_item", "_score", "_rank"])

    return spread(queries.select("_query", "_query_vector")).mapInArrow(answered, output)


def nearest_by_pivots(items: DataFrame, queries: DataFrame, payload: Sequence[str], k: int, query_name: str, score_name: str) -> DataFrame:
    """``_item, _vector`` and payload, ``_query, _query_vector`` to the best k items of each query by cosine."""
    spark = items.sparkSession
    vectors = items.select("_item", "_vector")
    held = topk.few_rows(vectors, F.size("_vector") * 8, HELD_ITEMS)
    if held is not None and held.num_rows:
        return with_payload(_past_held_items(held, queries, k), items, payload, query_name, score_name)
    rows, numbers = vectors.agg(F.count(F.lit(1)), F.max(F.size("_vector"))).first()
    size = _group_size(spark, rows, numbers or 0)
    pivots = choose_pivots(vectors, rows, min(MOST_PIVOTS, CELLS_PER_GROUP * -(-rows // size))) if rows else np.zeros((0, 0))
    if not len(pivots):
        empty = queries.limit(0).join(items.limit(0).select(*payload), F.lit(False)).select(F.col("_query").alias(query_name), *[p for p in payload if p != "_item"])
        return empty.withColumns({score_name: F.lit(0.0), "rank": F.lit(0)})
    dealt = _with_cell(vectors, "_vector", pivots)
    cells = {r["_cell"]: (r["n"], r["angle"]) for r in dealt.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_angle").alias("angle")).collect()}
    filled = sorted(cells)  # a query is sent to none of the others
    parts = _packed({cell: n for cell, (n, _) in cells.items()}, size, _neighbours(pivots, filled, -(-rows // size)))
    groups = max(first + many for first, many in parts.values())
    placed = _item_rows(dealt, _part_table(spark, parts))
    centres, places = pivots[filled], [parts[cell] for cell in filled]
    table = _part_table(spark, dict(enumerate(places)))
    asked = _with_cell(queries.select("_query", "_query_vector"), "_query_vector", centres)
    # own group: one part of the own cell
    own = asked.join(table, "_cell").withColumn("_group", F.col("_first") + F.pmod(F.xxhash64("_query"), F.col("_many")).cast("int"))
    own = own.withColumn("_floor", F.lit(None).cast("double"))
    first = settled(_streamed(placed, own, k, groups), "nearest-first")
    worst = F.max(F.struct((-F.col("_score")).alias("s"), F.col("_item").alias("i")))
    floors = first.groupBy("_query").agg(F.count(F.lit(1)).alias("n"), worst.alias("w")).where(F.col("n") >= k)
    floors = floors.select(F.col("_query").alias("_of"), (-F.col("w.s")).alias("_floor"), F.col("w.i").alias("_last")).hint("merge")
    again = own.drop("_floor", "_first", "_many", "_cell").withColumnRenamed("_group", "_own").join(floors, F.col("_query").eqNullSafe(F.col("_of")), "left")
    widest = np.array([cells[cell][1] for cell in filled])
    each = again.withColumn("_group", F.explode(_reach(again, centres, widest, places))).where(F.col("_group") != F.col("_own"))
    found = first.unionByName(_streamed(placed, each, k, groups))
    return with_payload(merged(found, k), items, payload, query_name, score_name)


def _reach(queries: DataFrame, pivots: np.ndarray, widest: np.ndarray, places: Sequence[tuple[int, int]]) -> Column:
    """Groups of the cells that can hold an item as near as the query's floor. ``places``: each cell's first group and
    number of groups."""
    order = np.array(sorted(range(len(places)), key=lambda cell: places[cell]))
    first, many = np.array([places[cell] for cell in order]).T
    starts = np.flatnonzero(np.diff(first, prepend=-1))  # cells of one group follow each other
    shipped = queries.sparkSession.sparkContext.broadcast((pivots[order], widest[order], starts, many[starts]))

    @F.arrow_udf("array<int>")
    def reach(vectors: pa.Array, floors: pa.Array) -> pa.Array:
        centres, widest, starts, many = shipped.value
        floor = np.nan_to_num(floors.to_numpy(zero_copy_only=False).astype(np.float64), nan=-2.0)
        reached = []
        for angles in _angles(vectors, centres):
            done = sum(map(len, reached))
            least = np.maximum(angles - widest - SLACK, 0.0)
            able = np.cos(np.minimum(least, np.pi)) >= floor[done : done + len(least), None] - MARGIN
            reached.append(np.repeat(np.logical_or.reduceat(able, starts, axis=1), many, axis=1))
        row, group = np.nonzero(np.concatenate(reached)) if reached else (np.empty(0, np.int64), np.empty(0, np.int64))
        ends = np.searchsorted(row, np.arange(len(vectors) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(group.astype(np.int32)))

    return reach(F.col("_query_vector").cast("array<double>"), F.col("_floor"))


def nearest_by_probes(items: DataFrame, queries: DataFrame, payload: Sequence[str], k: int, query_name: str, score_name: str) -> DataFrame:
    """The same where items have a ``_cell`` and queries the ``_probes`` they look into, and only those."""
    spark = items.sparkSession
    cells = items.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_vector")).alias("numbers")).collect()  # a row per cell
    parts = _parts({r["_cell"]: r["n"] for r in cells}, _most_items(max((r["numbers"] or 0 for r in cells), default=0)))
    table = _part_table(spark, parts)
    looking = queries.select("_query", "_query_vector", F.explode("_probes").alias("_cell")).join(table, "_cell")
    each = looking.withColumn("_group", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_many") - 1)))
    found = _streamed(_item_rows(items, table), each.withColumn("_floor", F.lit(None).cast("double")), k, max(1, sum(m for _, m in parts.values())))
    return with_payload(merged(found, k), items, payload, query_name, score_name)
