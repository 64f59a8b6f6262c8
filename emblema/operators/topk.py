"""Best k items for each query of a batch, scored inside Spark tasks.

The batch of queries is checked to be small, shipped to the tasks, and the items are read once. A task keeps its best k
per query while it streams, so it sends on at most k rows per query. Items are never shuffled. For any number of queries
``pivots`` (vectors) and ``postings`` (words) give the same rows.

What the tasks sent is merged by query and bucket first where there are many tasks, and then by query. Scores are rounded
to four digits before ranking and the item id decides ties, so all plans and any partitioning agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCAN_QUERIES = 4096
SCAN_BYTES = 64 << 20
ITEMS_PER_BLOCK = 65_536
QUERIES_PER_BLOCK = 2048
#: From more tasks than this, a query's partial results are merged in two steps.
MERGED_AT_ONCE = 64
SCORES_AT_ONCE = 1_000_000
#: Words of a batch that are looked at together; a word may spread over many queries.
WORDS_AT_ONCE = 65_536
DIGITS = 10_000.0


def round_score(scores: np.ndarray) -> np.ndarray:
    """Four digits, halves away from zero, as SQL rounds."""
    return np.copysign(np.floor(np.abs(scores) * DIGITS + 0.5) / DIGITS, scores) + 0.0


class BestSoFar:
    """The best k items per query seen by one task."""

    def __init__(self, queries: int, k: int, id_column: str):
        self.k = k
        self.id_column = id_column
        self.floor = np.full(queries, -np.inf)
        self.query = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.row = np.empty(0, dtype=np.int64)
        self.pool: pa.Table | None = None

    def offer(self, batch: pa.RecordBatch, scores: np.ndarray) -> None:
        """``scores`` has a row per item and a column per query; NaN means no match."""
        fresh = np.flatnonzero(np.isneginf(self.floor))
        if len(fresh) and len(scores) > self.k:
            known = np.where(np.isnan(scores[:, fresh]), -np.inf, scores[:, fresh])
            self.floor[fresh] = np.partition(known, len(scores) - self.k, axis=0)[len(scores) - self.k]
        # rounding can lift a score to the floor, so what is that close is looked at; NaN passes no comparison
        rows, queries = np.nonzero((scores >= self.floor - 1.0 / DIGITS) & (scores > -np.inf))
        if len(rows) == 0:
            return
        kept, position = np.unique(rows, return_inverse=True)
        fresh = pa.Table.from_batches([batch.take(pa.array(kept))])
        offset = 0 if self.pool is None else self.pool.num_rows
        self.pool = fresh if self.pool is None else pa.concat_tables([self.pool, fresh])
        self.query = np.concatenate([self.query, queries])
        self.score = np.concatenate([self.score, round_score(scores[rows, queries])])
        self.row = np.concatenate([self.row, position + offset])
        self._prune()

    def _prune(self) -> None:
        ids = self.pool.column(self.id_column).to_numpy()
        _, id_rank = np.unique(ids, return_inverse=True)
        order = np.lexsort((id_rank[self.row], -self.score, self.query))
        query = self.query[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        lengths = np.diff(np.r_[starts, len(query)])
        rank = np.arange(len(query)) - np.repeat(starts, lengths)
        keep = order[rank < self.k]
        full = starts[lengths >= self.k]
        self.floor[query[full]] = np.maximum(self.floor[query[full]], self.score[order[full + self.k - 1]])
        self.query, self.score = self.query[keep], self.score[keep]
        used, self.row = np.unique(self.row[keep], return_inverse=True)
        self.pool = self.pool.take(pa.array(used)).combine_chunks()

    def result(self, query_ids: pa.Array, payload: Sequence[str], schema: pa.Schema) -> pa.RecordBatch | None:
        if self.pool is None:
            return None
        rows = self.pool.take(pa.array(self.row))
        columns = [query_ids.take(pa.array(self.query))]
        columns += [rows.column(name).combine_chunks() for name in payload]
        columns.append(pa.array(self.score))
        arrays = [c.cast(f.type) if c.type != f.type else c for c, f in zip(map(_one_chunk, columns), schema)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _one_chunk(column):
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


class Cosine:
    """Cosine of item vectors against a block of query vectors; columns ``_vector`` and ``_query_vector``."""

    def __init__(self, queries: pa.Table):
        self.query_ids = _one_chunk(queries.column("_query").combine_chunks())
        self.matrix = _unit_rows(dense(queries.column("_query_vector"))).T

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        return _unit_rows(dense(batch.column("_vector"))) @ self.matrix


class CosineInCells(Cosine):
    """Cosine only where the query looks into the item's cell; columns ``_cell`` and ``_probes``."""

    def __init__(self, queries: pa.Table):
        super().__init__(queries)
        probes = queries.column("_probes").to_pylist()
        self.lookers: dict[int, np.ndarray] = {}
        for cell in {c for cells in probes for c in cells}:
            self.lookers[cell] = np.array([i for i, cells in enumerate(probes) if cell in cells])

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.full((batch.num_rows, len(self.query_ids)), np.nan)
        cells = batch.column("_cell").to_numpy(zero_copy_only=False)
        items = _unit_rows(dense(batch.column("_vector")))
        for cell in np.unique(cells):
            queries = self.lookers.get(int(cell))
            if queries is not None:
                rows = np.flatnonzero(cells == cell)
                out[np.ix_(rows, queries)] = items[rows] @ self.matrix[:, queries]
        return out


class WeightedTerms:
    """BM25 of token lists against query terms of positive weight; columns ``_tokens``, ``_terms``, ``_weights``.

    ``saturation`` is (k1, b, average length), or None to add the weights of the distinct terms an item holds.
    """

    def __init__(self, queries: pa.Table, saturation: tuple[float, float, float] | None):
        self.query_ids = _one_chunk(queries.column("_query").combine_chunks())
        self.saturation = saturation
        terms = _one_chunk(queries.column("_terms").combine_chunks())
        owner = np.repeat(np.arange(len(terms)), terms.value_lengths().to_numpy(zero_copy_only=False))
        weights = _one_chunk(queries.column("_weights").combine_chunks()).flatten().to_numpy(zero_copy_only=False)
        coded = terms.flatten().dictionary_encode()
        self.vocabulary = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        self.owner, self.weight = owner[order], weights[order]
        self.users = np.bincount(codes, minlength=len(self.vocabulary))
        self.first = np.concatenate([[0], np.cumsum(self.users)[:-1]])

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        tokens, out = batch.column("_tokens"), np.empty((batch.num_rows, len(self.query_ids)))
        for start, stop in stretches(tokens):
            out[start:stop] = self._score(tokens.slice(start, stop - start))
        return out

    def _score(self, tokens: pa.Array) -> np.ndarray:
        many = len(tokens)
        lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = pa.compute.index_in(tokens.flatten(), value_set=self.vocabulary)
        known = codes.is_valid().to_numpy(zero_copy_only=False)
        item = np.repeat(np.arange(many), lengths)[known]
        code = codes.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        pair, count = np.unique(item * len(self.vocabulary) + code, return_counts=True)
        item, code = pair // max(len(self.vocabulary), 1), pair % max(len(self.vocabulary), 1)
        if self.saturation is None:
            part = np.ones(len(pair))
        else:
            k1, b, average = self.saturation
            part = count * (k1 + 1.0) / (count + k1 * (1.0 - b + b * lengths[item] / average))
        # every matched word spreads over the queries that use it
        users = self.users[code]
        spread = np.repeat(np.arange(len(pair)), users)
        within = np.arange(len(spread)) - np.repeat(np.cumsum(users) - users, users)
        use = self.first[code[spread]] + within
        cell = item[spread] * len(self.query_ids) + self.owner[use]
        total = np.bincount(cell, self.weight[use] * part[spread], many * len(self.query_ids))
        return np.where(total > 0, total, np.nan).reshape(many, len(self.query_ids))


def stretches(tokens: pa.ListArray, words: int | None = None) -> Iterator[tuple[int, int]]:
    """Rows of a column of lists, from and to, cut so that each stretch holds some ``WORDS_AT_ONCE`` words or is one row."""
    ends = np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + (words or WORDS_AT_ONCE), side="right")))
        yield start, stop
        start = stop


def usable_vectors(table: pa.Table, column: str, dim: int) -> pa.Table:
    """Rows whose vector has the given size and only finite numbers."""
    sized = table.filter(pa.array([v is not None and len(v) == dim for v in table.column(column)], pa.bool_()))
    return sized.filter(pa.array(np.isfinite(dense(sized.column(column))).all(axis=1))) if sized.num_rows else sized


def dense(column) -> np.ndarray:
    values = _one_chunk(column.combine_chunks()) if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.full_like(matrix, np.nan), where=length > 0)


def _best_of(kernel, batches: Iterator[pa.RecordBatch], k: int, payload, schema) -> pa.RecordBatch | None:
    best = BestSoFar(len(kernel.query_ids), k, "_item")
    kept = list(dict.fromkeys(["_item", *payload]))  # what is scored is not held
    step = max(1, SCORES_AT_ONCE // max(1, len(kernel.query_ids)))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            best.offer(part.select(kept), kernel.score(part))
    return best.result(kernel.query_ids, payload, schema)


@dataclass
class TopK:
    """One scoring job. ``kernel`` builds a scorer from a table of queries.

    ``items``   columns ``_item`` (unique id), the features the kernel reads, and the payload to hand back.
    ``queries`` columns ``_query`` (unique id) and the features the kernel reads.
    ``head``    the queries, already read.
    """

    items: DataFrame
    queries: DataFrame
    payload: Sequence[str]
    kernel: Callable[[pa.Table], object]
    k: int
    query_name: str
    score_name: str
    head: pa.Table

    def _output(self) -> T.StructType:
        fields = [T.StructField(self.query_name, self.queries.schema["_query"].dataType)]
        fields += [T.StructField(name, self.items.schema[name].dataType) for name in self.payload]
        return T.StructType([*fields, T.StructField("_score", T.DoubleType())])

    def run(self) -> DataFrame:
        """Rows (query, payload, score, rank)."""
        found = self._scan(self.head)
        many = self.items.rdd.getNumPartitions() > MERGED_AT_ONCE
        for keys in ([self.query_name, F.pmod(F.xxhash64("_item"), F.lit(MERGED_AT_ONCE))], [self.query_name])[0 if many else 1 :]:
            order = Window.partitionBy(*keys).orderBy(F.col("_score").desc(), F.col("_item"))
            found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)
        wanted = [name for name in self.payload if name != "_item"]
        return found.select(self.query_name, *wanted, F.col("_score").alias(self.score_name), "rank")

    def _scan(self, queries: pa.Table) -> DataFrame:
        # the table itself is sent: a broadcast value must not need this package to be installed on the executors
        shipped = self.items.sparkSession.sparkContext.broadcast(queries)
        kernel, payload, k, output = self.kernel, list(self.payload), self.k, self._output()
        schema = _arrow_schema(output)

        def best_in_partition(batches):
            found = _best_of(kernel(shipped.value), batches, k, payload, schema)
            if found is not None:
                yield found

        return self.items.mapInArrow(best_in_partition, output)


def few_rows(queries: DataFrame, width: Column, rows: int = SCAN_QUERIES, size: int = SCAN_BYTES) -> pa.Table | None:
    """The queries if a count shows at most so many rows and bytes, else None. ``width`` is the size of a row."""
    total = queries.agg(F.count(F.lit(1)).alias("rows"), F.sum(width.cast("bigint")).alias("bytes")).first()
    return queries.toArrow() if total["rows"] <= rows and (total["bytes"] or 0) <= size else None


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
