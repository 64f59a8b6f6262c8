"""Vector search: exact nearest marks, and the cell-pruned variant for large registers."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import INDEX_FROM_ROWS, MAX_CELLS, ROWS_PER_CELL
from ..functions.numbers import rounded
from ..functions.vectors import unit
from ..schema import VECTOR_COLUMNS
from .pivots import nearest_by_pivots, nearest_by_probes
from .topk import SCAN_QUERIES, Cosine, CosineInCells, TopK, dense, few_rows, usable_vectors

ROWS_PER_FILE = 1_000_000


def _usable(vector: Column, dim: int) -> Column:
    """The right size. Vectors with missing or endless numbers, or of length zero, get no score in the tasks."""
    return F.size(vector) == dim


def single_size(vectors: DataFrame, vector: str) -> int:
    """The one size that all vectors have; 0 where there are none. Several sizes are an error: which of them is meant
    is for the caller to say with ``dim``, as rows of the others would otherwise go missing unseen."""
    found = vectors.where(F.size(vector) > 0).agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if found[0] != found[1]:
        raise ValueError(f"{vector} holds vectors of {found[0]} to {found[1]} numbers: give the size as dim")
    return found[0] or 0


def why_unusable(vector: Column, dim: int) -> Column:
    """Reason why a vector cannot be searched with, or null."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    endless = F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(vector.isNull() | (F.size(vector) == 0), "no vector")
        .when(F.size(vector) != dim, "vector of another size")
        .when(endless, "vector without all its numbers")
        .when(F.forall(numbers, lambda x: x == 0), "vector of length zero")
    )


def unusable_queries(
    queries: DataFrame, dim: int, *, query_id: str = "query_id", query_vector: str = "query_vector"
) -> DataFrame:
    """Queries that no vector search answers, and the ``reason``."""
    return queries.select(query_id, why_unusable(F.col(query_vector), dim).alias("reason")).where("reason IS NOT NULL")


def _query_side(queries: DataFrame, query_id: str, query_vector: str, scan_queries: int, dim: int | None, *extra: str):
    """Queries under the names the kernels read, their vector size, and their rows if these are few."""
    named = queries.where(F.size(query_vector) > 0).select(
        F.col(query_id).alias("_query"), F.col(query_vector).alias("_query_vector"), *extra
    )
    dim = single_size(named, "_query_vector") if dim is None else dim
    asked = named.where(_usable(F.col("_query_vector"), dim))
    head = few_rows(asked, F.size("_query_vector") * 8, scan_queries)
    return asked, dim, None if head is None else usable_vectors(head, "_query_vector", dim)


def nearest(
    register: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    item_id: str = "id",
    vector: str = "text_vector",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    keep: Sequence[str] | None = None,
    where: Column | None = None,
    prefilter: bool = True,
    dim: int | None = None,
    score_name: str = "similarity_score",
    scan_queries: int = SCAN_QUERIES,
) -> DataFrame:
    """Top ``k`` rows of the register per query by cosine: query id, kept columns, score (4 digits), rank.

    ``where`` filters before the top k is taken, or with ``prefilter=False`` after it, which can leave fewer rows.
    ``dim`` is the vector size searched for; left out, all queries must be of one size. Rows whose vector is missing,
    of another size or of length zero take no part; ``unusable_queries`` names such queries.
    """
    keep = _kept(register, vector, keep)
    asked, dim, head = _query_side(queries, query_id, query_vector, scan_queries, dim)
    rows, keep, after = _filtered(register, keep, where, prefilter)
    items = rows.where(_usable(F.col(vector), dim)).select(
        F.col(item_id).alias("_item"), F.col(vector).alias("_vector"), *keep
    )
    if head is None:
        found = nearest_by_pivots(items, asked, ["_item", *keep], k, query_id, score_name)
    else:
        found = TopK(items, asked, ["_item", *keep], Cosine, k, query_id, score_name, head).run()
    return found.where("_passes").drop("_passes") if after else found


def _filtered(rows: DataFrame, keep: list[str], where: Column | None, prefilter: bool):
    """The rows to search, the columns to keep, and whether rows are filtered by ``_passes`` afterwards."""
    if where is None:
        return rows, keep, False
    if prefilter:
        return rows.where(where), keep, False
    return rows.withColumn("_passes", where), [*keep, "_passes"], True


def _kept(register: DataFrame, vector: str, keep: Sequence[str] | None) -> list[str]:
    if keep is not None:
        return list(keep)
    return [c for c in register.columns if c not in (*VECTOR_COLUMNS, vector, "cell")]


def cells_for(rows: int) -> int:
    """Number of cells the index uses: about the square root of the rows, so cells and rows per cell grow alike."""
    return max(1, math.isqrt(rows))


def capped_cells(rows: int) -> int:
    """The other usual number, an option of ``build_index``: one per 100 rows, 256 at most."""
    return max(1, min(MAX_CELLS, rows // ROWS_PER_CELL))


def train_cells(
    register: DataFrame,
    *,
    vector: str = "text_vector",
    cells: int,
    dim: int,
    sample: float | None = None,
    seed: int = 42,
) -> np.ndarray:
    """Cell centres by cosine k-means over all rows with a usable vector, or over the share ``sample`` of them."""
    points = register.where(_usable(F.col(vector), dim)).select(unit(F.col(vector)).alias("v"))
    if sample is not None:
        points = points.sample(fraction=sample, seed=seed)
    points = points.where("v IS NOT NULL").select(array_to_vector("v").alias("features"))
    if cells == 1:  # k-means wants two; a single centre is the mean
        mean = points.agg(Summarizer.mean(F.col("features"))).first()[0]
        return np.zeros((1, dim)) if mean is None else mean.toArray()[None, :]
    points = points.persist()
    model = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=20).fit(points)
    points.unpersist()
    return np.array(model.clusterCenters())


def assign_cells(register: DataFrame, centres: np.ndarray, *, vector: str = "text_vector") -> DataFrame:
    """Adds ``cell``, the centre with the largest cosine. One narrow pass; rows without a usable vector get null."""
    dim = centres.shape[1]
    shipped = register.sparkSession.sparkContext.broadcast(_unit_matrix(centres))

    @F.arrow_udf("int")
    def cell_of(vectors: pa.Array) -> pa.Array:
        return pa.array((dense(vectors) @ shipped.value.T).argmax(axis=1), pa.int32())

    usable = _usable(F.col(vector), dim)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return register.withColumn(
        "cell", F.when(usable, cell_of(F.when(usable, F.col(vector).cast("array<float>")).otherwise(zeros)))
    )


def _unit_matrix(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length > 0, length, 1.0)


@dataclass(frozen=True)
class CellIndex:
    """The register stored by cell, and the cell centres."""

    rows: DataFrame
    centres: np.ndarray
    vector: str


def build_index(
    register: DataFrame,
    path: str,
    *,
    item_id: str = "id",
    vector: str = "text_vector",
    cells: int | None = None,
    dim: int | None = None,
    sample: float | None = None,
) -> CellIndex:
    """Trains cells, assigns every row and writes the register by cell, so a search reads only the cells it probes.

    A cell is spread over files of about a million rows by a hash of the id, however large it is. ``dim`` is the
    vector size; left out, all vectors must be of one size. Rows without a vector of that size are left out.
    """
    dim = single_size(register, vector) if dim is None else dim
    if not dim:
        raise ValueError("the register holds no vectors")
    rows = register.where(_usable(F.col(vector), dim)).count()
    centres = train_cells(register, vector=vector, cells=cells or cells_for(rows), dim=dim, sample=sample)
    assigned = assign_cells(register, centres, vector=vector).where(F.col("cell").isNotNull())
    # one number per cell
    counts = {r["cell"]: r["count"] for r in assigned.groupBy("cell").count().collect()}
    per_cell = [math.ceil(counts.get(cell, 0) / ROWS_PER_FILE) or 1 for cell in range(len(centres))]
    part = F.pmod(F.xxhash64(item_id), F.get(F.array(*map(F.lit, per_cell)), F.col("cell")))
    assigned.repartition(sum(per_cell), "cell", part).write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/rows")
    spark = register.sparkSession
    numbered = pa.table({"cell": pa.array(range(len(centres)), pa.int32()), "centre": centres.tolist()})
    spark.createDataFrame(numbered).coalesce(1).write.parquet(f"{path}/centres")
    return open_index(spark, path, vector=vector)


def open_index(spark: SparkSession, path: str, *, vector: str = "text_vector") -> CellIndex:
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return CellIndex(spark.read.parquet(f"{path}/rows"), np.array([r["centre"] for r in centres]), vector)


def ensure_index(register: DataFrame, path: str, *, mode: str, **options) -> CellIndex | None:
    """An index if ``mode`` is ``cells``; none, hence exact search, if it is ``exact``. The size of the register never
    decides: ``index_advised`` says what it would suggest."""
    if mode not in ("exact", "cells"):
        raise ValueError("mode is exact or cells")
    return build_index(register, path, **options) if mode == "cells" else None


def index_advised(rows: int) -> bool:
    return rows >= INDEX_FROM_ROWS


def with_probes(queries: DataFrame, centres: np.ndarray, nprobe: int, *, query_vector: str = "query_vector") -> DataFrame:
    """Adds ``_probes``, the ``nprobe`` cells nearest to the query."""
    shipped = queries.sparkSession.sparkContext.broadcast(_unit_matrix(centres))

    @F.arrow_udf("array<int>")
    def probes_of(vectors: pa.Array) -> pa.Array:
        order = np.argsort(-(dense(vectors) @ shipped.value.T), axis=1, kind="stable")
        return pa.array(list(order[:, :nprobe].astype(np.int32)), pa.list_(pa.int32()))

    return queries.withColumn("_probes", probes_of(F.col(query_vector).cast("array<float>")))


def nearest_in_cells(
    index: CellIndex,
    queries: DataFrame,
    k: int,
    nprobe: int,
    *,
    item_id: str = "id",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    keep: Sequence[str] | None = None,
    where: Column | None = None,
    prefilter: bool = True,
    score_name: str = "similarity_score",
    scan_queries: int = SCAN_QUERIES,
    changed: DataFrame | None = None,
) -> DataFrame:
    """Top ``k`` among the ``nprobe`` cells nearest to each query, by exact cosine. All cells probed = ``nearest``.

    ``where`` filters the rows of the probed cells before the top k is taken, or after it, as in ``nearest``. ``changed``
    are rows of the register, of unique keys, that have come or changed since the index was built.
    """
    held = index.rows
    if changed is not None:
        fresh = assign_cells(changed, index.centres, vector=index.vector).where(F.col("cell").isNotNull())
        held = held.join(changed.select(item_id), item_id, "left_anti").unionByName(fresh.select(*held.columns))
    keep = _kept(held, index.vector, keep)
    dim = index.centres.shape[1]
    usable = queries.where(_usable(F.col(query_vector), dim))
    probing = with_probes(usable, index.centres, nprobe, query_vector=query_vector)
    asked, _, head = _query_side(probing, query_id, query_vector, scan_queries, dim, "_probes")
    rows, keep, after = _filtered(held, keep, where, prefilter)
    if nprobe < len(index.centres):
        # at most one number per cell
        probed = asked.select(F.explode("_probes").alias("cell")).distinct().collect()
        rows = rows.where(F.col("cell").isin([r["cell"] for r in probed]))
    items = rows.select(
        F.col(item_id).alias("_item"), F.col(index.vector).alias("_vector"), F.col("cell").alias("_cell"), *keep
    )
    if head is None:
        found = nearest_by_probes(items, asked, ["_item", *keep], k, query_id, score_name)
    else:
        found = TopK(items, asked, ["_item", *keep], CosineInCells, k, query_id, score_name, head).run()
    return found.where("_passes").drop("_passes") if after else found


def search_vectors(register: DataFrame, queries: DataFrame, k: int, *, index=None, nprobe: int = 32, **names) -> DataFrame:
    """Through the index if there is one, a ``CellIndex`` or a ``celltree.CellTree``, else exact over the register.

    An index answers from the rows it holds. A ``CellTree`` is given changed rows by ``upsert_rows``; a ``CellIndex`` is
    handed them as ``changed`` with every search, keys of which hide the rows it holds.
    """
    if index is None:
        names.pop("changed", None)
        return nearest(register, queries, k, **names)
    names.pop("vector", None)
    dim, held = names.pop("dim", None), index.centres.shape[1] if isinstance(index, CellIndex) else index.dim
    if dim not in (None, held):
        raise ValueError(f"the index holds vectors of {held} numbers, not of {dim}")
    if not isinstance(index, CellIndex):
        return index.search(queries, k, nprobe, **names)
    return nearest_in_cells(index, queries, k, nprobe, **names)


def recall(approximate: DataFrame, exact: DataFrame, *, query_id: str = "query_id", item_id: str = "id") -> DataFrame:
    """Share of the exact top k that the approximate search found, per query."""
    hit = approximate.select(query_id, item_id).withColumn("_hit", F.lit(1))
    return (
        exact.select(query_id, item_id)
        .join(hit, [query_id, item_id], "left")
        .groupBy(query_id)
        .agg(rounded(F.count("_hit") / F.count(F.lit(1)), 4).alias("recall"))
    )
