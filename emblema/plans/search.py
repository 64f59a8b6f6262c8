"""The search a user of the register calls: text, vector or filter only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import RRF_K, SEARCH_LIMIT
from ..operators.celltree import CellTree
from ..operators.filters import first_rows, register_condition
from ..operators.lexical import bm25, reciprocal_rank_fusion
from ..operators.nearest import CellIndex, nearest, search_vectors
from ..operators.postings import Postings, bm25_stored
from ..schema import without_vectors

_KEEP_NULLS = {"ignoreNullFields": "false"}


def hybrid_search(
    register: DataFrame,
    query_text: str = "",
    query_vector: Sequence[float] | None = None,
    nice_classes: Sequence[int] = (),
    status: str = "",
    country: str = "",
    filing_date_after: str = "",
    limit: int = SEARCH_LIMIT,
    *,
    vector: str = "text_vector",
    prefilter: bool = True,
    index: CellIndex | CellTree | None = None,
    nprobe: int = 32,
    changed: DataFrame | None = None,
) -> DataFrame:
    """Register rows without vectors.

    With a vector: the ``limit`` nearest by cosine that pass the filters, with ``similarity_score``; the text is then
    not matched. With an ``index`` the ``nprobe`` nearest of its cells are read, and not the register: rows that came or
    changed since it was built are put in by ``celltree.upsert_rows``, or handed over as ``changed``. Without a vector: rows
    that pass the filters, the name containing the text if there is one.
    """
    filters = dict(nice_classes=nice_classes, status=status, country=country, filing_date_after=filing_date_after)
    if query_vector is not None and len(query_vector) > 0:
        query = register.sparkSession.createDataFrame(
            [(0, [float(x) for x in query_vector])], "query_id int, query_vector array<double>"
        )
        found = search_vectors(
            register, query, limit, index=index, nprobe=nprobe, vector=vector,
            where=register_condition(**filters), prefilter=prefilter, **({} if changed is None else {"changed": changed}),
        )
        return found.drop("query_id", "rank").orderBy(F.col("similarity_score").desc(), "id")
    condition = register_condition(query_text=query_text, **filters)
    rows = register if condition is None else register.where(condition)
    return first_rows(without_vectors(rows), limit)


def fused_search(
    register: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    depth: int = 100,
    item_id: str = "id",
    text: str = "mark_name",
    vector: str = "text_vector",
    query_id: str = "query_id",
    query_text: str = "query_text",
    query_vector: str = "query_vector",
    constant: int = RRF_K,
    index: CellIndex | None = None,
    postings: Postings | None = None,
) -> DataFrame:
    """Vector ranking and word ranking, each to ``depth``, fused by rank. With ``postings``, an index of the register's
    ``text`` by ``item_id``, words are looked up there and no text is read."""
    dense = search_vectors(
        register, queries, depth, index=index, item_id=item_id, vector=vector, query_id=query_id,
        query_vector=query_vector, keep=[item_id],
    )
    asked = dict(query_id=query_id, query_text=query_text)
    if postings is None:
        lexical = bm25(register, queries, depth, doc_id=item_id, text=text, **asked)
    else:
        lexical = bm25_stored(postings, queries, depth, **asked)
    return reciprocal_rank_fusion([dense, lexical], k, query_id=query_id, item_id=item_id, constant=constant)


def image_search(register: DataFrame, queries: DataFrame, k: int, **names) -> DataFrame:
    """Nearest marks by image vector."""
    return nearest(register, queries, k, vector="image_vector", **names)


def response(rows: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """One row with one JSON text for a caller outside Spark: success, count, results. Holds ``limit`` rows at most,
    the first by application number and id."""
    first = first_rows(without_vectors(rows), limit)
    packed = first.agg(F.sort_array(F.collect_list(F.struct(*first.columns))).alias("results"))
    return packed.select(
        F.to_json(
            F.struct(F.lit(True).alias("success"), F.size("results").alias("count"), "results"), _KEEP_NULLS
        ).alias("json")
    )


def failure(spark: SparkSession, message: str) -> DataFrame:
    """The JSON text a caller gets in place of results: not successful, the error, no results."""
    said = spark.createDataFrame([(message,)], "error string")
    return said.select(
        F.to_json(
            F.struct(F.lit(False).alias("success"), "error", F.lit(0).alias("count"), F.array().alias("results"))
        ).alias("json")
    )


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object per row, vectors left out, letters kept as they are."""
    plain = without_vectors(rows)
    return plain.select(F.to_json(F.struct(*plain.columns), _KEEP_NULLS).alias(name))
