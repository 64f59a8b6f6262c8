"""Lexical search: word statistics, BM25 and fusion of rankings."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BM25_B, BM25_K1, RRF_K
from ..functions.numbers import rounded
from ..functions.rows import each_element
from ..functions.text import words
from .topk import SCAN_QUERIES, TopK, WeightedTerms, few_rows

CORPUS = ""  # stands for the corpus itself in the word statistics; no word is empty
SCAN_TERMS = 500_000


def word_statistics(
    docs: DataFrame, text: str = "text", vocabulary: DataFrame | None = None, *, small_vocabulary: bool = False
) -> DataFrame:
    """Per word: number of texts that hold it. The empty word carries the number of texts and of all words.

    One pass: words repeat at most once per text before they are counted, and counting combines on the map side.
    A vocabulary (column ``term``) restricts the words: before counting if it was checked to be small enough to send
    to the tasks, otherwise after, when every word is one row.
    """
    tokens = docs.select(words(F.col(text)).alias("tokens"))
    held = F.array_append(F.array_distinct("tokens"), F.lit(CORPUS))
    each = each_element(tokens, [F.size("tokens").alias("length")], held, "term")
    if small_vocabulary:
        each = each.join(F.broadcast(vocabulary), "term", "left_semi")
    counted = each.groupBy("term").agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum(F.when(F.col("term") == CORPUS, F.col("length")).otherwise(0)).alias("total_words"),
    )
    if vocabulary is not None and not small_vocabulary:
        counted = counted.join(vocabulary, "term", "left_semi")
    return counted


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    asked = [F.col(query_id).alias("_query")]
    return each_element(queries, asked, F.array_distinct(words(F.col(text))), "term").drop("position")


def _as_query_rows(weighted: DataFrame) -> DataFrame:
    """(query, term, weight) to one row per query; a query holds no more rows than its own text has words."""
    packed = weighted.groupBy("_query").agg(F.collect_list(F.struct("term", "weight")).alias("_t"))
    return packed.select("_query", F.col("_t.term").alias("_terms"), F.col("_t.weight").alias("_weights"))


def bm25(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    query_id: str = "query_id",
    query_text: str = "query_text",
    keep: Sequence[str] = (),
    k1: float = BM25_K1,
    b: float = BM25_B,
    score_name: str = "score",
    scan_queries: int = SCAN_QUERIES,
) -> DataFrame:
    """Top ``k`` texts per query by BM25: query id, doc id, kept columns, score (4 digits), rank.

    Two passes over the texts: word statistics restricted to the queries' words, then scoring inside the tasks. For more
    queries than can be sent to the tasks, the texts are indexed first and the queries meet the postings of their words.
    """
    columns = [doc_id, *[c for c in keep if c != doc_id]]
    terms = query_terms(queries, query_id, query_text)
    head = few_rows(terms, F.length("term") + 16, SCAN_TERMS)
    if head is None or pc.count_distinct(head.column("_query")).as_py() > scan_queries:
        from .postings import bm25_stored, temporary_postings

        index = temporary_postings(docs, doc_id=doc_id, text=text, keep=keep)
        return bm25_stored(index, queries, k, query_id=query_id, query_text=query_text, keep=keep, k1=k1, b=b, score_name=score_name)
    average, rows = _weights_of_few(docs, text, head)
    items = docs.select(F.col(doc_id).alias("_item"), words(F.col(text)).alias("_tokens"), *columns)
    saturation = (k1, b, average or 1.0)
    return TopK(items, terms, ["_item", *columns], lambda q: WeightedTerms(q, saturation), k, query_id, score_name, rows).run()


def _weights_of_few(docs: DataFrame, text: str, head: pa.Table) -> tuple[float, pa.Table]:
    """Average text length and weighted query rows. The queries' words are few and already read, so their statistics
    are one small table, too."""
    vocabulary = pa.table({"term": pc.unique(head.column("term")).to_pylist() + [CORPUS]})
    known = docs.sparkSession.createDataFrame(vocabulary)
    statistics = word_statistics(docs, text, known, small_vocabulary=True).toArrow().to_pylist()
    texts = {row["term"]: row["texts"] for row in statistics}
    corpus = next((row for row in statistics if row["term"] == CORPUS), None)
    total, average = (corpus["texts"], corpus["total_words"] / corpus["texts"]) if corpus else (0, 1.0)
    weighted: dict[object, list[tuple[str, float]]] = {}
    for query, term in zip(head.column("_query").to_pylist(), head.column("term").to_pylist(), strict=True):
        if term in texts:
            weight = math.log1p((total - texts[term] + 0.5) / (texts[term] + 0.5))
            weighted.setdefault(query, []).append((term, weight))
    rows = pa.table(
        {
            "_query": pa.array(list(weighted), head.schema.field("_query").type),
            "_terms": pa.array([[t for t, _ in pairs] for pairs in weighted.values()], pa.list_(pa.string())),
            "_weights": pa.array([[w for _, w in pairs] for pairs in weighted.values()], pa.list_(pa.float64())),
        }
    )
    return average, rows


def shared_terms(
    items: DataFrame,
    weights: DataFrame,
    k: int,
    *,
    item_id: str,
    terms: str,
    query_id: str = "query_id",
    keep: Sequence[str] = (),
    score_name: str = "score",
) -> DataFrame:
    """Top ``k`` items per query by the summed weights of the terms they share with it.

    ``items[terms]`` is an array of strings, ``weights`` has (query id, term, weight). Pairs of items are never formed,
    so a term that a third of all items hold costs no more than any other.
    """
    query_rows = _as_query_rows(weights.select(F.col(query_id).alias("_query"), "term", F.col("weight").cast("double")))
    head = few_rows(query_rows, F.size("_terms") * 32)
    if head is None:
        from .postings import shared_terms_stored, temporary_postings

        index = temporary_postings(items, doc_id=item_id, terms=terms, keep=keep)
        return shared_terms_stored(index, weights, k, query_id=query_id, keep=keep, score_name=score_name)
    rows = items.where(F.size(terms) > 0).select(
        F.col(item_id).alias("_item"), F.array_distinct(terms).alias("_tokens"), item_id, *keep
    )
    return TopK(rows, query_rows, ["_item", item_id, *keep], lambda q: WeightedTerms(q, None), k, query_id, score_name, head).run()


def reciprocal_rank_fusion(
    rankings: Sequence[DataFrame], k: int, *, query_id: str = "query_id", item_id: str = "id", constant: int = RRF_K
) -> DataFrame:
    """Fuses rankings (query id, item id, rank) by the sum of 1 / (constant + rank)."""
    votes = [
        r.select(query_id, item_id, (F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("vote")) for r in rankings
    ]
    fused = (
        reduce(DataFrame.unionByName, votes)
        .groupBy(query_id, item_id)
        .agg(rounded(F.sum("vote"), 6).alias("fused_score"), F.count(F.lit(1)).alias("lists"))
    )
    order = Window.partitionBy(query_id).orderBy(F.col("fused_score").desc(), F.col(item_id))
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
