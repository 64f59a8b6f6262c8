"""Statute and decision texts: passages and retrieval by words, by cited articles and by how often articles are cited."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.letters import article_numbers
from ..functions.rows import each_element
from ..functions.text import has_text, strip
from ..operators.lexical import bm25, reciprocal_rank_fusion, shared_terms
from ..operators.postings import CODEC, Postings, bm25_stored, build_postings, open_postings, shared_terms_stored
from ..session import settled

MODES = ("naive", "local", "global", "hybrid")


def split_passages(corpus: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Articles cut into their numbered paragraphs; text before the first article is article null.

    Columns: passage_id, source, article, heading, paragraph (0 for the text under the heading), text, cites.
    """
    articles = F.split(F.col(text), r"(?m)^(?=Article \d+)")
    sections = each_element(corpus, [F.col(source).alias("source")], articles, "_s", "section")
    number = F.regexp_extract("_s", r"^Article (\d+)", 1).try_cast("int")
    heading = F.when(number.isNotNull(), strip(F.substring_index("_s", "\n", 1)))
    # a projection of its own, below the rows of paragraphs, so that these do not carry the section's text and search it
    numbered = sections.select("source", "section", number.alias("article"), heading.alias("heading"), "_s")
    keep = ["source", "section", "article", "heading"]
    cut = each_element(numbered, keep, F.split("_s", r"(?m)^(?=\d+\. )"), "_p", "piece")
    body = F.when(
        F.col("article").isNotNull() & (F.col("piece") == 0), F.regexp_replace("_p", r"^[^\n]*\n?", "")
    ).otherwise(F.col("_p"))
    # filtered before it is stripped: a filter on the stripped text would strip it a second time
    read = cut.where(has_text(body)).select(*keep, "piece", strip(body).alias("text"))
    return read.select(
        F.concat_ws("#", "source", "section", "piece").alias("passage_id"),
        "source",
        "article",
        "heading",
        F.coalesce(F.regexp_extract("text", r"^(\d+)\. ", 1).try_cast("int"), F.lit(0)).alias("paragraph"),
        "text",
        article_numbers(F.col("text")).alias("cites"),
    )


def article_index(passages: DataFrame) -> DataFrame:
    """One row per article: heading, number of passages and the first of them."""
    return (
        passages.where(F.col("article").isNotNull())
        .groupBy("article")
        .agg(
            F.min_by("heading", "passage_id").alias("heading"),
            F.count(F.lit(1)).alias("passages"),
            F.min("passage_id").alias("first_passage"),
        )
    )


def citation_degree(passages: DataFrame) -> DataFrame:
    """How many passages cite an article."""
    return (
        passages.select(F.explode("cites").alias("article"))
        .groupBy("article")
        .agg(F.count(F.lit(1)).alias("cited_by"))
    )


def _with_articles(passages: DataFrame) -> DataFrame:
    """Adds the articles a passage belongs to or cites, as words."""
    own = F.when(F.col("article").isNull(), F.array().cast("array<int>")).otherwise(F.array("article"))
    return passages.withColumn("articles", F.array_distinct(F.concat(own, "cites")).cast("array<string>"))


def retrieve(
    passages: DataFrame, queries: DataFrame, mode: str = "hybrid", k: int = 10, *, depth: int = 50
) -> DataFrame:
    """Top ``k`` passages per query (query_id, query_text): query_id, passage_id, score, rank.

    naive   words of the query
    local   passages that share articles with the best word matches, weighted by how many of these hold the article
    global  the best word matches, most cited article first
    hybrid  local and global fused by rank
    """
    related = _with_articles(passages)

    def best(many: int, *keep: str) -> DataFrame:
        return bm25(related, queries, many, doc_id="passage_id", keep=keep)

    def sharing(weights: DataFrame, many: int) -> DataFrame:
        return shared_terms(related, weights, many, item_id="passage_id", terms="articles")

    return _by_mode(mode, k, depth, best, sharing, lambda: citation_degree(passages))


@dataclass(frozen=True)
class LegalIndex:
    """What retrieval needs, stored: the passages' words, the graph's edges from article to passage, and how often an
    article is cited. The edges of a much-cited article are split by ranges of passages, as the postings of a word are."""

    words: Postings
    edges: Postings
    degrees: DataFrame


def build_legal_index(passages: DataFrame, path: str, **options) -> LegalIndex:
    """Writes the index of passages as ``split_passages`` gives them. They are computed once."""
    spark = passages.sparkSession
    passages.write.option("compression", CODEC).parquet(f"{path}/passages")
    stored = _with_articles(spark.read.parquet(f"{path}/passages"))
    build_postings(stored, f"{path}/words", doc_id="passage_id", keep=["article", "articles"], **options)
    build_postings(stored, f"{path}/edges", doc_id="passage_id", terms="articles", **options)
    citation_degree(stored).write.parquet(f"{path}/degrees")
    return open_legal_index(spark, path)


def open_legal_index(spark: SparkSession, path: str) -> LegalIndex:
    words, edges = (open_postings(spark, f"{path}/{part}", doc_id="passage_id") for part in ("words", "edges"))
    return LegalIndex(words, edges, spark.read.parquet(f"{path}/degrees"))


def retrieve_stored(index: LegalIndex, queries: DataFrame, mode: str = "hybrid", k: int = 10, *, depth: int = 50) -> DataFrame:
    """``retrieve`` from the index: reads the postings of the queries' words and the edges of the articles they lead to."""

    def best(many: int, *keep: str) -> DataFrame:
        return bm25_stored(index.words, queries, many, keep=keep)

    def sharing(weights: DataFrame, many: int) -> DataFrame:
        return shared_terms_stored(index.edges, weights, many)

    return _by_mode(mode, k, depth, best, sharing, lambda: index.degrees)


def _by_mode(mode: str, k: int, depth: int, best: Callable, sharing: Callable, degrees: Callable) -> DataFrame:
    """``best`` gives word matches, ``sharing`` the passages of weighted articles, ``degrees`` citations by article."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if mode == "naive":
        return best(k)
    seeds = settled(best(depth, "article", "articles"), "legal-seeds")
    if mode == "local":
        return sharing(_article_weights(seeds), k)
    if mode == "global":
        return _global(degrees(), seeds, k)
    lists = [sharing(_article_weights(seeds), depth), _global(degrees(), seeds, depth)]
    fused = reciprocal_rank_fusion(lists, k, item_id="passage_id")
    return fused.select("query_id", "passage_id", F.col("fused_score").alias("score"), "rank")


def _article_weights(seeds: DataFrame) -> DataFrame:
    return (
        seeds.select("query_id", F.explode("articles").alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def _global(degrees: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    ranked = seeds.join(degrees, "article", "left").select(
        "query_id", "passage_id", F.coalesce("cited_by", F.lit(0)).cast("double").alias("score"), F.col("rank").alias("_r")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "_r")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_r")
