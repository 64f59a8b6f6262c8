"""Nice classes for a description of goods and services."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded

from ..operators.lexical import bm25
from ..operators.postings import Postings, bm25_stored


def recommend_classes(
    register: DataFrame | None,
    queries: DataFrame,
    k: int = 5,
    *,
    depth: int = 50,
    item_id: str = "id",
    text: str = "goods_text",
    classes: str = "nice_classes",
    postings: Postings | None = None,
) -> DataFrame:
    """Classes of the ``depth`` best word matches, each voting with its score: query_id, nice_class, votes, weight, rank.

    With ``postings``, an index of the goods that keeps the classes, the register itself is not read and may be None.
    """
    if postings is None:
        hits = bm25(register, queries, depth, doc_id=item_id, text=text, keep=[classes])
    else:
        hits = bm25_stored(postings, queries, depth, keep=[classes])
    votes = (
        hits.select("query_id", F.explode(F.array_distinct(classes)).alias("nice_class"), "score")
        .groupBy("query_id", "nice_class")
        .agg(F.count(F.lit(1)).alias("votes"), rounded(F.sum("score")).alias("weight"))
    )
    order = Window.partitionBy("query_id").orderBy(F.col("weight").desc(), "nice_class")
    return votes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
