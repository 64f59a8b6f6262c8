"""Names that sound alike, found without vectors and without comparing all pairs.

Two sound keys are alike if enough positions hold the same character, measured on the longer key. A key of ``l``
characters that is alike to one of ``L >= l`` differs from it, missing positions counted, in at most ``m = floor((1 - least)
* L)`` positions. So if the L positions are cut into ``m + 1`` stretches, one stretch is equal in both, and the shorter key
has all of it. Keys meet in a join on length, stretch and its characters; those that meet are compared in full.

Each key is one row however many marks have it, so a key that a third of the register shares joins as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import sound_key, sound_similarity
from ..functions.numbers import rounded
from ..functions.rows import each_element


def _differing(length: Column, least: float) -> Column:
    """Positions in which a longer key of that length may differ; a little is allowed for rounding."""
    return F.floor((1.0 - least) * length + 1e-9).cast("int")


def stretches(keys: DataFrame, key: str, least: float, *, longer: bool) -> DataFrame:
    """``key`` to ``key, _L, _s, _chars``: its stretches as the longer key, or as the shorter one of every length it may
    meet. Stretch s of m + 1 covers positions ``s * L / (m + 1)`` up to the next."""
    own = F.length(key)
    lengths = F.array(own) if longer else F.sequence(own, F.greatest(own, F.floor(own / least + 1e-9).cast("int")))
    each = each_element(keys, [key], lengths, "_L").drop("position")
    parts = _differing(F.col("_L"), least) + 1
    cut = each_element(each, [key, "_L"], F.sequence(F.lit(0), parts - 1), "_s").drop("position")
    start = F.floor(F.col("_s") * F.col("_L") / parts).cast("int")
    stop = F.floor((F.col("_s") + 1) * F.col("_L") / parts).cast("int")
    return cut.select(key, "_L", "_s", start.alias("_a"), stop.alias("_b")).where(F.col("_b") <= F.length(key)).select(
        key, "_L", "_s", F.substring(F.col(key), F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("_chars")
    )


def alike_keys(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``a`` (distinct keys of the left table) and ``b`` to the pairs with a similarity of ``least`` or more: ``a, b, _similar``."""
    if not 0 < least <= 1:
        raise ValueError("least is above 0 and at most 1")
    names = ["_L", "_s", "_chars"]
    meeting = stretches(left, "a", least, longer=True).join(stretches(right, "b", least, longer=False), names)
    other = stretches(left, "a", least, longer=False).join(stretches(right, "b", least, longer=True), names)
    pairs = meeting.select("a", "b").union(other.where(F.length("a") < F.length("b")).select("a", "b"))
    # compared before the repeats go: most of what meets is not alike
    similar = pairs.withColumn("_similar", sound_similarity(F.col("a"), F.col("b"))).where(F.col("_similar") >= least - 1e-12)
    return similar.distinct()


def similar_names(
    register: DataFrame,
    candidates: DataFrame,
    least: float = 0.8,
    *,
    item_id: str = "id",
    name: str = "mark_name",
    query_id: str = "query_id",
    query_name: str = "candidate_name",
) -> DataFrame:
    """All marks whose name sounds like a candidate's, at ``least`` or more: query id, candidate's name, item id, mark's name,
    ``sound`` (4 digits). Names without letters and digits sound like nothing; null names take no part."""
    marks = register.select(F.col(item_id), F.col(name), sound_key(F.col(name)).alias("b")).where("b <> ''")
    asked = candidates.select(F.col(query_id), F.col(query_name), sound_key(F.col(query_name)).alias("a")).where("a <> ''")
    found = alike_keys(asked.select("a").distinct(), marks.select("b").distinct(), least)
    return asked.join(found, "a").join(marks, "b").select(query_id, query_name, item_id, name, rounded(F.col("_similar"), 4).alias("sound"))
