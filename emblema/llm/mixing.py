"""Mixing sources to target weights by Pareto order sampling.

A source's target of words over its size gives the copies expected of each of its documents. Whole copies are certain;
for the fraction left over, documents are ranked by random odds over inclusion odds, and the first are taken while the
words of the source fit its target; one more fills what is missing.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a source of its own, the last one; rows
that are equal in id and text share a rank and are taken together; an empty table gives an empty result; a corpus
without words has targets of 0; further columns are carried along or left aside, never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emblema.session import settled

from .common import only, word_count

WEIGHTS = (3.0, 1.0, 2.0)
BUCKETS = 4096
#: A table of one row for each source is broadcast up to this many sources; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 2_000


def chance(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the row alone: 52 bits of an MD5."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``: ``share`` of all words dealt by weight, no source
    above ``most`` times its size, the excess dealt again by weight.

    Dealing again until none is above its bound ends where the sources with the smallest bound for their weight are
    full and the rest share what is left by weight. Ordered by bound over weight, a source is full if its own share of
    what the ones before it leave is above its bound. The table has one row for each source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = (
        sizes.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("weight", cycle)
        .withColumn("bound", F.lit(most) * F.col("source_size"))
    )
    filling = W.orderBy(F.col("bound") / F.col("weight"), "place")
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = (
        weighed.withColumn("filled", F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("all_words", F.lit(share) * F.sum("source_size").over(whole))
        .withColumn("all_weights", F.sum("weight").over(whole))
        .withColumn("level", (F.col("all_words") - F.col("filled")) / (F.col("all_weights") - F.col("weight_before")))
        .withColumn("full", F.col("weight") * F.col("level") >= F.col("bound"))
    )
    level = F.min(F.when(~F.col("full"), F.struct("bound_by_weight", "place", "level"))).over(whole)["level"]
    return (
        ranked.withColumn("bound_by_weight", F.col("bound") / F.col("weight"))
        .withColumn("shared", level)
        .select("source", "source_size", F.when(F.col("full"), F.col("bound")).otherwise(F.col("weight") * F.col("shared")).alias("target"))
    )


def joined_by_source(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with their source's row. The table is counted before it is broadcast; a larger one is shuffled, and
    adaptive execution splits a hot source."""
    small = sources.count() <= BROADCAST_SOURCES
    right = sources.withColumnRenamed("source", "_of_source")
    return docs.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("_of_source"))).drop("_of_source")


def copy_scales(sized: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """``sources`` with ``scale`` and ``held_from``: a document is expected ``scale * importance`` times, and ``most`` times from that importance on.

    A source's expected words add up to its target. Documents whose share comes out above ``most`` are held there and
    the rest of the target is shared by the others, until none is above; with equal importance the first round settles it.
    """
    bounds = sources.withColumn("held_from", F.lit(float("inf")))
    while True:
        held = F.col("importance") >= F.col("held_from")
        sums = joined_by_source(sized, bounds).groupBy(F.col("source").alias("_s")).agg(
            F.sum(F.when(held, F.col("size")).otherwise(0)).alias("held"),
            F.sum(F.when(held, 0.0).otherwise(F.col("size") * F.col("importance"))).alias("open"),
            F.max(F.when(~held, F.col("importance"))).alias("highest"),
        )
        left = F.greatest(F.lit(0.0), F.col("target") - most * F.col("held"))
        scaled = settled(
            bounds.join(sums, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("scale", F.when(F.col("open") > 0, left / F.col("open")).otherwise(0.0)),
            "mix-scales",
        )
        if scaled.where(F.col("scale") * F.col("highest") > most * (1 + 1e-12)).isEmpty():
            return scaled.drop("held", "open", "highest")
        above = F.when(F.col("scale") > 0, F.lit(most) / F.col("scale")).otherwise(F.lit(float("inf")))
        bounds = scaled.select("source", "source_size", "target", F.least("held_from", above).alias("held_from"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, importance: Column | None = None, seed: int = 17) -> DataFrame:
    """``row`` (a document with all its columns; ``doc_id, text, source`` are read), ``size, source_size, target, copies``: how often each is taken.

    ``importance`` makes documents of a source unequally likely; without it all have the same expected copies. Counts
    by source and by bucket of the rank are combined on the map side, so a hot source costs no more than others; only
    the documents of one bucket of ranks, a 4096th of a source, are sorted.
    """
    sized = docs.select(
        "source",
        word_count(F.col("text")).alias("size"),
        chance(F.col("doc_id"), F.col("text"), seed).alias("u"),
        (F.lit(1.0) if importance is None else importance.cast("double")).alias("importance"),
    )
    sized = settled(sized, "mix-sizes")
    sources = settled(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    if importance is None:
        ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        sources = sources.withColumns({"scale": ratio, "held_from": F.lit(float("inf"))})
    else:
        sources = copy_scales(sized, sources, most)
    held = F.col("importance") >= F.col("held_from")
    expected = F.when(held, F.lit(most)).otherwise(F.least(F.lit(most), F.col("scale") * F.col("importance")))

    def planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
        return joined_by_source(rows, plan).withColumn("copies_expected", expected)

    ranked = ranks(planned(sized, sources))
    cuts = settled(cut_points(ranked), "mix-cuts")
    sources = sources.alias("s").join(cuts.withColumnRenamed("source", "_cut_source"), F.col("s.source").eqNullSafe(F.col("_cut_source")), "left").drop("_cut_source")
    # the document goes along as one column, so none of its names can clash
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        "source",
        word_count(F.col("text")).alias("size"),
        chance(F.col("doc_id"), F.col("text"), seed).alias("u"),
        (F.lit(1.0) if importance is None else importance.cast("double")).alias("importance"),
    )
    taken = ranks(planned(rows, settled(sources, "mix-plan")))
    extra = F.coalesce((F.col("rank") <= F.col("cut")) | F.coalesce(F.col("rank") == F.col("fill"), F.lit(False)), F.lit(False)).cast("bigint")
    return taken.select("row", "size", "source_size", "target", (F.col("whole") + extra).alias("copies"))


def ranks(df: DataFrame) -> DataFrame:
    """``whole`` certain copies, and ``rank``: random odds over the odds of inclusion for the rest, brought into (0, 1)."""
    rest = F.col("copies_expected") - F.col("whole")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("rest") / (1 - F.col("rest")))
    return (
        df.withColumn("whole", F.floor("copies_expected").cast("bigint"))
        .withColumn("rest", rest)
        .withColumn("odds", F.when(F.col("rest") > 0, odds))
        .withColumn("rank", F.col("odds") / (1 + F.col("odds")))
    )


def cut_points(ranked: DataFrame) -> DataFrame:
    """The rank up to which each source's documents get one more copy: as many as fit its target. Of the rest one more is
    taken, ``fill``: the one whose size comes nearest to the words still missing."""
    needed = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("needed"))
    bucket = F.floor(F.col("rank") * BUCKETS)
    candidates = ranked.where(F.col("rank").isNotNull()).select("source", "rank", "size", bucket.alias("bucket"))
    by_bucket = candidates.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    in_order = W.partitionBy("source").orderBy("bucket")
    marked = by_bucket.join(needed.withColumnRenamed("source", "_n"), F.col("source").eqNullSafe(F.col("_n"))).drop("_n")
    marked = marked.withColumn("before", F.sum("words").over(in_order) - F.col("words"))
    # the last bucket that begins below what is needed; the cut lies in it
    edge = marked.where(F.col("before") < F.col("needed")).groupBy("source").agg(F.max(F.struct("bucket", "before", "needed")).alias("e")).select("source", "e.*")
    inside = joined_by_source(candidates.withColumnRenamed("bucket", "own_bucket"), edge).where("own_bucket = bucket")
    tied = inside.groupBy("source", "rank", "before", "needed").agg(F.sum("size").alias("size"))
    running = tied.withColumn("words", F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("rank")))
    last = running.where("words <= needed").groupBy("source").agg(F.max(F.struct("rank", "words")).alias("last"))
    cut = settled(
        edge.withColumnRenamed("source", "_e").join(last, F.col("_e").eqNullSafe(F.col("source")), "left").select(
            F.col("_e").alias("source"),
            F.coalesce("last.rank", F.col("bucket") / BUCKETS - 1e-18).alias("cut"),
            (F.col("needed") - F.coalesce("last.words", "before")).alias("gap"),
        ),
        "mix-edge",
    )
    left = joined_by_source(candidates, cut).where(F.col("rank") > F.col("cut")).groupBy("source", "rank", "cut", "gap").agg(F.sum("size").alias("size"))
    off = F.abs(F.col("gap") - F.col("size"))
    nearest = left.where(off < F.col("gap")).groupBy(F.col("source").alias("_n")).agg(F.min(F.struct(off.alias("off"), "rank"))["rank"].alias("fill"))
    return cut.join(nearest, F.col("source").eqNullSafe(F.col("_n")), "left").select("source", "cut", "fill")


def repeated(mixed: DataFrame) -> DataFrame:
    """A mix as documents: each row as often as it is taken."""
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def mix_words(docs: DataFrame) -> DataFrame:
    """The query: words taken of each document."""
    words = (F.col("copies") * F.col("size")).alias("taken")
    return mix(only(docs, "doc_id", "text", "source")).select("row.doc_id", "size", "source_size", "target", words, "row.source", "copies")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(text, '')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), placed AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM sums
), weighed AS (SELECT *, CAST([3, 1, 2][CAST(place % 3 AS INT) + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS bound FROM placed
), walked AS (
  SELECT *, coalesce(sum(bound) OVER f, 0) AS filled, coalesce(sum(weight) OVER f, 0) AS weight_before,
    1.5::DOUBLE * sum(source_size) OVER () AS all_words, sum(weight) OVER () AS all_weights
  FROM weighed WINDOW f AS (ORDER BY bound / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (SELECT *, (all_words - filled) / (all_weights - weight_before) AS level FROM walked
), shared AS (SELECT min_by(level, (bound / weight, place)) AS level FROM levels WHERE NOT weight * level >= bound
), targets AS (
  SELECT l.source, source_size, CASE WHEN weight * l.level >= bound THEN bound ELSE weight * s.level END AS target FROM levels l LEFT JOIN shared s ON true
), planned AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), ranked AS (
  SELECT *, CAST(floor(ratio) AS BIGINT) AS whole,
    CASE WHEN ratio > floor(ratio) THEN (u / (1 - u)) / ((ratio - floor(ratio)) / (1 - (ratio - floor(ratio)))) END AS odds
  FROM planned
), tied AS (
  SELECT source, odds / (1 + odds) AS rank, sum(size) AS size, any_value(target - whole * source_size) AS needed
  FROM ranked WHERE odds IS NOT NULL GROUP BY 1, 2
), running AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank) AS words FROM tied
), cuts AS (
  SELECT source, coalesce(max(rank) FILTER (WHERE words <= needed), -1) AS cut, any_value(needed) - coalesce(max(words) FILTER (WHERE words <= needed), 0) AS gap
  FROM running WHERE needed > 0 GROUP BY source
), fills AS (
  SELECT r.source, arg_min(r.rank, (abs(gap - r.size), r.rank)) AS fill FROM running r JOIN cuts c ON r.source IS NOT DISTINCT FROM c.source
  WHERE r.rank > c.cut AND abs(gap - r.size) < gap GROUP BY 1
), extra AS (
  SELECT r.*, CAST(coalesce(odds / (1 + odds) <= cut, false) OR coalesce(odds / (1 + odds) = fill, false) AS BIGINT) AS more
  FROM ranked r LEFT JOIN cuts c ON r.source IS NOT DISTINCT FROM c.source LEFT JOIN fills f ON r.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, size, source_size, target, size * (whole + more) AS taken, source, whole + more AS copies FROM extra
"""
