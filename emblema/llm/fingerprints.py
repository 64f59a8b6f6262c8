"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (sentences and lines, a long one every 160 characters). A digest is 44 bits of a
paragraph's hash and 20 bits of checksum, and each is combined by exclusive or into three cells. Two sketches subtract
cell by cell: what both have cancels out, and peeling the difference recovers the digests that only one of them has, as
a cell with one digest is known by its checksum. If cells are left over, the digests are sketched again into more
cells. All work is DataFrame operations.

A sketch of a long text is many small ones, each for the digests of one hash range, so peeling stays linear in the text.

Defined cases: a null text is empty; two empty texts have likeness 1, an empty and another 0; a null id follows after
all others; equal ids stand in order of a hash of their texts; a single document is its own successor; an empty table
gives an empty result; further columns are left aside; a very long text is sketched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emblema.session import settled

from .common import only

PARAGRAPH = r"[^.\n]{1,160}[.\n]*|[.\n]+"
#: Cells for each of the three hashes, digests that a small sketch is meant for, and how much larger each retry is.
CELLS, LOAD, LARGER = 6, 8, (1, 4, 16)
#: Documents that are put in order by one task, and quantiles of the ids that ranges begin at.
ORDERED, QUANTILES = 2_000, 256


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def checked(high: Column) -> Column:
    """44 bits with their checksum below them."""
    return F.shiftleft(high, 20).bitwiseOR(F.xxhash64(high).bitwiseAND(F.lit((1 << 20) - 1)))


def digests(text: Column) -> Column:
    """The distinct digests of the paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: checked(F.shiftrightunsigned(F.xxhash64(p), 20))))


def placed(keys: Column, cells: int) -> Column:
    """Each digest with its three cells."""

    def cell(d: Column, j: int) -> Column:
        return (F.pmod(F.shiftrightunsigned(d, 20 + 13 * j).bitwiseXOR(F.shiftrightunsigned(d, 40)), F.lit(cells)) + j * cells).cast("int").alias(f"at{j}")

    return F.transform(keys, lambda d: F.struct(d.alias("d"), *[cell(d, j) for j in range(3)]))


def sketch(keys: Column, cells: int) -> Column:
    """Three rows of ``cells`` cells."""

    def cell(p: Column, i: Column) -> Column:
        return F.aggregate(
            p, F.lit(0).cast("bigint"), lambda held, x: F.when((x["at0"] == i) | (x["at1"] == i) | (x["at2"] == i), held.bitwiseXOR(x["d"])).otherwise(held)
        )

    return bound(placed(keys, cells), lambda p: F.transform(F.array(*[F.lit(i) for i in range(3 * cells)]), lambda i: cell(p, i)))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def peeled(cells_of: Column, cells: int) -> Column:
    """``ok, found``: whether all cells came out empty, and how many digests only one of the two sketches has.

    A round takes every cell that holds one digest and removes it from its three cells. A mixed cell whose checksum holds
    by chance puts a false digest into two others and is found again there, so a digest found twice is a failure too.
    """
    start = F.struct(cells_of.alias("cells"), F.array().cast("array<bigint>").alias("found"), F.lit(False).alias("done"))

    def pure(state: Column) -> Column:
        return F.array_distinct(F.filter(state["cells"], lambda c: (c != 0) & (c == checked(F.shiftrightunsigned(c, 20)))))

    def removed(state: Column, taken: Column) -> Column:
        return F.when(F.size(taken) == 0, F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(True).alias("done"))).otherwise(
            F.struct(subtracted(state["cells"], sketch(taken, cells)).alias("cells"), F.concat(state["found"], taken).alias("found"), F.lit(False).alias("done"))
        )

    def step(state: Column) -> Column:
        return F.when(state["done"], state).otherwise(bound(pure(state), lambda taken: removed(state, taken)))

    rounds = F.array(*[F.lit(k) for k in range(24)])
    ended = F.aggregate(rounds, start, lambda state, _: step(state))
    once = lambda found: F.size(F.array_distinct(found)) == F.size(found)
    return bound(ended, lambda e: F.struct((F.forall(e["cells"], lambda c: c == 0) & once(e["found"])).alias("ok"), F.size(e["found"]).alias("found")))


def ranges(keys: Column, groups: Column, seed: str) -> Column:
    """``keys`` in ``groups`` arrays by hash."""
    marked = F.transform(keys, lambda d: F.struct(F.pmod(F.xxhash64(d, F.lit(seed)), groups).alias("g"), d.alias("d")))
    return bound(marked, lambda m: F.transform(F.sequence(F.lit(0).cast("bigint"), groups - 1), lambda g: F.transform(F.filter(m, lambda x: x["g"] == g), lambda x: x["d"])))


def with_likeness(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds ``name``: shared digests over all digests of the texts whose digests are in columns ``a`` and ``b``.

    The digests go to small sketches of about ``LOAD`` by two rounds of hashing, the square root of their number each
    time, so no step scans all digests for each sketch. Small sketches that don't peel are made again with more cells;
    should the largest fail too, their digests are compared as they are.
    """
    one = F.lit(1).cast("bigint")

    def zipped(x: Column, y: Column, groups: Column, seed: str) -> Column:
        return F.zip_with(ranges(x, groups, seed), ranges(y, groups, seed), lambda p, q: F.struct(p.alias("x"), q.alias("y")))

    both = F.size(a) + F.size(b)
    side = F.greatest(one, F.ceil(F.sqrt(F.ceil(both / F.lit(float(LOAD))))).cast("bigint"))
    rows = rows.withColumn("_side", side).withColumn("_outer", zipped(F.col(a), F.col(b), F.col("_side"), "outer"))
    inner = F.transform("_outer", lambda p: zipped(p["x"], p["y"], F.greatest(one, F.ceil((F.size(p["x"]) + F.size(p["y"])) / F.lit(float(LOAD))).cast("bigint")), "inner"))
    rows = rows.withColumn("_open", F.filter(F.flatten(inner), lambda p: F.size(p["x"]) + F.size(p["y"]) > 0))
    rows = rows.withColumn("_apart_in", F.lit(0))

    def summed(column: str, value) -> Column:
        return F.aggregate(column, F.lit(0), lambda s, r: s + value(r))

    def apart(cells: int) -> Column:
        return F.transform("_open", lambda p: peeled(subtracted(sketch(p["x"], cells), sketch(p["y"], cells)), cells))

    for larger in LARGER:
        rows = rows.withColumn("_peeled", apart(CELLS * larger))
        rows = rows.withColumns(
            {
                "_apart_in": F.col("_apart_in") + summed("_peeled", lambda r: F.when(r["ok"], r["found"]).otherwise(0)),
                "_open": F.transform(F.filter(F.zip_with("_open", "_peeled", lambda p, r: F.struct(p.alias("p"), r["ok"].alias("ok"))), lambda z: ~z["ok"]), lambda z: z["p"]),
            }
        )
    left = summed("_open", lambda p: F.size(F.array_except(p["x"], p["y"])) + F.size(F.array_except(p["y"], p["x"])))
    rows = rows.withColumn("_apart_in", F.col("_apart_in") + left)
    # what is not apart stands in both
    near = F.when(both == 0, 1.0).otherwise((both - F.col("_apart_in")) / (both + F.col("_apart_in")))
    return rows.withColumn(name, near).drop("_side", "_outer", "_open", "_peeled", "_apart_in")


def fingerprint(keys: Column) -> Column:
    """The small sketch of all digests, in hexadecimal."""
    return F.array_join(F.transform(sketch(keys, CELLS), lambda c: F.lower(F.hex(c))), "-")


def with_part(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds ``part``: ranges of about ``ORDERED`` documents, rising with the id, null ids lowest.

    Ranges begin at quantiles of the ids and are cut evenly between their own least and largest id; rows of one id that
    fills a range, and those without an id, are cut by the hash of their text, which also orders them. The driver gets the
    quantiles and a row for each range, ``2 * QUANTILES`` at most.
    """
    found = ids.agg(F.percentile_approx("doc_id", [k / QUANTILES for k in range(1, QUANTILES)], 10_000).alias("q")).first()["q"] or []
    often = {x for x, y in zip(found, found[1:], strict=False) if x == y}  # such an id is a range of its own
    begins = F.array(*[F.lit(x).cast("bigint") for x in sorted({*found, *(x + 1 for x in often if x < (1 << 63) - 1)})]).cast("array<bigint>")
    at = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(begins, lambda x: x <= F.col("doc_id"))))
    counted = ids.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()
    first, ranges = 0, {}
    for row in sorted(counted, key=lambda r: r["at"]):
        parts = -(-row["n"] // ORDERED)
        ranges[row["at"]] = (first, parts, float(row["low"] or 0), float(row["high"] or 0), row["low"] == row["high"])
        first += parts
    table = [ranges.get(k, (0, 1, 0.0, 0.0, True)) for k in range(-1, max(ranges, default=-1) + 1)]
    names = ("first", "parts", "low", "high", "one_id")
    bounds = F.element_at(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in table]), F.col("_at") + 2)
    place = F.col("_range")
    by_text = (F.col("text_key") / F.lit(2.0**64) + 0.5) * place["parts"]
    by_id = (F.col("doc_id").cast("double") - place["low"]) / (place["high"] - place["low"] + 1) * place["parts"]
    inside = F.least(F.floor(F.when(place["one_id"], by_text).otherwise(by_id)), place["parts"].cast("bigint") - 1)
    return rows.withColumn("_at", at).withColumn("_range", bounds).withColumn("part", place["first"] + inside).drop("_at", "_range")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, keys, next_text, next_keys``: each document and the next one by descending id, the first after the last.

    The top document of a range is copied to the range above it, so each range finds its successors on its own, and texts
    are shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    rows = with_part(rows, docs.select(F.col("doc_id").cast("bigint").alias("doc_id")))
    # a row for each range, one in ORDERED documents
    tops = rows.groupBy("part").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text_key")).alias("top"))
    order = W.orderBy(F.col("part").desc())
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    above = tops.select("top", F.coalesce(F.lag("part").over(order), F.last("part").over(whole)).alias("to"))
    above = settled(above.select(F.col("top.doc_id").alias("top_id"), F.col("top.text_key").alias("top_key"), "to"), "range-tops")
    is_top = (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("top_id")) & (F.col("text_key") == F.col("top_key"))
    small = above.count() <= 100_000
    copies = rows.join(F.broadcast(above) if small else above, is_top).select("doc_id", "text", "text_key", F.col("to").alias("part"), F.lit(True).alias("tail"))
    dealt = rows.select("doc_id", "text", "text_key", "part", F.lit(False).alias("tail")).unionByName(copies)
    dealt = dealt.withColumn("keys", digests(F.col("text")))
    descending = W.partitionBy("part").orderBy("tail", F.col("doc_id").desc_nulls_last(), F.col("text_key").desc())
    following = F.lead(F.struct("text", "keys")).over(descending)
    return dealt.withColumn("following", following).where("not tail").select("doc_id", "text", "keys", F.col("following.text").alias("next_text"), F.col("following.keys").alias("next_keys"))


def compared(docs: DataFrame) -> DataFrame:
    """The query: fingerprints of each document and of its edited text, and their likenesses."""
    rows = with_next(only(docs, "doc_id", "text")).withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "keys", "next_keys", digests(F.col("edited")).alias("edited_keys"))
    rows = with_likeness(rows, "keys", "edited_keys", "near_edited")
    rows = with_likeness(rows, "keys", "next_keys", "near_next")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("keys")).alias("fingerprint"),
        fingerprint(F.col("edited_keys")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
