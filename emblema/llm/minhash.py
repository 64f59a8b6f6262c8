"""MinHash near-dedup with circulant permutations, banding and exact confirmation.

A document's set holds the hashes of its distinct shingles. Two permutations make the whole signature: the first
scatters the set, and the second, shifted circularly by one for each coordinate, gives that coordinate's minimum. Bands
of coordinates are buckets. Every document goes to the leader (least set) of each of its buckets, and within a leader's
group links are confirmed on full sets by an inverted index over their shingles. Linked documents form components.

Documents with equal sets are one set throughout, so groups of exact copies cost no more than one document. A leader's
group is dealt out in blocks; each task holds two blocks.

Chance of missing a link: at a similarity of exactly 0.8, one in 300,000 (32 bands of 5); less above.

Defined cases: a null text, or one without words, has an empty set, links with nothing and is kept; a null id takes part
in links but never becomes a component's id; documents of a component without ids have a null one and are kept; repeated
rows have equal sets; an empty table gives an empty result; further columns are left aside; a set is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emblema.session import settled

from .common import only
from .components import components
from .rolling import Hashes, mixed, runs

WORDS, THRESHOLD = 4, 80
BANDS, ROWS = 32, 5
#: Sets in a block of a leader's group.
BLOCK = 2048
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    found: list[np.ndarray] = []
    for _, _, data, begins in runs([(t or "").encode().lower() for t in texts]):
        hashes, space = Hashes(data), _SPACE[data]
        before = np.concatenate([[True], space[:-1]]) if len(data) else np.zeros(0, bool)
        after = np.concatenate([space[1:], [True]]) if len(data) else np.zeros(0, bool)
        inner = begins[:-1][np.diff(begins) > 0]
        before[inner] = True  # texts stand side by side; a word ends with its text
        after[inner[1:] - 1] = True
        start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        word = hashes.of(start, end)
        bounds = np.searchsorted(start, begins)
        for k in range(len(begins) - 1):
            own = word[bounds[k] : bounds[k + 1]]
            n = max(1, len(own) - words + 1) if len(own) else 0
            total = np.zeros(n, np.uint64)
            for j in range(min(words, len(own))):
                total = mixed(total + own[j : j + n]) + np.uint64(j + 1)
            found.append(np.unique(total))
    return found


_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)[:, None]
_WITHIN = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)).reshape(BANDS, ROWS) | np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set's bands, as signed 64-bit numbers."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    scattered = (mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(scattered), 1024):
        x = scattered[None, at : at + 1024] + _SHIFTS
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        np.minimum(least, x.min(axis=1), out=least)
    keys = mixed((least.reshape(BANDS, ROWS).astype(np.uint64) * _WITHIN).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return keys.view(np.int64)


def set_key(hashes: np.ndarray) -> int:
    """One 64-bit key for a set."""
    at = np.arange(1, len(hashes) + 1, dtype=np.uint64)
    return int(mixed(np.array([mixed(hashes + at * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)])).view(np.int64)[0])


def with_keys(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, set_key`` and the keys of the bands; an empty set has none."""
    schema = "doc_id bigint, text_key bigint, n_shingles bigint, set_key bigint, bands array<bigint>"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist(), words)
            bands = [band_keys(s) if len(s) else np.zeros(0, np.int64) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64()), lists],
                ["doc_id", "text_key", "n_shingles", "set_key", "bands"],
            )

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(keys, schema)


def groups(keyed: DataFrame) -> DataFrame:
    """``set_key, leader``: each set with the leaders of its shared buckets, its own lead included; sets that share none are left out."""
    sets = keyed.where("n_shingles > 0").groupBy("set_key").agg(F.first("bands").alias("bands"))
    rows = settled(sets.select("set_key", F.explode("bands").alias("band")), "bands")
    shared = rows.groupBy("band").agg(F.min("set_key").alias("leader"), F.max("set_key").alias("last")).where("leader < last").select("band", "leader")
    return rows.join(shared, "band").select("set_key", "leader").distinct()


def linked_pairs(members: list[tuple[int, np.ndarray]], others: list[tuple[int, np.ndarray]] | None, threshold: int) -> list[tuple[int, int]]:
    """Links that connect ``members`` with each other, or with ``others``, as each set with one of its component.

    An inverted index over the shingles counts what a set shares with all others at once. A set that is linked with
    the first set of its component needs no second look against that component.
    """
    sets = members + (others or [])
    n, first = len(sets), len(members)
    parent = np.arange(n)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    sizes = np.array([len(s) for _, s in sets])
    tokens, place = np.unique(np.concatenate([s for _, s in sets]), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(place, kind="stable")
    posting = owner[order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(tokens)))])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    links: list[tuple[int, int]] = []
    for k in range(first if others is not None else n):
        own = place[starts[k] : starts[k + 1]]
        counts = bounds[own + 1] - bounds[own]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1]) + np.repeat(bounds[own] - (ends - counts), counts)
        common = np.bincount(posting[at], minlength=n)
        near = 100 * common >= threshold * (sizes[k] + sizes - common)
        near[: first if others is not None else k + 1] = False
        for other in np.flatnonzero(near):
            a, b = root(k), root(int(other))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((sets[k][0], sets[int(other)][0]))
    return links


def confirmed(docs: DataFrame, keyed: DataFrame, grouped: DataFrame, words: int, threshold: int, block: int) -> DataFrame:
    """``a, b``: links that hold on full sets and connect every component.

    Each set is computed anew from one of its texts and goes to its leaders' groups. A group of more than ``block`` sets
    is cut into blocks by hash, and each pair of blocks is a task's work, so no task holds more than two blocks.
    """
    sizes = grouped.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    # block k meets block j in the cell (min, max); a group of one block is one cell
    own = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("low"), F.greatest(j, F.col("own")).alias("high")))
    placed = (
        grouped.join(sizes, "leader").withColumn("blocks", blocks).withColumn("own", own)
        .select("set_key", "leader", "own", F.explode(cells).alias("cell"))
        .select("set_key", F.struct("leader", "own", "cell").alias("place"))
        .groupBy("set_key").agg(F.collect_list("place").alias("places"))
    )
    chosen = keyed.where("n_shingles > 0").groupBy("set_key").agg(F.min(F.struct("text_key", "doc_id")).alias("row")).select("set_key", "row.*")
    wanted = placed.join(chosen, "set_key").select(F.col("text_key").alias("wanted_key"), F.col("doc_id").alias("wanted_id"), "set_key", "places")
    texts = only(docs, "doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    matched = texts.join(wanted, (F.col("text_key") == F.col("wanted_key")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("wanted_id")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [s.tobytes() for s in shingle_sets(batch.column(0).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(raw, pa.binary())], ["set_key", "places", "hashes"])

    place = "struct<leader:bigint,own:int,cell:struct<low:int,high:int>>"
    rows = matched.select("text", "set_key", "places").mapInArrow(sets, f"set_key bigint, places array<{place}>, hashes binary")
    rows = rows.select("set_key", "hashes", F.explode("places").alias("place")).select("place.leader", "place.cell.low", "place.cell.high", "place.own", "set_key", "hashes")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(cell, held):
            low, high = cell[1], cell[2]
            unique = {key: (own, raw) for own, key, raw in held}
            sides = {0: [], 1: []}
            for key, (own, raw) in sorted(unique.items()):
                sides[int(own == high and high != low)].append((key, np.frombuffer(raw, np.uint64)))
            if low == high:
                return linked_pairs(sides[0], None, threshold) if len(sides[0]) > 1 else []
            return linked_pairs(sides[0], sides[1], threshold) if sides[0] and sides[1] else []

        cell, held = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for leader, low, high, own, key, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (leader, low, high) != cell:
                    out += flush(cell, held) if held else []
                    cell, held = (leader, low, high), []
                held.append((own, key, raw))
            yield pairs(out)
        yield pairs(flush(cell, held) if held else [])

    def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return rows.repartition("leader", "low", "high").sortWithinPartitions("leader", "low", "high").mapInArrow(link, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``doc_id, text_key, n_shingles, set_key, component_id, first_key``: every document with its component.

    ``component_id`` is the smallest id of the component, ``first_key`` the text of the document that stands for it.
    """
    keyed = settled(with_keys(docs, words), "shingle-keys")
    grouped = settled(groups(keyed), "leaders")
    labels = components(confirmed(docs, keyed, grouped, words, threshold, block))
    rows = keyed.select("doc_id", "text_key", "n_shingles", "set_key")
    # an empty set is a component of its own
    alone = rows.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "first_key": F.col("text_key")})
    named = rows.where("n_shingles > 0").join(labels.withColumnRenamed("node", "set_key"), "set_key", "left")
    named = settled(named.withColumn("component", F.coalesce("component", "set_key")), "labels")
    first = named.groupBy("component").agg(
        F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    )
    return named.join(first, "component").select(*rows.columns, "component_id", F.col("first.text_key").alias("first_key")).unionByName(alone)


def label_documents(docs: DataFrame) -> DataFrame:
    """The query: each document's set size and component."""
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, with its columns; documents without words stay.

    Repeated rows of the document that stays, equal in id and text, are one.
    """
    found = near_duplicates(docs, words, threshold)
    stays = found.where(
        (F.col("n_shingles") == 0) | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key")))
    ).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(((F.count(F.lit(1)) > 1) & (F.max("n_shingles") > 0)).alias("_repeated"))
    names = docs.columns
    rows = docs.withColumn("_text_key", F.xxhash64("text")).join(
        stays, (F.col("_text_key") == F.col("_key")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id"))
    )
    rows = settled(rows.select(*[F.col(f"`{c}`") for c in names], "_text_key", "_repeated"), "kept")
    once = rows.where("_repeated").dropDuplicates(["doc_id", "_text_key"])
    return rows.where("not _repeated").unionByName(once).select(*[F.col(f"`{c}`") for c in names])


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(greatest(1, len(w) - 3)), lambda i: array_to_string(w[i + 1:i + 4], ' '))) END AS s
  FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sets s JOIN least l USING (doc_id)
"""
