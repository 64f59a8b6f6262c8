"""Stored postings: a word index on disk that answers BM25 and shared-term queries without reading the texts again.

Texts are split into words once, when they are added. A segment holds what one addition brought: ``documents``, each
text's words and counts under a shard and a number within it; ``postings``, for each word and shard the numbers (as
gaps), counts and lengths, with the highest count and least length of every block of 128; ``statistics``, the texts that
hold a word; ``dead``, the texts of earlier segments that the addition replaces or removes, and with them negative
statistics. A shard is a run of texts of one task, up to a number of words, so texts and their words are not shuffled; a
word that all texts hold is as many rows as there are shards. The task of a file of ``documents`` reads it from the shared
folder and makes the postings of its shards; these alone are shuffled. They are stored by bucket of the word, and a
bucket's shards over several files.

Segments are never changed. A version is the list of segments it consists of, and the latest complete one counts, so a
failed addition leaves no trace in answers. ``merge_segments`` makes one segment of all living texts, from their stored
words.

A query's words meet their postings in a join. The task of a shard takes a query's words in order of what they can add;
once the best k found lie above all that the words left can add, only texts that can still reach them are looked up, and
blocks whose maxima show that they cannot help are passed over. Tasks send shard, number and score; ids and kept columns
are fetched for the best alone.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import BM25_B, BM25_K1
from ..functions.rows import each_element
from ..functions.text import words
from ..session import fresh_path, settled
from ..sources.textfiles import file_system
from .lexical import CORPUS, query_terms
from .topk import _one_chunk, round_score, stretches

BLOCK = 128
SHARD_CHARS = 8 << 20
CHARS_PER_WORD = 6
#: Of stored texts, words and postings, which are large and written once.
CODEC = "zstd"
BUCKET_CHARS = 64 << 20
MOST_BUCKETS = 4096
#: Shards of one bucket that stand in one file, at most. There are fewer where all cores would not have two files to write.
SHARDS_PER_FILE = 64
QUERIES_PER_BLOCK = 2048
#: Words of a batch of texts that are counted together.
COUNTED_AT_ONCE = 250_000
#: Terms up to this number are sent to the tasks, to choose postings; beyond, the join shuffles.
SENT_TERMS = 200_000
#: Scores are compared after rounding to four digits, so nothing is passed over that is this close to the best.
MARGIN = 1e-4
VERSIONS = "version int, place int, segment string, texts bigint, words bigint, buckets int"
POSTINGS = "shard int, term string, gaps array<int>, counts array<int>, lengths array<int>, top_counts array<int>, least_lengths array<int>"


@dataclass(frozen=True)
class Segment:
    name: str
    texts: int
    words: int
    buckets: int


@dataclass(frozen=True)
class Postings:
    """An index as it stood at a version; ``doc_id`` names the texts' key."""

    spark: SparkSession
    path: str
    version: int
    segments: tuple[Segment, ...]
    doc_id: str

    @property
    def texts(self) -> int:
        return sum(s.texts for s in self.segments)

    @property
    def average(self) -> float:
        return sum(s.words for s in self.segments) / self.texts if self.texts else 1.0

    def _read(self, segment: Segment, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{segment.name}/{part}").withColumn("segment", F.lit(segment.name))

    def _all(self, part: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._read(s, part) for s in self.segments])

    def dead(self) -> DataFrame:
        """``segment, shard, numbers``: texts that a later segment replaces or removes; a row for each time."""
        return self._all("dead").select(F.col("of_segment").alias("segment"), "shard", "numbers")

    def documents(self, columns: Sequence[str] | None = None) -> DataFrame:
        """The living texts: their stored columns, ``segment, shard, number, length, terms, counts``; or their places and
        ``columns`` alone."""
        at = ["segment", "shard", "number"]
        gone = each_element(self.dead(), ["segment", "shard"], F.col("numbers"), "number").drop("position")
        held = self._all("documents")
        return (held if columns is None else held.select(*at, *columns)).join(gone, at, "left_anti")


def count_terms(batch: pa.RecordBatch, tokens: str, kept: Sequence[str]) -> pa.RecordBatch:
    """``kept, length, terms, counts`` of some texts."""
    column = batch.column(tokens)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = column.flatten().dictionary_encode()
    row = np.repeat(np.arange(batch.num_rows), lengths)
    width = max(len(coded.dictionary), 1)
    pair, count = np.unique(row * width + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    ends = pa.array(np.searchsorted(pair // width, np.arange(batch.num_rows + 1)).astype(np.int32))
    terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(pair % width)).cast(pa.string()))
    counts = pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32)))
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lengths), terms, counts], names=[*kept, "length", "terms", "counts"])


def term_counts(docs: DataFrame, tokens: str) -> DataFrame:
    """Replaces the array ``tokens`` by ``length, terms, counts``: its distinct words and how often each stands there."""
    kept = [c for c in docs.columns if c != tokens]

    def counted(batches):
        for batch in batches:
            for start, stop in stretches(batch.column(tokens), COUNTED_AT_ONCE):
                yield count_terms(batch.slice(start, stop - start), tokens, kept)

    head = docs.select(*kept, F.lit(0).cast("bigint").alias("length"), F.array().cast("array<string>").alias("terms"), F.array().cast("array<int>").alias("counts"))
    return docs.select(*kept, tokens).mapInArrow(counted, head.schema)


def shard_postings(table: pa.Table) -> pa.Table:
    """The postings of one shard: ``shard, number, length, terms, counts`` of its texts to a row for each word."""
    table = table.combine_chunks()
    held = table.column("terms").combine_chunks()
    held = pa.concat_arrays(held.chunks) if isinstance(held, pa.ChunkedArray) else held
    sizes = held.value_lengths().to_numpy(zero_copy_only=False)
    coded = held.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    number = np.repeat(table.column("number").to_numpy(), sizes).astype(np.int32)
    length = np.repeat(table.column("length").to_numpy(), sizes).astype(np.int32)
    count = table.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((number, code))
    code, number, length, count = code[order], number[order], length[order], count[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    runs = np.diff(first, append=len(code))
    gaps = np.diff(number, prepend=0)
    gaps[first] = number[first]
    blocks = -(-runs // BLOCK)
    begins = np.repeat(first - (np.cumsum(blocks) - blocks) * BLOCK, blocks) + np.arange(blocks.sum()) * BLOCK
    ends, block_ends = (pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)) for n in (runs, blocks))
    lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (gaps, count, length)]
    tops = np.maximum.reduceat(count, begins) if len(begins) else count
    least = np.minimum.reduceat(length, begins) if len(begins) else length
    maxima = [pa.ListArray.from_arrays(block_ends, pa.array(v.astype(np.int32))) for v in (tops, least)]
    shard = pa.array(np.full(len(first), table.column("shard")[0].as_py() if table.num_rows else 0, np.int32))
    terms = coded.dictionary.take(pa.array(code[first]))
    return pa.Table.from_arrays([shard, terms, *lists, *maxima], names=["shard", "term", "gaps", "counts", "lengths", "top_counts", "least_lengths"])


LISTS = [column.split()[0] for column in POSTINGS.split(", ")][2:]
PACKED = "shard int, term string, many int, wide boolean, packed binary, piece int"


def pack(rows: pa.Table, piece: int) -> pa.Table:
    """Postings with the lists of a row as one value, for the shuffle: an array of a row has more overhead than a rare word
    has postings. Numbers take two bytes each where all of them fit."""
    lists = [_one_chunk(rows.column(c).combine_chunks()) for c in LISTS]
    sizes = [held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for held in lists]
    flat = [held.flatten().to_numpy(zero_copy_only=False) for held in lists]
    wide = max((int(v.max()) for v in flat if len(v)), default=0) >= 1 << 16
    total = sum(sizes)
    ends = np.cumsum(total)
    out, at = np.empty(ends[-1] if len(ends) else 0, np.int32 if wide else np.uint16), ends - total
    for size, values in zip(sizes, flat, strict=True):
        out[np.arange(len(values)) + np.repeat(at - (np.cumsum(size) - size), size)] = values
        at = at + size
    offsets = (np.concatenate([[0], ends]) * out.itemsize).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(total), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    columns = [rows.column("shard"), rows.column("term"), pa.array(sizes[0].astype(np.int32)), pa.array(np.full(len(total), wide)), packed, pa.array(np.full(len(total), piece, np.int32))]
    return pa.Table.from_arrays(columns, names=["shard", "term", "many", "wide", "packed", "piece"])


def unpack(batch: pa.RecordBatch, kept: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """``kept`` and the lists of packed rows."""
    for wide in (False, True):
        rows = batch.filter(pc.equal(batch.column("wide"), wide))
        if not rows.num_rows:
            continue
        packed, many = rows.column("packed"), rows.column("many").to_numpy().astype(np.int64)
        offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
        values = np.frombuffer(packed.buffers()[2], np.int32 if wide else np.uint16, offsets[-1] // (4 if wide else 2))
        at, blocks, lists = offsets[:-1] // values.itemsize, -(-many // BLOCK), []
        for size in (many, many, many, blocks, blocks):
            ends = np.cumsum(size)
            taken = values[np.arange(ends[-1]) + np.repeat(at - (ends - size), size)].astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(taken)))
            at = at + size
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *lists], names=[*kept, *LISTS])


def number_texts(texts: DataFrame, doc_id: str, shard_words: int) -> DataFrame:
    """Adds ``shard, number``: texts as they come, each shard some ``shard_words`` words of one task, numbered by id."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting, words = TaskContext.get().partitionId() << 14, [], 0

        def in_order() -> list[pa.RecordBatch]:
            table = pa.Table.from_batches(waiting)
            table = table.take(pc.sort_indices(table.column(doc_id), null_placement="at_start"))
            number = np.arange(table.num_rows, dtype=np.int32)
            return table.append_column("shard", pa.array(np.full_like(number, shard))).append_column("number", pa.array(number)).to_batches()

        for batch in batches:
            ends = np.cumsum(batch.column("length").to_numpy(zero_copy_only=False) + 1)  # a text without words counts, too
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                stop = min(batch.num_rows, int(np.searchsorted(ends, before + shard_words - words)) + 1)
                waiting.append(batch.slice(at, stop - at))
                words += int(ends[stop - 1]) - before
                at = stop
                if words >= shard_words:
                    yield from in_order()
                    shard, waiting, words = shard + 1, [], 0
        if waiting:
            yield from in_order()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInArrow(numbered, f"{kinds}, shard int, number int")


def _stored_shards(store: fs.FileSystem, file: str) -> Iterator[pa.Table]:
    """The shards of a file of documents, one after the other."""
    columns = ["shard", "number", "length", "terms", "counts"]
    waiting: list[pa.RecordBatch] = []
    with store.open_input_file(file) as opened:
        for batch in pq.ParquetFile(opened).iter_batches(4096, columns=columns, use_threads=False):
            shards = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.diff(shards, prepend=shards[:1] - 1))
            for start, stop in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if waiting and waiting[-1].column("shard")[0].as_py() != shards[start]:
                    yield pa.Table.from_batches(waiting)
                    waiting = []
                waiting.append(batch.slice(start, stop - start))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _postings_of(documents: DataFrame, folder: str, most: int) -> tuple[DataFrame, int]:
    """The packed postings of stored documents with the ``piece`` that their shard belongs to, and the number of pieces, ``most``
    or as many as there are shards."""
    store, path = file_system(folder)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".parquet") and f.base_name[0] not in "._")
    shards = sorted(r["shard"] for r in documents.select("shard").distinct().collect())  # a number for millions of words
    pieces = max(1, min(len(shards), most))
    piece = {shard: at * pieces // len(shards) for at, shard in enumerate(shards)}

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, _ = file_system(folder)
        for batch in batches:
            for at in batch.column(0).to_pylist():
                for table in _stored_shards(held, files[at]):
                    yield from pack(shard_postings(table), piece[table.column("shard")[0].as_py()]).to_batches()

    spark = documents.sparkSession
    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(posted, PACKED), pieces


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _write_segment(spark: SparkSession, path: str, texts: DataFrame, doc_id: str, chars: int, shard_chars: int, dead: DataFrame | None, lost: DataFrame | None) -> Segment:
    """Writes one segment from texts with ``length, terms, counts``. ``dead``: ``of_segment, shard, numbers``; ``lost``: the
    stored rows of those texts."""
    name = uuid.uuid4().hex
    at = f"{path}/segments/{name}"
    shards = max(1, math.ceil(chars / shard_chars))
    buckets = max(1, min(MOST_BUCKETS, math.ceil(chars / BUCKET_CHARS)))
    few = texts.coalesce(max(shards, spark.sparkContext.defaultParallelism))  # else each of many small tasks is a shard
    numbered = number_texts(few, doc_id, max(1, shard_chars // CHARS_PER_WORD))
    numbered.write.option("maxRecordsPerFile", 0).option("compression", CODEC).parquet(f"{at}/documents")  # a shard stands in one file
    documents = spark.read.parquet(f"{at}/documents")
    most = max(math.ceil(shards / SHARDS_PER_FILE), math.ceil(2 * spark.sparkContext.defaultParallelism / buckets))
    made, pieces = _postings_of(documents, f"{at}/documents", most)
    kept = ["shard", "term", "bucket"]
    # by number, not by hash, which gives some tasks several files and others none
    dealt = made.withColumn("bucket", _bucket(F.col("term"), buckets)).repartitionById(buckets * pieces, F.col("bucket") * pieces + F.col("piece"))
    lists = ", ".join(f"{c} array<int>" for c in LISTS)
    postings = dealt.mapInArrow(lambda batches: (rows for batch in batches for rows in unpack(batch, kept)), f"shard int, term string, bucket int, {lists}")
    postings.sortWithinPartitions("bucket", "term", "shard").write.option("compression", CODEC).partitionBy("bucket").parquet(f"{at}/postings")
    counts = [spark.read.schema(f"{POSTINGS}, bucket int").parquet(f"{at}/postings").groupBy("term").agg(F.sum(F.size("gaps")).alias("texts"))]
    totals = documents.agg(F.count(F.lit(1)).alias("texts"), F.sum("length").alias("words")).first()
    brought, removed = (totals["texts"], totals["words"] or 0), (0, 0)
    if lost is not None:
        counts.append(lost.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("texts")))
        gone = lost.agg(F.count(F.lit(1)).alias("texts"), F.sum("length").alias("words")).first()
        removed = (gone["texts"], gone["words"] or 0)
    reduce(DataFrame.unionByName, counts).write.parquet(f"{at}/statistics")
    none = spark.createDataFrame([], "of_segment string, shard int, numbers array<int>")
    (none if dead is None else dead).write.parquet(f"{at}/dead")
    return Segment(name, brought[0] - removed[0], brought[1] - removed[1], buckets)


def _commit(spark: SparkSession, path: str, version: int, segments: Sequence[Segment], doc_id: str) -> Postings:
    rows = [(version, k, s.name, s.texts, s.words, s.buckets) for k, s in enumerate(segments)]
    spark.createDataFrame(rows, VERSIONS).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/versions/version={version}")
    return Postings(spark, path, version, tuple(segments), doc_id)


def open_postings(spark: SparkSession, path: str, *, doc_id: str = "doc_id") -> Postings:
    """The latest version."""
    rows = spark.read.schema(VERSIONS).option("basePath", f"{path}/versions").parquet(f"{path}/versions").collect()
    latest = max(r["version"] for r in rows)
    held = sorted((r for r in rows if r["version"] == latest), key=lambda r: r["place"])
    return Postings(spark, path, latest, tuple(Segment(r["segment"], r["texts"], r["words"], r["buckets"]) for r in held), doc_id)


def _read_texts(docs: DataFrame, doc_id: str, text: str, terms: str | None, keep: Sequence[str]) -> tuple[DataFrame, int]:
    """The texts' words and counts, and their number of characters. Null texts are left out, as BM25 does."""
    tokens = words(F.col(text)) if terms is None else F.col(terms).cast("array<string>")
    size = F.length(text) if terms is None else F.size(terms) * 8
    present = docs.where(F.col(text if terms is None else terms).isNotNull())
    chars = present.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    columns = [doc_id, *[c for c in keep if c != doc_id]]
    return term_counts(present.select(*columns, tokens.alias("_tokens")), "_tokens"), chars


def build_postings(
    docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", terms: str | None = None, keep: Sequence[str] = (), shard_chars: int = SHARD_CHARS
) -> Postings:
    """Writes the index of ``docs`` below ``path``. ``doc_id`` is unique and not null.

    ``text`` is split into words; or ``terms`` names an array that holds the terms. ``keep`` are columns that answers can carry.
    """
    spark = docs.sparkSession
    texts, chars = _read_texts(docs, doc_id, text, terms, keep)
    return _commit(spark, path, 0, [_write_segment(spark, path, texts, doc_id, chars, shard_chars, None, None)], doc_id)


def _dead(index: Postings, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Living texts whose key comes in: their places by shard, and their stored rows."""
    at = ["segment", "shard", "number"]
    coming = keys.select(index.doc_id).distinct()
    # keys and places alone are shuffled; the words of the texts hit follow from where they stand
    hit = settled(index.documents([index.doc_id]).join(coming, index.doc_id, "left_semi").select(*at), "postings-dead")
    lost = settled(index._all("documents").select(*at, "length", "terms").join(hit, at, "left_semi"), "postings-lost")
    places = hit.groupBy(F.col("segment").alias("of_segment"), "shard").agg(F.sort_array(F.collect_list("number")).alias("numbers"))
    return places, lost


def add_texts(index: Postings, docs: DataFrame, *, text: str = "text", terms: str | None = None, keep: Sequence[str] = (), shard_chars: int = SHARD_CHARS) -> Postings:
    """A version with ``docs`` added; a text whose key is there already replaces it. Only the new texts are split into words."""
    texts, chars = _read_texts(docs, index.doc_id, text, terms, keep)
    dead, lost = _dead(index, docs)
    added = _write_segment(index.spark, index.path, texts, index.doc_id, chars, shard_chars, dead, lost)
    return _commit(index.spark, index.path, index.version + 1, [*index.segments, added], index.doc_id)


def remove_texts(index: Postings, keys: DataFrame) -> Postings:
    """A version without the texts whose key is among ``keys``."""
    dead, lost = _dead(index, keys)
    nothing = index._read(index.segments[0], "documents").drop("segment", "shard", "number").limit(0)
    removed = _write_segment(index.spark, index.path, nothing, index.doc_id, 0, SHARD_CHARS, dead, lost)
    return _commit(index.spark, index.path, index.version + 1, [*index.segments, removed], index.doc_id)


def merge_segments(index: Postings, *, shard_chars: int = SHARD_CHARS) -> Postings:
    """A version of one segment with all living texts, made from their stored words."""
    living = index.documents().drop("segment", "shard", "number")
    chars = CHARS_PER_WORD * sum(s.words for s in index.segments)
    merged = _write_segment(index.spark, index.path, living, index.doc_id, chars, shard_chars, None, None)
    return _commit(index.spark, index.path, index.version + 1, [merged], index.doc_id)


def stored_statistics(index: Postings) -> DataFrame:
    """``term, texts, total_words`` as ``lexical.word_statistics`` gives them, from the index."""
    counted = index._all("statistics").groupBy("term").agg(F.sum("texts").alias("texts")).where("texts > 0")
    corpus = index.spark.createDataFrame([(CORPUS, index.texts, sum(s.words for s in index.segments))], "term string, texts bigint, total_words bigint")
    rows = counted.select("term", "texts", F.lit(0).cast("bigint").alias("total_words"))
    return rows.unionByName(corpus) if index.texts else rows


class ShardScorer:
    """The postings of some words in one shard, and the best texts for a query of them.

    ``saturation`` is (k1, b, average length), or None if each word a text holds adds its weight once.
    """

    def __init__(self, rows: pa.Table, saturation: tuple[float, float, float] | None, dead: np.ndarray):
        self.saturation = saturation
        self.numbers, self.counts, self.lengths, self.tops = {}, {}, {}, {}
        size = 0
        columns = [rows.column(c) for c in ("gaps", "counts", "lengths", "top_counts", "least_lengths")]
        for at, term in enumerate(rows.column("term").to_pylist()):
            gaps, counts, lengths, top, least = (c[at].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
            self.numbers[term] = np.cumsum(gaps)
            self.counts[term], self.lengths[term] = counts, lengths
            self.tops[term] = self.part(top, least)
            size = max(size, int(self.numbers[term][-1]) + 1)
        self.living = np.ones(size, bool)
        self.living[dead[dead < size]] = False
        self.scored = 0  # postings that were scored, of all queries so far

    def part(self, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if self.saturation is None:
            return np.ones(len(counts))
        k1, b, average = self.saturation
        return counts * (k1 + 1.0) / (counts + k1 * (1.0 - b + b * lengths / average))

    def best(self, terms: list[str], weights: list[float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and rounded scores of the best k, by score and then number."""
        most = np.array([w * self.tops[t].max() for t, w in zip(terms, weights, strict=True)])
        order = np.argsort(-most, kind="stable")
        left = np.concatenate([np.cumsum(most[order][::-1])[::-1][1:], [0.0]])  # what the words after each can add
        scores, touched = np.zeros(len(self.living)), np.zeros(len(self.living), bool)
        alive, floor = None, 0.0
        for at, rest in zip(order, left, strict=True):
            term, weight = terms[at], weights[at]
            numbers = self.numbers[term]
            if alive is None:
                place = np.flatnonzero(self.living[numbers])
                found = numbers[place]
                touched[found] = True
            else:
                place = np.searchsorted(numbers, alive)
                there = place < len(numbers)
                there[there] = numbers[place[there]] == alive[there]
                reach = scores[alive] + rest
                reach[there] += weight * self.tops[term][place[there] // BLOCK]
                chance = reach >= floor - MARGIN  # the block's maximum shows that the others are out
                alive, place = alive[chance], place[chance & there]
                found = numbers[place]
            self.scored += len(place)
            scores[found] += weight * self.part(self.counts[term][place], self.lengths[term][place])
            pool = np.flatnonzero(touched) if alive is None else alive
            if len(pool) > k:
                held = scores[pool]
                floor = max(floor, float(np.partition(held, len(held) - k)[len(held) - k]))
                if floor - MARGIN > rest:  # no text without a score so far can come among the best
                    alive = pool[held + rest >= floor - MARGIN]
        pool = np.flatnonzero(touched) if alive is None else alive
        rounded = round_score(scores[pool])
        best = np.lexsort((pool, -rounded))[:k]
        return pool[best], rounded[best]


def _asked_by_term(weighted: DataFrame, blocks: int) -> DataFrame:
    """``_query, term, weight`` to a row for each word and block of queries that use it."""
    block = F.pmod(F.xxhash64("_query"), F.lit(blocks)).cast("int")
    return weighted.groupBy("term", block.alias("asking")).agg(F.collect_list(F.struct("_query", "weight")).alias("users"))


def _scored(index: Postings, weighted: DataFrame, k: int, saturation: tuple[float, float, float] | None) -> DataFrame:
    """``_query, segment, shard, number, score``: the best k of every shard for every query."""
    spark = index.spark
    asking = settled(weighted, "postings-asked")
    size = asking.agg(F.approx_count_distinct("_query").alias("queries"), F.count(F.lit(1)).alias("rows")).first()
    blocks = max(1, math.ceil(size["queries"] / QUERIES_PER_BLOCK))
    users = _asked_by_term(asking, blocks)
    if size["rows"] <= SENT_TERMS:
        users = F.broadcast(users)
    kind, names = asking.schema["_query"].dataType.simpleString(), ["segment", "shard", "asking"]
    lists = [c.split()[0] for c in POSTINGS.split(", ")][2:]
    parts = []
    for segment in index.segments:
        rows = spark.read.schema(f"{POSTINGS}, bucket int").parquet(f"{index.path}/segments/{segment.name}/postings")
        if segment.buckets > 1 and size["rows"] <= SENT_TERMS:  # at most MOST_BUCKETS numbers
            rows = rows.where(F.col("bucket").isin([r[0] for r in asking.select(_bucket(F.col("term"), segment.buckets)).distinct().collect()]))
        parts.append(rows.join(users, "term").select(F.lit(segment.name).alias("segment"), "shard", "asking", "term", *lists, "users"))
    found = reduce(DataFrame.unionByName, parts)
    gone = index.dead().select("segment", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("asking"), F.col("numbers").alias("gaps"))
    found = found.unionByName(gone, allowMissingColumns=True)

    def best_in_shard(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dead = table.filter(pc.is_null(table.column("term"))).column("gaps").combine_chunks().flatten()
        rows = table.filter(pc.is_valid(table.column("term")))
        scorer = ShardScorer(rows, saturation, dead.to_numpy(zero_copy_only=False).astype(np.int64))
        asked: dict[object, tuple[list[str], list[float]]] = {}
        for term, users_of in zip(rows.column("term").to_pylist(), rows.column("users").to_pylist(), strict=True):
            for one in users_of:
                terms, weights = asked.setdefault(one["_query"], ([], []))
                terms.append(term)
                weights.append(one["weight"])
        query, number, score = [], [], []
        for one, (terms, weights) in asked.items():
            order = sorted(range(len(terms)), key=terms.__getitem__)  # the order of adding does not hang on the order of rows
            numbers, scores = scorer.best([terms[i] for i in order], [weights[i] for i in order], k)
            query += [one] * len(numbers)
            number.append(numbers)
            score.append(scores)
        many = len(query)
        columns = [
            pa.array(query, table.schema.field("users").type.value_type.field("_query").type),
            pa.array([table.column("segment")[0].as_py()] * many, pa.string()),
            pa.array([table.column("shard")[0].as_py()] * many, pa.int32()),
            pa.array(np.concatenate(number) if number else [], pa.int32()),
            pa.array(np.concatenate(score) if score else [], pa.float64()),
        ]
        return pa.Table.from_arrays(columns, names=["_query", "segment", "shard", "number", "score"])

    return found.groupBy(*names).applyInArrow(best_in_shard, f"_query {kind}, segment string, shard int, number int, score double")


def _ranked(index: Postings, scored: DataFrame, k: int, query_id: str, keep: Sequence[str], score_name: str) -> DataFrame:
    """The best k of each query with id and kept columns, which are read for those alone.

    Merged first by query and group of shards, then by query, with ties kept, as ids decide them.
    """
    for keys in (["_query", F.pmod(F.hash("segment", "shard"), F.lit(64))], ["_query"]):
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc())
        scored = scored.withColumn("_r", F.rank().over(order)).where(F.col("_r") <= k).drop("_r")
    columns = [index.doc_id, *[c for c in keep if c != index.doc_id]]
    texts = index._all("documents").select("segment", "shard", "number", *columns)
    full = texts.join(settled(scored, "postings-best"), ["segment", "shard", "number"])
    order = Window.partitionBy("_query").orderBy(F.col("score").desc(), F.col(index.doc_id))
    ranked = full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("_query").alias(query_id), *columns, F.col("score").alias(score_name), "rank")


def bm25_stored(
    index: Postings,
    queries: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    query_text: str = "query_text",
    keep: Sequence[str] = (),
    k1: float = BM25_K1,
    b: float = BM25_B,
    score_name: str = "score",
) -> DataFrame:
    """``lexical.bm25`` from the index: query id, doc id, kept columns, score (4 digits), rank. No text is read."""
    terms = settled(query_terms(queries, query_id, query_text), "postings-terms")
    asked = terms.select("term").distinct()
    small = terms.count() <= SENT_TERMS
    held = index._all("statistics").join(F.broadcast(asked) if small else asked, "term", "left_semi")
    counts = held.groupBy("term").agg(F.sum("texts").alias("texts")).where("texts > 0")
    weight = F.log1p((F.lit(float(index.texts)) - F.col("texts") + 0.5) / (F.col("texts") + 0.5))
    weighted = terms.join(counts, "term").select("_query", "term", weight.alias("weight"))
    return _ranked(index, _scored(index, weighted, k, (k1, b, index.average)), k, query_id, keep, score_name)


def shared_terms_stored(index: Postings, weights: DataFrame, k: int, *, query_id: str = "query_id", keep: Sequence[str] = (), score_name: str = "score") -> DataFrame:
    """``lexical.shared_terms`` from an index of terms: items by the summed weights of the terms they share with a query."""
    weighted = weights.select(F.col(query_id).alias("_query"), "term", F.col("weight").cast("double"))
    return _ranked(index, _scored(index, weighted, k, None), k, query_id, keep, score_name)


def temporary_postings(docs: DataFrame, name: str = "postings", **options) -> Postings:
    """An index in a folder of its own below the shared one."""
    return build_postings(docs, fresh_path(docs.sparkSession, name), **options)
