"""Spelling variants: words one edit apart, found by pivotal grams, and the frequent word that each rare one stands for.

A word's bigrams are ordered by how many words hold them, rarest first. Its prefix is the first three and all that are
equal to the third; its two pivots are disjoint bigrams of the prefix, of the least total frequency, chosen by dynamic
programming. One edit spoils one of two disjoint bigrams at most. So of two words an edit apart, the one whose
prefix ends earlier in the order has a pivot that stands unharmed in the other's prefix, and the edit lies on one side
of it. The position limit is therefore exact: the other side is equal, letter by letter, in both words. A pivot is looked
up together with that side, and what is found is verified. Where very many words share such a key, it is narrowed by the
other side with each letter left out in turn, which two sides one edit apart have in common: no group is ever paired
with itself, and no link is lost.

Defined cases: a null or empty text has no words; a null id counts as an empty one; repeated rows count as often as
they stand there; words of four letters or less meet by their letters left out as well, as they have too few bigrams; words of 512 letters
or more meet by their first or last 256, one of which is unharmed; of equally frequent forms the smallest in code-point
order counts; no words give an empty result; further columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emblema.session import settled

from .common import only
from .rolling import mixed

#: Grams are counted in so many cells by hash, which bounds the table sent to the tasks whatever the alphabet.
GRAM_CELLS = 1 << 16
#: Words that share a key are paired within it up to this number; beyond, the key is narrowed.
CROWD = 64
HELD_WORDS, HELD_CHARS = 200_000, 8 << 20
#: Rows of a batch that a task hands on.
PIECE = 50_000
#: Of the polynomial hash: an odd number and its inverse for 64 bits.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Words of at most so many letters have too few bigrams; of at least so many, their first or last half of that is equal.
SHORT, LONG = 4, 512
SIGNATURE = {
    "key": ("bigint", pa.int64()), "pivot": ("boolean", pa.bool_()), "start": ("int", pa.int32()), "stop": ("int", pa.int32()),
    "last_n": ("bigint", pa.int64()), "last": ("string", pa.string()), "word": ("string", pa.string()), "n": ("bigint", pa.int64()),
}


def planted_typo(doc_id: object, word: str) -> str:
    """The word, or for one in 31 by the hash of id and word, the word without one of its letters."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    return word if h % 31 else word[: h % len(word)] + word[h % len(word) + 1 :]


def count_words(docs: DataFrame, *, change: Callable[[object, str], str] | None = None, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """``doc_id, text`` to ``word, n``: maximal runs of Latin letters, A to Z lower-cased, and how often each occurs.

    ``change`` replaces a word given its document's id before lengths are taken and words counted. Tasks count words
    before the shuffle and send their table on whenever it is full, so their memory is bounded by it and one text.
    """
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least_length},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        chars = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for run, n in Counter(runs.findall(text.as_py() or "")).items():
                    word = run.encode("latin-1").lower().decode("latin-1")  # bytes know no letters but A to Z
                    word = word if change is None else change(doc_id, word)
                    if len(word) >= least_length:
                        chars += 0 if word in held else len(word)
                        held[word] += n
                if len(held) > HELD_WORDS or chars > HELD_CHARS:
                    yield _columns(word=(list(held), pa.string()), n=(list(held.values()), pa.int64()))
                    held, chars = Counter(), 0
        if held:
            yield _columns(word=(list(held), pa.string()), n=(list(held.values()), pa.int64()))

    found = only(docs, "doc_id", "text").where("text IS NOT NULL").mapInArrow(counted, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _columns(**columns: tuple[list, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns.values()], names=list(columns))


def _cell(gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram) & (GRAM_CELLS - 1)


def gram_counts(words: DataFrame) -> list[int]:
    """Number of words by cell of their bigrams; ``GRAM_CELLS`` numbers."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                counts.update({_cell(word[p : p + 2]) for p in range(len(word) - 1)})
        yield _columns(cell=(list(counts), pa.int32()), n=(list(counts.values()), pa.int64()))

    counts = [0] * GRAM_CELLS
    for row in words.select("word").mapInArrow(cells, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[row["cell"]] = row["n"]
    return counts


def prefix(word: str, counts: list[int]) -> list[tuple[int, str, int]]:
    """``(frequency, bigram, position)`` of the three first bigrams in the order, and of all others equal to the third."""
    grams = sorted((counts[_cell(word[p : p + 2])], word[p : p + 2], p) for p in range(len(word) - 1))
    return [g for g in grams if g[:2] <= grams[2][:2]] if len(grams) > 2 else []


def pivots(grams: list[tuple[int, str, int]], many: int = 2) -> set[int]:
    """Positions of ``many`` disjoint bigrams of the least total frequency.

    Dynamic programming from left to right: ``best[m]`` holds the cheapest choice of m bigrams among those seen so far,
    and ``ready[m]`` that among those that end before the one at hand.
    """
    by_place = sorted((position, frequency) for frequency, _, position in grams)
    best: list[tuple[int, tuple[int, ...]] | None] = [(0, ())] + [None] * many
    ready, waiting = list(best), []
    for position, frequency in by_place:
        while waiting and waiting[0][0] <= position - 2:
            ready = waiting.pop(0)[1]
        for m in range(many, 0, -1):
            if ready[m - 1] is not None:
                cost = (ready[m - 1][0] + frequency, (*ready[m - 1][1], position))
                best[m] = cost if best[m] is None else min(best[m], cost)
        waiting.append((position, list(best)))
    return set(best[many][1]) if best[many] else set()


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts)) - (1 << 63)


def _keys(word: str, counts: list[int]) -> Iterator[tuple[int, bool, int, int, int, str]]:
    """``key, is a pivot, from, to, frequency and bigram at the prefix's end``; from and to bound the side left open."""
    if len(word) <= SHORT:
        for rest in {word, *(word[:p] + word[p + 1 :] for p in range(len(word)))}:
            yield _hash("short", rest), True, 0, 0, 0, ""
    if len(word) >= LONG:
        yield _hash("head", word[: LONG // 2]), True, LONG // 2, len(word), 0, ""
        yield _hash("tail", word[-(LONG // 2) :]), True, 0, len(word) - LONG // 2, 0, ""
    if len(word) > LONG or not (grams := prefix(word, counts)):
        return
    chosen, (frequency, last, _) = pivots(grams), grams[-1]
    for _, _, p in grams:
        yield _hash("left", word[: p + 2]), p in chosen, p + 2, len(word), frequency, last
        yield _hash("right", word[p:]), p in chosen, 0, p, frequency, last


def signatures(words: DataFrame, counts: list[int]) -> DataFrame:
    """A row for each prefix bigram and side of each word."""
    shipped = words.sparkSession.sparkContext.broadcast(counts)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for key in _keys(word, shipped.value):
                    rows.append((*key, word, n))
                    chars += len(word) + 64
                    if chars > HELD_CHARS:
                        yield _rows(rows)
                        rows, chars = [], 0
        yield _rows(rows)

    return words.select("word", "n").mapInArrow(keyed, ", ".join(f"{name} {kind}" for name, (kind, _) in SIGNATURE.items()))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(SIGNATURE)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, SIGNATURE.values(), strict=True)], names=list(SIGNATURE))


def open_sides(words: list[str], starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash for each word's open side as it is, and with each of its letters left out in turn.

    Polynomial hashes of 64 bits from running sums, so all of a side's cost one pass over it. Of equal letters side by
    side one is left out, as the others give the same.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    begins = np.cumsum(lengths) - lengths + starts
    sizes = stops - starts
    many = int(lengths.max(initial=0)) + 1
    power, inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(many, base, np.uint64)])) for base in (BASE, INVERSE))
    offset = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * power[offset])])
    whole = (sums[begins + sizes] - sums[begins]) * inverse[starts]
    row = np.repeat(np.arange(len(words)), sizes)
    at = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(row))
    own = np.ones(len(row), bool)
    own[1:] = (letters[at[1:]] != letters[at[:-1]]) | (row[1:] != row[:-1])
    row, at = row[own], at[own]
    less = (sums[at] - sums[begins[row]]) * inverse[starts[row]] + (sums[begins[row] + sizes[row]] - sums[at + 1]) * inverse[starts[row] + 1]
    return np.concatenate([np.arange(len(words)), row]), np.concatenate([whole, less])


def narrowed(rows: DataFrame) -> DataFrame:
    """Rows of crowded keys under narrower ones: two sides that are one edit apart are equal once the right letter is
    left out of the longer, or of both."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            chars = np.cumsum([len(w) * (len(w) + 64) for w in words])
            ends = np.unique(np.searchsorted(chars, np.arange(HELD_CHARS, chars[-1] + HELD_CHARS, HELD_CHARS), "right")) if words else []
            for begin, end in zip([0, *ends], [*ends, len(words)]):
                if begin < end:
                    part = batch.slice(begin, end - begin)
                    bounds = [part.column(c).to_numpy().astype(np.int64) for c in ("start", "stop")]
                    row, side = open_sides(words[begin:end], *bounds)
                    fine = mixed(part.column("key").to_numpy().view(np.uint64)[row] + mixed(side)).view(np.int64)
                    for at in range(0, len(row), PIECE):
                        many = part.take(pa.array(row[at : at + PIECE]))
                        yield many.set_column(many.schema.get_field_index("key"), "key", pa.array(fine[at : at + PIECE]))

    return rows.mapInArrow(spread, rows.schema)


def _met(rows: DataFrame) -> DataFrame:
    """Words under one key of which one's pivot stands in the other's prefix, verified; the smaller word first.

    Both sides of the join are the same table, so that it is shuffled once.
    """
    a, b = rows.alias("a"), rows.alias("b")
    ends = {t: F.struct(F.col(f"{t}.last_n"), F.col(f"{t}.last")) for t in "ab"}
    asked = (F.col("a.pivot") & (ends["a"] <= ends["b"])) | (F.col("b.pivot") & (ends["b"] <= ends["a"]))
    lengths = F.abs(F.length("a.word") - F.length("b.word")) <= 1
    found = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word")) & lengths & asked)
    near = found.where(F.levenshtein("a.word", "b.word", 1) == 1)
    return near.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))


def near_words(words: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """``word, n`` (distinct words) to ``word, n, near, near_n``: all pairs that differ by exactly one letter inserted,
    deleted or replaced, each once with the smaller word first."""
    rows = settled(signatures(words, gram_counts(words)), "spelling-keys")
    crowded = settled(rows.groupBy("key").count().where(F.col("count") > crowd).select("key"), "spelling-crowded")
    if crowded.isEmpty():
        return _met(rows).distinct()
    # a crowded key's rows number more than `crowd`, so the table is a small part of the keys; the join splits hot ones
    fine = narrowed(rows.join(crowded, "key", "left_semi").repartition(F.col("word")))
    return _met(rows.join(crowded, "key", "left_anti")).union(_met(fine)).distinct()


def spelling_forms(words: DataFrame, *, ratio: int = 10, crowd: int = CROWD) -> DataFrame:
    """``word, n`` to ``word, form, root, n, n_near, form_n``: a word's form is its most frequent near word if that is at
    least ``ratio`` times as frequent; its root is where following forms ends.

    A chain's counts grow by the ratio at each step, so it has at most 18 steps for a ratio of 10, and following it by
    doubling takes five rounds.
    """
    if ratio < 2:
        raise ValueError("ratio is at least 2, so that forms cannot go round in a circle")
    near = settled(near_words(words, crowd=crowd), "spelling-near")
    both = near.union(near.select("near", "near_n", "word", "n"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    chosen = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    taken = F.col("form_n") >= F.lit(ratio) * F.col("n")
    table = settled(
        chosen.select("word", F.when(taken, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(taken, F.col("form_n")).alias("form_n")),
        "spelling-forms",
    )
    steps = table.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = settled(steps.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return table.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_documents(docs: DataFrame) -> DataFrame:
    """Spelling forms of the words of ``doc_id, text``, after one word in 31 has lost a letter."""
    return spelling_forms(settled(count_words(docs, change=planted_typo), "spelling-words"))
