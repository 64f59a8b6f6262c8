"""Suffix-array dedup: every byte of a string of 200 bytes that also starts anywhere else is removed.

Suffixes are sorted where a string can first be recognised. Of the hashes of all 40-byte grams in a 200-byte window, the
least marks an anchor; equal windows have their anchor at the same place, so every repeat contains equal anchors in all
its copies. Anchors whose gram stands once are dropped by a count. For the others, the text after the anchor and,
reversed, the text before it are suffixes of a group and are sorted by deep-shallow sorting: multikey quicksort to a
shallow depth, then blind tries for the groups that still share a prefix. The common prefixes of neighbours give how
far any two anchors agree to either side; where that is 200 bytes together, the bytes are repeated.

Anchors with equal surroundings are counted, not compared, so copies by the thousand are one suffix.

Defined cases: a null text is empty; texts under 200 bytes keep everything; a null id is carried; repeated rows are
repeats of each other; an empty table gives an empty result; further columns are left aside; texts are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emblema.session import settled

from .common import only
from .rolling import Hashes, mixed, runs

LENGTH, GRAM = 200, 40
#: Bytes that the multikey quicksort sorts by before blind tries take over.
SHALLOW = 24
#: Surroundings of one gram that a task compares with all of that gram's; more are dealt to further tasks.
SLICE = 8192


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The least or largest of every ``width`` values in a row, by doubling."""
    reach, out = 1, values
    while 2 * reach <= width:
        out = pick(out[:-reach], out[reach:])
        reach *= 2
    return pick(out[: len(out) - (width - reach)], out[width - reach :]) if reach < width else out


def anchors(data: np.ndarray, begins: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``position, text, gram hash, hash of the surroundings`` of the anchors of texts that stand side by side in ``data``."""
    width = length - gram + 1
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty
    hashes = Hashes(data)
    grams = hashes.every(gram)
    order = (grams >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = sliding(order, width, np.minimum)
    # a window that reaches into the next text doesn't count
    starts = np.arange(len(least))
    text = np.searchsorted(begins, starts, side="right") - 1
    least[starts + length > begins[text + 1]] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32)])
    at = np.flatnonzero(sliding(padded, width, np.maximum) == order)
    owner = np.searchsorted(begins, at, side="right") - 1
    left, right = np.maximum(begins[owner], at - (length - 1)), np.minimum(begins[owner + 1], at + length)
    around = mixed(hashes.of(left, right) + (at - left).astype(np.uint64) * np.uint64(1_000_003) + (right - at).astype(np.uint64))
    return at - begins[owner], owner, grams[at].view(np.int64), around.view(np.int64)


def with_anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``text_key, position, gram, around`` for each anchor of each text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, data, begins in runs([(t or "").encode() for t in batch.column(1).to_pylist()]):
                position, owner, grams, around = anchors(data, begins, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(keys[first + owner]), pa.array(position.astype(np.int32)), pa.array(grams), pa.array(around)], ["text_key", "position", "gram", "around"])

    return texts.mapInArrow(find, "text_key bigint, position int, gram bigint, around bigint")


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree on ``known`` bytes."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """A trie that holds at each fork only where its strings part; a search skips what lies between and compares once, at the leaf."""

    def __init__(self, strings: list[bytes], ids: list[int], known: int):
        self.strings, self.root = strings, [None, {}, [ids[0]]]  # where it forks, branches, equal strings of a leaf
        for k in ids[1:]:
            self.insert(k, known)

    def byte(self, text: bytes, at: int) -> int:
        return text[at] if at < len(text) else -1

    def insert(self, k: int, known: int) -> None:
        text, node = self.strings[k], self.root
        while node[0] is not None:  # blind descent: any leaf below shares as much as the right one
            node = node[1].get(self.byte(text, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[2][0]]
        shared = common_prefix(text, other, known)
        if shared == len(text) == len(other):
            node[2].append(k)
            return
        node = self.root
        while node[0] is not None and node[0] < shared:
            node = node[1][self.byte(text, node[0])]
        if node[0] == shared:
            node[1][self.byte(text, shared)] = [None, {}, [k]]
            return
        below = [node[0], node[1], node[2]]
        node[0], node[1], node[2] = shared, {self.byte(other, shared): below, self.byte(text, shared): [None, {}, [k]]}, []

    def ordered(self) -> tuple[list[int], list[int]]:
        """The strings in order, and what each shares with the one before it; 0 for the first."""
        order: list[int] = []
        shared: list[int] = []
        stack: list[tuple[list, int]] = [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if node[0] is None:
                order += node[2]
                shared += [before] + [len(self.strings[node[2][0]])] * (len(node[2]) - 1)
                continue
            branches = [node[1][b] for b in sorted(node[1])]
            stack += [(child, node[0]) for child in reversed(branches[1:])] + [(branches[0], before)]
        return order, shared


def deep_shallow(strings: list[bytes], depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and the common prefix of each with the one before it in order."""
    n = len(strings)
    order: list[int] = []
    shared: list[int] = []
    # multikey quicksort: parts that share ``at`` bytes are split in three by the byte there
    stack: list[tuple[list[int], int, int, bool]] = [(list(range(n)), 0, 0, False)]
    while stack:
        part, at, before, equal = stack.pop()
        if equal or len(part) == 1:
            order += part
            shared += [before] + [at] * (len(part) - 1)
        elif at >= depth:
            own, prefixes = BlindTrie(strings, part, at).ordered()
            order += own
            shared += [before, *prefixes[1:]]
        else:
            keys = [strings[k][at] if at < len(strings[k]) else -1 for k in part]
            pivot = keys[len(keys) // 2]
            sides = [[k for k, b in zip(part, keys, strict=True) if (b > pivot) - (b < pivot) == side] for side in (-1, 0, 1)]
            todo = []
            for side, these in enumerate(sides):
                if these:
                    ended = side == 1 and pivot == -1
                    todo.append((these, at + (side == 1 and not ended), at if todo else before, ended))
            stack += reversed(todo)
    return np.array(order, np.int64), np.array(shared, np.int64)


def extents(lefts: list[bytes], rights: list[bytes], rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far to the left and right of the anchors ``rows`` bytes are repeated; 0 for none. ``lefts`` are reversed."""
    n = len(lefts)
    (right_order, right_shared), (left_order, left_shared) = deep_shallow(rights), deep_shallow(lefts)
    right_rank, left_rank = np.argsort(right_order), np.argsort(left_order)
    before, after = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)

    def agreement(rank: int, shared: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Common prefix of the string at ``rank`` with every other, in the strings' own numbering."""
        out = np.zeros(n, np.int64)
        out[order[rank + 1 :]] = np.minimum.accumulate(shared[rank + 1 :])
        out[order[:rank]] = np.minimum.accumulate(shared[1 : rank + 1][::-1])[::-1]
        return out

    for j, k in enumerate(rows):
        right, left = agreement(right_rank[k], right_shared, right_order), agreement(left_rank[k], left_shared, left_order)
        near = right + left >= length
        near[k] = False
        if near.any():
            before[j], after[j] = left[near].max(), right[near].max()
    return before, after


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``text_key, spans``: for each text with repeats, where its repeated bytes begin and end."""
    texts = only(docs, "text").select(F.xxhash64("text").alias("text_key"), "text")
    found = settled(with_anchors(texts, length, gram), "anchors")
    by_gram = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("low"), F.max("around").alias("high"))
    # written first: a join of two plain tables can split a gram that very many texts have
    shared = settled(by_gram.where("n > 1").select("gram", (F.col("low") < F.col("high")).alias("mixed")), "shared-grams")
    rows = settled(found.join(shared, "gram"), "shared-anchors")
    several = rows.where("mixed").groupBy("gram", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text_key", "position")).alias("at"))
    several = settled(several, "surroundings")
    compared = compare(docs, several, length)
    whole = several.where("n > 1").select("gram", "around", F.lit(length - 1).alias("before"), F.lit(length).alias("after"))
    verdicts = settled(compared.unionByName(whole), "verdicts")
    equal = rows.where("not mixed").select("text_key", "position", F.lit(length - 1).alias("before"), F.lit(length).alias("after"))
    partly = rows.where("mixed").join(verdicts, ["gram", "around"]).select("text_key", "position", "before", "after")
    spans = equal.unionByName(partly).distinct()
    return spans.groupBy("text_key").agg(
        F.collect_list(F.struct(F.greatest(F.lit(0), F.col("position") - F.col("before")).alias("start"), (F.col("position") + F.col("after")).alias("end"))).alias("spans")
    )


def compare(docs: DataFrame, several: DataFrame, length: int) -> DataFrame:
    """``gram, around, before, after`` for surroundings that stand once: how far they are repeated in others of their gram."""
    sizes = several.groupBy("gram").agg(F.count(F.lit(1)).alias("members"))
    wanted = several.join(sizes, "gram").select(
        F.col("at.text_key").alias("wanted"),
        F.struct(F.col("at.position").alias("position"), "gram", "around", (F.col("n") == 1).alias("open"), F.ceil(F.col("members") / SLICE).cast("int").alias("slices")).alias("w"),
    ).groupBy("wanted").agg(F.collect_list("w").alias("places"))
    texts = only(docs, "text").select(F.xxhash64("text").alias("text_key"), "text")
    matched = texts.join(wanted, F.col("text_key") == F.col("wanted")).select("text", "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                for w in places:
                    p = w["position"]
                    for column, value in zip(out, (w["gram"], w["around"], w["open"], w["slices"], raw[max(0, p - length + 1) : p][::-1], raw[p : p + length]), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["gram", "around", "open", "slices", "left", "right"])

    rows = matched.mapInArrow(cut, "gram bigint, around bigint, open boolean, slices int, left binary, right binary")
    rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: dict, group: tuple) -> list[tuple]:
            if len(held) < 2:
                return []
            around = sorted(held)
            lefts, rights = [held[a][1] for a in around], [held[a][2] for a in around]
            own = np.array([k for k, a in enumerate(around) if held[a][0] and a % held[a][3] == group[1]], np.int64)
            if not len(own):
                return []
            before, after = extents(lefts, rights, own, length)
            return [(group[0], around[k], int(b), int(e)) for k, b, e in zip(own, before, after, strict=True) if b + e]

        held, group = {}, None
        for batch in batches:
            out: list[tuple] = []
            for gram, around, is_open, slices, left, right, slice_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (gram, slice_) != group:
                    out += flush(held, group) if held else []
                    held, group = {}, (gram, slice_)
                held[around] = (is_open, left, right, slices)
            yield verdicts(out)
        yield verdicts(flush(held, group) if held else [])

    def verdicts(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["gram", "around", "before", "after"])

    dealt = rows.repartition("gram", "slice").sortWithinPartitions("gram", "slice")
    return dealt.mapInArrow(sort, "gram bigint, around bigint, before int, after int")


def stripped(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``: each document without its repeated bytes."""
    spans = settled(repeated_spans(docs, length, gram), "spans").withColumnRenamed("text_key", "_key")
    texts = only(docs, "doc_id", "text").withColumn("_text_key", F.xxhash64("text"))
    rows = texts.join(spans, F.col("_text_key") == F.col("_key"), "left").select("doc_id", "text", "spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                kept, at, removed, n = [], 0, 0, 0
                for start, end in sorted((p["start"], p["end"]) for p in places or []):
                    end = min(end, len(raw))
                    if start > at or n == 0:
                        kept.append(raw[at:start])
                        n, at = n + 1, start
                    if end > at:
                        removed, at = removed + end - at, end
                kept.append(raw[at:])
                left = b"".join(kept)
                for column, value in zip(out, (len(raw), removed, n, hashlib.sha256(left).hexdigest(), left), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(strip, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The query: what is left of each document."""
    return stripped(docs).drop("kept")
