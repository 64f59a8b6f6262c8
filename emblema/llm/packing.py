"""Best-fit packing of documents into token sequences, bounded-space and online.

Documents become token ids, longer ones pieces of one sequence's length. Pieces are then placed in arrival order: each
goes to the open sequence where it leaves least room. Open sequences stand in a bitset keyed by their free space, so the
best one is the lowest set bit from the piece's length upwards. Only a fixed number is open; one more closes the fullest.

Defined cases: a null text counts as empty and gives the end id alone; repeated rows are packed as often as they stand
there; a null id is kept; an empty table gives an empty result; further columns are left aside; a very long text is cut.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emblema.session import settled

from .common import only

LENGTH = 2048
OPEN = 1024
#: Pieces that one task packs. Each task leaves at most OPEN sequences part filled.
PIECES_PER_TASK = 100_000
END = 0
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = f"{PIECES}, sequence_id bigint, offset bigint"


def encoder(path: str, ranks_path: str | None = None):
    """Text to its ids as little-endian 32-bit numbers.

    ``path`` is the tokenizer's file. With ``ranks_path``, the same vocabulary as ranks, plain Latin text goes through
    the faster of the two libraries, which gives the same ids there; other scripts and texts that hold a special token
    go through the tokenizer's own library.
    """
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def slow(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    if not ranks_path:
        return slow
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    odd = re.compile("[^\t\n\r -~¡-¬®-ɏ]|<\\|")

    def encode(text: str) -> bytes:
        return slow(text) if odd.search(text) else np.array(fast.encode_ordinary(text), "<u4").tobytes()

    return encode


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """A row for each piece of each document: its place, length and the checksum of its ids.

    A document longer than ``length`` is cut so that all pieces but the first are full. Tokens stay in their task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(path, ranks_path) if path else encoder(*default_paths())
        last = END.to_bytes(4, "little")
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py() or "") + last)
                total, start, n = len(ids) // 4, 0, 0
                while start < total:
                    size = (total - start - 1) % length + 1
                    for column, value in zip(out, (doc_id.as_py(), n, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])), strict=True):
                        column.append(value)
                    start, n = start + size, n + 1
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return only(docs, "doc_id", "text").mapInArrow(cut, PIECES)


class BestFit:
    """At most ``most_open`` open sequences; ``free`` has a bit for each free space that some open sequence has."""

    def __init__(self, length: int = LENGTH, most_open: int = OPEN):
        self.length, self.most_open = length, most_open
        self.free, self.by_space, self.n_open, self.next_id = 0, {}, 0, 0

    def place(self, size: int) -> tuple[int, int]:
        """Sequence and offset for a piece of ``size`` tokens."""
        above = self.free >> size
        if above:
            space = size + (above & -above).bit_length() - 1
            sequence = self._take(space)
        else:
            sequence, space = self.next_id, self.length
            self.next_id += 1
        left = space - size
        if left:
            self.by_space.setdefault(left, []).append(sequence)
            self.free |= 1 << left
            self.n_open += 1
            if self.n_open > self.most_open:
                self._take((self.free & -self.free).bit_length() - 1)
        return sequence, self.length - space

    def _take(self, space: int) -> int:
        held = self.by_space[space]
        sequence = held.pop()
        if not held:
            del self.by_space[space]
            self.free &= ~(1 << space)
        self.n_open -= 1
        return sequence


def pack(cut: DataFrame, length: int = LENGTH, most_open: int = OPEN, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. Pieces are dealt to as many tasks as their number asks for, each task packs
    its own in order of ids, and a task that is run again places them alike."""
    cut = settled(cut, "pieces")
    tasks = max(1, -(-cut.count() // pieces_per_task))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(length, most_open), TaskContext.get().partitionId() << 40
        for batch in batches:
            places = [bins.place(size) for size in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + s for s, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    dealt = cut.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions("doc_id", "piece", "length", "ids_crc32")
    return dealt.mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, **settings) -> DataFrame:
    """The query: every document cut and packed."""
    return pack(pieces(docs), **settings)
