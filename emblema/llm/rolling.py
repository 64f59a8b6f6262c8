"""Hashes of any substrings of many texts at once, with numpy: prefix sums of a polynomial modulo 2**64."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``size`` of each; the largest so far is kept."""
    if 0 not in _powers or len(_powers[0][0]) < size:
        n = max(1 << 20, 1 << (size - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers[0] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b)])) for b in (_BASE, _INVERSE))
    return _powers[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Of one run of bytes: ``of(start, end)`` hashes its substrings, for arrays of bounds."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, length: int) -> np.ndarray:
        """Of all substrings of one length, in order."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def runs(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts gathered to runs of about ``most`` bytes: first and last index, the bytes, and where each text begins. A
    longer text is a run of its own."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= most):
            size += len(texts[last])
            last += 1
        data = np.frombuffer(b"".join(texts[first:last]), np.uint8)
        yield first, last, data, np.concatenate([[0], np.cumsum([len(t) for t in texts[first:last]], dtype=np.int64)]).astype(np.int64)
        first = last
