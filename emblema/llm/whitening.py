"""Embedding whitening with exact covariances by polarisation.

Entries become whole numbers, and each is centred as ``n * x - S``, whole again. Tasks add up the squares of every
dimension and of the sum of every pair of dimensions, without rounding; half of what a pair's square holds beyond its two
dimensions' own squares is their product, so differences of variances give all covariances. The matrix, as large as the
vectors' size squared whatever the number of rows, is assembled on the driver for the eigenvectors.

Defined cases: rows whose vector is null or holds null, NaN or endless entries are left out; a null id stays null;
repeated vectors count once for the fit and each row is answered; shorter vectors, empty ones too, count as filled up
with zeros; entries whose whole number exceeds a long take the nearest long; a component without variance has null
``whitened``; there are no more components than dimensions; ``deviation`` is null where it exceeds a long
(``deviation_decimal`` goes on to 38 digits); an empty table gives an empty result; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emblema.session import settled

from .common import only

SCALE, COMPONENTS = 256, 4
ROWS_AT_ONCE = 2048
#: Sums leave the tasks in three parts to this base, so that adding them cannot overflow 38 digits.
PART = 10**30
SUMS = "i int, j int, low decimal(38,0), mid decimal(38,0), high decimal(38,0)"
_DECIMAL = pa.decimal128(38, 0)


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """The entries as whole numbers, ``floor(scale * entry)``; null if an entry is null, NaN or endless."""
    numbers = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(numbers, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~bad, F.transform(numbers, lambda c: F.floor(c * float(scale))))


def matrix_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` without rounding: 64-bit numbers where they suffice, else Python's own."""
    largest = n * int(max(abs(int(x.min())), abs(int(x.max())))) + max(abs(s) for s in sums) if x.size else 0
    if largest < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def square_sums(t: np.ndarray) -> list[int]:
    """Sum of squares of each column, without rounding."""
    if t.dtype == object:
        return [int(s) for s in (t * t).sum(axis=0)]
    largest = int(np.abs(t).max()) if t.size else 0
    if largest * largest * len(t) < 1 << 63:
        return [int(s) for s in np.einsum("ij,ij->j", t, t)]
    parts = [t >> 42, (t >> 21) & 0x1FFFFF, t & 0x1FFFFF]  # of 21 bits; a product of two, added over the rows, fits in 63
    total = [0] * t.shape[1]
    for a, left in enumerate(parts):
        for b, right in enumerate(parts):
            for k, s in enumerate(np.einsum("ij,ij->j", left, right)):
                total[k] += int(s) << 21 * (4 - a - b)
    return total


def _sum_rows(keys: list[tuple[int, int]], totals: list[int]) -> pa.RecordBatch:
    limbs = [[], [], []]
    for total in totals:
        high, rest = divmod(total, PART * PART)
        for limb, value in zip(limbs, (rest % PART, rest // PART, high), strict=True):
            limb.append(Decimal(value))
    columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array(x, _DECIMAL) for x in limbs)]
    return pa.RecordBatch.from_arrays(columns, names=["i", "j", "low", "mid", "high"])


def _added(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Adds up the tasks' sums: one row for each pair of dimensions reaches the driver."""
    rows = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("low", "mid", "high")]).collect()
    return {(r["i"], r["j"]): int(r["low"]) + PART * int(r["mid"]) + PART * PART * int(r["high"]) for r in rows}


def column_sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, [0] * size
        for batch in batches:
            x = matrix_of(batch.column(0))
            n += len(x)
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            totals = [t + (int(h) << 32) + int(w) for t, h, w in zip(totals, high, low, strict=True)] if len(x) else totals
        yield _sum_rows([(-1, -1), *((k, k) for k in range(size))], [n, *totals])

    found = _added(fit.mapInArrow(partial, SUMS))
    return found.get((-1, -1), 0), [found.get((k, k), 0) for k in range(size)]


def squares(fit: DataFrame, n: int, sums: list[int]) -> dict[tuple[int, int], int]:
    """Exact sum of squared centred values: under ``(i, i)`` of dimension i, under ``(i, j)`` of the sum of i and j."""
    size = len(sums)
    keys = [(i, j) for i in range(size) for j in range(i, size)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * len(keys)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                y = centred(matrix_of(batch.column(0).slice(start, ROWS_AT_ONCE)), n, sums)
                at = 0
                for i in range(size):
                    pairs = y[:, i:] + y[:, i : i + 1]
                    pairs[:, 0] = y[:, i]
                    for k, s in enumerate(square_sums(pairs)):
                        totals[at + k] += s
                    at += size - i
        yield _sum_rows(keys, totals)

    return _added(fit.mapInArrow(partial, SUMS))


def covariances(square: dict[tuple[int, int], int], n: int, size: int) -> np.ndarray:
    """From the squares of single dimensions ``Q(i)`` and of pairs ``Q(i + j)``: ``(Q(i + j) - Q(i) - Q(j)) / 2`` over n cubed."""
    out = np.zeros((size, size))
    for (i, j), q in square.items():
        product = q if i == j else Fraction(q - square[i, i] - square[j, j], 2)
        out[i, j] = out[j, i] = float(Fraction(product) / n**3) if n else 0.0
    return out


@dataclass(frozen=True)
class Whitening:
    """What the fit found: ``directions`` has a column for each component, ``variances`` falls, ``total`` is the trace."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    total: float

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Components of centred rows ``n * x - S``; NaN for a component without variance."""
        spread = np.where(self.variances > 0, np.sqrt(np.maximum(self.variances, 0.0)), np.nan)
        return (y.astype(np.float64) / self.n) @ self.directions / spread


def fitted(fit: DataFrame, size: int, components: int = COMPONENTS) -> Whitening:
    """Of distinct vectors of whole numbers, the one column of ``fit``."""
    n, sums = column_sums(fit, size)
    variance = covariances(squares(fit, n, sums), n, size)
    values, vectors = np.linalg.eigh(variance)
    order = np.argsort(-values, kind="stable")[:components]
    directions = vectors[:, order]
    heaviest = np.abs(directions).argmax(axis=0)
    directions = directions * np.where(directions[heaviest, range(len(order))] < 0, -1.0, 1.0)
    total = float(np.trace(variance))
    found = np.where(values[order] > total * size * np.finfo(float).eps, values[order], 0.0)
    return Whitening(n, sums, directions, found, total)


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list less the identity, measured over all its rows."""
    real = [k for k, e in enumerate(model.variances) if e > 0]
    if not real:
        return None
    many = len(real)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(many), np.zeros((many, many))
        for batch in batches:
            w = model.whitened(centred(matrix_of(batch.column(0)), model.n, model.sums))[:, real]
            first, second = first + w.sum(axis=0), second + w.T @ w
        values = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["k", "value"])

    rows = fit.mapInArrow(partial, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(many + many * many)
    for r in rows:
        total[r["k"]] = r["value"]
    mean = total[:many] / model.n
    covariance = total[many:].reshape(many, many) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(many)).max())


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_decimal`` for each usable row."""
    read = only(vectors, vec_id, vector).select(F.col(f"`{vec_id}`").alias("vec_id"), whole_numbers(F.col(f"`{vector}`"), scale).alias("x"))
    rows = read.where("x IS NOT NULL")
    sizes = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    size = sizes[1] or 0
    if sizes[0] != sizes[1]:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(size) - F.size("x"))))
    schema = T.StructType(
        [T.StructField("vec_id", vectors.schema[vec_id].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType())]
        + [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType())]
        + [T.StructField("identity_error", T.DoubleType()), T.StructField("deviation_decimal", T.DecimalType(38, 0))]
    )
    if not size:
        return vectors.sparkSession.createDataFrame([], schema)
    fit = settled(rows.select("x").distinct(), "whitening-fit")
    model = fitted(fit, size, components)
    error, many = identity_error(fit, model), len(model.variances)
    explained = [float(e / model.total) if model.total > 0 else None for e in model.variances]

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = centred(matrix_of(batch.column(1)), model.n, model.sums)
            deviation = np.repeat(np.array(square_sums(y.T), object), many)
            whitened = model.whitened(y)
            rows_of = pa.array(np.repeat(np.arange(len(y)), many))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows_of),
                    pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(y))),
                    pa.array(np.full(len(rows_of), model.n, np.int64)),
                    pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64()),
                    pa.array(whitened.ravel(), mask=np.isnan(whitened.ravel())),
                    pa.array(explained * len(y), pa.float64()),
                    pa.array([error] * len(rows_of), pa.float64()),
                    pa.array([Decimal(d) if d < 10**38 else None for d in deviation], _DECIMAL),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(answered, schema)
