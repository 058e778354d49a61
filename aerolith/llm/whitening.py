"""Whitening of embeddings from exact covariances: digit-slice products, big integers, one eigendecomposition.

An entry c becomes the whole number x = floor(SCALE * c) + SHIFT, and a vector is centred as y = n * x - S (n vectors,
sums S), in whole numbers. y is split into balanced digits of DIGIT bits; the products of digit matrices are float64 BLAS
products whose sums stay below 2^53, hence exact. Digits are put together as big integers in each task; tasks send these
as words of WORD bits, whose sums Spark merges. The driver gets one sum for each pair of dimensions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_columns, restored

SCALE, SHIFT = 1024, 100_000
#: bits of a digit, and rows of one BLAS product: 2 * (DIGIT - 1) bits for a product of digits, 13 for the rows
DIGIT, ROWS = 20, 1 << 13
WORD = 30
#: entries from this size on have no whole number of 64 bits
LARGEST = float(1 << 61)
COMPONENTS = 8


def whole_vectors(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, x) for each length of the valid vectors of a column of lists of doubles."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = np.diff(col.offsets.to_numpy())
    values = col.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # nulls become NaN
    valid = col.is_valid().to_numpy(zero_copy_only=False)
    starts = col.offsets.to_numpy()[:-1]
    for d in np.unique(size[valid & (size > 0)]).tolist():
        rows = np.flatnonzero(valid & (size == d))
        v = values[starts[rows][:, None] + np.arange(d)]
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(SCALE * v)
            fine = (np.isfinite(v) & (np.abs(x) < LARGEST)).all(axis=1)
        if fine.any():
            yield d, rows[fine], x[fine].astype(np.int64) + SHIFT


def digits(y: np.ndarray) -> list[np.ndarray]:
    """Balanced digits of whole numbers, the lowest first, as float64: y = sum of digit_k * 2^(DIGIT * k)."""
    out, half = [], 1 << (DIGIT - 1)
    while True:
        low = ((y + half) & ((1 << DIGIT) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> DIGIT
        if not (y != 0).any():
            return out


class Gram:
    """The exact sum of y'y over all rows added."""

    def __init__(self, d: int):
        self.d, self.sums, self.added = d, {}, 0
        self.total = np.zeros((d, d), object)

    def add(self, y: np.ndarray) -> None:
        for lo in range(0, len(y), ROWS):
            part = digits(y[lo : lo + ROWS])
            for a, left in enumerate(part):
                for b, right in enumerate(part):
                    product = (left.T @ right).astype(np.int64)  # exact: below 2^53
                    held = self.sums.get(a + b)
                    self.sums[a + b] = product if held is None else held + product
            self.added += 1
            if self.added == 1 << 6:  # at most 8 digits a sum: 2^51 * 8 * 64 stays below 2^63
                self._carry()

    def _carry(self) -> None:
        for k, s in self.sums.items():
            self.total = self.total + s.astype(object) * (1 << (DIGIT * k))
        self.sums, self.added = {}, 0

    def words(self) -> Iterator[tuple[int, int, int, int]]:
        """(i, j, k, word) of the upper triangle; the sum of word * 2^(WORD * k) is the entry."""
        self._carry()
        for i in range(self.d):
            for j in range(i, self.d):
                v, k = int(self.total[i, j]), 0
                sign, v = (-1 if v < 0 else 1), abs(v)
                while v:
                    yield i, j, k, sign * (v & ((1 << WORD) - 1))
                    v, k = v >> WORD, k + 1


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, in 64 bits where these hold it, else in big integers."""
    mean = [s // n for s in sums]
    if n * (1 + max(int(np.abs(x - np.array(mean, np.int64)).max()), 1)) < 1 << 62:
        return n * (x - np.array(mean, np.int64)) - np.array([s - n * m for s, m in zip(sums, mean, strict=True)], np.int64)
    return n * x.astype(object) - np.array(sums, object)


@dataclass(frozen=True)
class Whitening:
    """Vectors of one length: n, sums, the unit eigenvectors as rows, their eigenvalues, and the covariance's trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Rows of y = n * x - S on the components, over the root of their variances; NaN where there is none."""
        root = np.sqrt(self.values)
        floor = len(self.sums) * np.finfo(float).eps * max(self.trace, 0.0)
        root = np.where(self.values > floor, root, np.nan)
        with np.errstate(invalid="ignore"):
            return (y / self.n).astype(np.float64) @ self.components.T / root


def _vectors(df: DataFrame, vector_col: str) -> DataFrame:
    return df.select(F.col(f"`{vector_col}`").cast("array<double>").alias("v"))


def _sums(df: DataFrame, vector_col: str) -> dict[int, tuple[int, list[int]]]:
    """(n, sums of x) for each length: tasks send one row a dimension, Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for d, rows, x in whole_vectors(b.column(0)):
                n, high, low = held.setdefault(d, [0, np.zeros(d, object), np.zeros(d, object)])
                high += (x >> 31).sum(axis=0).astype(object)
                low += (x & ((1 << 31) - 1)).sum(axis=0).astype(object)
                held[d][0] = n + len(rows)
        for d, (n, high, low) in held.items():
            s = [Decimal(int(a) * (1 << 31) + int(b)) for a, b in zip(high, low, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(s, pa.decimal128(38, 0))], ["d", "i", "n", "s"])

    parts = _vectors(df, vector_col).mapInArrow(run, "d int, i int, n bigint, s decimal(38,0)")
    out: dict[int, tuple[int, dict[int, int]]] = {}
    for r in parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        out.setdefault(r["d"], (r["n"], {}))[1][r["i"]] = int(r["s"])
    return {d: (n, [s[i] for i in range(d)]) for d, (n, s) in out.items()}


def _grams(df: DataFrame, vector_col: str, sums: dict[int, tuple[int, list[int]]]) -> dict[int, dict[tuple[int, int], int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Gram] = {}
        for b in batches:
            for d, _, x in whole_vectors(b.column(0)):
                held.setdefault(d, Gram(d)).add(centred(x, *sums[d]))
        for d, gram in held.items():
            rows = np.array(list(gram.words()), np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), d), pa.int32()), *[pa.array(rows[:, c].astype(np.int32)) for c in range(3)], pa.array(rows[:, 3])], ["d", "i", "j", "k", "word"])

    parts = _vectors(df, vector_col).mapInArrow(run, "d int, i int, j int, k int, word bigint")
    out: dict[int, dict[tuple[int, int], int]] = {d: defaultdict(int) for d in sums}
    for r in parts.groupBy("d", "i", "j", "k").agg(F.sum("word").alias("word")).collect():
        out[r["d"]][r["i"], r["j"]] += r["word"] * (1 << (WORD * r["k"]))
    return out


def fit_whitening(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> dict[int, Whitening]:
    """A whitening for each length of vectors (see `whiten`); two jobs, of which the driver gets sums by dimensions."""
    sums = _sums(df, vector_col)
    out = {}
    for d, gram in _grams(df, vector_col, sums).items():
        n, s = sums[d]
        v = np.zeros((d, d))
        for (i, j), g in gram.items():
            v[i, j] = v[j, i] = g / n**3  # whole numbers divided: rounded once
        trace = sum(gram.get((i, i), 0) for i in range(d)) / n**3
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[: min(components, d)]
        rows = vectors[:, order].T
        rows = rows * np.where(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
        out[d] = Whitening(n, tuple(s), np.ascontiguousarray(rows), np.maximum(values[order], 0.0), trace)
    return out


def identity_errors(df: DataFrame, models: dict[int, Whitening], vector_col: str = "embedding") -> dict[int, float]:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, by length. Components without
    variance are left out. Tasks centre their rows by their own means; means and products are merged by sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for d, _, x in whole_vectors(b.column(0)):
                w = np.nan_to_num(models[d].whitened(centred(x, models[d].n, list(models[d].sums))))
                n, mean = len(w), w.mean(axis=0)
                m2 = (w - mean).T @ (w - mean)
                if d in held:
                    n0, mean0, m20 = held[d]
                    step = mean - mean0
                    held[d] = [n0 + n, mean0 + step * n / (n0 + n), m20 + m2 + np.outer(step, step) * n0 * n / (n0 + n)]
                else:
                    held[d] = [n, mean, m2]
        for d, (n, mean, m2) in held.items():
            i, j = (a.ravel() for a in np.indices(m2.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d), pa.int32()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(mean[i] * n), pa.array((m2 + n * np.outer(mean, mean)).ravel())], ["d", "i", "j", "s", "p"])

    parts = _vectors(df, vector_col).mapInArrow(run, "d int, i int, j int, s double, p double")
    got: dict[int, dict] = {d: {} for d in models}
    for r in parts.groupBy("d", "i", "j").agg(F.sum("s").alias("s"), F.sum("p").alias("p")).collect():
        got[r["d"]][r["i"], r["j"]] = (r["s"], r["p"])
    out = {}
    for d, m in models.items():
        live = np.flatnonzero(~np.isnan(m.whitened(np.zeros((1, d)))[0])).tolist()
        mean = {i: got[d][i, i][0] / m.n for i in live}
        out[d] = max((abs(got[d][i, j][1] / m.n - mean[i] * mean[j] - (i == j)) for i in live for j in live), default=0.0)
    return out


def whiten(df: DataFrame, keep: list[str], vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The kept columns, component (from 1), n, deviation, whitened, explained and identity_error: a row for each valid
    row and component.

    Rows whose vector is null, empty, or holds null, non-finite or too large entries (1024 * c from 2^61 on) take no part.
    Vectors of different lengths are whitened apart, with an n of their own. deviation is exact (decimal(38,0); null if
    that can't hold it). A component without variance (one vector, or all alike) has null for `whitened`, and `explained`
    is null if there is no variance at all. Repeated rows all count. An empty table gives no rows. A kept column named
    like a result column keeps its name, and the result's gets an underscore.
    """
    models = fit_whitening(df, vector_col, components)
    errors = identity_errors(df, models, vector_col)
    src = df.select(*kept_columns(keep), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    added = T._parse_datatype_string("component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    schema = T.StructType([*src.schema.fields[: len(keep)], *added.fields])
    largest = 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, rows, x in whole_vectors(b.column(len(keep))):
                m = models[d]
                y = centred(x, m.n, list(m.sums))
                w = m.whitened(y)
                c = w.shape[1]
                square = (y.astype(object) ** 2).sum(axis=1) if y.dtype == object or float(np.abs(y).max()) ** 2 * d >= 2.0**62 else (y * y).sum(axis=1)
                apart = pa.array([Decimal(v) if v < largest else None for v in square.tolist()], pa.decimal128(38, 0))
                at = pa.array(np.repeat(np.arange(len(rows)), c))
                kept = [col.take(pa.array(rows)).take(at) for col in b.columns[: len(keep)]]
                share = [float(v / m.trace) if m.trace > 0 else None for v in m.values]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(at), m.n)), apart.take(at), pa.array(w.ravel(), from_pandas=True), pa.array(share * len(rows), pa.float64()), pa.array(np.full(len(at), errors[d]))],
                    schema.names,
                )

    return restored(src.mapInArrow(run, schema), keep, added.names)
