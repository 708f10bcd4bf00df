"""Embedding whitening: vectors turned onto the principal axes of the corpus and scaled to unit variance there.

Entries become integers x = floor(64 c) + 1000000. The fit list is every distinct vector once, written as a table. Three
aggregations run over it, each with partial results of fixed size a task, merged by row of the matrix in two rounds:

* n and the sums S, exact: high and low halves of x are summed apart as integers.
* The covariance. A vector is centred by S / n in double-double (high and low part). Batches are cut into slices of so
  few bits that every product of slices, and its sum over a batch, is exact in a double: an error-free transformation
  that turns the sum of outer products into matrix products. Their results are added up in double-double by two-sum, and tasks' high and
  low parts are merged in the same way, so no rounding of the sums depends on how rows are dealt.
* The covariance of the whitened vectors as they come out, for ``identity_error``.

The eigenvectors come from LAPACK's symmetric driver (reduction to tridiagonal form, then divide and conquer), as
numpy.linalg.eigh calls it, on the driver: d x d numbers. They are then refined in extended precision against the
double-double covariance, so that close eigenvalues do not cost digits.

Defined results for odd input: a null vector, or one with a null, NaN or infinite entry, is left out; so are vectors
without entries (they have no component). Null vec_ids and repeated rows stay, each with rows of its own; repeated
vectors count once in the fit. Axes without variance (a single distinct vector, constant or dependent entries) are not
components, so a row has min(16, rank) rows and identical vectors have none. x keeps to the range of a long.
``deviation`` is null where it passes a long. Vectors of unlike lengths raise a ValueError that names the lengths. An empty
table gives an empty table. Extra columns do not take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 16
#: Rows of a batch that one matrix product takes, and bits of a slice, one more with its low part: 2 * (BITS + 1) + log2(BATCH) stays within 53.
BATCH, BITS = 1024, 20
SLICES = 5
#: No column's scale falls below this, so that the last slice's unit stays a normal number.
LEAST = 2.0**-300
#: Partial results of one matrix row that one group of the first round of merging takes.
FAN_IN = 64
LOW = (1 << 32) - 1
#: An eigenvalue below this share of the trace is no variance but rounding of the solver.
NOTHING = 1e-13
#: Neighbouring eigenvalues are far apart if more than this many times the norm of what is left off the diagonal lies between them.
FAR = 1024.0


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as the rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, more: np.ndarray, rest: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) + (more, rest) in double-double."""
    s, e = two_sum(high, more)
    return two_sum(s, e + (low + rest))


def quantised(entries: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 as longs, within their range."""
    scaled = np.floor(entries * SCALE)
    limit = float(1 << 62)
    return np.clip(scaled, -limit, limit).astype(np.int64) + SHIFT


def matrix(column: pa.ListArray, kind: type) -> np.ndarray:
    """The rows of a list column whose rows have no null and one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(len(column), -1)


def slices(x: np.ndarray, scale: np.ndarray) -> Iterator[np.ndarray]:
    """``x`` cut column by column into parts of at most BITS bits, from the top; ``scale`` bounds each column's powers of two."""
    at = scale.astype(np.float64)
    for _ in range(SLICES):
        unit = np.exp2(at - BITS)
        part = np.round(x / unit) * unit
        yield part
        x = x - part
        at = at - BITS


def outer_sums(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over rows of the outer product of each row (high + low) with itself, in double-double."""
    d = high.shape[1]
    total, error = np.zeros((d, d)), np.zeros((d, d))
    for k in range(0, len(high), BATCH):
        h, w = high[k : k + BATCH], low[k : k + BATCH]
        top = np.maximum(np.abs(h).max(axis=0), LEAST)
        scale = np.ceil(np.log2(top)) + 1
        # the low parts lie below the last bit of the high ones: they join the slices that reach there
        parts = [p + q for p, q in zip(slices(h, scale), slices(w, scale), strict=True)]
        for i, p in enumerate(parts):
            for q in parts[: SLICES - i]:
                total, error = add(total, error, p.T @ q)
    return total, error


@dataclass(frozen=True)
class Centre:
    """Mean of the fit list as double-double, from exact sums."""

    n: int
    sums: tuple[int, ...]

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        means = [Fraction(s, self.n) for s in self.sums]
        high = [float(m) for m in means]
        return np.array(high), np.array([float(m - Fraction(h)) for m, h in zip(means, high, strict=True)])

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = self.parts()
        as_double = x.astype(np.float64)
        rest = (x - np.clip(as_double, -(2.0**62), 2.0**62).astype(np.int64)).astype(np.float64)
        h, e = two_sum(as_double, -high)
        return two_sum(h, e + rest - low)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        sums = np.array(self.sums, dtype=object)
        span = max(abs(int(x.max())), abs(int(x.min())), *(abs(s) // self.n + 1 for s in self.sums)) if x.size else 0
        if span * self.n < 1 << 61:
            gap = x * self.n - np.array(self.sums, dtype=np.int64)
            if x.shape[1] * int(np.abs(gap).max(initial=0)) ** 2 < 1 << 63:
                return (gap * gap).sum(axis=1).tolist()
        exact = [sum((int(v) * self.n - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
        return [v if v < 1 << 63 else None for v in exact]


def usable(rows: DataFrame, embedding: str) -> DataFrame:
    """Rows whose vector can be used, the entries as doubles."""
    c = F.col(embedding).cast("array<double>")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return rows.filter(F.col(embedding).isNotNull() & (F.size(embedding) > 0) & fine).withColumn("_c", c)


def fit_list(rows: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Every distinct vector of longs once, as a written table of one column x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(b.column(0).value_lengths().to_numpy(zero_copy_only=False), dtype=np.int32)
            flat = quantised(b.column(0).flatten().to_numpy(zero_copy_only=False))
            yield pa.record_batch({"x": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat))})

    return materialize(usable(rows, embedding).select("_c").mapInArrow(run, "x array<long>").distinct(), "whitening-fit")


def _merged(partials: DataFrame) -> DataFrame:
    """Rows (row, salt, high, low) merged by row in double-double: first within salts, then over them."""

    def run(table: pa.Table) -> pa.Table:
        high, low = matrix(table.column("high").combine_chunks(), float), matrix(table.column("low").combine_chunks(), float)
        h, w = high[0], low[0]
        for a, b in zip(high[1:], low[1:], strict=True):
            h, w = add(h, w, a, b)
        return pa.table({"row": table.column("row")[:1], "high": [h], "low": [w]}, schema=pa.schema([("row", pa.int32()), ("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64()))]))

    shape = "row int, high array<double>, low array<double>"
    return partials.groupBy("row", "salt").applyInArrow(run, shape).groupBy("row").applyInArrow(run, shape)


def outer_total(rows: DataFrame, width: int, centred) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the outer products of ``centred(x)`` over all rows, ``width`` numbers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, error = np.zeros((width, width)), np.zeros((width, width))
        some = False
        for b in batches:
            if len(b):
                some = True
                total, error = add(total, error, *outer_sums(*centred(matrix(b.column(0), np.int64))))
        if some:
            salt = TaskContext.get().partitionId() // FAN_IN
            yield pa.record_batch(
                {
                    "row": pa.array(np.arange(width, dtype=np.int32)), "salt": pa.array(np.full(width, salt, dtype=np.int32)),
                    "high": pa.array(list(total), pa.list_(pa.float64())), "low": pa.array(list(error), pa.list_(pa.float64())),
                }
            )

    found = _merged(rows.select("x").mapInArrow(run, "row int, salt int, high array<double>, low array<double>")).collect()  # one row a dimension
    high, low = np.zeros((width, width)), np.zeros((width, width))
    for r in found:
        high[r.row], low[r.row] = r.high, r.low
    return high, low


def sums_of(fit: DataFrame) -> Centre | None:
    """Number and exact sums of the fit list; None where it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                x = matrix(b.column(0).filter(pa.array(lengths == d)), np.int64)
                k = len(x)
                yield pa.record_batch(
                    {
                        "d": pa.array(np.full(d, d, dtype=np.int32)), "at": pa.array(np.arange(d, dtype=np.int32)), "n": pa.array(np.full(d, k, dtype=np.int64)),
                        "high": pa.array((x >> 32).sum(axis=0)), "low": pa.array((x & LOW).sum(axis=0)),
                    }
                )

    parts = fit.mapInArrow(run, "d int, at int, n long, high long, low long")
    shapes = [r.d for r in parts.select("d").distinct().limit(5).collect()]
    if not shapes:
        return None
    if len(shapes) > 1:
        raise ValueError(f"vectors must have one length; there are {sorted(shapes)}")
    wide = parts.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    found = sorted(wide.collect(), key=lambda r: r["at"])  # one row a dimension
    return Centre(found[0].n, tuple((int(r.high) << 32) + int(r.low) for r in found))


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """The nearest orthonormal columns to nearly orthonormal ones."""
    one = np.eye(x.shape[1], dtype=x.dtype)
    for _ in range(6):
        r = one - x.T @ x
        x = x + x @ ((r + r.T) / 4)
        if np.abs(r).max() < 1e-12:  # its square is below the last bit
            break
    return x


def eigen(high: np.ndarray, low: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix in double-double.

    Tridiagonal divide and conquer, then rounds of iterative refinement in extended precision: what is left of
    off-diagonal entries gives a first-order turn of vectors whose eigenvalues are far apart for its size. Runs of close ones are
    turned by the eigenvectors of their block, less its mean so that a double holds their differences. Vectors are
    made orthonormal after every round, so no turn costs orthogonality, however close the eigenvalues.
    """
    _, vectors = np.linalg.eigh((high + high.T) / 2)
    a = high.astype(np.longdouble) + low.astype(np.longdouble)
    a = (a + a.T) / 2
    floor = len(a) * np.finfo(np.longdouble).eps * np.linalg.norm(high, 2)
    x = _orthonormal(vectors.astype(np.longdouble))
    for _ in range(rounds):
        s = x.T @ (a @ x)
        s = (s + s.T) / 2
        order = np.argsort(np.diag(s), kind="stable")
        x, s = x[:, order], s[order][:, order]
        value = np.diag(s)
        off = max(np.linalg.norm((s - np.diag(value)).astype(float), 2), floor)
        ends = np.flatnonzero(np.diff(value) > FAR * off) + 1  # runs of close values end there
        run = np.searchsorted(ends, np.arange(len(value)), side="right")
        apart = run[:, None] != run[None, :]
        x = x + x @ np.where(apart, s / np.where(apart, value[None, :] - value[:, None], 1), 0)
        for c in map(slice, [0, *ends], [*ends, len(value)]):
            block = s[c, c] - value[c].mean() * np.eye(c.stop - c.start, dtype=np.longdouble)
            x[:, c] = x[:, c] @ np.linalg.eigh(block.astype(float))[1].astype(np.longdouble)
        x = _orthonormal(x)
    value = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-value, kind="stable")
    return value[order].astype(float), x[:, order].astype(float)


@dataclass(frozen=True)
class Whitening:
    centre: Centre
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of longs."""
        high, low = self.centre.centred(x)
        return (high @ self.axes + low @ self.axes) / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = COMPONENTS, embedding: str = "embedding") -> tuple[Whitening, float] | None:
    """(the transformation, largest absolute entry of the whitened fit list's covariance minus the identity); None without vectors."""
    x = fit_list(rows, embedding)
    centre = sums_of(x)
    if centre is None:
        return None
    d = len(centre.sums)
    high, low = outer_total(x, d, centre.centred)
    n = float(centre.n)
    over = [(Fraction(float(h)) + Fraction(float(w))) / centre.n for h, w in zip(high.ravel(), low.ravel(), strict=True)]
    top = np.array([float(v) for v in over])
    rest = np.array([float(v - Fraction(t)) for v, t in zip(over, top.tolist(), strict=True)])
    values, axes = eigen(top.reshape(d, d), rest.reshape(d, d))
    trace = math.fsum(np.diag(top.reshape(d, d)))
    k = min(components, int((values > NOTHING * trace).sum()) if trace > 0 else 0)
    model = Whitening(centre, values[:k], np.ascontiguousarray(axes[:, :k]), trace)
    if not k:
        return model, 0.0

    def whitened(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = model.apply(v)
        return w, np.zeros_like(w)

    high, low = outer_total(x, k, whitened)
    return model, float(np.abs((high + low) / n - np.eye(k)).max())


COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: its whitened coordinate, with what the fit found."""
    spark = rows.sparkSession
    fitted = fit(rows, components, embedding)
    if fitted is None:
        return spark.createDataFrame([], COLUMNS)
    model, error = fitted
    k = len(model.values)
    explained = model.values / model.trace if k else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = len(b)
            x = quantised(matrix(b.column(1), np.float64)) if m else np.zeros((0, len(model.centre.sums)), dtype=np.int64)
            if not m or not k:
                continue
            yield pa.record_batch(
                {
                    "vec_id": b.column(0).take(pa.array(np.repeat(np.arange(m), k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, model.centre.n, dtype=np.int64)), "deviation": pa.array(model.centre.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    "whitened": pa.array(model.apply(x).ravel()), "explained": pa.array(np.tile(explained, m)), "identity_error": pa.array(np.full(m * k, error)),
                }
            )

    return usable(rows, embedding).select(F.col(vec_id).cast("long").alias("vec_id"), "_c").mapInArrow(run, COLUMNS)


def op13(rows: DataFrame) -> DataFrame:
    """The contract's columns over all of ``embeddings``."""
    return whiten(rows)
