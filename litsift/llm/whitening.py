"""Whitening of embeddings: rows centred, turned onto the principal components and scaled to unit variance.

Entries become integers (floor(scale * c) + SHIFT). Sums and centred numerators n * x - S are exact integers. A covariance is
added up in double-double: each task cuts its centred rows into slices of SLICE bits on a grid of powers of two, so that the
matrix products of the slices are free of error for up to BLOCK rows, and adds the products to a pair of matrices, high and
low, by error-free two-sums. Spark adds up the pairs of all tasks by matrix row in the same way, so neither the order of
the rows nor their number of tasks shows in the result, and one matrix of fixed size goes to the driver. There it is turned
into tridiagonal form and solved by divide and conquer (LAPACK's syevd), and the pairs are refined by one step of Newton's
method in extended precision. Whitened rows are measured by the same pass: identity_error is the largest
absolute entry of their covariance minus the identity.

Tasks hold one block of rows and a few matrices of dims * dims; only such matrices are shuffled.

Edge cases: vectors that are null, or hold null or non-finite entries, are dropped; shorter vectors count as padded with
zeros; rows that repeat an id or have none are kept one by one; components without variance (fewer rows than dimensions,
constant dimensions) have null in `whitened` and don't count for identity_error, which is null if there is no other; a
deviation beyond a long is null; an entry of 2^40 or more after scaling raises an error; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsift.llm.common import cut

SHIFT = 1_000_000
#: Rows of a block, and bits of a slice: products of slices stay below 2^(2 * SLICE) * BLOCK = 2^52.
BLOCK, SLICE, SLICES = 4096, 20, 3  # 2^40 * 2^12 = 2^52
MOST = 2.0**40
#: Components with less than this share of the largest variance have none.
LEAST = 1e-13
PAIR = "i int, hi binary, lo binary"


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def sliced(x: np.ndarray) -> list[np.ndarray]:
    """Columns as sums of slices, each a multiple of a power of two with at most SLICE bits, and what is left."""
    top = np.frexp(np.abs(x).max(axis=0, initial=0))[1]
    out = []
    for k in range(1, SLICES + 1):
        grid = np.ldexp(1.0, top - k * SLICE)
        part = np.rint(x / grid) * grid
        out.append(part)
        x = x - part
    return [*out, x]


def products(high: np.ndarray, low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the outer products of the rows high + low, as a double-double."""
    total = np.zeros((2, high.shape[1], high.shape[1]))
    total = total[0], total[1]
    for a in range(0, len(high), BLOCK):
        parts = sliced(high[a : a + BLOCK])
        if low is not None:
            parts[-1] = parts[-1] + low[a : a + BLOCK]
        for i, p in enumerate(parts):  # products of slices are exact; those with the rest are below 2^-60
            for q in parts[: SLICES + 1 - i]:
                total = added(total, (p.T @ q, np.zeros_like(total[0])))
    return total


def column_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of a block's rows as a double-double of one row; sums of slices are exact."""
    total = np.zeros((1, x.shape[1])), np.zeros((1, x.shape[1]))
    for p in sliced(x):
        total = added(total, (p.sum(axis=0)[None], np.zeros_like(total[0])))
    return total


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Entries as the rows of a matrix of integers, padded with what zeros become."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(sizes), dims), SHIFT, dtype=np.int64)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def integers(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, x) of the vectors that take part, cut."""
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    y = lambda c: F.floor(c.cast("double") * scale)
    x = F.transform("embedding", lambda c: F.when(F.abs(c.cast("double") * scale) < MOST, y(c) + SHIFT).otherwise(F.raise_error(F.lit("an entry is too large to be whitened")).cast("long")))
    return cut(vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")))


def sums(rows: DataFrame, dims: int) -> list[int]:
    """The exact sum of each dimension; tasks send one row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, dtype=object)
        for b in batches:
            total = total + matrix(b.column("x"), dims).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([int(t) for t in total], pa.int64())], ["i", "s"])

    found = rows.select("x").mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()  # a row a dimension
    return [int(r["s"]) for r in found]


@dataclass(frozen=True)
class Centre:
    """The exact mean S / n of each dimension: a whole part, and the rest as S' / n, rounded, with its error."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    high: np.ndarray
    low: np.ndarray

    @classmethod
    def of(cls, n: int, total: list[int]) -> Centre:
        rest = [s % n for s in total]
        high = [Fraction(r, n) for r in rest]
        low = [float(f - Fraction(float(f))) for f in high]
        return cls(n, np.array([s // n for s in total], dtype=np.int64), np.array(rest, dtype=np.int64), np.array([float(f) for f in high]), np.array(low))

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - S / n as high and low part."""
        high, low = two_sum((x - self.whole).astype(float), -self.high)
        return high, low - self.low

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)^2 of each row; None where a long can't hold it."""
        d = x - self.whole
        about = ((d * float(self.n) - self.rest) ** 2).sum(axis=1)
        with np.errstate(over="ignore"):
            out: list[int | None] = ((d * self.n - self.rest) ** 2).sum(axis=1).tolist()
        for i in np.flatnonzero(about > 2.0**61):
            exact = sum((int(v) * self.n - int(r)) ** 2 for v, r in zip(d[i], self.rest, strict=True)) if about[i] < 2.0**64 else 1 << 63
            out[i] = exact if exact < 1 << 63 else None
        return out


def pairs(high: np.ndarray, low: np.ndarray, index: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(index, pa.int32()), pa.array([x.tobytes() for x in high], pa.binary()), pa.array([x.tobytes() for x in low], pa.binary())], ["i", "hi", "lo"])


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums by i of the pairs that meet in a task."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for i, hi, lo in zip(*(b.column(c).to_pylist() for c in ("i", "hi", "lo")), strict=True):
            pair = np.frombuffer(hi), np.frombuffer(lo)
            held[i] = added(held[i], pair) if i in held else pair
    if held:
        yield pairs(np.stack([x[0] for x in held.values()]), np.stack([x[1] for x in held.values()]), list(held))


def added_up(rows: DataFrame, dims: int, of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sum of the matrices of(block) over all blocks of rows, in extended precision; tasks send pairs of matrix rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = of(matrix(b.column("x").slice(a, BLOCK), dims))
                total = part if total is None else added(total, part)
        if total is not None:
            yield pairs(*total, list(range(len(total[0]))))

    found = rows.select("x").mapInArrow(each, PAIR).repartition("i").mapInArrow(merge, PAIR).orderBy("i").collect()  # a row a dimension
    high, low = (np.stack([np.frombuffer(r[c]) for r in found]).astype(np.longdouble) for c in ("hi", "lo"))
    return high + low


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns; v is symmetric, in extended precision."""
    e, x = np.linalg.eigh(v.astype(float))
    x = x.astype(np.longdouble)
    for _ in range(1 if len(v) <= 512 else 0):
        r, s = np.eye(len(v)) - x.T @ x, x.T @ (v @ x)
        values = np.diag(s) / (1 - np.diag(r))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= 1e-10 * max(np.abs(values).max(), np.finfo(float).tiny)
        fix = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        x, e = x + x @ fix, values
    order = np.argsort(-e, kind="stable")[:k]
    return np.asarray(e[order], dtype=float), np.asarray(x[:, order], dtype=float)


def whiten(vectors: DataFrame, k: int = 32, scale: float = 64.0) -> DataFrame:
    """From rows (vec_id, embedding) for each vector and component: vec_id, component, n, deviation, whitened, explained and identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integers(vectors, scale)
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims")).first()
    n, dims = about["n"], about["dims"] or 0
    if not n or not dims:
        return rows.sparkSession.createDataFrame([], schema)
    centre = Centre.of(n, sums(rows, dims))
    v = added_up(rows, dims, lambda x: products(*centre.centred(x))) / n
    k = min(k, dims)
    e, p = components((v + v.T) / 2, k)
    good = e > LEAST * e[0] if e[0] > 0 else np.zeros(k, dtype=bool)
    turn, live, trace = p[:, good] / np.sqrt(e[good]), int(good.sum()), float(np.trace(v))
    explained = e / trace if trace > 0 else np.zeros(k)

    def white(x: np.ndarray) -> np.ndarray:
        high, low = centre.centred(x)
        return high @ turn + low @ turn

    error = None
    if live:
        mean = np.asarray(added_up(rows, dims, lambda x: column_sums(white(x))) / n, dtype=float)
        spread = added_up(rows, dims, lambda x: products(white(x) - mean, None)) / n
        error = float(np.abs(spread - np.eye(live)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                x = matrix(part.column("x"), dims)
                w = np.full((len(x), k), np.nan)
                w[:, good] = white(x)
                every, size = pa.array(np.repeat(np.arange(len(x)), k)), len(x) * k
                columns = {
                    "vec_id": part.column("vec_id").take(every), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), "n": pa.array(np.full(size, n)),
                    "deviation": pa.array(centre.deviations(x), pa.int64()).take(every), "whitened": pa.array(w.ravel(), pa.float64(), from_pandas=True),
                    "explained": pa.array(np.tile(explained, len(x))), "identity_error": pa.array([error] * size, pa.float64()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, schema)
