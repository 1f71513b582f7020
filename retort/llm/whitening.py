"""Embedding whitening: sums over all vectors in Spark, components by FEAST contour integration of the covariance.

Plan: vectors become whole numbers; each different one counts once. Partial sums of tasks, row by row of the matrix, give the
mean and the centred covariance, whose size depends on the number of dimensions alone. Counts of eigenvalues above a shift
(Sylvester's law of inertia) cut the upper end of the spectrum into intervals of a few eigenvalues, with no eigenvalue near
an end. The intervals are rows that Spark solves side by side: the quadrature of complex shifted solves projects onto an
interval's eigenvectors, Rayleigh-Ritz extracts them, and their number must be the inertia count. A map projects all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm.common import cut, documents

#: Most dimensions: the covariance, their square in doubles, is held by the driver and each solving task (128 MB).
DIMENSIONS = 4096
#: Most different lengths of vectors in one table; each is whitened on its own.
LENGTHS = 64
#: Nodes on a half circle, and eigenvalues of an interval, about.
NODES, TOGETHER = 8, 6
#: Components that a task looks at together.
BLOCK = 1 << 20


def whole_vectors(vectors: DataFrame, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """``vec_id, x`` (array of long, floor(scale * component) + offset) of the rows whose vector holds finite numbers only."""
    v = F.col("embedding").cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(fine).select("vec_id", F.transform(v, lambda c: F.floor(c * scale).cast("long") + offset).alias("x"))


def _matrices(column, dim: int):
    """An Arrow column of whole vectors as matrices of bounded size."""
    values = np.asarray(column.flatten()).reshape(-1, dim)
    step = max(1, BLOCK // dim)
    for at in range(0, len(values), step):
        yield values[at : at + step]


def _summed(parts: DataFrame, kind: str) -> list:
    """The sums of the rows ``pos, value`` (array of ``kind``) by pos, in order."""
    arrow, number = (pa.int64(), np.int64) if kind == "long" else (pa.float64(), np.float64)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for pos, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[pos] = total.get(pos, 0) + np.asarray(value.values, number)
        for pos, value in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([pos], pa.int32()), pa.array([value], pa.list_(arrow))], names=["pos", "value"])

    rows = parts.repartition("pos").mapInArrow(add, f"pos int, value array<{kind}>").collect()
    return [np.array(value, number) for _, value in sorted(map(tuple, rows))]


def _rows(values: np.ndarray, arrow):
    for at in range(len(values)):
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([values[at]], pa.list_(arrow))], names=["pos", "value"])


def _sums(fit: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """How many vectors there are, and the exact sum of each dimension."""

    def add(batches):
        total = np.zeros(dim + 1, np.int64)
        for batch in batches:
            for x in _matrices(batch.column(0), dim):
                total += np.concatenate((x.sum(0), [len(x)]))
        yield from _rows(total[None, :], pa.int64())

    total = _summed(fit.mapInArrow(add, "pos int, value array<long>"), "long")[0]
    return int(total[-1]), total[:-1]


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n: the whole part exactly, then the fraction."""
    return (x - sums // n).astype(np.float64) - (sums % n) / n


def _gram(fit: DataFrame, dim: int, made) -> np.ndarray:
    """The sum of outer products of ``made(x)`` and of these themselves, as the last row."""

    def add(batches):
        total = 0.0
        for batch in batches:
            for x in _matrices(batch.column(0), dim):
                y = made(x)
                total = total + np.vstack((y.T @ y, y.sum(0)))
        if np.ndim(total):
            yield from _rows(total, pa.float64())

    return np.vstack(_summed(fit.mapInArrow(add, "pos int, value array<double>"), "double"))


# --- the spectrum of a symmetric matrix -------------------------------------------------------------------------


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are above the shift: positive pivots of a symmetric elimination with complete pivoting."""
    a = matrix - shift * np.eye(len(matrix))
    count = 0
    while len(a):
        size = np.abs(a)
        at, most = int(size.diagonal().argmax()), size.max()
        if most == 0:
            break
        if size[at, at] >= 0.64 * most:  # (1 + sqrt(17)) / 8 bounds the growth
            count += int(a[at, at] > 0)
            pivot = [at]
        else:
            count += 1  # a pivot of two rows has a negative determinant: one eigenvalue on either side
            pivot = list(np.unravel_index(int(size.argmax()), size.shape))
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        side = a[np.ix_(pivot, rest)]
        a = a[np.ix_(rest, rest)] - side.T @ np.linalg.solve(a[np.ix_(pivot, pivot)], side)
        a = (a + a.T) / 2
    return count


def _cut_near(matrix: np.ndarray, low: float, high: float, gap: float) -> tuple[float, int]:
    """A point about the middle of an interval with no eigenvalue beside it, and the count above it."""
    for k in range(40):
        at = low + (high - low) * (0.5 + (-1) ** k * 0.011 * k)
        count = above(matrix, at - gap)
        if count == above(matrix, at + gap):
            return at, count
    return at, above(matrix, at)


def upper_intervals(matrix: np.ndarray, want: int) -> list[tuple[float, float, int]]:
    """Intervals of the spectrum with the numbers of their eigenvalues, by inertia: together at least the ``want`` largest.

    Eigenvalues closer than a millionth of the largest stay in one interval, so that their vectors are orthogonal.
    """
    top = float(np.abs(matrix).sum(1).max()) * (1 + 1e-9)
    least, gap = 1e-6 * top, 1e-8 * top
    ends = [(-gap, len(matrix)), (top, 0)]
    while ends[0][1] > want and ends[1][0] - ends[0][0] > least:  # raise the lower end
        at, count = _cut_near(matrix, ends[0][0], ends[1][0], gap)
        if count >= want:
            ends[0] = (at, count)
        else:
            ends.insert(1, (at, count))
    out, todo = [], list(zip(ends[:-1], ends[1:], strict=True))
    while todo:
        (a, more), (b, less) = todo.pop()
        if more - less > TOGETHER and b - a > least:
            at, count = _cut_near(matrix, a, b, gap)
            todo += [((a, more), (at, count)), ((at, count), (b, less))]
        elif more > less:
            out.append((a, b, more - less))
    return sorted(out)


def feast(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between low and high, ascending, and their unit vectors as columns.

    The spectral projector is the integral of the resolvent around the interval, here by Gauss-Legendre nodes on the
    upper half of a circle; for a real symmetric matrix the lower half is its conjugate.
    """
    d, norm = len(matrix), float(np.abs(matrix).sum(1).max())
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(0.5j * np.pi * (1 + nodes))
    middle, radius = (low + high) / 2, (high - low) / 2
    width = min(d, count + max(4, count // 2))
    while True:
        y = np.random.default_rng(width).standard_normal((d, width))
        for _ in range(12):
            q = sum(w / 2 * (radius * t * np.linalg.solve((middle + radius * t) * np.eye(d) - matrix, y)).real for t, w in zip(turns, weights, strict=True))
            q, _ = np.linalg.qr(q)
            values, small = np.linalg.eigh(q.T @ matrix @ q)  # Rayleigh-Ritz
            y = q @ small
            left = np.sqrt(((matrix @ y - y * values) ** 2).sum(0))
            inside = (values > low) & (values < high) & (left <= 1e-9 * norm)
            if inside.sum() == count and left[inside].max(initial=0.0) <= 4e-15 * norm * max(1.0, d**0.5):
                break
        if inside.sum() == count:
            return values[inside], y[:, inside]
        if width == d:
            raise ArithmeticError(f"{int(inside.sum())} of {count} eigenvalues found between {low} and {high}")
        width = min(d, 2 * width)


def components_of(spark, matrix: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues of a symmetric matrix, falling, and their vectors; intervals are solved side by side in Spark."""
    intervals = upper_intervals(matrix, want)
    sent = spark.sparkContext.broadcast(matrix)

    def solve(batches):
        for batch in batches:
            for low, high, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values, vectors = feast(sent.value, low, high, count)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(list(vectors.T), pa.list_(pa.float64()))], names=["value", "vector"])

    rows = spark.createDataFrame(intervals, "low double, high double, count int").repartition(len(intervals)).mapInArrow(solve, "value double, vector array<double>")
    found = sorted(((value, vector) for value, vector in map(tuple, rows.collect())), key=lambda r: -r[0])
    if len(found) < want:
        raise ArithmeticError(f"{len(found)} of {want} components found")
    vectors = np.array([vector for _, vector in found[:want]]).T
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(want)])
    return np.array([value for value, _ in found[:want]]), vectors * signs


# --- whitening ----------------------------------------------------------------------------------------------------


def _whitened(rows: DataFrame, dim: int, components: int) -> DataFrame:
    fit = cut(rows.select("x").distinct())
    n, sums = _sums(fit, dim)
    gram = _gram(fit, dim, lambda x: _centred(x, n, sums))
    covariance = gram[:-1] / n - np.outer(gram[-1] / n, gram[-1] / n)
    trace, top = float(np.trace(covariance)), float(np.abs(covariance).sum(1).max())
    most = min(components, dim)
    want = min(most, above(covariance, 16 * dim * np.finfo(float).eps * top)) if top > 0 else 0
    values, vectors = components_of(rows.sparkSession, covariance, want) if want else (np.empty(0), np.empty((dim, 0)))
    to_white = vectors / np.sqrt(values)
    error = None
    if want:
        white = _gram(fit, dim, lambda x: _centred(x, n, sums) @ to_white)
        error = float(np.abs(white[:-1] / n - np.outer(white[-1] / n, white[-1] / n) - np.eye(want)).max())
    explained = [float(e) / trace for e in values] + [0.0 if trace > 0 else None] * (most - want)
    largest = 2**63 - 1

    def project(batches):
        for batch in batches:
            ids, at = batch.column(0), 0
            for x in _matrices(batch.column(1), dim):
                white = _centred(x, n, sums) @ to_white
                reach = int(np.abs(x - sums // n).max(initial=0)) + 1
                if (reach * n) ** 2 * dim <= largest:
                    deviation = pa.array(((n * x - sums) ** 2).sum(1)).cast(pa.decimal128(38, 0))
                else:
                    own = [int(s) for s in sums]
                    deviation = pa.array([sum((n * v - s) ** 2 for v, s in zip(row, own, strict=True)) for row in x.tolist()], pa.decimal128(38, 0))
                repeat = pa.array(np.repeat(np.arange(len(x)), most))
                full = np.full((len(x), most), np.nan)
                full[:, :want] = white
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(x)).take(repeat), pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * most, n)),
                        deviation.take(repeat), pa.array(full.ravel(), from_pandas=True), pa.array(explained * len(x), pa.float64()), pa.array([error] * (len(x) * most), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
                at += len(x)

    kind = dict(rows.dtypes)["vec_id"]
    return rows.select("vec_id", "x").mapInArrow(project, f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = 16, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """Each vector's coordinates in the ``components`` directions of largest variance, divided by their standard deviations.

    ``vectors`` has ``vec_id, embedding``. Components c become whole numbers x = floor(scale * c) + offset. Each different
    x vector counts once in the fit: their number n, their sums S, and the covariance with divisor n. Returns for each
    row and each component, numbered from 1 by falling variance: ``vec_id, component, n, deviation`` (the sum over the
    dimensions of (n x - S) ** 2, exact, as a decimal), ``whitened, explained`` (share of the whole variance) and
    ``identity_error`` (how far the fit list's whitened covariance is from the identity). A component's sign is the
    same for all rows: its entry of largest size is positive.

    Null and empty vectors and those with null or non-finite components take no part. Repeated rows are returned each
    and count once in the fit; a null vec_id stays null. There are no more components than dimensions. A component
    without variance (equal vectors, fewer vectors than components) has a null ``whitened`` and a share of 0; with no
    variance at all the shares and the error are null. Vectors of different lengths are whitened each among its own
    kind, up to LENGTHS lengths; more, or more than DIMENSIONS dimensions, are an error, as is an x beyond 64
    bits. Other columns are ignored; an empty table gives no rows.
    """
    rows = whole_vectors(vectors, scale, offset)
    lengths = [r[0] for r in rows.select(F.size("x").alias("dim")).distinct().orderBy("dim").limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS or max(lengths, default=0) > DIMENSIONS:
        raise ValueError(f"vectors must have at most {LENGTHS} different lengths and {DIMENSIONS} dimensions")
    out = rows.select("vec_id", *(F.lit(None).cast(kind).alias(name) for name, kind in _COLUMNS)).limit(0)
    for dim in lengths:
        part = _whitened(rows.where(F.size("x") == dim) if len(lengths) > 1 else rows, dim, components)
        out = part if len(lengths) == 1 else out.unionByName(part)
    return out


_COLUMNS = (("component", "int"), ("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))


def op12_embedding_whitening(spark, sf_dir):
    """The contract's columns over all embeddings."""
    return whiten(documents(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
