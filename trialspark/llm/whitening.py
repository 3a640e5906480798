"""Whitening of vectors by the eigenvectors of their covariance.

Executors sum the entries, then the products of entries centred on the mean; only sums of as many numbers as a vector has
entries, squared, reach the driver. There the scatter S = L L' is factored by a pivoted Cholesky, and one-sided Jacobi rotations are applied
directly to the columns of the triangular factor until they are orthogonal: then L J = U D, so the squared lengths of the columns are the
eigenvalues of S and the columns, normalised, its eigenvectors. Small eigenvalues come out as precise as large ones.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, written
from .vectors import doubles, matrix, whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMPONENTS = 32
#: Entries are whole numbers floor(SCALE * c) + SHIFT; the first part is held to MOST either way.
SCALE, SHIFT, MOST = 64.0, 1_000_000, 2.0**52
#: Pivots below this share of the largest entry on the diagonal end the factorisation: what is left is rounding.
RANK = 1e-14
#: Sweeps over all pairs of columns at most; some ten do.
SWEEPS = 60


def cholesky(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L and the order of its rows: scatter[order][:, order] = L L'. L has as many columns as the scatter has rank.

    At each step the row of the largest remaining variance comes next; equal ones in their own order.
    """
    size = len(scatter)
    order, left = np.arange(size), scatter.astype(float).copy()
    factor = np.zeros((size, size))
    top = float(np.diag(left).max(initial=0.0))
    for k in range(size):
        pivot = k + int(np.argmax(np.diag(left)[k:]))
        if left[pivot, pivot] <= RANK * top or left[pivot, pivot] <= 0:
            return factor[:, :k], order
        for table in (left, factor):
            table[[k, pivot]] = table[[pivot, k]]
        left[:, [k, pivot]] = left[:, [pivot, k]]
        order[[k, pivot]] = order[[pivot, k]]
        factor[k, k] = np.sqrt(left[k, k])
        factor[k + 1:, k] = left[k + 1:, k] / factor[k, k]
        left[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return factor, order


def rounds(n: int):
    """Every pair of n columns once, as rounds of disjoint pairs: all but the first move on one seat per round."""
    seats = list(range(n + n % 2))
    for _ in range(len(seats) - 1):
        pairs = [(a, b) for a, b in zip(seats[:len(seats) // 2], reversed(seats[len(seats) // 2:])) if max(a, b) < n]
        if pairs:
            yield np.array([min(p) for p in pairs]), np.array([max(p) for p in pairs])
        seats = seats[:1] + seats[-1:] + seats[1:-1]


def rotated(factor: np.ndarray) -> np.ndarray:
    """The factor times rotations of pairs of columns, until all columns are orthogonal."""
    g = factor.copy()
    orthogonal = np.finfo(float).eps * max(1, len(g))  # a cosine that is rounding only
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in rounds(g.shape[1]):
            x, y = g[:, p], g[:, q]
            a, b, c = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            cosine = np.abs(c) / np.sqrt(np.maximum(a * b, np.finfo(float).tiny))
            worst = max(worst, float(cosine.max(initial=0.0)))
            turn = cosine > orthogonal
            with np.errstate(divide="ignore", over="ignore"):
                zeta = np.where(turn, (b - a) / np.where(turn, 2 * c, 1.0), 0.0)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(turn, t, 0.0)
            cos = 1 / np.sqrt(1 + t * t)
            sin = cos * t
            g[:, p], g[:, q] = cos * x - sin * y, sin * x + cos * y
        if worst <= orthogonal:
            break
    return g


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues, falling, and their unit eigenvectors as columns; the largest entry of each is positive."""
    factor, order = cholesky(scatter)
    columns = rotated(factor)
    values = (columns * columns).sum(axis=0)
    rank = np.argsort(-values, kind="stable")
    rank = rank[values[rank] > 0]
    vectors = np.empty((len(scatter), len(rank)))
    vectors[order] = columns[:, rank] / np.sqrt(values[rank])
    if len(rank):
        peak = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(rank))]
        vectors = vectors * np.where(peak < 0, -1.0, 1.0)
    return values[rank], vectors


def summed(rows: DataFrame, size: int, centre: np.ndarray | None, make: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> np.ndarray:
    """Over make(x) of rows (x array<double> of `size` entries): sums of the entries, or, with a centre, of the products of centred entries.

    Each task sends its own sums, one row per number; those are added by Spark.
    """
    def add(batches):
        total = np.zeros((size, size if centre is not None else 1))
        for batch in batches:
            x = make(matrix(batch.column(0), size))
            total += x.sum(axis=0)[:, None] if centre is None else (x - centre).T @ (x - centre)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (i, j, total)], names=["i", "j", "s"])

    out = np.zeros((size, size if centre is not None else 1))
    for i, j, s in rows.select("x").mapInArrow(add, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s")).collect():
        out[i, j] = s
    return out[:, 0] if centre is None else out


def exact_scatter(n: int, products: np.ndarray, sums: list[int]) -> np.ndarray:
    """n x the covariance from whole numbers y centred on the mean rounded to whole numbers: (products - sums sums' / n), in integers till the last step."""
    return np.array([[(n * int(v) - a * b) / n for v, b in zip(row, sums)] for row, a in zip(products.tolist(), sums)]).reshape(len(sums), len(sums))


def whitened(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, n, deviation, whitened array, explained array, identity_error) of every vector that takes part.

    Entries become whole numbers floor(64 c) + 1,000,000. All vectors that take part are fitted; none is drawn. n is their number,
    deviation the squared distance from the mean, times n squared, exact (the largest 64-bit integer where it is beyond). Arrays go by component, by falling
    eigenvalue, up to `components` and to the rank of the covariance: a direction without variance has no component, so equal
    vectors only, or one, give empty arrays. identity_error is measured on the whitened vectors (0 without components).

    Vectors that are null or hold a null or non-finite entry are dropped, as are those whose length differs from the most
    frequent one (the longest, if equally frequent). Repeated rows count as often as they occur. A null id is kept. Entries beyond
    2^46 are held to that. Empty tables give an empty result. Columns of other names are not looked at.
    """
    spark = prepare(rows.sparkSession)
    valid = rows.select(F.col(id_col).alias("id"), doubles(F.col(vector)).alias("x")).where(F.col("x").isNotNull())
    lengths = valid.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size, n = lengths if lengths else (0, 0)
    part = valid.where(F.size("x") == size)
    make = lambda x: whole(x, SCALE, MOST)
    # Everything is counted from SHIFT, which keeps sums small: doubles hold whole numbers exactly below 2^53.
    sums = [int(s) for s in summed(part, size, None, make)]
    near = [round(s / n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, near)]
    scatter = exact_scatter(n, summed(part, size, np.array(near, float), make), rest) if n else np.zeros((0, 0))
    values, vectors = eigen(scatter)
    shown = values[:components]
    explained = (shown / np.trace(scatter)).tolist() if len(shown) else []
    project = vectors[:, :components] / np.sqrt(shown / max(1, n))

    def turn(batches):
        for batch in batches:
            x = make(matrix(batch.column(1), size)).astype(np.int64)
            apart = np.abs(x - np.array(near, np.int64)).max(initial=0)
            if (n * (int(apart) + 1)) ** 2 * size < 2**63:
                deep = n * (x - np.array(near, np.int64)) - np.array(rest, np.int64)  # n x - S
                deviation, centred = (deep * deep).sum(axis=1), deep / n
            else:
                deep = [[n * (v - c) - r for v, c, r in zip(row, near, rest)] for row in x.tolist()]
                deviation = np.array([min(2**63 - 1, sum(v * v for v in row)) for row in deep], np.int64)
                centred = np.array([[v / n for v in row] for row in deep]).reshape(len(x), size)
            out = centred @ project
            ends = pa.array(np.arange(len(x) + 1) * out.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=["id", "deviation", "x"])

    kind = valid.schema["id"].dataType.simpleString()
    flat = written(part.select("id", "x").mapInArrow(turn, f"id {kind}, deviation long, x array<double>"), "whitened")
    error = 0.0
    if len(shown):
        mean = summed(flat, len(shown), None) / n
        error = float(np.abs(summed(flat, len(shown), mean) / n - np.eye(len(shown))).max())
    return flat.select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), "deviation", F.col("x").alias("whitened"),
                       F.array(*[F.lit(v) for v in explained]).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))
