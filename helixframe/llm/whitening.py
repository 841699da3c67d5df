"""Whitening of embeddings on principal components found by FEAST contour integration.

Spark makes the fit list (each distinct vector once), its exact sums and the centred covariance as partial matrices
that are summed by entry; only d x d numbers, d the dimension, reach the driver. There eigenpairs of the covariance
are taken interval by interval: inertia counts of the shifted matrix place the intervals and say how many eigenvalues
each holds, a quadrature of complex shifted solves along the circle around an interval projects a block of vectors on
its eigenspace, and Rayleigh-Ritz on the projected block gives the pairs, until as many converge as the inertia says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release, small_batches, table

#: Components that are returned.
COMPONENTS = 16
#: The largest dimension: d x d numbers are on the driver and in every task of the covariance.
MOST_DIMENSIONS = 4096
#: Vectors multiplied at a time.
BLOCK = 512
#: Gauss-Legendre nodes on the upper half of a contour; the lower half is its mirror image.
NODES = 8
#: An interval holds at most this many eigenvalues where they can be told apart.
PER_INTERVAL = 8
ROUNDS = 30
#: Of the largest eigenvalue: residuals of a converged pair, and what counts as no variance (times the dimension).
TOLERANCE = 4e-14


@dataclass(frozen=True)
class Whitener:
    """n fitted vectors, exact sums by dimension, total variance, eigenvalues falling, components as columns."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix that is orthogonally similar to the symmetric ``a`` (Householder)."""
    a, d = a.copy(), len(a)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += norm if x[0] >= 0 else -norm
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        p -= (x @ p) * x
        rest -= 2 * (np.outer(x, p) + np.outer(p, x))
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy()


def inertia(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """How many eigenvalues are over ``shift``: the positive pivots of the shifted matrix (Sylvester's law)."""
    least = np.finfo(float).tiny + np.finfo(float).eps ** 2 * (np.abs(diagonal).max() + np.abs(off).max(initial=0))
    over, pivot = 0, 1.0
    for k, x in enumerate(diagonal):
        pivot = x - shift - (off[k - 1] ** 2 / pivot if k else 0.0)
        if abs(pivot) < least:
            pivot = -least
        over += pivot > 0
    return over


def eigenvalue(diagonal: np.ndarray, off: np.ndarray, rank: int, scale: float) -> float:
    """The eigenvalue that is ``rank``-th from the top, by bisection of inertia down to rounding."""
    low, high = -scale, scale
    while (middle := (low + high) / 2) not in (low, high) and high - low > np.finfo(float).eps * scale:
        low, high = (middle, high) if inertia(diagonal, off, middle) >= rank else (low, middle)
    return middle


def intervals(diagonal: np.ndarray, off: np.ndarray, wanted: int, floor: float, scale: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues in it) from the top down, until ``wanted`` eigenvalues or all over ``floor`` are covered.

    Bisection by inertia: an interval is halved while it holds over PER_INTERVAL eigenvalues that rounding can tell apart.
    Borders then move to the middle of the gaps beside the interval, which is where a contour sees its neighbours least.
    """
    d, out, done = len(diagonal), [], 0
    top = scale * (1 + 1e-9)
    open_ = [(floor, top, inertia(diagonal, off, floor), 0)]
    while open_ and done < wanted:
        low, high, over_low, over_high = open_.pop()
        inside = over_low - over_high
        if not inside:
            continue
        middle = (low + high) / 2
        over = inertia(diagonal, off, middle)
        # halves whose border stands in an eigenvalue's rounding would find it from both sides
        clear = high - low > 8 * floor and inertia(diagonal, off, middle - floor) == inertia(diagonal, off, middle + floor)
        if inside > PER_INTERVAL and not clear and high - low > 8 * floor:
            middle = low + 0.37 * (high - low)
            over = inertia(diagonal, off, middle)
            clear = inertia(diagonal, off, middle - floor) == inertia(diagonal, off, middle + floor)
        if inside > PER_INTERVAL and clear:
            open_ += [(low, middle, over_low, over), (middle, high, over, over_high)]
            continue
        first, last = eigenvalue(diagonal, off, over_high + 1, scale), eigenvalue(diagonal, off, over_low, scale)
        below = eigenvalue(diagonal, off, over_low + 1, scale) if over_low < d else last - max(first - last, 0.1 * scale)
        above = eigenvalue(diagonal, off, over_high, scale) if over_high else first + max(first - last, last - below)
        out.append(((last + below) / 2, (first + above) / 2, inside))
        done += inside
    return out


def feast(a: np.ndarray, low: float, high: float, count: int, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of the symmetric ``a`` in [low, high], values falling.

    The block has more columns than eigenvalues; a filter along the circle on [low, high] damps the others by the
    distance of their eigenvalues, and rounds repeat until ``count`` Ritz pairs in the interval are converged, and once
    more, which takes what is left of their residuals down to rounding.
    """
    d = len(a)
    width = max((high - low) / 2, 1e-12 * scale)
    centre = (low + high) / 2
    angles, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(1j * np.pi / 2 * (angles + 1))  # the upper half circle
    columns = min(d, count + max(8, count // 2))
    block = np.linalg.qr(rng.standard_normal((d, columns)))[0]
    eye, ready = np.eye(d), False
    for _ in range(ROUNDS):
        projected = np.zeros_like(block)
        for turn, weight in zip(turns, weights):
            solved = np.linalg.solve((centre + width * turn) * eye - a, block.astype(complex))
            projected += weight / 2 * (width * turn * solved).real
        # an orthonormal base of what is left; columns that the filter has emptied go
        left, sizes, _ = np.linalg.svd(projected, full_matrices=False)
        base = left[:, sizes > sizes[0] * 1e-14]
        ritz, turn_in = np.linalg.eigh(base.T @ a @ base)
        block = base @ turn_in
        bad = np.linalg.norm(a @ block - block * ritz, axis=0)
        slack = TOLERANCE * scale * d
        good = (bad <= slack) & (ritz > low) & (ritz <= high)
        if good.sum() >= count and not ready:
            ready = True
        elif good.sum() >= count:
            middle = np.abs(ritz - centre)
            keep = np.flatnonzero(good)[np.argsort(middle[good], kind="stable")[:count]]
            keep = keep[np.argsort(-ritz[keep], kind="stable")]
            return ritz[keep], block[:, keep]
    raise ArithmeticError(f"{int(good.sum())} of {count} eigenvalues in [{low}, {high}] converged in {ROUNDS} rounds")


def leading(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a covariance, falling, and unit eigenvectors as columns. Eigenvalues that are
    nothing but rounding are left out, so there may be fewer."""
    d, scale = len(a), float(np.abs(a).sum(axis=1).max())
    if not scale:
        return np.zeros(0), np.zeros((d, 0))
    rng = np.random.default_rng(0)
    diagonal, off = tridiagonal(a)
    found = [feast(a, *x, scale, rng) for x in intervals(diagonal, off, wanted, TOLERANCE * d * scale, scale)]
    if not found:
        return np.zeros(0), np.zeros((d, 0))
    values, vectors = np.concatenate([x[0] for x in found]), np.hstack([x[1] for x in found])
    # neighbouring intervals are converged apart; one orthonormalisation and Rayleigh-Ritz step joins them
    base = np.linalg.qr(vectors)[0]
    values, turn = np.linalg.eigh(base.T @ a @ base)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], base @ turn[:, order]


def scaled(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``rows`` whose vector is neither null nor empty and has finite entries only, with x: floor(64 c) + 1000000."""
    c = F.col(column)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * 64).cast("long") + F.lit(1_000_000))
    return rows.filter(c.isNotNull() & (F.size(c) > 0) & finite).withColumn("x", x)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _summed(fit: DataFrame, width: int, part) -> np.ndarray:
    """Sums over all of ``fit`` of the rows of numbers that ``part`` makes of a batch, by place; a task adds up its own."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                new = part(b.column(0).slice(i, BLOCK))
                total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "v"])

    out = fit.select("x").mapInArrow(tasks, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).collect()
    result = np.zeros(width)
    for r in out:
        result[r.place] = r.v
    return result


def fit_whitener(fit: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitener of ``fit`` (x: equally long arrays of long, each vector once); None of an empty table."""
    lengths = fit.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("d")).first()
    n, d = lengths.n, lengths.d
    if not n:
        return None
    if lengths.least != d:
        raise ValueError(f"vectors of {lengths.least} and of {d} entries cannot be whitened together")
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions; at most {MOST_DIMENSIONS}")
    at = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).collect()
    sums = [r.s for r in sorted(at, key=lambda r: r.i)]
    mean, frac = np.array([s // n for s in sums]), np.array([s % n / n for s in sums])
    upper = np.triu_indices(d)

    def products(x: pa.Array) -> np.ndarray:
        c = (_matrix(x, d) - mean) - frac
        return (c.T @ c)[upper]

    v = np.zeros((d, d))
    v[upper] = _summed(fit, len(upper[0]), products) / n
    v = v + np.triu(v, 1).T
    values, vectors = leading(v, components)
    return Whitener(n, sums, float(np.trace(v)), values, vectors)


def _projector(w: Whitener):
    n, d = w.n, len(w.sums)
    mean, frac = np.array([s // n for s in w.sums]), np.array([s % n / n for s in w.sums])
    to = w.components / np.sqrt(w.values)
    return lambda x: ((_matrix(x, d) - mean) - frac) @ to


def identity_error(fit: DataFrame, w: Whitener) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, measured over the list."""
    project, k = _projector(w), len(w.values)

    def moments(x: pa.Array) -> np.ndarray:
        p = project(x)
        return np.concatenate([p.sum(axis=0), (p.T @ p).ravel()])

    total = _summed(fit, k + k * k, moments) / w.n
    return float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max())


def deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n x - S)^2 of every row, exact; OverflowError beyond a long."""
    off, rest = np.array([s // n for s in sums]), [s % n for s in sums]
    near = x - off
    if n * (int(np.abs(near).max(initial=0)) + 1) < 2**31 // max(1, int(np.sqrt(x.shape[1])) + 1):
        y = near * n - np.array(rest)
        return (y * y).sum(axis=1).tolist()
    out = [sum((int(v) * n - r) ** 2 for v, r in zip(row, rest)) for row in near.tolist()]
    if max(out, default=0) >= 2**63:
        raise OverflowError("a deviation does not fit a long")
    return out


def whiten(rows: DataFrame, fit: DataFrame, w: Whitener, id_column: str = "vec_id") -> DataFrame:
    """A row for each of ``rows`` (id_column, x) and component: component from 1 on, n, deviation, whitened, explained,
    identity_error."""
    error = identity_error(fit, w) if len(w.values) else None
    project, k = _projector(w), len(w.values)
    explained = w.values / w.trace if w.trace else w.values
    d, n, sums = len(w.sums), w.n, w.sums

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                ids, x = b.column(0).slice(i, BLOCK), b.column(1).slice(i, BLOCK)
                m = len(ids)
                far = pa.array(deviation(_matrix(x, d), n, sums), pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                    far.take(each), pa.array(project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error, np.float64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = dict(rows.dtypes)[id_column]
    out = rows.select(F.col(id_column).alias("id"), "x").mapInArrow(tasks, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_column)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row of ``embeddings`` on the 16 leading components of the distinct vectors, whitened.

    Rows whose vector is null, empty or has null or non-finite entries go; null and repeated vec_ids and repeated vectors
    are rows like others. Components without variance cannot be whitened and are left out, so a table whose distinct
    vectors span fewer dimensions has fewer components a row, and one with a single distinct vector, like an empty one,
    gives no rows. Vectors of several lengths raise ValueError, deviations beyond a long OverflowError.
    """
    small_batches(spark)
    rows = scaled(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "x")
    fit = materialise(rows.select("x").distinct(), "fit")
    w = fit_whitener(fit)
    if w is None or not len(w.values):
        release(fit)
        return rows.limit(0).selectExpr("vec_id", "1 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    out = whiten(rows, fit, w)
    release(fit)
    return out
