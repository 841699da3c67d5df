"""Leading singular vectors of a tall matrix whose rows are spread over tasks, without its Gram matrix.

A randomised block Krylov space of the row space grows by one multiplication with the matrix a step: every task multiplies
its rows by a block of columns and back, and the partial products are summed tree-wise. A tall-skinny QR tree then gives
the triangle of the matrix times the base found, whose small SVD rotates it. What is on the driver has as many rows as
the matrix has columns and as many columns as the base, BLOCK_NUMBERS numbers a block or a few times the wanted number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in a block of columns, unless the wanted columns and SPARE more have more.
BLOCK_NUMBERS = 1 << 18
SPARE = 10
#: Steps of the Krylov space, and the change of the wanted values, relative, from which on it is converged.
STEPS = 30
TOLERANCE = 1e-13
#: Rows of a product that travel together, and partial results that are joined at a time.
CHUNK = 256
FAN_IN = 64

Prepare = Callable[[pd.DataFrame], np.ndarray]


def summed(rows: DataFrame, product: Prepare, shape: tuple[int, int]) -> np.ndarray:
    """The sum over tasks of ``product`` (some rows -> matrix of ``shape``); partial sums are joined FAN_IN at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                own = product(f)
                total = own if total is None else total + own
        if total is not None:
            parts = [total[i : i + CHUNK].ravel() for i in range(0, len(total), CHUNK)]
            yield pd.DataFrame({"task": TaskContext.get().partitionId(), "chunk": np.arange(len(parts)), "part": parts})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"task": f["task"].head(1), "chunk": f["chunk"].head(1), "part": [np.sum(np.stack(f["part"]), axis=0)]})

    kind = "task long, chunk int, part array<double>"
    parts, most = rows.mapInPandas(run, kind), rows.rdd.getNumPartitions()
    while most > 1:
        parts = parts.groupBy("chunk", F.floor(F.col("task") / FAN_IN)).applyInPandas(add, kind).withColumn("task", F.floor(F.col("task") / FAN_IN))
        most = -(-most // FAN_IN)
    out = np.zeros(shape)
    for r in parts.collect():  # a row a chunk
        own = np.array(r["part"]).reshape(-1, shape[1])
        out[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(own)] += own
    return out


def triangle(rows: DataFrame, make: Prepare, columns: int) -> np.ndarray:
    """R of the QR decomposition of the matrix of which ``make`` gives the rows of a batch: tasks reduce their rows to a
    triangle, and triangles are stacked and reduced FAN_IN at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, columns))
        for f in frames:
            if len(f):
                r = np.linalg.qr(np.vstack([r, make(f)]), mode="r")
        if len(r):
            yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "r": [r.ravel()]})

    def join(f: pd.DataFrame) -> pd.DataFrame:
        stack = np.vstack([np.asarray(r).reshape(-1, columns) for r in f.sort_values("task")["r"]])
        return pd.DataFrame({"task": f["task"].head(1), "r": [np.linalg.qr(stack, mode="r").ravel()]})

    kind = "task long, r array<double>"
    parts, most = rows.mapInPandas(run, kind), rows.rdd.getNumPartitions()
    while most > 1:
        parts = parts.groupBy(F.floor(F.col("task") / FAN_IN)).applyInPandas(join, kind).withColumn("task", F.floor(F.col("task") / FAN_IN))
        most = -(-most // FAN_IN)
    found = [np.array(r["r"]).reshape(-1, columns) for r in parts.collect()]
    return np.linalg.qr(np.vstack([np.zeros((0, columns)), *found]), mode="r") if found else np.zeros((0, columns))


def _orthonormal(block: np.ndarray, base: np.ndarray) -> np.ndarray:
    """A base of what ``block`` has besides ``base``; directions that are rounding are left out."""
    size = np.linalg.norm(block, axis=0).max(initial=0.0)
    for _ in range(2):
        block = block - base @ (base.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-12 * max(size, 1e-300)]
    u = u - base @ (base.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def leading_columns(rows: DataFrame, prepare: Prepare, width: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """(right singular vectors as columns, squares of singular values falling, sum of all squares) of the matrix with
    ``width`` columns of which ``prepare`` gives the rows of a batch.

    ``rows`` is read once a step, so it should be cut before. The largest entry of each vector is positive. Rows that the
    space does not reach are never guessed: steps end when the wanted values stand still or the space is whole. A matrix
    without columns has no vectors.
    """
    wanted = min(wanted, width)
    if not wanted:
        return np.zeros((width, 0)), np.zeros(0), 0.0
    size = min(width, max(wanted + SPARE, BLOCK_NUMBERS // max(width, 1)))
    block = np.eye(width) if size == width else np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    base, image, total, last = np.zeros((width, 0)), np.zeros((width, 0)), 0.0, None
    for _ in range(STEPS):

        def both(f: pd.DataFrame, block: np.ndarray = block) -> np.ndarray:
            a = prepare(f)
            squares = np.zeros((1, block.shape[1]))
            squares[0, 0] = (a * a).sum()
            return np.vstack([a.T @ (a @ block), squares])

        product = summed(rows, both, (width + 1, block.shape[1]))
        total, product = float(product[-1, 0]), product[:-1]
        base, image = np.hstack([base, block]), np.hstack([image, product])
        t = base.T @ image
        values = np.sort(np.linalg.eigvalsh((t + t.T) / 2))[::-1][:wanted]
        still = last is not None and len(last) == len(values) and np.abs(values - last).max(initial=0.0) <= TOLERANCE * max(total, 1e-300)
        block = _orthonormal(product, base)[:, : width - base.shape[1]]
        last = values
        if still or not block.shape[1] or not total:
            break
    r = triangle(rows, lambda f: prepare(f) @ base, base.shape[1])
    _, s, turn = np.linalg.svd(r, full_matrices=True)
    s = np.append(s, np.zeros(base.shape[1]))[:wanted]
    u = base @ turn.T[:, :wanted]
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    return u * np.where(sign == 0, 1.0, sign), s * s, total
