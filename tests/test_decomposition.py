"""Leading components without a Gram matrix against numpy's SVD."""

import numpy as np
import pytest

from helixframe.functions import decomposition as D


def frame(spark, a, parts=5):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(a)], "i long, values array<double>").repartition(parts, "i").checkpoint()


def stacked():
    """By value, as tasks cannot import this file."""
    return lambda f: np.stack([np.asarray(v, float) for v in f["values"]])


stack = stacked()


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('checkpoints')}")


@pytest.mark.parametrize("case", ["noise", "batches", "low rank", "wide", "zero"])
def test_equal_numpy(spark, monkeypatch, case):
    rng = np.random.default_rng(0)
    m, n, k = (12, 90, 4) if case == "wide" else (300, 60, 4)
    a = rng.normal(size=(m, n))
    if case == "batches":
        a += 3 * np.outer(rng.normal(size=m), np.arange(n) % 3 - 1)
    if case == "low rank":
        a = rng.normal(size=(m, 3)) @ rng.normal(size=(3, n))
    if case == "zero":
        a[:] = 0
    monkeypatch.setattr(D, "BLOCK_NUMBERS", 14 * n)  # a block is far narrower than the matrix
    sizes = []
    summed = D.summed
    monkeypatch.setattr(D, "summed", lambda r, f, shape: sizes.append(shape) or summed(r, f, shape))
    u, w, total = D.leading_columns(frame(spark, a), stack, n, k)
    _, s, v = np.linalg.svd(a, full_matrices=False)
    assert all(b <= 14 for _, b in sizes)
    assert total == pytest.approx((a * a).sum()) and np.allclose(w, s[:k] ** 2, rtol=1e-9, atol=1e-9)
    assert np.allclose(u.T @ u, np.eye(k), atol=1e-10)
    real = s[:k] > 1e-9
    assert np.allclose(np.abs((u * v[:k].T).sum(0))[real], 1, atol=1e-7)
    assert len(sizes) <= (3 if case == "low rank" else 12)


def test_one_step_where_all_columns_fit(spark):
    a = np.random.default_rng(1).normal(size=(50, 8))
    u, w, _ = D.leading_columns(frame(spark, a), stack, 8, 8)
    assert np.allclose(w, np.linalg.svd(a)[1] ** 2) and np.allclose(u @ np.diag(w) @ u.T, a.T @ a)


def test_tree_of_triangles_and_sums(spark, monkeypatch):
    monkeypatch.setattr(D, "FAN_IN", 2)
    monkeypatch.setattr(D, "CHUNK", 3)
    a = np.random.default_rng(2).normal(size=(200, 7))
    df = frame(spark, a, 9)
    r = D.triangle(df, stack, 7)
    assert r.shape == (7, 7) and np.allclose(r.T @ r, a.T @ a)
    assert np.allclose(D.summed(df, lambda f: stack(f).T @ stack(f), (7, 7)), a.T @ a)
    assert D.triangle(df.limit(0), stack, 7).shape == (0, 7) and not D.summed(df.limit(0), stack, (4, 7)).any()
