import math

import numpy as np
import pytest

from helixframe.llm import whitening


@pytest.mark.parametrize("kind", ["random", "equal", "close", "low rank", "one", "spread", "zero", "two levels"])
def test_leading_equals_a_dense_solver(kind):
    rng = np.random.default_rng(5)
    d = 1 if kind == "one" else 40
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = {
        "random": rng.random(d), "equal": np.full(d, 3.0), "close": 1 + np.arange(d) * 1e-9, "low rank": np.where(np.arange(d) < 5, 2.0 + np.arange(d), 0),
        "one": np.array([7.0]), "spread": 10.0 ** -np.arange(0, d / 4, 0.25), "zero": np.zeros(d), "two levels": np.where(np.arange(d) < 20, 5.0, 1.0),
    }[kind]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, vectors = whitening.leading(a, 16)
    want = np.sort(values)[::-1]
    want = want[want > 1e-10][:16]
    assert len(got) == len(want) and np.allclose(got, want, rtol=1e-9, atol=1e-13)
    assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-13)
    assert len(got) == 0 or np.linalg.norm(a @ vectors - vectors * got, axis=0).max() < 1e-13 * max(values)


def test_inertia_counts():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    diagonal, off = whitening.tridiagonal(a)
    values = np.linalg.eigvalsh(a)
    for shift in np.linspace(-15, 15, 61):
        assert whitening.inertia(diagonal, off, shift) == (values > shift).sum()


def plain(data):
    """vec_id, component -> values, by plain numpy."""
    rows = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in data if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in rows}))
    n, s = len(fit), fit.sum(axis=0)
    c = (fit * n - s) / n
    v = c.T @ c / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(16, (values > 1e-9 * values[0]).sum())
    out = []
    for i, x in rows:
        w = ((np.array(x) * n - s) / n) @ vectors[:, :k] / np.sqrt(values[:k])
        far = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s))
        out += [(i, j + 1, n, far, w[j], values[j] / np.trace(v)) for j in range(k)]
    return out


def run(spark, path, data, kind="float"):
    spark.createDataFrame([(i, v, 1) for i, v in data], f"vec_id long, embedding array<{kind}>, component int").write.parquet(f"{path}/embeddings.parquet")
    return whitening.op13_embedding_whitening(spark, str(path)).collect()


def test_query_equals_numpy(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = [[float(np.float32(c)) for c in v] for v in rng.standard_normal((300, 24)) * np.linspace(3, 0.3, 24)]
    data = list(enumerate(vectors)) + [(1000 + i, vectors[0]) for i in range(150)] + [(5, vectors[7]), (None, vectors[9])]
    data += [(2000, None), (2001, [None] + vectors[0][1:]), (2002, [math.nan] + vectors[0][1:]), (2003, [math.inf] + vectors[0][1:]), (2004, [])]
    got, want = run(spark, tmp_path, data), plain(data)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want) == 452 * 16
    signs = {}
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and abs(g[5] - w[5]) <= 1e-10 * w[5] and g[6] < 1e-10
        if abs(w[4]) > 1e-3:
            sign = signs.setdefault(g[1], math.copysign(1, g[4] * w[4]))
            assert abs(g[4] - sign * w[4]) < 1e-8
    assert len(signs) == 16


def test_few_dimensions_and_few_vectors(spark, tmp_path):
    got = run(spark, tmp_path / "a", [(1, [1.0, 0.0, 2.0]), (2, [2.0, 0.0, 2.0]), (2, [2.0, 0.0, 2.0])])
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9), round(r.explained, 9)) for r in got) == [(1, 1, 2, 64**2, 1, 1), (2, 1, 2, 64**2, 1, 1), (2, 1, 2, 64**2, 1, 1)]
    assert run(spark, tmp_path / "b", [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    assert run(spark, tmp_path / "c", [(1, None)], "double") == []
    assert run(spark, tmp_path / "d", []) == []
    with pytest.raises(ValueError, match="entries"):
        run(spark, tmp_path / "e", [(1, [1.0]), (2, [1.0, 2.0])])


def test_deviation_is_exact():
    x = np.array([[1000001, 999999], [1000123, 1000000]])
    n, sums = 10**9 + 7, [1000000 * (10**9 + 7) + 5, 1000000 * (10**9 + 7) - 3]
    assert whitening.deviation(x[:1], n, sums) == [sum((n * int(a) - b) ** 2 for a, b in zip(x[0], sums))]
    with pytest.raises(OverflowError):
        whitening.deviation(x, n, sums)
