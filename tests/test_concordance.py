"""Kendall's tau by inversion counts against all pairs."""

import tracemalloc

import numpy as np
import pytest

from helixframe.functions import special
from helixframe.functions.concordance import concordance, inversions
from helixframe.operators import association


def pairs(x, y):
    """S, tau-b and z by the matrix of signs."""
    n = len(x)
    s = int((np.sign(x[:, None] - x) * np.sign(y[:, None] - y)).sum() / 2)
    tx, ty = (np.unique(a, return_counts=True)[1].astype(float) for a in (x, y))
    full = n * (n - 1)
    nx, ny = full - (tx * (tx - 1)).sum(), full - (ty * (ty - 1)).sum()
    var = (full * (2 * n + 5) - sum((t * (t - 1) * (2 * t + 5)).sum() for t in (tx, ty))) / 18
    if n > 1:
        var += (tx * (tx - 1)).sum() * (ty * (ty - 1)).sum() / (2 * full)
    if n > 2:
        var += (tx * (tx - 1) * (tx - 2)).sum() * (ty * (ty - 1) * (ty - 2)).sum() / (9 * full * (n - 2))
    return s, 2 * s / np.sqrt(nx * ny) if nx and ny else 0.0, s / np.sqrt(var) if var > 1e-12 else 0.0


def test_equals_all_pairs_with_ties():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 2, 3, 7, 50, 200, 1, 0, 33]
    for levels in (1, 2, 5, 1000):
        xs = [rng.integers(0, levels, n).astype(float) for n in sizes]
        ys = [np.where(rng.random(n) < 0.5, x, rng.integers(0, levels, n)).astype(float) for x, n in zip(xs, sizes)]
        c = concordance(np.concatenate(xs), np.concatenate(ys), np.repeat(np.arange(len(sizes)), sizes), len(sizes))
        for k, (x, y) in enumerate(zip(xs, ys)):
            s, tau, z = pairs(x, y)
            assert (c.n[k], c.s[k]) == (len(x), s)
            assert c.tau_b()[k] == pytest.approx(tau, abs=1e-12) and c.z()[k] == pytest.approx(z, abs=1e-9)


def test_inversions_per_group():
    rng = np.random.default_rng(1)
    keys, group = rng.integers(0, 9, 60), np.repeat([0, 1, 3], 20)
    want = [sum(int(a > b) for i, a in enumerate(keys[group == g]) for b in keys[group == g][i + 1 :]) for g in range(4)]
    assert inversions(keys, group, 4).tolist() == want
    assert inversions(keys[:0], group[:0], 2).tolist() == [0, 0]


def test_twenty_thousand_samples_take_linear_memory():
    rng = np.random.default_rng(2)
    n = 20_000
    x = rng.integers(0, 500, n).astype(float)
    y = np.round(x / 50 + rng.normal(0, 5, n), 1)
    tracemalloc.start()
    c = concordance(x, y, np.zeros(n, np.int64), 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * n  # bytes; a matrix of signs would have 8 n a value
    s = 0
    for i in range(0, n, 500):  # all pairs, a block at a time
        s += int((np.sign(x[i : i + 500, None] - x) * np.sign(y[i : i + 500, None] - y)).sum())
    assert c.s[0] == s // 2


def test_operator_with_p(spark):
    rng = np.random.default_rng(3)
    rows, data = [], {}
    for g, n in (("small", 12), ("ties", 40), ("long", 700), ("flat", 20), ("one", 1)):
        x = rng.normal(size=n) if g != "ties" else rng.integers(0, 4, n).astype(float)
        x = np.zeros(n) if g == "flat" else x
        y = x + rng.normal(size=n)
        data[g] = (x, y)
        rows += [(g, f"s{j:04d}", float(a), float(b)) for j, (a, b) in enumerate(zip(x, y))]
    rows += [("small", "s9998", None, 1.0), ("small", "s9999", float("nan"), 1.0)]
    got = {r.gene_id: r for r in association.kendall(spark.createDataFrame(rows, "gene_id string, sample_id string, value double, y double")).collect()}
    assert len(got) == 5
    for g, (x, y) in data.items():
        s, tau, z = pairs(x, y)
        assert got[g].r == pytest.approx(tau, abs=1e-12) and got[g].n == len(x)
        exact = len(x) <= association.EXACT_KENDALL and len(set(x)) == len(x)
        assert got[g].p_value == pytest.approx(special.kendall_exact(s, len(x)) if exact else float(special.normal_two_sided(z)), rel=1e-9, abs=1e-300)


def test_resamples_do_not_depend_on_the_way(monkeypatch):
    rng = np.random.default_rng(4)
    v, y = rng.integers(0, 30, 80).astype(float), rng.normal(size=80)
    w = rng.multinomial(80, np.full(80, 1 / 80), 100).astype(float)
    by_matrix = association._resampled("kendall", v, y, w)
    monkeypatch.setattr(association, "MATRIX_KENDALL", 10)
    assert np.allclose(association._resampled("kendall", v, y, w), by_matrix, atol=1e-12)
