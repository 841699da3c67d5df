"""Neighbours and silhouettes by metric partitioning against all pairs."""

import numpy as np
import pytest

from helixframe.operators import metric, validation


def frame(spark, x, labels, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in p], int(c)) for i, p, c in zip(ids, x, labels)], "vec_id long, embedding array<double>, label int")


def all_pairs(x):
    return np.sqrt(((x[:, None] - x) ** 2).sum(-1))


def shares(x, labels, k):
    d = np.round(all_pairs(x), 6)
    out = []
    for i in range(len(x)):
        near = [j for j in sorted(range(len(x)), key=lambda j: (d[i, j], j)) if j != i][:k]
        out.append(np.mean([labels[j] == labels[i] for j in near]) if near else None)
    return out


def silhouettes(x, labels):
    d, out = all_pairs(x), []
    for i in range(len(x)):
        means = {c: d[i, labels == c].sum() / max((labels == c).sum() - (c == labels[i]), 1) for c in np.unique(labels)}
        a, b = means.pop(labels[i]), min(means.values(), default=0)
        out.append((b - a) / max(a, b) if (labels == labels[i]).sum() > 1 and means and max(a, b) > 0 else 0.0)
    return np.array(out)


def cases():
    rng = np.random.default_rng(0)
    clusters = np.repeat(rng.normal(0, 20, (8, 3)), 40, axis=0) + rng.normal(size=(320, 3))
    copies = rng.normal(size=(240, 2))
    copies[::3] = copies[0]  # a third of all rows at one place
    return {
        "clusters": (clusters, np.repeat(np.arange(8), 40)), "mixed": (clusters, rng.integers(0, 3, 320)), "copies": (copies, rng.integers(0, 4, 240)), "grid": (np.array([(i, j) for i in range(15) for j in range(15)], float), np.arange(225) % 2),
        "alone": (rng.normal(size=(5, 2)), np.array([0, 1, 2, 2, 2])), "one": (np.zeros((1, 2)), np.array([3])), "one label": (rng.normal(size=(30, 2)), np.zeros(30, int)),
    }


@pytest.mark.parametrize("name", list(cases()))
def test_equal_all_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(metric, "BLOCK", 50)
    x, labels = cases()[name]
    df = frame(spark, x, labels)
    got = {r.vec_id: r.share for r in metric.label_shares(df, 7).collect()}
    assert [got.get(i) for i in range(len(x))] == pytest.approx(shares(x, labels, 7), abs=1e-12)
    rows = metric.silhouettes(df).collect()
    assert sum(r.copies for r in rows) == len(x)
    by = {(tuple(r.embedding), r.label): r.s for r in rows}
    assert np.allclose([by[tuple(p), c] for p, c in zip(x, labels)], silhouettes(x, labels), atol=1e-9)
    assert validation.silhouette(df).first().silhouette == pytest.approx(silhouettes(x, labels).mean(), abs=1e-9)


def test_far_fewer_distances_than_pairs(spark, monkeypatch):
    monkeypatch.setattr(metric, "BLOCK", 100)
    rng = np.random.default_rng(1)
    n = 4000
    x = np.repeat(rng.normal(0, 50, (40, 4)), 100, axis=0) + rng.normal(size=(n, 4))
    df = frame(spark, x, np.repeat(np.arange(40), 100))
    assert metric.neighbours(df, 16).agg({"seen": "sum"}).first()[0] < 0.1 * n * n
    assert metric.silhouettes(df).agg({"seen": "sum"}).first()[0] < 0.15 * n * n


def test_empty(spark):
    df = frame(spark, [], [])
    assert metric.label_shares(df, 3).count() == 0 and metric.silhouettes(df).count() == 0
    assert validation.silhouette(df).first().silhouette is None


@pytest.mark.parametrize("of", [lambda df: metric.label_shares(df, 5), metric.silhouettes], ids=["neighbours", "silhouettes"])
def test_a_kept_table_has_a_row_a_point_where_bounds_rule_out_nothing(spark, monkeypatch, of):
    monkeypatch.setattr(metric, "BLOCK", 20)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    sizes, cut = [], metric.cut
    monkeypatch.setattr(metric, "cut", lambda df: sizes.append((kept := cut(df)).count()) or kept)
    assert of(frame(spark, x, rng.integers(0, 6, 600))).count() == 600
    assert sizes and max(sizes) <= 600
