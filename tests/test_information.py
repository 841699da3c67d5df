"""Mutual information over cells against all pairs of rows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.functions import information
from helixframe.functions.neighbours import FAR, nearest_others
from helixframe.functions.special import digamma


def all_pairs(a, b, k=3):
    """The estimate from all pairs of integer coordinates, a block of rows at a time."""
    n, terms = len(a), 0.0
    for i in range(0, n, 500):
        dx, dy = np.abs(a[i : i + 500, None] - a), np.abs(b[i : i + 500, None] - b)
        d = np.maximum(dx, dy)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = FAR
        eps = np.maximum(np.partition(d, k - 1, axis=1)[:, k - 1 : k], 1)
        terms += (digamma((dx < eps).sum(1)) + digamma((dy < eps).sum(1))).sum()
    return max(0.0, float(digamma(np.array([float(k)]))[0] + digamma(np.array([float(n)]))[0] - terms / n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-40, 40), st.integers(-3, 3)), max_size=120), st.integers(1, 4))
def test_nearest_others_equal_all_pairs(points, k):
    x, y = (np.array([p[i] for p in points], np.int64) for i in range(2))
    d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
    d[np.diag_indices(len(x))] = FAR
    want = np.sort(np.column_stack([d, np.full((len(x), k), FAR)]), axis=1)[:, :k]
    assert np.array_equal(nearest_others(x, y, k)[0], want)


def table(spark, groups):
    rows = [(i, g, float(a), float(b)) for g, (x, y) in groups.items() for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, g string, x double, y double")


def check(spark, df):
    got = {r.g: r.mi for r in information.mutual_information(df, "g", "x", "y", "id").collect()}
    points = information._integers(df, "g", "x", "y", "id").toPandas()
    for g, f in points.groupby("g"):
        if len(f) > 3:
            assert got[g] == pytest.approx(all_pairs(f["a"].to_numpy(), f["b"].to_numpy()), abs=1e-9), g
        else:
            assert got[g] == 0
    return got


def test_equals_all_pairs_at_20000_rows(spark, monkeypatch):
    monkeypatch.setattr(information, "CELL", 700)
    rng = np.random.default_rng(0)
    n = 20_000
    x = rng.normal(size=n)
    got = check(spark, table(spark, {"dense": (x, x + rng.normal(size=n))}))
    assert got["dense"] == pytest.approx(0.5 * np.log(2), abs=0.03)


def test_equals_all_pairs_on_hard_shapes(spark, monkeypatch):
    monkeypatch.setattr(information, "CELL", 60)
    rng = np.random.default_rng(1)
    n = 1500
    cauchy, whole = rng.standard_cauchy(n), rng.integers(0, 4, n)
    groups = {
        "heavy tails": (cauchy, cauchy + rng.standard_cauchy(n)), "ties": (whole, whole + rng.integers(0, 2, n)), "a third at one place": (np.where(rng.random(n) < 0.35, 0, rng.normal(size=n)), np.where(rng.random(n) < 0.35, 0, rng.normal(size=n))),
        "flat": (np.ones(200), rng.normal(size=200)), "line": (np.arange(400.0), np.arange(400.0) * 2), "few": ([1.0, 2.0, 3.0], [1.0, 2.0, 4.0]), "clusters": (np.repeat(rng.normal(0, 100, 15), 100) + rng.normal(0, 1e-3, n), rng.normal(size=n)),
    }
    df = table(spark, groups).union(spark.createDataFrame([(10**6, "ties", None, 1.0), (10**6 + 1, "ties", 1.0, float("nan"))], "id long, g string, x double, y double"))
    got = check(spark, df)
    assert set(got) == set(groups) and got["line"] > 3 and got["flat"] < 0.2
    assert information.mutual_information(df.limit(0), "g", "x", "y", "id").count() == 0


def test_equal_values_do_not_make_points_ask_everywhere(spark, monkeypatch):
    """Strips through equal values, which only their noise tells apart, had every point ask all strips."""
    monkeypatch.setattr(information, "CELL", 60)
    rng = np.random.default_rng(3)
    n = 6000
    y, few = rng.normal(size=n), rng.integers(0, 3, n)
    groups = {"one value": (np.full(n, 60.0), y), "few values": (y, few), "mostly zero": (np.where(rng.random(n) < 0.7, 0.0, rng.random(n) + 1), y)}
    df = table(spark, groups)
    points = information._integers(df, "g", "x", "y", "id").cache()
    cells = information._partition(points, points.groupBy("g").count().withColumnRenamed("count", "n"), "string", 3)
    for g, f in points.toPandas().groupby("g"):
        a, b = f["a"].to_numpy(), f["b"].to_numpy()
        cell = cells.of(f["g"], a, b)
        assert np.bincount(cell).max() < 4 * 60
        d = nearest_others(a, b, 3)[0][:, 2]
        point, _ = cells.touched(g, a, b, d)
        assert len(point) < 1.6 * n, g
        # every other point within the square lies in a cell that is asked
        own = np.flatnonzero(rng.random(n) < 0.02)
        point, asked = cells.touched(g, a[own], b[own], d[own])
        for i, o in enumerate(own):
            near = (np.abs(a - a[o]) <= d[o]) & (np.abs(b - b[o]) <= d[o])
            assert set(cell[near]) <= set(asked[point == i])
    check(spark, df.filter("id < 2500"))


def test_letters_of_a_text_are_taken_once(spark):
    from helixframe.sources import tables

    plan = tables.sequences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(upper(text") == 1


def test_in_memory_is_the_same_estimate():
    rng = np.random.default_rng(2)
    x = rng.normal(size=900)
    y = np.round(x + rng.normal(size=900), 1)
    noise = np.random.default_rng(42).integers(-information.NOISE, information.NOISE + 1, (2, 900))
    a, b = information.coordinates(x, noise[0]), information.coordinates(y, noise[1])
    assert information.ksg(x, y) == pytest.approx(all_pairs(a, b), abs=1e-12)
    assert information.ksg(x[:3], y[:3]) == 0
