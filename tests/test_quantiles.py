"""Quantiles by distributed selection against numpy, and without a percentile in any plan."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helixframe.functions import quantiles as Q
from helixframe.operators import descriptive, features, modelling, sequence

AT = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]


def frame(spark, groups):
    return spark.createDataFrame([(g, float(v) if v is not None else None) for g, vs in groups.items() for v in vs], "g string, x double")


def test_equal_numpy(spark):
    rng = np.random.default_rng(0)
    groups = {
        "normal": rng.normal(size=3000), "tails": rng.standard_cauchy(3000) * 1e6, "tiny": rng.normal(size=500) * 1e-14, "near one": 1 + rng.random(3000) * 1e-9, "hot": np.where(rng.random(3000) < 0.4, 7.0, rng.random(3000)),
        "whole": rng.integers(-5, 5, 999), "one": [3.5], "two": [-1.0, 2.0], "huge": [-1.7e308, 1e300, 1.7e308, 5e299, 2e305], "infinite": [-np.inf, 1.0, np.inf, np.inf, 2.0],
    }
    df = frame(spark, groups | {"null": [None, None]}).union(spark.createDataFrame([("one", float("nan")), ("two", None)], "g string, x double"))
    got = {r.g: r.q for r in Q.quantiles(df, "x", AT, "g").collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        v = np.sort(np.asarray(v, float))
        for p, q in zip(AT, got[g]):
            r = p * (len(v) - 1)
            lo, hi = v[int(np.floor(r))], v[int(np.ceil(r))]
            want = lo if lo == hi else (1 - (r - np.floor(r))) * lo + (r - np.floor(r)) * hi
            assert q == want or abs(q - want) <= 1e-12 * abs(want), (g, p)
    whole = Q.quantiles(df.filter("g = 'normal'"), "x", [0.25, 0.75], out="r").collect()
    assert np.allclose(whole[0].r, np.quantile(groups["normal"], [0.25, 0.75])) and len(whole) == 1
    assert Q.quantiles(df.limit(0), "x", [0.5]).collect()[0].q is None and Q.quantiles(df.limit(0), "x", [0.5], "g").collect() == []


def test_null_and_several_groups(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 1, 3.0), ("a", None, 5.0), ("a", 2, 9.0)], "g string, h int, x double")
    got = {(r.g, r.h): r.q for r in Q.quantiles(df, "x", [0.5], "g", "h").collect()}
    assert got == {(None, 1): [2.0], ("a", None): [5.0], ("a", 2): [9.0]}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=1, max_size=40), st.floats(0, 1))
def test_order_statistics_of_any_doubles(spark, values, p):
    got = Q.quantiles(frame(spark, {"a": values}), "x", [p]).first().q[0]
    v, r = sorted(values), p * (len(values) - 1)
    assert v[int(np.floor(r))] <= got <= v[int(np.ceil(r))]


def test_no_percentile_in_the_plans(spark, monkeypatch):
    rng = np.random.default_rng(1)
    expr = spark.createDataFrame([(f"g{i}", f"s{j}", float(rng.gamma(2, 5))) for i in range(20) for j in range(6)], "gene_id string, sample_id string, value double")
    rows = spark.createDataFrame([(i, float(a), float(b), i % 2) for i, (a, b) in enumerate(rng.random((60, 2)))], "id long, a double, b double, g int")
    plans = []
    checkpoint = type(rows).checkpoint
    monkeypatch.setattr(type(rows), "checkpoint", lambda self, *a, **k: plans.append(self._jdf.queryExecution().toString()) or checkpoint(self, *a, **k))
    made = [descriptive.consistent_genes(expr), sequence.stability_category(rows, "a"), modelling.clean_features(rows, ["a", "b"]), features.group_comparison(rows, ["a", "b"], "g")]
    text = "".join(plans) + "".join(df._jdf.queryExecution().toString() for df in made)
    assert "percentile(" not in text and "median(" not in text
    holes = spark.createDataFrame([(1, 1.0, None), (2, float("inf"), None), (3, 5.0, None)], "id long, a double, b double")
    assert sorted((r.id, r.a, r.b) for r in modelling.clean_features(holes, ["a", "b"]).collect()) == [(1, 1.0, None), (2, 3.0, None), (3, 5.0, None)]
