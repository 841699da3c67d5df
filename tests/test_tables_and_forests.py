import numpy as np
import pytest

from helixframe.operators import association, features, modelling, ranking
from helixframe.plans import analyses, plotdata


def test_random_forest_follows_the_target_whatever_the_partitions(spark):
    rng = np.random.default_rng(3)
    y = rng.permutation(60).astype(float)
    genes = {"step": (y > 30) * 1.0 + rng.normal(0, 0.01, 60), "noise": rng.normal(0, 1, 60), "flat": np.ones(60)}
    rows = [(g, f"s{i:02d}", float(v[i]), float(y[i])) for g, v in genes.items() for i in range(60)]
    x = spark.createDataFrame(rows, "gene_id string, sample_id string, value double, y double")
    got = {r.gene_id: r for r in association.trees(x, 20).collect()}
    assert got.keys() == {"step", "noise"}  # a gene without spread has no tree
    assert got["step"].r > 0.6 > got["noise"].r + 0.3
    for r in got.values():
        assert r.p_value == pytest.approx(np.clip(1 / (1 + 10 * r.r), 0.001, 0.99))
    again = {r.gene_id: r for r in association.trees(x.repartition(7, "sample_id"), 20).collect()}
    assert got == again
    both = association.correlations(x, ("pearson", "random_forest"))
    assert {r.coefficient for r in both.filter("method = 'random_forest'").collect()} == {r.r for r in got.values()}


def test_regional_significance_equals_numpy(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(40, 4))
    a[:, 3] += a[:, 0]
    a[:, 2] -= 2 * a[:, 3]
    names = ["UTR5_length", "CAI", "UTR3_GC", "GC3_content"]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "id long, " + ", ".join(f"{n} double" for n in names))
    got = {(r.target, r.feature): r for r in features.regional_significance(df, names, ["GC3_content", "CAI"]).collect()}
    assert got.keys() == {(t, f) for t in ("GC3_content", "CAI") for f in names if f != t}
    for (t, f), r in got.items():
        assert r.region == {"UTR5_length": "UTR5", "UTR3_GC": "UTR3"}.get(f, "CDS")
        assert r.pearson_r == pytest.approx(np.corrcoef(a[:, names.index(f)], a[:, names.index(t)])[0, 1])
        rank = lambda v: v.argsort().argsort()
        assert r.spearman_rho == pytest.approx(np.corrcoef(rank(a[:, names.index(f)]), rank(a[:, names.index(t)]))[0, 1])
    assert got["GC3_content", "UTR3_GC"].is_significant


def test_scatter_matrix_has_whole_samples_only(spark):
    rows = [("b", "s1", 1.0, 9.0), ("b", "s2", 2.0, 8.0), ("b", "s3", 5.0, 7.0), ("a", "s1", 3.0, 9.0), ("a", "s2", None, 8.0), ("a", "s3", 6.0, 7.0), ("c", "s1", 0.0, 9.0)]
    x = spark.createDataFrame(rows, "gene_id string, sample_id string, value double, y double")
    got = plotdata.scatter_matrix(x, spark.createDataFrame([("b",), ("a",)], "gene_id string"))
    assert got.columns == ["sample_id", "a", "b", "y"]
    assert sorted(map(tuple, got.collect())) == [("s1", 3.0, 1.0, 9.0), ("s3", 6.0, 5.0, 7.0)]


def test_panel_gains_add_up(spark):
    rows = [("x", 3, 0.2, 1.0), ("x", 5, 0.5, 0.8), ("x", 10, 0.4, 0.9), ("z", 3, -0.1, 2.0)]
    got = {(r.panel_type, r.size): r for r in ranking.panel_gains(spark.createDataFrame(rows, "panel_type string, size int, r2_loocv double, rmse_loocv double")).collect()}
    assert {k: round(r.gain, 9) for k, r in got.items()} == {("x", 3): 0.2, ("x", 5): 0.3, ("x", 10): -0.1, ("z", 3): -0.1}


def test_one_fit_serves_the_model_queries(spark, monkeypatch):
    calls, plain = [], analyses.L.fit_models
    monkeypatch.setattr(analyses.L, "fit_models", lambda *a, **k: calls.append(a) or plain(*a, trees=3, folds=2, **k))
    monkeypatch.setattr(analyses, "_fits", {})
    sf = "/root/testdata/sf0.001"
    metrics = {r.model_type: r for r in analyses.ridge_gbt_model(spark, sf).collect()}
    predicted = analyses.model_predictions(spark, sf).toPandas()
    assert len(calls) == 1 and metrics.keys() == {"ridge", "gbr", "ensemble"}
    assert np.allclose(predicted["ensemble"], (predicted["ridge"] + predicted["gbr"]) / 2, atol=2e-6)
    assert np.allclose(predicted["error"], predicted["ensemble"] - predicted["GC3_content"], atol=2e-6)
    assert analyses.model_importance(spark, sf).count() == len(analyses.OTHERS) and len(calls) == 1


def test_grids_start_from_selected_medians(spark, monkeypatch):
    def whole(*_):
        raise AssertionError("a median's buffer holds all values in one task")

    monkeypatch.setattr(modelling.F, "median", whole)
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=501), [None if i % 7 == 0 else float(i % 50) for i in range(501)]
    df = spark.createDataFrame([(float(x), y, None) for x, y in zip(a, b)], "a double, b double, c double")
    row = modelling._at_medians(df, ["a", "b", "c"]).collect()
    left = [y for y in b if y is not None]
    assert len(row) == 1 and row[0].a == np.median(a) and row[0].b == np.median(left) and row[0].c is None
    assert (row[0]._lo_a, row[0]._hi_a, row[0]._lo_b, row[0]._hi_b) == (a.min(), a.max(), min(left), max(left))
    assert modelling._at_medians(df.limit(0), ["a"]).first().a is None
