"""Operators without SQL against plain numpy or their defining property."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.config import Layout, patterns
from helixframe.control import step
from helixframe.functions.columns import benjamini_hochberg, spread_position, spread_rank
from helixframe.operators import association, batch, counts, features, modelling, ranking, validation
from helixframe.sources import matrix


def expression(spark, genes=30, samples=24, seed=0, shift=0.0):
    rng = np.random.default_rng(seed)
    v = rng.gamma(3, 10, (genes, samples))
    v[:, ::2] *= 1 + shift
    rows = [(f"g{i:02d}", f"s{j:02d}", ("A", "B")[j % 2], float(v[i, j])) for i in range(genes) for j in range(samples)]
    return spark.createDataFrame(rows, "gene_id string, sample_id string, platform string, value double"), v


def with_target(spark, expr, v, seed=1):
    y = v[0] * 2 + np.random.default_rng(seed).normal(0, 5, v.shape[1])
    t = spark.createDataFrame([(f"s{j:02d}", float(y[j])) for j in range(len(y))], "sample_id string, y double")
    return expr.join(F.broadcast(t), "sample_id"), y


def test_ranks_and_adjustment_range_by_range(spark):
    rng = np.random.default_rng(2)
    x = [float(a) for a in rng.integers(0, 40, 500)] + [None]
    df = spark.createDataFrame(list(enumerate(x)), "id long, x double")
    have = {r.id: r.r for r in spread_rank(df, "x", "r").collect()}
    v = np.array(x[:-1])
    for i, a in enumerate(v):
        assert have[i] == (v < a).sum() + ((v == a).sum() + 1) / 2
    order = sorted(range(500), key=lambda i: (v[i], i))
    place = {r.id: r.k for r in spread_position(df.filter("x is not null"), "x", "id", "k").collect()}
    assert [place[i] for i in order] == list(range(1, 501))
    p = rng.random(300) ** 2
    adjusted = {r.id: r.q for r in benjamini_hochberg(spark.createDataFrame([(i, float(a)) for i, a in enumerate(p)], "id long, p double"), "p", "q").collect()}
    srt, want = np.argsort(p), np.empty(300)
    want[srt] = np.minimum(1, np.minimum.accumulate((p[srt] * 300 / np.arange(1, 301))[::-1])[::-1])
    assert np.allclose([adjusted[i] for i in range(300)], want)
    # a usual p is one row on its way, and null stays null
    usual = spark.createDataFrame([(i, 1.0 if i % 3 else i / 9000) for i in range(300)] + [(300, None)], "id long, p double")
    got = {r.id: r.q for r in benjamini_hochberg(usual, "p", "q").collect()}
    assert all(got[i] == 1.0 for i in range(300) if i % 3) and got[300] is None
    small = [min(1.0, min(300 * j / 9000 / (j // 3 + 1) for j in range(i, 300, 3))) for i in range(0, 300, 3)]
    assert np.allclose([got[i] for i in range(0, 300, 3)], small)


def test_combat_seq_takes_platform_rates_away(spark):
    rng = np.random.default_rng(3)
    mu = rng.uniform(20, 200, (40, 1)) * np.where(np.arange(24) % 2 == 0, 1.0, 2.0)
    y = rng.negative_binomial(5, 5 / (5 + mu))
    y[0] = 0  # a gene that is zero throughout stays
    rows = [(f"g{i:02d}", f"s{j:02d}", ("A", "B")[j % 2], float(y[i, j])) for i in range(40) for j in range(24)]
    out = counts.combat_seq(spark.createDataFrame(rows, "gene_id string, sample_id string, platform string, value double"))
    by = {(r.gene_id, r.platform): r.m for r in out.groupBy("gene_id", "platform").agg(F.avg("value").alias("m")).collect()}
    ratio = [by[f"g{i:02d}", "B"] / by[f"g{i:02d}", "A"] for i in range(1, 40)]
    assert abs(math.log(np.median(ratio)) - math.log(np.median(y[1:, 1::2].sum() / y[1:, ::2].sum()))) < 0.3
    assert by["g00", "A"] == by["g00", "B"] == 0 and out.count() == 960
    mu_, phi = np.array([[7.0]]), np.array([[0.4]])
    for k in range(12):  # the quantile function inverts the distribution function
        assert counts.quantile(counts.cdf(np.array([[float(k)]]), mu_, phi) - 1e-12, mu_, phi)[0, 0] == k


def test_combat_keeps_the_covariate_and_drops_the_platform(spark):
    expr, v = expression(spark, shift=0.8)
    c = np.arange(24.0)
    own = expr.join(F.broadcast(spark.createDataFrame([(f"s{j:02d}", float(c[j])) for j in range(24)], "sample_id string, c double")), "sample_id")
    own = own.withColumn("value", F.col("value") + 5 * F.col("c"))
    fixed = batch.combat(own, "c")
    m = fixed.groupBy("gene_id", "platform").agg(F.avg("value").alias("m")).groupBy("gene_id").pivot("platform").agg(F.first("m")).toPandas()
    raw = own.groupBy("gene_id", "platform").agg(F.avg("value").alias("m")).groupBy("gene_id").pivot("platform").agg(F.first("m")).toPandas()
    assert (m.A - m.B - (c[::2].mean() - c[1::2].mean()) * 5).abs().mean() < 0.5 * (raw.A - raw.B).abs().mean()
    slope = fixed.join(own.select("sample_id", "c").distinct(), "sample_id").groupBy("gene_id").agg(F.regr_slope("value", "c").alias("b")).toPandas().b
    assert abs(slope.mean() - 5) < 0.6


def test_sample_space_against_numpy(spark):
    expr, v = expression(spark, shift=0.5)
    centred = v - v.mean(1, keepdims=True)
    u, s, _ = np.linalg.svd(centred.T, full_matrices=False)
    have = validation.sample_pca(matrix.to_vectors(expr), 24, 2)
    assert np.allclose(np.abs(have), np.abs(u[:, :2] * s[:2]), atol=1e-6)
    rebuilt = validation.remove_unwanted(expr, 10, alpha=0.0)  # nothing goes: the first ten components
    want = v.mean(1, keepdims=True) + centred @ u[:, :10] @ u[:, :10].T
    got = np.stack([r["values"] for r in matrix.to_vectors(rebuilt).orderBy("gene_id").collect()])
    assert np.allclose(got, want, atol=1e-6)
    report = {r.stage: r for r in validation.validate_correction(expr, batch.combat(expr), 5, 5).collect()}
    assert report["after"].silhouette < report["before"].silhouette and report["after"].ks_share <= report["before"].ks_share
    row = validation.detect_batch_effect(expr).first()
    assert row.n_platforms == 2 and validation.needs_correction(validation.detect_batch_effect(expr)) == (row.pct_affected > 20 or abs(row.silhouette) > 0.1)


def test_components_at_each_stage(spark):
    expr, v = expression(spark)
    stages = {"raw": expr, "filtered": expr.filter("gene_id < 'g10'"), "none": expr.filter("value < 0"), "corrected": batch.combat(expr)}
    rows = {}
    for r in validation.stage_pca(stages).collect():
        rows.setdefault(r.stage, []).append(r)
    assert {s: len(r) for s, r in rows.items()} == {"raw": 24, "filtered": 24, "corrected": 24}
    for stage, own in (("raw", v), ("filtered", v[:10])):
        c = own - own.mean(1, keepdims=True)
        _, s, u = np.linalg.svd(c, full_matrices=False)
        got = np.array([[r.pc1, r.pc2] for r in sorted(rows[stage], key=lambda r: r.sample_id)])
        assert np.allclose(np.abs(got), np.abs(u[:2].T * s[:2]), atol=1e-6)
        assert rows[stage][0].explained1 == pytest.approx(s[0] ** 2 / (s**2).sum())


def test_bootstrap_against_resampled_numpy(spark):
    expr, v = expression(spark, 6)
    x, y = with_target(spark, expr, v)
    w = np.random.default_rng(42).multinomial(24, np.full(24, 1 / 24), 100)
    out = {(r.gene_id, r.method): r for r in association.bootstrap(x, 100, 2, methods=("pearson", "spearman", "kendall", "regression")).collect()}
    rank = lambda a: np.array([(a < b).sum() + ((a == b).sum() + 1) / 2 for b in a])
    for g in (0, 3):
        r, rho, slope = [], [], []
        for row in w:
            i = np.repeat(np.arange(24), row)
            a, b = v[g][i], y[i]
            r.append(np.corrcoef(a, b)[0, 1])
            rho.append(np.corrcoef(rank(a), rank(b))[0, 1])
            slope.append(np.cov(a, b)[0, 1] / a.var(ddof=1))
        for m, have in (("pearson", r), ("spearman", rho), ("regression", slope)):
            assert out[f"g{g:02d}", m].mean_boot == pytest.approx(np.mean(have), abs=1e-9)
            assert out[f"g{g:02d}", m].ci_lower == pytest.approx(np.quantile(have, 0.025), abs=1e-9)
    assert out["g00", "pearson"].rank_stability_perc > 99
    one = association.gene_regression(x, x.select("gene_id").distinct()).collect()
    with pytest.raises(ValueError, match="more than 3 genes"):
        association.gene_regression(x, x.select("gene_id").distinct(), most=3)
    want = np.linalg.lstsq(np.column_stack([np.ones(24), v.T]), y, rcond=None)[0][1:]
    assert {r.gene_id: round(r.coefficient, 6) for r in one} == {f"g{i:02d}": round(float(b), 6) for i, b in enumerate(want)}


def test_selection_and_models(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(400, 4))
    y = 3 * a[:, 0] - 2 * a[:, 2] + rng.normal(0, 0.5, 400)
    df = spark.createDataFrame([(i, *map(float, a[i]), 1.0, float(y[i])) for i in range(400)], "id long, a double, b double, c double, d double, flat double, y double")
    names = ["a", "b", "c", "d", "flat"]
    for method in ("statistical", "rfe", "lasso"):
        rows = modelling.select_features(df, names, "y", "id", method).collect()
        assert [r.feature for r in rows[:2]] == ["a", "c"] and rows[0].normalized_importance == 1
    g = modelling.gram(df, names[:4], "y", "id").sum(0)
    z = (a - a.mean(0)) / a.std(0)
    assert np.allclose(modelling._ridge(g), np.linalg.solve(z.T @ z + np.eye(4), z.T @ (y - y.mean())), atol=1e-8)
    fitted = modelling.fit_models(df, names, "y", trees=5, folds=2)
    metrics = {r.model_type: r for r in fitted.metrics.collect()}
    assert metrics["ridge"].test_r2 > 0.95 and metrics["ridge"].cv_r2_mean > 0.95 and metrics["ridge"].n_train + metrics["ridge"].n_test == 400
    assert fitted.importance().first().feature == "a"
    predicted = fitted.predict(df)
    assert predicted.filter(F.abs(F.col("ensemble") - (F.col("ridge") + F.col("gbr")) / 2) > 1e-9).count() == 0
    sweep = {r.feature: r for r in modelling.optimisation_sweep(fitted, df).collect()}
    assert sweep["a"].least_at < 0 < sweep["a"].most_at and sweep["c"].least_at > 0 > sweep["c"].most_at
    assert modelling.contour(fitted, df, "a", "c", 6).count() == 36


def test_information_panels_and_comparison(spark):
    expr, v = expression(spark, 8)
    x, y = with_target(spark, expr, v)
    cand = spark.createDataFrame([(f"g{i:02d}", 1.0 / (i + 1), (-1.0) ** i * (8 - i) / 8) for i in range(8)], "gene_id string, score double, correlation double")
    rows = {(r.panel_type, r["size"]): r for r in ranking.panels(matrix.to_vectors(expr), cand, list(y), (2, 3)).collect()}
    assert rows["max_score", 3].genes == rows["max_correlation", 3].genes == ["g00", "g01", "g02"]
    assert rows["minimal_redundancy", 2].genes[0] == "g00"
    compared = ranking.compare_methods(association.correlations(x, ("pearson", "spearman")), x, 3).collect()
    assert {r.method for r in compared} == {"pearson", "spearman"} and all(0 <= r.overall_score <= 1 for r in compared)
    rng = np.random.default_rng(1)
    pairs = [(i, "f", float(a), float(a + e)) for i, (a, e) in enumerate(zip(rng.normal(size=300), rng.normal(size=300), strict=True))]
    mi = features.mutual_information(spark.createDataFrame(pairs, "id long, g string, x double, y double"), "g", "x", "y", "id").first().mi
    assert mi == pytest.approx(0.5 * math.log(2), abs=0.15)


def test_design_texts(spark):
    prof = [("UTR5_length", "UTR5", 50.0, 90.9, 60.0), ("CAI", "CDS", 0.6, 0.8, 0.71), ("UTR3_GC", "UTR3", 40.0, 45.25, 44.0)]
    df = spark.createDataFrame(prof, "feature string, region string, balanced_range_lo double, balanced_range_hi double, balanced_profile_mean double")
    out = {}
    for r in features.recommendations(df).orderBy("section", "position").collect():
        out.setdefault(r.section, []).append(r.text)
    assert out["UTR5"] == ["Keep 5' UTR length between 50 and 90 nucleotides", features.FIXED_TEXTS["UTR5"]]
    assert out["CDS"] == ["Target a Codon Adaptation Index (CAI) of approximately 0.71"] and len(out["general"]) == 3
    assert out["priority"][0] == features.PRIORITY_TEXT and len(out["priority"]) == 5
    assert features.templates("M" * 30)["CDS_optimized"].startswith("Optimized sequence for: " + "M" * 20)


def test_sources_and_settings(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Unnamed: 0,ensembl_transcript_id,sym,ensembl_peptide_id,s1\n0,t1,A,p1,2.5\n1,t2,B,p2,x\n")
    got = matrix.read_matrix(spark, str(tmp_path / "m.csv"))
    assert got.columns[0] == "ensembl_transcript_id" and [r.s1 for r in got.orderBy("sym").collect()] == [2.5, None]
    genes = spark.createDataFrame([("t1", "A"), ("t2", "t1")], "gene_id string, sym string")
    assert matrix.gene_info(genes, "t1").first().sym == "A" and matrix.gene_info(genes, "A").first().gene_id == "t1"
    with pytest.raises(ValueError):
        matrix.gene_info(genes, "zz")
    with pytest.raises(ValueError):
        matrix.require_columns(genes, "nope")
    with pytest.raises(KeyError):
        matrix.load_all(spark, {"nope": "x"})
    row = matrix.conditions(spark.createDataFrame([("CHO-K1 at 33°C, stationary",)], "description string")).first()
    assert (row.cell_line, row.treatment, row.growth_phase) == ("CHO-K1", "33°C", "stationary")
    metrics = spark.createDataFrame([(1.5, float("nan"), "x")], "a double, b double, c string")
    assert matrix.write_metrics(metrics, f"file://{tmp_path}/m.json") == {"a": 1.5} and '"a": 1.5' in (tmp_path / "m.json").read_text()
    assert Layout(data="d").file("cds") == "d/raw/cds.fa"
    with pytest.raises(KeyError):
        Layout().folder("nope")
    assert patterns({"kozak": "A"}, {"kozak": "("}) == {"kozak": "A"} and patterns({"kozak": "A"}, {"kozak": "GG"}) == {"kozak": "GG"}
    with pytest.raises(ZeroDivisionError), step("x"):
        _ = 1 / 0
    effects = batch.repaired(spark.createDataFrame([(1, None)], "gene_id int, p_adj double")).first()
    assert (effects.gene_id, effects.p_adj) == ("1", 1.0)
