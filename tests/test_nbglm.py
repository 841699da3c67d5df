"""Negative-binomial regression: coefficients, dispersions and their trend, and the correction with a covariate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import nbglm


def simulated(spark, genes=160, samples=36, seed=0):
    rng = np.random.default_rng(seed)
    platform = np.arange(samples) % 3
    c = rng.normal(size=samples)
    c = (c - c.mean()) / c.std()
    level, shift, slope = rng.uniform(2, 7, genes), rng.normal(0, 0.7, (genes, 3)), rng.normal(0, 0.3, genes)
    mu = np.exp(level[:, None] + shift[:, platform] + slope[:, None] * c)
    phi = 0.03 + 3 / np.exp(level)
    y = rng.negative_binomial(1 / phi[:, None], 1 / (1 + phi[:, None] * mu)).astype(float)
    y[0, platform == 1] = 0  # has no fit
    rows = [(f"g{i:03d}", f"s{j:02d}", "ABC"[platform[j]], float(y[i, j]), float(c[j] * 4 + 10)) for i in range(genes) for j in range(samples)]
    return spark.createDataFrame(rows, "gene_id string, sample_id string, platform string, value double, age double"), y, platform, c, phi, slope


def test_scores_vanish_at_the_coefficients():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.arange(30) % 2 == 0, np.arange(30) % 2 == 1, rng.normal(size=30)]).astype(float)
    size, phi = rng.uniform(0.5, 2, 30), np.array([0.01, 0.2, 3.0, 0.5])
    y = rng.poisson(np.array([[5.0], [50.0], [3.0], [1000.0]]) * size * np.exp(0.5 * x[:, 2])).astype(float)
    beta = nbglm.coefficients(y, x, size, phi)
    mu = nbglm._mean(x, beta, size)
    assert np.abs(((y - mu) / (1 + phi[:, None] * mu)) @ x).max() < 1e-5
    for _ in range(20):  # nothing near is likelier
        other = nbglm._mean(x, beta + rng.normal(0, 0.02, beta.shape), size)
        assert (nbglm.log_likelihood(y, other, phi) <= nbglm.log_likelihood(y, mu, phi) + 1e-9).all()


def test_highest_is_between_grid_points():
    peak = np.log([0.0123, 0.5, 4.0])
    curves = -((np.log(nbglm.GRID) - peak[:, None]) ** 2)
    assert np.allclose(np.log(nbglm.highest(curves)), peak, atol=1e-9)
    assert nbglm.highest(np.arange(25.0)[None])[0] == pytest.approx(nbglm.GRID[-1])


def test_regression_finds_effects_dispersions_and_trend(spark):
    expr, y, platform, c, phi, slope = simulated(spark)
    rows = nbglm.regress(expr, ["age"]).toPandas()
    own = rows[rows.term == "age"].set_index("gene_id").sort_index()
    assert set(rows.term) == {"A", "B", "C", "age"} and "g000" not in own.index and len(own) == len(y) - 1
    assert np.corrcoef(own.coefficient, slope[1:])[0, 1] > 0.9 and np.abs(own.coefficient - slope[1:]).mean() < 0.1
    size = np.maximum(y.sum(0), 1)
    x = np.column_stack([platform == k for k in range(3)] + [c]).astype(float)
    assert np.allclose(own.coefficient, nbglm.coefficients(y[1:], x, size, own.dispersion.to_numpy())[:, 3], atol=1e-6)
    assert np.corrcoef(np.log(own.trend_dispersion), np.log(phi[1:]))[0, 1] > 0.9
    # dispersions are drawn to the trend, so they are nearer the truth than a gene's own
    alone = nbglm.highest(nbglm.profiles(y[1:], x, size))
    error = lambda d: np.abs(np.log(d) - np.log(phi[1:])).mean()
    assert error(own.dispersion.to_numpy()) < 0.8 * error(alone)


def test_correction_keeps_the_covariate_and_drops_platforms(spark):
    expr, y, platform, c, phi, slope = simulated(spark)
    fixed = nbglm.correct(expr, ["age"])
    ages = F.broadcast(expr.select("sample_id", "age").distinct())
    after = nbglm.regress(fixed.join(ages, "sample_id"), ["age"]).toPandas().pivot(index="gene_id", columns="term", values="coefficient")
    before = nbglm.regress(expr, ["age"]).toPandas().pivot(index="gene_id", columns="term", values="coefficient")
    spread = lambda t: t[["A", "B", "C"]].std(axis=1).mean()
    assert spread(after) < 0.15 * spread(before)
    assert np.abs(after.age - before.age).mean() < 0.06
    values = {(r.gene_id, r.sample_id): r.value for r in fixed.collect()}
    assert len(values) == y.size and all(values["g000", f"s{j:02d}"] == y[0, j] for j in range(y.shape[1]))
    assert all(values[f"g{i:03d}", f"s{j:02d}"] == y[i, j] for i in range(len(y)) for j in range(y.shape[1]) if y[i, j] <= 1)


def test_designs_that_cannot_be_told_apart(spark):
    rows = [("g", f"s{j}", "AB"[j % 2], 5.0, float(j % 2), 1.0) for j in range(6)]
    expr = spark.createDataFrame(rows, "gene_id string, sample_id string, platform string, value double, same double, flat double")
    for covariate in ("same", "flat"):
        with pytest.raises(ValueError):
            nbglm.regress(expr, [covariate])
    assert nbglm.regress(expr.withColumn("value", F.lit(0.0))).count() == 0
