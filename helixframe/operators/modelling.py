"""Feature selection, regression models, predictions and what follows from them.

Linear work needs the data once: tasks sum products of features by fold, and every ridge or lasso fit, for any subset of
features and any fold, follows from those small matrices. Boosted trees are Spark ML's.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fold, held_out
from ..functions.quantiles import quantiles
from ..functions.stages import cut
from .features import f_regression

FOLDS = 5
ROWS_A_TASK = 50_000
MODELS = ("ridge", "gbr", "ensemble")


def clean_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles; infinite and missing values become the feature's median."""
    number = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).alias(c)
    own = df.select(*[c for c in df.columns if c not in features], *[number(c) for c in features])
    own = cut(own)
    long = own.unpivot([], features, "_f", "_x")
    # a feature without any value stays null
    medians = quantiles(long, "_x", [0.5], "_f").agg(*[F.max(F.when(F.col("_f") == c, F.col("q")[0])).alias(f"_{c}") for c in features])
    return own.join(F.broadcast(medians)).select(*[c for c in df.columns if c not in features], *[F.coalesce(c, f"_{c}").alias(c) for c in features])


def dense_features(df: DataFrame, features: list[str], most: float = 0.5) -> list[str]:
    """Features of which at most the share ``most`` is null (one row of counts comes to the driver)."""
    row = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in features]).first()
    return [c for c in features if row["_n"] - row[c] <= most * row["_n"]]


def gram(df: DataFrame, features: list[str], target: str, key: str, folds: int = FOLDS) -> np.ndarray:
    """Per fold the sums of products of (1, features..., target): folds x (p + 2) x (p + 2) numbers, whatever the rows."""
    names = [*features, target]

    def run(frames):
        total = np.zeros((folds, len(names) + 1, len(names) + 1))
        for f in frames:
            a = np.column_stack([np.ones(len(f)), f[names].to_numpy(float)])
            for k in range(folds):
                own = a[f["_fold"].to_numpy() == k]
                total[k] += own.T @ own
        yield pd.DataFrame({"k": range(folds), "m": [list(x.ravel()) for x in total]})

    parts = df.select(fold(key, folds).alias("_fold"), *names).mapInPandas(run, "k int, m array<double>")
    cells = parts.select("k", F.posexplode("m").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((folds, (len(names) + 1) ** 2))
    for r in cells:
        out[r["k"], r["i"]] = r["v"]
    return out.reshape(folds, len(names) + 1, len(names) + 1)


def _standard(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """(correlations of features, their covariance with y in deviations, means, deviations, mean of y)."""
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
    sd = np.where(sd < 1e-9 * np.maximum(1, np.abs(mean[:-1])), 1.0, sd)  # a constant feature stays out of everything
    cov[:-1][sd == 1.0] *= np.diag(cov)[:-1][sd == 1.0, None] > 1e-12
    return cov[:-1, :-1] / np.outer(sd, sd), cov[:-1, -1] / sd, mean[:-1], sd, mean[-1]


def _ridge(g: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Coefficients for standardised features."""
    r, c, *_ = _standard(g)
    return np.linalg.solve(r + alpha / g[0, 0] * np.eye(len(c)), c)


def _lasso(g: np.ndarray, alpha: float, rounds: int = 1000) -> np.ndarray:
    r, c, *_ = _standard(g)
    b = np.zeros(len(c))
    for _ in range(rounds):
        was = b.copy()
        for j in range(len(c)):
            rho = c[j] - r[j] @ b + r[j, j] * b[j]
            b[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / max(r[j, j], 1e-12)
        if np.abs(b - was).max(initial=0) < 1e-10:
            break
    return b


def _r2(train: np.ndarray, test: np.ndarray) -> float:
    """R squared on ``test`` of the ridge fitted to ``train``, from their products alone."""
    _, _, mean, sd, ym = _standard(train)
    b = _ridge(train) / sd
    w = np.concatenate([[ym - b @ mean], b, [-1.0]])  # a residual is w . (1, x, y)
    n = test[0, 0]
    total = test[-1, -1] - test[0, -1] ** 2 / n if n else 0.0
    return 1 - (w @ test @ w) / total if total > 1e-12 else 0.0


def recursive_elimination(g: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(features kept, their |coefficients|): the one with the least |coefficient| goes until one is left; the number
    with the best mean R squared over folds is taken."""
    whole = g.sum(0)
    kept, best = list(range(g.shape[1] - 2)), None
    while kept:
        at = np.array([0, *[k + 1 for k in kept], g.shape[1] - 1])
        sub = g[:, at[:, None], at]
        score = np.mean([_r2(sub.sum(0) - s, s) for s in sub if s[0, 0] > 1])
        coef = np.abs(_ridge(whole[at[:, None], at]))
        if best is None or score >= best[0]:
            best = (score, list(kept), coef)
        kept.pop(int(coef.argmin()))
    return (best[1], best[2]) if best else ([], np.zeros(0))


def select_features(df: DataFrame, features: list[str], target: str, key: str, method: str = "statistical", most: int = 15) -> DataFrame:
    """feature, importance, normalized_importance, method of the ``most`` best. ``method`` is one of statistical, rfe and
    lasso, or several with commas: a feature counts by the first that has it."""
    spark = df.sparkSession
    own = clean_features(df.filter(F.col(target).isNotNull()), features)
    g = None
    rows: dict[str, tuple[float, str]] = {}
    for m in (x.strip() for x in method.split(",")):
        if m == "statistical":
            scored = [(r["feature"], r["f"] or 0.0) for r in f_regression(own, features, target).collect()]  # a row a feature
        else:
            g = gram(own, features, target, key) if g is None else g
            if m == "rfe":
                scored = [(features[i], float(c)) for i, c in zip(*recursive_elimination(g), strict=True)]
            elif m == "lasso":
                scored = [(f, abs(float(c))) for f, c in zip(features, _lasso(g.sum(0), 0.01), strict=True) if abs(c) > 1e-12]
            else:
                raise ValueError(f"unknown selection method: {m}")
        top = max((s for _, s in scored), default=0.0) or 1.0
        for f, s in sorted(scored, key=lambda x: (-x[1], x[0])):
            rows.setdefault(f, (s / top, m))
    best = sorted(rows.items(), key=lambda x: (-x[1][0], x[0]))[:most]
    top = max((v[0] for _, v in best), default=0.0) or 1.0
    return spark.createDataFrame([(f, s, s / top, m) for f, (s, m) in best], "feature string, importance double, normalized_importance double, method string")


@dataclass(frozen=True)
class Fitted:
    features: list[str]
    target: str
    model: PipelineModel
    metrics: DataFrame

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with a column per model, and error and abs_error of the ensemble where the target is known."""
        out = with_ensemble(self.model.transform(df.withColumns({f: F.col(f).cast("double") for f in self.features})))
        out = out.drop(*[c for c in out.columns if c.startswith("_ml_")])
        if self.target not in df.columns:
            return out
        error = F.col("ensemble") - F.col(self.target)
        return out.withColumn("error", error).withColumn("abs_error", F.abs(error))

    def importance(self) -> DataFrame:
        """feature, ridge and gbr importances (each sums to 1), and their mean, largest first."""
        ridge = np.abs(self.model.stages[-2].coefficients.toArray())
        trees = self.model.stages[-1].featureImportances.toArray()
        a, b = (v / (v.sum() or 1) for v in (ridge, trees))
        rows = sorted(zip(self.features, map(float, a), map(float, b), map(float, (a + b) / 2), strict=True), key=lambda r: (-r[3], r[0]))
        return self.metrics.sparkSession.createDataFrame(rows, "feature string, ridge double, gbr double, importance double")


def with_ensemble(df: DataFrame) -> DataFrame:
    return df.withColumn("ensemble", (F.col("ridge") + F.col("gbr")) / 2)


def _pipeline(train: DataFrame, features: list[str], target: str, trees: int) -> Pipeline:
    n, sd = train.agg(F.count("*"), F.stddev_pop(target)).first()
    vec, out = "_ml_vec", "_ml_features"
    filled = [f"_ml_{f}" for f in features]
    head = [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol=vec), StandardScaler(inputCol=vec, outputCol=out, withMean=True)]
    # the penalty that equals alpha = 1 on the sum of squares
    ridge = LinearRegression(featuresCol=out, labelCol=target, predictionCol="ridge", solver="normal", regParam=float(sd or 0) / max(n, 1), elasticNetParam=0.0, standardization=False)
    boosted = GBTRegressor(featuresCol=out, labelCol=target, predictionCol="gbr", maxIter=trees, stepSize=0.1, maxDepth=3, seed=42)
    return Pipeline(stages=[*head, ridge, boosted])


def _scores(predicted: DataFrame, target: str) -> dict[str, tuple[float, float]]:
    aggs = []
    for m in MODELS:
        e = F.col(target) - F.col(m)
        aggs += [F.sum(e * e).alias(f"{m}_ss"), F.avg(e * e).alias(f"{m}_mse")]
    row = with_ensemble(predicted).agg(*aggs, (F.var_pop(target) * F.count("*")).alias("total")).first()
    return {m: (1 - row[f"{m}_ss"] / row["total"] if row["total"] else 0.0, (row[f"{m}_mse"] or 0.0) ** 0.5) for m in MODELS}


def fit_models(df: DataFrame, features: list[str], target: str, key: str = "id", trees: int = 100, folds: int = FOLDS) -> Fitted:
    """Ridge (alpha 1), boosted trees (``trees``, rate .1, depth 3) and their mean: R squared over ``folds`` hashed folds
    of the training rows (none for one fold), R squared and RMSE on the held-out fifth. metrics has a row per model, the best first."""
    own = df.select(key, F.col(target).cast("double").alias(target), *[F.col(f).cast("double").alias(f) for f in features]).filter(F.col(target).isNotNull())
    rows = own.withColumn("_part", F.when(held_out(key), -1).otherwise(fold(key, folds)))
    # trees take several jobs each: a task has ROWS_A_TASK rows, so small tables do not pay for many tasks
    own = rows.coalesce(1 + rows.count() // ROWS_A_TASK).persist()
    try:
        train, test = own.filter("_part >= 0"), own.filter("_part < 0")
        cv: dict[str, list[float]] = {m: [] for m in MODELS}

        def fitted(rows: DataFrame) -> PipelineModel:
            return _pipeline(rows, features, target, trees).fit(rows)

        def validated(k: int) -> dict[str, tuple[float, float]]:
            return _scores(fitted(train.filter(F.col("_part") != k)).transform(train.filter(F.col("_part") == k)), target)

        with ThreadPoolExecutor(folds + 1) as pool:  # the fits' jobs run side by side
            whole = pool.submit(fitted, train)
            for scores in pool.map(validated, range(folds) if folds > 1 else ()):
                for m, (r2, _) in scores.items():
                    cv[m].append(r2)
            model = whole.result()
        final = _scores(model.transform(test), target)
        counts = (train.count(), test.count())
    finally:
        own.unpersist()
    rows = sorted(((m, float(np.mean(cv[m])) if cv[m] else None, float(np.std(cv[m])) if cv[m] else None, float(final[m][0]), float(final[m][1]), *counts) for m in MODELS), key=lambda r: -r[3])
    metrics = df.sparkSession.createDataFrame(rows, "model_type string, cv_r2_mean double, cv_r2_std double, test_r2 double, test_rmse double, n_train long, n_test long")
    return Fitted(features, target, model, metrics)


def _at_medians(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: each feature's exact median, least and largest value."""
    own = cut(df.select(*[F.col(f).cast("double").alias(f) for f in features]))
    medians = quantiles(own.unpivot([], features, "_f", "_x"), "_x", [0.5], "_f").agg(*[F.max(F.when(F.col("_f") == f, F.col("q")[0])).alias(f) for f in features])
    ends = own.agg(*[F.min(f).alias(f"_lo_{f}") for f in features], *[F.max(f).alias(f"_hi_{f}") for f in features])
    return cut(medians.crossJoin(F.broadcast(ends)))  # the grids read it several times


def _grid(name: str, steps: int) -> F.Column:
    return F.explode(F.expr(f"transform(sequence(0, {steps - 1}), i -> `_lo_{name}` + (`_hi_{name}` - `_lo_{name}`) * i / {steps - 1})"))


def optimisation_sweep(fitted: Fitted, df: DataFrame, steps: int = 10) -> DataFrame:
    """For each feature the values, of ``steps`` over its range with the others at their medians, where the ensemble
    predicts least and most, and what the better one improves on the prediction at the medians."""
    base = _at_medians(df, fitted.features)
    grids = None
    for f in fitted.features:
        own = base.withColumn("_at", _grid(f, steps)).select(F.lit(f).alias("swept"), *[F.col("_at").alias(c) if c == f else F.col(c).cast("double").alias(c) for c in fitted.features], F.col("_at").alias("at"))
        grids = own if grids is None else grids.unionByName(own)
    middle = fitted.predict(base.select(*fitted.features)).select(F.col("ensemble").alias("baseline"))
    out = fitted.predict(grids).groupBy("swept").agg(F.min_by("at", "ensemble").alias("least_at"), F.min("ensemble").alias("least"), F.max_by("at", "ensemble").alias("most_at"), F.max("ensemble").alias("most"))
    return out.join(F.broadcast(middle)).withColumnRenamed("swept", "feature").withColumn("reduction", F.col("baseline") - F.col("least")).withColumn("gain", F.col("most") - F.col("baseline"))


def contour(fitted: Fitted, df: DataFrame, a: str, b: str, steps: int = 50) -> DataFrame:
    """The ensemble's prediction over ``steps`` x ``steps`` values of two features, the others at their medians."""
    base = _at_medians(df, fitted.features).withColumn("_a", _grid(a, steps)).withColumn("_b", _grid(b, steps))
    grid = base.select(*[F.col({a: "_a", b: "_b"}.get(c, c)).cast("double").alias(c) for c in fitted.features])
    return fitted.predict(grid).select(F.col(a).alias("x"), F.col(b).alias("y"), F.col("ensemble").alias("prediction"))
