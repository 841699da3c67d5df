"""Association of every gene with the target: rows (gene_id, sample_id, value, y) in, one row per gene and method out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import special
from ..functions.columns import avg_rank, benjamini_hochberg, corr_p, safe_corr
from ..functions.concordance import concordance

METHODS = ("pearson", "spearman", "kendall", "regression")
#: Samples up to which Kendall's p is exact where there are no ties.
EXACT_KENDALL = 33
#: Samples up to which resamples take tau-b from one matrix of signs, which is then small and quicker; the value is the same.
MATRIX_KENDALL = 256


def pearson(x: DataFrame) -> DataFrame:
    return x.groupBy("gene_id").agg(safe_corr("value", "y").alias("r"), F.count("*").alias("n"))


def spearman(x: DataFrame, *by: str, dense: bool = False) -> DataFrame:
    """Pearson r of mean ranks; with ``by`` within those groups too. Ranks are over the samples a gene has; where
    ``dense`` says that all genes have all samples, y is ranked once, over its row a sample."""
    ranked = x.withColumn("rx", avg_rank("value", "gene_id", *by))
    if dense:
        ys = x.select("sample_id", "y", *by).distinct().withColumn("ry", avg_rank("y", *by)).select("sample_id", "ry")
        ranked = ranked.join(F.broadcast(ys), "sample_id")
    else:
        ranked = ranked.withColumn("ry", avg_rank("y", "gene_id", *by))
    return ranked.groupBy("gene_id", *by).agg(safe_corr("rx", "ry").alias("r"), F.count("*").alias("n"))


def regression(x: DataFrame) -> DataFrame:
    """OLS slope of y on the gene, R squared; genes without spread have no row."""
    out = x.groupBy("gene_id").agg(F.regr_slope("y", "value").alias("slope"), safe_corr("value", "y").alias("r"), F.count("*").alias("n"), F.stddev_pop("value").alias("s")).filter("s > 1e-9")
    return out.select("gene_id", "slope", (F.col("r") * F.col("r")).alias("r2"), "r", "n")


def _vectors(x: DataFrame) -> DataFrame:
    """gene_id, values and ys in order of the samples."""
    return x.groupBy("gene_id").agg(F.sort_array(F.collect_list(F.struct("sample_id", "value", "y"))).alias("v")).select("gene_id", F.col("v.value").alias("values"), F.col("v.y").alias("ys"))


def kendall(x: DataFrame) -> DataFrame:
    """tau-b and its p, by inversions of y in order of the gene (Knight): n log n steps and memory for n values a gene.

    p is exact without ties up to EXACT_KENDALL samples, otherwise by the normal approximation with tie-corrected
    variance. Pairs with a null or NaN on either side don't count.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            size = [len(v) for v in f["values"]]
            own = np.repeat(np.arange(len(f)), size)
            v, y = (np.concatenate([np.asarray(a, float) for a in f[c]]) if len(f) else np.zeros(0) for c in ("values", "ys"))
            whole = ~(np.isnan(v) | np.isnan(y))
            c = concordance(v[whole], y[whole], own[whole], len(f))
            z, exact = c.z(), (c.n <= EXACT_KENDALL) & c.untied()
            p = np.asarray(special.normal_two_sided(z))
            p[exact] = [special.kendall_exact(float(s), int(n)) for s, n in zip(c.s[exact], c.n[exact])]
            yield pd.DataFrame({"gene_id": f["gene_id"], "r": c.tau_b(), "n": c.n, "z": z, "p_value": p})

    return _vectors(x).mapInPandas(run, "gene_id string, r double, n long, z double, p_value double")


def correlations(x: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """gene_id, method, coefficient, p_value, rank_score, and p adjusted within the method."""
    parts = {
        "pearson": lambda: pearson(x).select("gene_id", "r", corr_p("r", "n").alias("p_value")),
        "spearman": lambda: spearman(x).select("gene_id", "r", corr_p("r", "n").alias("p_value")),
        "kendall": lambda: kendall(x).select("gene_id", "r", "p_value"),
        "regression": lambda: regression(x).withColumn("p_value", corr_p("r", "n")).select("gene_id", F.col("slope").alias("r"), "p_value"),
        "decision_tree": lambda: trees(x, 1),
        "random_forest": lambda: trees(x, 20),
    }
    out = None
    for m in methods:
        own = parts[m]().select("gene_id", F.lit(m).alias("method"), F.col("r").alias("coefficient"), "p_value")
        out = own if out is None else out.unionByName(own)
    scored = out.withColumn("rank_score", F.abs("coefficient") / (F.col("p_value") + 1e-10))
    return benjamini_hochberg(scored.withColumn("_p", F.greatest(F.lit(1e-300), F.least(F.lit(1.0), "p_value"))), "_p", "p_adjusted", "method").drop("_p")


def _tree(x: np.ndarray, y: np.ndarray, depth: int):
    """Regression tree of one feature as (cut, left, right) or a mean."""
    if depth == 0 or len(y) < 2 or x[0] == x[-1]:
        return float(y.mean())
    n = np.arange(1, len(y))
    left = np.cumsum(y)[:-1]
    gain = left**2 / n + (y.sum() - left) ** 2 / (len(y) - n)
    gain[x[1:] == x[:-1]] = -np.inf
    k = int(gain.argmax()) + 1
    if gain[k - 1] <= y.sum() ** 2 / len(y) + 1e-12:
        return float(y.mean())
    return (x[k - 1] + x[k]) / 2, _tree(x[:k], y[:k], depth - 1), _tree(x[k:], y[k:], depth - 1)


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x <= tree[0], _apply(tree[1], x), _apply(tree[2], x))


def trees(x: DataFrame, count: int, top: int = 1000, depth: int = 3, seed: int = 42) -> DataFrame:
    """Cross-validated R squared (3 folds, at least 0) of one-feature trees, for the ``top`` genes by variance.

    One tree fits all rows, several fit seeded bootstraps. The pseudo p is 1 / (1 + 10 score), within .001 and .99.
    """
    best = x.groupBy("gene_id").agg(F.var_pop("value").alias("s")).filter("s > 0").orderBy(F.desc("s"), "gene_id").limit(top).select("gene_id")
    own = x.join(F.broadcast(best), "gene_id")
    vectors = _vectors(own)

    def fit(v, y, rng):
        out = []
        for k in range(count):
            i = np.arange(len(v)) if count == 1 else rng.integers(0, len(v), len(v))
            i = i[np.argsort(v[i], kind="stable")]
            out.append(_tree(v[i], y[i], depth))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for gene, v, y in zip(f["gene_id"], f["values"], f["ys"], strict=True):
                v, y, rng, r2 = np.asarray(v, float), np.asarray(y, float), np.random.default_rng(seed), []
                for fold in np.array_split(np.arange(len(v)), 3):
                    rest = np.setdiff1d(np.arange(len(v)), fold)
                    guess = np.mean([_apply(t, v[fold]) for t in fit(v[rest], y[rest], rng)], axis=0)
                    total = ((y[fold] - y[fold].mean()) ** 2).sum()
                    r2.append(1 - ((y[fold] - guess) ** 2).sum() / total if total > 0 else 0.0)
                score = max(0.0, float(np.mean(r2)))
                rows.append((gene, score, float(np.clip(1 / (1 + 10 * score), 0.001, 0.99))))
            yield pd.DataFrame(rows, columns=["gene_id", "r", "p_value"])

    return vectors.mapInPandas(run, "gene_id string, r double, p_value double")


def _drawn_tau(v: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """tau-b of one gene in each of some resamples, every draw written out."""
    at = np.concatenate([np.repeat(np.arange(len(y)), k) for k in w.astype(int)])
    return concordance(v[at], y[at], np.repeat(np.arange(len(w)), w.sum(1).astype(int)), len(w)).tau_b()


def _resampled(method: str, v: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The coefficient of one gene in every resample, from how often each sample is drawn (``w``, resamples x samples)."""
    n = len(y)
    if method == "kendall" and n > MATRIX_KENDALL:
        return np.concatenate([_drawn_tau(v, y, w[i : i + 64]) for i in range(0, len(w), 64)])
    if method == "kendall":
        sv, sy = np.sign(v[:, None] - v), np.sign(y[:, None] - y)
        pairs = lambda m: ((w @ m) * w).sum(1)
        top, bottom = pairs(sv * sy), np.sqrt(pairs(sv * sv) * pairs(sy * sy))
    else:
        if method == "spearman":
            a, b = (w @ ((u < u[:, None]) + 0.5 * (u == u[:, None])).T for u in (v, y))  # mean ranks less a half
        else:
            a, b = np.broadcast_to(v, w.shape), np.broadcast_to(y, w.shape)
        a, b = a - (w * a).sum(1, keepdims=True) / n, b - (w * b).sum(1, keepdims=True) / n
        top, aa = (w * a * b).sum(1), (w * a * a).sum(1)
        bottom = aa if method == "regression" else np.sqrt(aa * (w * b * b).sum(1))
    return np.divide(top, bottom, out=np.zeros(len(w)), where=bottom > 1e-9)


def bootstrap(x: DataFrame, iterations: int = 1000, top: int = 20, level: float = 0.95, seed: int = 42, methods: tuple[str, ...] = ("pearson",)) -> DataFrame:
    """gene_id, method, mean_boot, ci_lower, ci_upper, rank_stability_perc over seeded resamples of the samples.

    rank_stability_perc is the per cent of resamples in which the gene is among the ``top`` by |coefficient| in any of
    ``methods``. Trees take Pearson's r here. A gene that is constant in nine of ten resamples has null statistics.
    All tasks draw the same resamples; of each resample and method a task gives only its own top genes, and the global
    top is among those, so little is ranked again.
    """
    vectors = _vectors(x)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            y = np.asarray(f["ys"].iloc[0], float)
            w = np.random.default_rng(seed).multinomial(len(y), np.full(len(y), 1 / len(y)), iterations).astype(float)
            for m in methods:
                kind = m if m in METHODS else "pearson"
                r = np.stack([_resampled(kind, np.asarray(v, float), y, w) for v in f["values"]])
                tail = (1 - level) / 2
                lo, hi = np.quantile(r, [tail, 1 - tail], axis=1)
                rank = np.argsort(-np.abs(r), axis=0, kind="stable")[:top]
                hits = [[] for _ in range(len(r))]
                for b in range(iterations):
                    for g in rank[:, b]:
                        hits[g].append({"b": b, "s": abs(r[g, b])})
                steady = (r != 0).mean(1) > 0.1
                yield pd.DataFrame({"gene_id": f["gene_id"], "method": m, "mean_boot": np.where(steady, r.mean(1), np.nan), "ci_lower": np.where(steady, lo, np.nan), "ci_upper": np.where(steady, hi, np.nan), "hits": hits})

    out = vectors.mapInPandas(run, "gene_id string, method string, mean_boot double, ci_lower double, ci_upper double, hits array<struct<b:int,s:double>>")
    number = [F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("mean_boot", "ci_lower", "ci_upper")]
    ranked = out.select("gene_id", "method", F.explode("hits").alias("h")).select("gene_id", "method", "h.*").withColumn("k", F.row_number().over(W.partitionBy("method", "b").orderBy(F.desc("s"), "gene_id")))
    kept = ranked.filter(F.col("k") <= top).groupBy("gene_id").agg((F.countDistinct("b") * 100.0 / iterations).alias("rank_stability_perc"))
    return out.select("gene_id", "method", *number).join(kept, "gene_id", "left").fillna(0.0, ["rank_stability_perc"])


def with_bootstrap(rows: DataFrame, boot: DataFrame | None) -> DataFrame:
    """Association rows with their bootstrap columns by (gene_id, method); nulls and stability 0 where there is none."""
    if boot is None:
        none = F.lit(None).cast("double")
        return rows.withColumns({"mean_boot": none, "ci_lower": none, "ci_upper": none, "rank_stability_perc": F.lit(0.0)})
    return rows.join(boot, ["gene_id", "method"], "left").fillna(0.0, ["rank_stability_perc"])


def gene_regression(x: DataFrame, genes: DataFrame, most: int = 200) -> DataFrame:
    """gene_id and coefficient of the least-squares model of y on all of ``genes``, largest |coefficient| first; over ``most``
    genes raise ValueError, as one model is one task. Coefficients come from the pseudo-inverse, so more genes than samples give the shortest solution."""
    named = genes.select("gene_id").distinct()
    if (asked := named.limit(most + 1).count()) > most:
        raise ValueError(f"a model on more than {most} genes ({asked} or more asked)")
    own = x.join(F.broadcast(named), "gene_id")
    vectors = own.groupBy("gene_id").agg(F.sort_array(F.collect_list(F.struct("sample_id", "value", "y"))).alias("v")).select(F.lit(1).alias("one"), "gene_id", F.col("v.value").alias("values"), F.col("v.y").alias("ys"))

    def solve(f: pd.DataFrame) -> pd.DataFrame:  # at most ``most`` rows
        f = f.sort_values("gene_id")
        a, y = np.stack([np.asarray(v, float) for v in f["values"]]).T, np.asarray(f["ys"].iloc[0], float)
        return pd.DataFrame({"gene_id": f["gene_id"], "coefficient": np.linalg.pinv(a - a.mean(0)) @ (y - y.mean())})

    return vectors.groupBy("one").applyInPandas(solve, "gene_id string, coefficient double").orderBy(F.desc(F.abs("coefficient")), "gene_id")
