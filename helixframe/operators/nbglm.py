"""Negative-binomial regression of counts on platforms and covariates, and the platform correction that follows from it.

A gene's counts have mean size * exp(design row . coefficients) and variance mean + dispersion * mean^2. Coefficients come
from iteratively reweighted least squares over all genes of a batch at once. A gene's dispersion maximises its
Cox-Reid adjusted profile likelihood plus that of the genes of like abundance: curves over a grid of dispersions are
averaged in ranges of abundance in Spark, smoothed over neighbouring ranges and read off at the gene's own abundance.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.special import lgamma
from ..functions.stages import cut
from ..sources.matrix import to_vectors
from .counts import GRID, PRIOR_DF, cdf, quantile

#: Ranges of abundance of the trend.
RANGES = 20


@dataclass(frozen=True)
class Design:
    """Samples in order, their library sizes, and the design: a column a platform, then standardised covariates."""

    samples: list[tuple[str, str]]
    size: np.ndarray
    x: np.ndarray
    names: list[str]
    platforms: int

    def without_platforms(self) -> np.ndarray:
        """The design with every sample at the mean platform, weighted by samples."""
        x = self.x.copy()
        x[:, : self.platforms] = self.x[:, : self.platforms].mean(axis=0)
        return x


def design_of(expr: DataFrame, covariates: Sequence[str] = ()) -> Design:
    """The design of (sample_id, platform, value, covariates...): a row a sample comes to the driver. Covariates are
    numbers of the sample; one that does not vary, or that platforms and others explain, raises ValueError."""
    rows = expr.groupBy("sample_id").agg(F.first("platform").alias("platform"), F.sum("value").alias("_size"), *[F.first(F.col(c).cast("double"), True).alias(c) for c in covariates]).orderBy("sample_id").collect()
    platforms = sorted({r["platform"] for r in rows})
    columns = [np.array([float(r["platform"] == p) for r in rows]) for p in platforms]
    for c in covariates:
        v = np.array([np.nan if r[c] is None else r[c] for r in rows], float)
        if np.isnan(v).any() or not v.std():
            raise ValueError(f"covariate {c} is missing for a sample or does not vary")
        columns.append((v - v.mean()) / v.std())
    x = np.column_stack(columns) if rows else np.zeros((0, 0))
    if np.linalg.matrix_rank(x) < x.shape[1]:
        raise ValueError("platforms and covariates explain each other")
    return Design([(r["sample_id"], r["platform"]) for r in rows], np.maximum(np.array([r["_size"] for r in rows], float), 1.0), x, [*platforms, *covariates], len(platforms))


def _mean(x: np.ndarray, beta: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(beta @ x.T, -40, 40)) * size


def log_likelihood(y: np.ndarray, mu: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Per gene, less what depends on neither."""
    r = 1 / phi[:, None]
    return (lgamma(y + r) - lgamma(r) + r * np.log(r / (r + mu)) + y * np.log(np.maximum(mu, 1e-300) / (r + mu))).sum(1)


def coefficients(y: np.ndarray, x: np.ndarray, size: np.ndarray, phi: np.ndarray, start: np.ndarray | None = None, rounds: int = 60) -> np.ndarray:
    """Maximum-likelihood coefficients (genes x columns) for dispersions ``phi``; a step that lowers a gene's likelihood is halved."""
    beta = np.linalg.lstsq(x, np.log((y + 0.5) / size).T, rcond=None)[0].T if start is None else start.copy()
    mu = _mean(x, beta, size)
    best = log_likelihood(y, mu, phi)
    for _ in range(rounds):
        damp = 1 + phi[:, None] * mu
        information = np.einsum("np,gn,nq->gpq", x, mu / damp, x) + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(information, (((y - mu) / damp) @ x)[:, :, None])[:, :, 0]
        step *= np.minimum(1, 4 / np.maximum(np.abs(step).max(axis=1, keepdims=True), 1e-300))
        for _ in range(12):
            new_mu = _mean(x, beta + step, size)
            new = log_likelihood(y, new_mu, phi)
            worse = new < best - 1e-9 * np.abs(best)
            if not worse.any():
                break
            step[worse] /= 2
        beta, mu, best = beta + step, new_mu, new
        if np.abs(step).max(initial=0) < 1e-9:
            break
    return beta


def profiles(y: np.ndarray, x: np.ndarray, size: np.ndarray, grid: np.ndarray = GRID) -> np.ndarray:
    """Cox-Reid adjusted profile log-likelihoods (genes x grid)."""
    out, beta = np.empty((len(y), len(grid))), None
    for k, p in enumerate(grid):
        phi = np.full(len(y), p)
        beta = coefficients(y, x, size, phi, beta)
        mu = _mean(x, beta, size)
        information = np.einsum("np,gn,nq->gpq", x, mu / (1 + p * mu), x)
        out[:, k] = log_likelihood(y, mu, phi) - 0.5 * np.linalg.slogdet(information + 1e-12 * np.eye(x.shape[1]))[1]
    return out


def highest(curves: np.ndarray, grid: np.ndarray = GRID) -> np.ndarray:
    """Where each curve over the logarithmic ``grid`` is highest, between grid points by a parabola through three."""
    k = np.clip(curves.argmax(axis=1), 1, len(grid) - 2)
    at = np.arange(len(curves))
    a, b, c = curves[at, k - 1], curves[at, k], curves[at, k + 1]
    bend = a - 2 * b + c
    move = np.where(bend < 0, np.clip(0.5 * (a - c) / np.where(bend < 0, bend, 1), -1, 1), np.sign(c - a))
    return np.exp(np.log(grid[k]) + move * np.log(grid[1] / grid[0]))


@dataclass(frozen=True)
class Trend:
    """Mean profile curves at the mean abundances of ranges, rising; a gene reads the curve between its neighbours."""

    at: np.ndarray
    curves: np.ndarray

    def of(self, abundance: np.ndarray) -> np.ndarray:
        return np.stack([np.interp(abundance, self.at, c) for c in self.curves.T], axis=1)


def trend_of(curves: DataFrame) -> Trend:
    """The trend of (abundance, curve): RANGES rows of means come to the driver."""
    bounds = quantiles(curves, "abundance", [k / RANGES for k in range(1, RANGES)], out="bounds")
    ranged = curves.join(F.broadcast(bounds)).withColumn("range", F.size(F.filter("bounds", lambda b: b < F.col("abundance"))))
    means = ranged.select("range", "abundance", F.posexplode("curve").alias("k", "v")).groupBy("range", "k").agg(F.avg("v").alias("v"), F.avg("abundance").alias("a")).collect()
    ranges = sorted({r["range"] for r in means})
    table = {(r["range"], r["k"]): r["v"] for r in means}
    raw = np.array([[table[i, k] for k in range(len(GRID))] for i in ranges])
    raw -= raw.max(axis=1, keepdims=True)
    wide = np.vstack([raw[:1], raw, raw[-1:]])
    return Trend(np.array([next(r["a"] for r in means if r["range"] == i) for i in ranges]), (wide[:-2] + 2 * wide[1:-1] + wide[2:]) / 4)


def _fitted(expr: DataFrame, design: Design) -> tuple[DataFrame, Trend | None]:
    """(gene_id, values, abundance, curve), the last two null for genes that are zero throughout a platform; the trend."""
    x, size, platforms = design.x, design.size, design.platforms
    indicator = x[:, :platforms]

    def curves(frames):
        for f in frames:
            if not len(f):
                continue
            y = np.stack([np.asarray(v, float) for v in f["values"]])
            fit = (y @ indicator > 0).all(axis=1)
            abundance, curve = np.full(len(y), None, object), np.full(len(y), None, object)
            if fit.any():
                abundance[fit] = np.log((y[fit] / size).mean(axis=1))
                for i, c in zip(np.flatnonzero(fit), profiles(y[fit], x, size)):
                    curve[i] = c.tolist()
            yield pd.DataFrame({"gene_id": f["gene_id"].to_numpy(), "values": list(f["values"]), "abundance": pd.Series(list(abundance), dtype=object), "curve": pd.Series(list(curve), dtype=object)})

    counts = expr.select("gene_id", "sample_id", F.round(F.greatest("value", F.lit(0.0))).alias("value"))
    made = cut(to_vectors(counts).mapInPandas(curves, "gene_id string, values array<double>, abundance double, curve array<double>"))
    known = made.filter("curve is not null")
    return made, trend_of(known) if known.limit(1).count() else None


def _dispersions(f: pd.DataFrame, trend: Trend, weight: float) -> tuple[np.ndarray, np.ndarray]:
    own = np.stack([np.asarray(c, float) for c in f["curve"]])
    like = trend.of(f["abundance"].to_numpy(float))
    return highest(own + weight * like), highest(like)


def regress(expr: DataFrame, covariates: Sequence[str] = ()) -> DataFrame:
    """gene_id, abundance (log of the mean rate), dispersion, trend_dispersion, term, coefficient of every gene with counts
    on all platforms; a term a platform (log rate) and covariate (log change a standard deviation)."""
    design = design_of(expr, covariates)
    made, trend = _fitted(expr, design)
    weight = PRIOR_DF / max(design.x.shape[0] - design.x.shape[1], 1)
    kind = "gene_id string, abundance double, dispersion double, trend_dispersion double, coefficients array<double>"
    if trend is None:
        return made.limit(0).selectExpr("gene_id", "abundance", "abundance AS dispersion", "abundance AS trend_dispersion", "'' AS term", "abundance AS coefficient")
    x, size = design.x, design.size

    def solve(frames):
        for f in frames:
            if len(f):
                phi, level = _dispersions(f, trend, weight)
                beta = coefficients(np.stack([np.asarray(v, float) for v in f["values"]]), x, size, phi)
                yield pd.DataFrame({"gene_id": f["gene_id"].to_numpy(), "abundance": f["abundance"].to_numpy(), "dispersion": phi, "trend_dispersion": level, "coefficients": list(beta)})

    out = made.filter("curve is not null").mapInPandas(solve, kind)
    names = F.array(*map(F.lit, design.names))
    return out.select("gene_id", "abundance", "dispersion", "trend_dispersion", F.posexplode("coefficients").alias("_i", "coefficient")).select("gene_id", "abundance", "dispersion", "trend_dispersion", F.get(names, F.col("_i")).alias("term"), "coefficient")


def correct(expr: DataFrame, covariates: Sequence[str] = ()) -> DataFrame:
    """gene_id, sample_id, platform, value: every count at the same quantile of its distribution without platform effects;
    what covariates explain stays. Genes that are zero throughout a platform stay as they are, as do counts of 0 and 1."""
    design = design_of(expr, covariates)
    made, trend = _fitted(expr, design)
    weight = PRIOR_DF / max(design.x.shape[0] - design.x.shape[1], 1)
    x, size, free = design.x, design.size, design.without_platforms()

    def move(frames):
        for f in frames:
            out = list(f["values"])
            fit = f["curve"].notna().to_numpy()
            if fit.any():
                own = f[fit]
                y = np.stack([np.asarray(v, float) for v in own["values"]])
                phi, _ = _dispersions(own, trend, weight)
                beta = coefficients(y, x, size, phi)
                wide = np.broadcast_to(phi[:, None], y.shape)
                p = cdf(y - 1, _mean(x, beta, size), wide)
                moved = 1 + quantile(np.minimum(p, 1 - 1e-4), _mean(free, beta, size), wide)
                for i, row in zip(np.flatnonzero(fit), np.where((y <= 1) | (p > 1 - 1e-4), y, moved)):
                    out[i] = row
            yield pd.DataFrame({"gene_id": f["gene_id"].to_numpy(), "values": pd.Series(out, dtype=object)})

    places = expr.sparkSession.createDataFrame([(i, s, p) for i, (s, p) in enumerate(design.samples)], "pos int, sample_id string, platform string")
    fixed = made.mapInPandas(move, "gene_id string, values array<double>")
    return fixed.select("gene_id", F.posexplode("values").alias("pos", "value")).join(F.broadcast(places), "pos").select("gene_id", "sample_id", "platform", "value")
