"""Platform correction of count data by negative-binomial regression (Zhang, Parmigiani and Johnson 2020).

Counts of a gene on a platform have mean rate * library size and variance mean + dispersion * mean^2. Rates and
dispersions are fitted per gene and platform; dispersions are drawn to the platform's common one by weighted likelihood
over a grid. Then every count is mapped to the same quantile of the distribution without platform effects.

Genes are rows of vectors (values in order of sample_id); tasks work on blocks of genes. Values are rounded to counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import betainc, lgamma
from ..sources.matrix import to_vectors

GRID = np.exp(np.linspace(np.log(1e-3), np.log(10.0), 25))
#: Genes' worth of evidence that a platform's common dispersion has, in degrees of freedom.
PRIOR_DF = 10.0


def rates(y: np.ndarray, size: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Maximum-likelihood rates of rows of ``y`` (genes x samples) for dispersions ``phi`` (a gene each), by scoring."""
    rate = np.maximum(y.sum(1) / size.sum(), 1e-12)
    for _ in range(50):
        mu = rate[:, None] * size
        w = mu / (1 + phi[:, None] * mu)
        step = ((y - mu) / (1 + phi[:, None] * mu)).sum(1) / np.maximum(w.sum(1), 1e-12)
        rate = np.maximum(rate * np.exp(np.clip(step, -2, 2)), 1e-12)
        if np.abs(step).max(initial=0) < 1e-10:
            break
    return rate


def likelihood(y: np.ndarray, size: np.ndarray, phi: float) -> np.ndarray:
    """Profile log-likelihood of each gene at dispersion ``phi``, adjusted for the fitted rate (Cox and Reid), less what
    does not depend on ``phi``."""
    own = np.full(len(y), phi)
    mu = rates(y, size, own)[:, None] * size
    r = 1 / phi
    ll = (lgamma(y + r) - lgamma(np.array(r)) + r * np.log(r / (r + mu)) + y * np.log(np.maximum(mu, 1e-300) / (r + mu))).sum(1)
    return ll - 0.5 * np.log(np.maximum((mu / (1 + phi * mu)).sum(1), 1e-12))


def cdf(k: np.ndarray, mu: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """P(count <= k)."""
    r = 1 / phi
    return np.where(k < 0, 0.0, betainc(r, np.maximum(k, 0) + 1, r / (r + mu), mu / (r + mu)))


def quantile(p: np.ndarray, mu: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """The least count whose distribution function reaches ``p``, by doubling and halving."""
    hi = np.maximum(np.ceil(mu), 1.0)
    while (short := cdf(hi, mu, phi) < p).any():
        hi = np.where(short, hi * 2, hi)
    lo = np.full_like(hi, -1.0)
    while (hi - lo > 1).any():
        mid = np.floor((lo + hi) / 2)
        up = cdf(mid, mu, phi) >= p
        hi, lo = np.where(up, mid, hi), np.where(up, lo, mid)
    return hi


def combat_seq(expr: DataFrame) -> DataFrame:
    """gene_id, sample_id, platform, value: counts without platform effects, for (gene_id, sample_id, platform, value).

    Samples are few (a row each comes to the driver with platform and library size). Genes that are zero throughout a
    platform stay as they are, as do counts of 0 and 1, and everything where there is one platform only.
    """
    counts = expr.select("gene_id", "sample_id", "platform", F.round(F.greatest("value", F.lit(0.0))).alias("value"))
    rows = counts.groupBy("sample_id").agg(F.first("platform").alias("platform"), F.sum("value").alias("size")).orderBy("sample_id").collect()
    size = np.maximum(np.array([r["size"] for r in rows], float), 1.0)
    batches = {b: np.array([i for i, r in enumerate(rows) if r["platform"] == b]) for b in sorted({r["platform"] for r in rows})}
    if len(batches) < 2:
        return counts
    vectors = to_vectors(counts)

    def blocks(frames):
        for f in frames:
            if len(f):
                y = np.stack([np.asarray(v, float) for v in f["values"]])
                fit = np.all([y[:, at].sum(1) > 0 for at in batches.values()], axis=0)
                yield f, y, fit

    def curves(frames):
        for _, y, fit in blocks(frames):
            for b, at in batches.items():
                yield pd.DataFrame([(b, k, float(likelihood(y[fit][:, at], size[at], phi).sum()), int(fit.sum())) for k, phi in enumerate(GRID)], columns=["b", "k", "ll", "n"])

    common = {b: np.zeros(len(GRID)) for b in batches}
    summed = vectors.mapInPandas(curves, "b string, k int, ll double, n long").groupBy("b", "k").agg((F.sum("ll") / F.nullif(F.sum("n"), F.lit(0))).alias("ll"))
    for r in summed.collect():  # a row per platform and grid point
        common[r["b"]][r["k"]] = r["ll"] or 0.0

    def correct(frames):
        for f, y, fit in blocks(frames):
            own, out = y[fit], y.copy()
            rate, phi = {}, {}
            for b, at in batches.items():
                ll = np.stack([likelihood(own[:, at], size[at], p) for p in GRID], axis=1)
                phi[b] = GRID[(ll + PRIOR_DF / max(len(at) - 1, 1) * common[b]).argmax(1)] if len(own) else np.zeros(0)
                rate[b] = rates(own[:, at], size[at], phi[b])
            free = np.exp(sum(len(at) / len(size) * np.log(rate[b]) for b, at in batches.items()))
            free_phi = np.mean(list(phi.values()), axis=0)
            made = own.copy()
            for b, at in batches.items():
                grid = lambda v, at=at: np.broadcast_to(v[:, None], (len(own), len(at)))
                p = cdf(own[:, at] - 1, rate[b][:, None] * size[at], grid(phi[b]))
                moved = 1 + quantile(np.minimum(p, 1 - 1e-4), free[:, None] * size[at], grid(free_phi))
                made[:, at] = np.where((own[:, at] <= 1) | (p > 1 - 1e-4), own[:, at], moved)
            out[fit] = made
            yield pd.DataFrame({"gene_id": f["gene_id"], "values": list(out)})

    places = expr.sparkSession.createDataFrame([(i, r["sample_id"], r["platform"]) for i, r in enumerate(rows)], "pos int, sample_id string, platform string")
    fixed = vectors.mapInPandas(correct, "gene_id string, values array<double>")
    return fixed.select("gene_id", F.posexplode("values").alias("pos", "value")).join(F.broadcast(places), "pos").select("gene_id", "sample_id", "platform", "value")
