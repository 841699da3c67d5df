"""Sample-space validation: PCA, silhouette, neighbour mixing, and what a correction does to them.

Samples are the small side of an expression matrix: some numbers a sample and component come to the driver, never one a
pair of samples. Genes stay in tasks, which sum products of theirs. Silhouettes and neighbours are exact and leave out
what bounds rule out, see ``metric``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import f_p
from ..functions.decomposition import leading_columns, summed
from ..functions.stages import cut
from ..sources.matrix import to_vectors
from . import batch, metric


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(a, float) for a in column])


def _scaled(v: np.ndarray, scale: bool) -> np.ndarray:
    v = v - v.mean(axis=1, keepdims=True)
    if scale:
        sd = v.std(axis=1, keepdims=True)
        v = v / np.where(sd < 1e-12, 1.0, sd)
    return v


def _eigen(vectors: DataFrame, samples: int, components: int, scale: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvectors, eigenvalues, their whole sum) of the samples' products over centred (and scaled) genes; these are
    never made, see ``leading_columns``. ``vectors`` is read several times."""
    return leading_columns(vectors, lambda f: _scaled(_stack(f["values"]), scale), samples, components)


def sample_pca(vectors: DataFrame, samples: int, components: int = 2, scale: bool = False) -> np.ndarray:
    """Principal components of samples from (gene_id, values)."""
    u, w, _ = _eigen(cut(vectors), samples, components, scale)
    return u * np.sqrt(w)


def samples_of(expr: DataFrame) -> list[tuple[str, str]]:
    """(sample_id, platform) in order: a row a sample."""
    return [(r["sample_id"], r["platform"]) for r in expr.groupBy("sample_id").agg(F.min("platform").alias("platform")).orderBy("sample_id").collect()]


def _points(expr: DataFrame, names: list[tuple[str, str]], coordinates: np.ndarray) -> DataFrame:
    """vec_id, embedding, label (the platform's number), platform."""
    labels = {p: i for i, p in enumerate(sorted({p for _, p in names}))}
    rows = [(i, [float(x) for x in v], labels[p], p) for i, ((_, p), v) in enumerate(zip(names, coordinates, strict=True))]
    return expr.sparkSession.createDataFrame(rows, "vec_id long, embedding array<double>, label int, platform string")


def detect_batch_effect(expr: DataFrame) -> DataFrame:
    """n_platforms, pct_affected (genes with raw ANOVA p under .05, of all) and the silhouette of platforms on two
    principal components of the samples with a known platform."""
    known = expr.filter("platform <> 'Unknown'")
    names = samples_of(known)
    pcs = sample_pca(to_vectors(known), len(names), 2)
    shape = silhouette(_points(known, names, pcs)).withColumn("n_platforms", F.lit(len({p for _, p in names})))
    return shape.join(F.broadcast(batch.affected_share(known))).select("n_platforms", "pct_affected", "silhouette")


def needs_correction(detected: DataFrame, pct: float = 20.0, silhouette: float = 0.1) -> bool:
    """Whether to correct: several platforms, and more than ``pct`` per cent affected or |silhouette| over its limit."""
    row = detected.first()
    return row["n_platforms"] > 1 and (row["pct_affected"] > pct or abs(row["silhouette"] or 0.0) > silhouette)


def remove_unwanted(expr: DataFrame, components: int = 10, alpha: float = 0.05) -> DataFrame:
    """Values rebuilt from the first ``components`` principal components of the samples without those that differ
    between platforms (ANOVA p under ``alpha``); a gene's mean stays."""
    names = samples_of(expr)
    vectors = cut(to_vectors(expr))
    u, w, _ = _eigen(vectors, len(names), min(components, len(names)), False)
    spark = expr.sparkSession
    scores = spark.createDataFrame([(f"pc{k}", s, p, float(u[i, k])) for k in range(u.shape[1]) for i, (s, p) in enumerate(names)], "gene_id string, sample_id string, platform string, value double")
    tested = batch.anova(scores).withColumn("p", f_p("f", F.col("df1").cast("double"), F.col("df2").cast("double")))
    gone = {int(r["gene_id"][2:]) for r in tested.filter(F.col("p") < alpha).collect()}  # a row a component
    kept = u[:, [k for k in range(u.shape[1]) if k not in gone]]

    def rebuild(frames):
        for f in frames:
            if len(f):
                v = _stack(f["values"])
                m = v.mean(axis=1, keepdims=True)
                yield pd.DataFrame({"gene_id": f["gene_id"], "values": list(m + (v - m) @ kept @ kept.T)})

    places = spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate(names)], "pos int, sample_id string, platform string")
    made = vectors.mapInPandas(rebuild, "gene_id string, values array<double>").select("gene_id", F.posexplode("values").alias("pos", "value"))
    return made.join(F.broadcast(places), "pos").select("gene_id", "sample_id", "platform", "value")


def stage_pca(stages: dict[str, DataFrame], components: int = 2) -> DataFrame:
    """stage, sample_id, platform, pc1, pc2, ... and the share of variance of each, for matrices before and after steps."""
    rows = []
    for stage, expr in stages.items():
        names = samples_of(expr)
        u, w, total = _eigen(cut(to_vectors(expr)), len(names), components, False)
        rows += [(stage, s, p, *map(float, u[i] * np.sqrt(w)), *[float(x / (total or 1)) for x in w]) for i, (s, p) in enumerate(names)]
    cols = [f"pc{k + 1} double" for k in range(components)] + [f"explained{k + 1} double" for k in range(components)]
    return next(iter(stages.values())).sparkSession.createDataFrame(rows, "stage string, sample_id string, platform string, " + ", ".join(cols))


def validate_correction(before: DataFrame, after: DataFrame, components: int = 10, k: int = 15, alpha: float = 0.05) -> DataFrame:
    """stage (before, after), silhouette, same_label_share and ks_share: samples on the principal components of the
    matrix before (genes scaled by its moments, for both), and the share of genes and platform pairs whose distributions
    differ (Kolmogorov-Smirnov p under ``alpha``)."""
    names = samples_of(before)
    n = len(names)
    both = cut(to_vectors(before).withColumnRenamed("values", "old").join(to_vectors(after).withColumnRenamed("values", "new"), "gene_id"))
    u, w, _ = _eigen(both.select("gene_id", F.col("old").alias("values")), n, min(components, n), True)
    inverse = u / np.sqrt(np.maximum(w, 1e-12))

    def project(f: pd.DataFrame) -> np.ndarray:
        old, new = _stack(f["old"]), _stack(f["new"])
        sd = old.std(axis=1, keepdims=True)
        sd = np.where(sd < 1e-12, 1.0, sd)
        m = old.mean(axis=1, keepdims=True)
        return ((new - m) / sd).T @ ((old - m) / sd @ inverse)

    scores = {"before": u * np.sqrt(w), "after": summed(both, project, (n, u.shape[1]))}
    out = None
    for stage, expr in (("before", before), ("after", after)):
        points = _points(before, names, scores[stage])
        ks = batch.ks_tests(expr).agg((F.count_if(F.col("p_value") < alpha) / F.nullif(F.count("*"), F.lit(0))).alias("ks_share"))
        own = silhouette(points).join(F.broadcast(knn_mixing(points, k))).join(F.broadcast(ks)).withColumn("stage", F.lit(stage))
        out = own if out is None else out.unionByName(own)
    return out.select("stage", "silhouette", "same_label_share", "ks_share")


def silhouette(points: DataFrame) -> DataFrame:
    """Mean silhouette over all points of (vec_id, embedding, label); 0 for a point alone in its label."""
    return metric.silhouettes(points).agg((F.sum(F.col("s") * F.col("copies")) / F.nullif(F.sum("copies"), F.lit(0))).alias("silhouette"))


def knn_mixing(points: DataFrame, k: int = 15) -> DataFrame:
    """Mean share of the same label among each point's ``k`` nearest others (lower is better mixed); ties by id."""
    return metric.label_shares(points, k).agg(F.avg("share").alias("same_label_share"))
