"""The tables behind the plots; pixels are left to whoever draws them. All are bounded by the top genes asked for."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_corr


def top_genes(scores: DataFrame, by: str, n: int) -> DataFrame:
    return scores.orderBy(F.desc(F.round(F.abs(by), 9)), "gene_id").limit(n).select("gene_id")


def scatter_matrix(x: DataFrame, genes: DataFrame) -> DataFrame:
    """A row a sample: y and a column per gene of ``genes`` (a few), without samples that lack a value."""
    names = sorted(r["gene_id"] for r in genes.collect())
    own = x.join(F.broadcast(genes), "gene_id", "left_semi")
    return own.groupBy("sample_id").pivot("gene_id", names).agg(F.first("value")).join(x.select("sample_id", "y").distinct(), "sample_id").dropna()


def expression_by_platform(expr: DataFrame, genes: DataFrame) -> DataFrame:
    """gene_id, platform, sample_id, value of ``genes``."""
    return expr.join(F.broadcast(genes), "gene_id", "left_semi").select("gene_id", "platform", "sample_id", "value")


def platform_heatmap(expr: DataFrame, effects: DataFrame | None = None, n: int = 50) -> DataFrame:
    """gene_id, platform, sample_id, z (by the gene's population deviation) of the ``n`` genes with the least adjusted p;
    by variance where there are no effects."""
    if effects is not None:
        best = effects.orderBy("kruskal_pvalue_adj", "gene_id").limit(n).select("gene_id")
    else:
        best = expr.groupBy("gene_id").agg(F.var_pop("value").alias("v")).orderBy(F.desc("v"), "gene_id").limit(n).select("gene_id")
    own = expr.join(F.broadcast(best), "gene_id", "left_semi")
    stats = own.groupBy("gene_id").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = F.coalesce((F.col("value") - F.col("_m")) / F.nullif("_s", F.lit(0.0)), F.lit(0.0))
    return own.join(F.broadcast(stats), "gene_id").select("gene_id", "platform", "sample_id", z.alias("z"))


def feature_correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """feature1, feature2, r of every pair, over rows that have both: one aggregate."""
    pairs = list(combinations(features, 2))
    both = lambda a, b: (F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double")))
    wide = df.select(*[c.alias(f"_{i}{s}") for i, (a, b) in enumerate(pairs) for s, c in zip("xy", both(a, b), strict=True)])
    row = wide.agg(*[safe_corr(f"_{i}x", f"_{i}y").alias(f"{a}*{b}") for i, (a, b) in enumerate(pairs)])
    out = row.unpivot([], [f"{a}*{b}" for a, b in pairs], "pair", "r")
    return out.select(F.split("pair", "\\*")[0].alias("feature1"), F.split("pair", "\\*")[1].alias("feature2"), "r")


def region_summary(rows: DataFrame, region: str = "region", value: str = "value") -> DataFrame:
    """Mean, deviation, least and largest value of each region."""
    return rows.groupBy(region).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
