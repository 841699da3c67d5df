"""Descriptive statistics, normalisation and simple predicates over the long layout (gene_id, sample_id, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import avg_rank
from ..functions.quantiles import quantiles
from ..functions.stages import cut


def basic_stats(expr: DataFrame) -> DataFrame:
    """Genes, samples, the mean of samples' means and the median of samples' medians."""
    by = expr.groupBy("sample_id").agg(F.avg("value").alias("m"), F.median("value").alias("md"), F.countDistinct("gene_id").alias("g"))
    return by.agg(F.max("g").alias("n_genes"), F.count("*").alias("n_samples"), F.avg("m").alias("mean_of_means"), F.median("md").alias("median_of_medians"))


def gene_stats(expr: DataFrame) -> DataFrame:
    """gene_id, mean, std (sample), cv (null where the mean is 0)."""
    out = expr.groupBy("gene_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"))
    return out.withColumn("cv", F.when(F.col("mean") != 0, F.col("std") / F.nullif(F.col("mean"), F.lit(0.0))))


def consistent_genes(expr: DataFrame, quantile: float = 0.3, threshold: float | None = None) -> DataFrame:
    """Genes whose cv is within the lowest ``quantile``; with ``threshold`` only genes over it in every sample."""
    stats = gene_stats(expr)
    if threshold is not None:
        stats = stats.filter(F.col("least") > threshold)
    stats = cut(stats)
    limit = quantiles(stats, "cv", [quantile])
    return stats.join(F.broadcast(limit), F.col("cv") <= F.col("q")[0]).select("gene_id", "mean", "std", "cv")


def constant_genes(expr: DataFrame, most: float = 0.2) -> DataFrame:
    out = expr.groupBy("gene_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return out.withColumn("ratio", F.col("std") / (F.col("mean") + 1e-10)).filter(F.col("ratio") <= most)


def normalise(expr: DataFrame, method: str) -> DataFrame:
    """log1p, log2, zscore or quantile (mean rank / n) within each sample, as column ``norm``."""
    by = W.partitionBy("sample_id")
    value = {
        "log1p": F.log1p("value"),
        "log2": F.log2(F.col("value") + 1e-10),
        "zscore": (F.col("value") - F.avg("value").over(by)) / F.nullif(F.stddev_samp("value").over(by), F.lit(0.0)),
        "quantile": avg_rank("value", "sample_id") / F.count("*").over(by),
    }[method]
    return expr.withColumn("norm", value)


def group_zscore(df: DataFrame, group: str, value: str) -> DataFrame:
    """Column ``z``: distance from the group's mean in its population deviations."""
    stats = df.groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(F.broadcast(stats), group).withColumn("z", (F.col(value) - F.col("_m")) / F.nullif("_s", F.lit(0.0))).drop("_m", "_s")


def replace_zeros(expr: DataFrame) -> DataFrame:
    """Zeros become a tenth of the least positive value of the matrix."""
    least = expr.agg(F.min(F.when(F.col("value") > 0, F.col("value"))).alias("_least"))
    return expr.join(F.broadcast(least)).withColumn("value", F.when(F.col("value") == 0, F.col("_least") * 0.1).otherwise(F.col("value"))).drop("_least")


def high_low(target: DataFrame) -> DataFrame:
    """sample_id, y, tg_group: "High TG" from the median on."""
    middle = target.agg(F.median("y").alias("_cut"))
    return target.join(F.broadcast(middle)).select("sample_id", "y", F.when(F.col("y") >= F.col("_cut"), "High TG").otherwise("Low TG").alias("tg_group"))


def expressed_per_sample(expr: DataFrame) -> DataFrame:
    return expr.groupBy("sample_id").agg(F.count_if(F.col("value") > 0).alias("n_expressed"))


def impute_row_mean(expr: DataFrame) -> DataFrame:
    return expr.withColumn("value", F.coalesce("value", F.avg("value").over(W.partitionBy("gene_id"))))
