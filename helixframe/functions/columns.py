"""Statistics as Columns and DataFrame steps; all run in the JVM except the tail probabilities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import special
from .stages import cut


def avg_rank(value: str, *by: str) -> Column:
    """Rank of ``value`` within ``by``; ties share their mean rank."""
    part = W.partitionBy(*by)
    return F.rank().over(part.orderBy(value)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2.0


def safe_corr(x: str, y: str) -> Column:
    """Pearson r as an aggregate; 0 if either side does not vary."""
    sd = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.stddev_pop(x) > 1e-9) & (F.stddev_pop(y) > 1e-9), F.covar_pop(x, y) / sd).otherwise(F.lit(0.0))


#: Ranges that a whole-table order is cut into; a range is a task's share.
RANGES = 64


def _ranged(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """``df`` with _range, the place of ``value`` among quantiles of its group: equal values share a range. Groups in
    ``by`` are few (methods, features), so a row of quantiles each is broadcast."""
    cuts = F.percentile_approx(value, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])).alias("_cuts")
    bounds = df.groupBy(*by).agg(cuts)
    near = df.join(F.broadcast(bounds), list(by)) if by else df.join(F.broadcast(bounds))
    return near.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def _offsets(ranged: DataFrame, by: tuple[str, ...], *aggs: Column) -> DataFrame:
    """A row per group and range: _before, the rows in earlier ranges, _total, and ``aggs``."""
    sizes = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_c"), *aggs)
    part = W.partitionBy(*by)
    return sizes.withColumn("_before", F.coalesce(F.sum("_c").over(part.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_c").over(part))


def spread_rank(df: DataFrame, value: str, out: str, *by: str, total: str | None = None) -> DataFrame:
    """``df`` with the mean-tie rank of ``value`` within the few groups ``by`` (or the whole table) as ``out``, and the
    rows of the group as ``total``. Values are counted first, then ordered range by range, so no task sorts a group."""
    counts = cut(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n")))
    counts = _ranged(counts, value, by)
    own = W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranked = counts.withColumn("_own", F.coalesce(F.sum("_n").over(own), F.lit(0))).join(F.broadcast(_offsets(counts, by)), [*by, "_range"])
    ranked = ranked.select(*by, value, (F.col("_before") + F.col("_own") + (F.col("_n") + 1) / 2.0).alias(out), *([F.col("_total").alias(total)] if total else []))
    return df.join(ranked, [*by, value])


def spread_position(df: DataFrame, value: str, key: str, out: str, descending: bool = False) -> DataFrame:
    """``df`` with the place (from 1) of each row in the order of ``value``, then ``key``, over the whole table."""
    own = cut(df.withColumn("_v", -F.col(value) if descending else F.col(value)).withColumn("_n", F.lit(1)))
    ranged = _ranged(own, "_v", ())
    place = F.row_number().over(W.partitionBy("_range").orderBy("_v", key))
    return ranged.withColumn("_k", place).join(F.broadcast(_offsets(ranged, ())), "_range").withColumn(out, F.col("_k") + F.col("_before")).drop("_v", "_n", "_k", "_c", "_range", "_before", "_total")


def benjamini_hochberg(df: DataFrame, p: str, out: str, *by: str) -> DataFrame:
    """Adjusted p: the least p * m / rank at or above each rank, at most 1; null p stays null and is not counted.

    Groups in ``by`` are few. Equal p are one row with a count, so a usual value (p = 1) is nobody's load; those rows are
    ranked and the least is carried down range by range, so no task has a whole group.
    """
    df = cut(df)
    ranged = _ranged(cut(df.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("_n"))), p, by)
    up = W.partitionBy(*by, "_range").orderBy(p).rowsBetween(W.unboundedPreceding, 0)
    ranked = ranged.withColumn("_k", F.sum("_n").over(up)).join(F.broadcast(_offsets(ranged, by)), [*by, "_range"])
    scaled = ranked.withColumn("_q", F.col(p) * F.col("_total") / (F.col("_before") + F.col("_k")))
    least = scaled.groupBy(*by, "_range").agg(F.min("_q").alias("_least"))
    later = least.withColumn("_later", F.min("_least").over(W.partitionBy(*by).orderBy("_range").rowsBetween(1, W.unboundedFollowing))).drop("_least")
    down = W.partitionBy(*by, "_range").orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    best = scaled.withColumn("_own", F.min("_q").over(down)).join(F.broadcast(later), [*by, "_range"])
    values = best.select(*by, p, F.least(F.lit(1.0), "_own", "_later").alias(out))
    return df.join(values, [*by, p], "left").select(*df.columns, out)


def bonferroni(df: DataFrame, p: str, out: str) -> DataFrame:
    """p times the number of tests, at most 1."""
    total = df.agg(F.count(p).alias("_m"))
    return df.join(F.broadcast(total)).withColumn(out, F.least(F.lit(1.0), F.col(p) * F.col("_m"))).drop("_m")


def adjusted(df: DataFrame, p: str, out: str, method: str = "fdr_bh") -> DataFrame:
    """p adjusted by "fdr_bh", "bonferroni" or not at all ("none")."""
    return {"fdr_bh": benjamini_hochberg, "bonferroni": bonferroni, "none": lambda d, a, b: d.withColumn(b, F.col(a))}[method](df, p, out)


def fold(key: str, k: int, seed: int = 42) -> Column:
    """A fold from 0 to k - 1 by a hash of the key: the same however the table is partitioned."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(k)).cast("int")


def held_out(key: str, share: float = 0.2, seed: int = 42) -> Column:
    """Whether a row belongs to the held-out ``share``, by a hash of the key."""
    return F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000)


def stratified_fold(key: str, label: str, k: int, *by: str, seed: int = 42) -> Column:
    """Folds of equal size within each value of ``label`` (and group of ``by``): places in hash order, dealt in turn."""
    return (F.row_number().over(W.partitionBy(*by, label).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)) - 1) % k


def cohens_d(n1, m1, v1, n2, m2, v2) -> Column:
    """From counts, means and sample variances; null under two values, 0 or signed infinity without spread."""
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / F.nullif(n1 + n2 - 2, F.lit(0)))
    flat = F.when(F.abs(m1 - m2) < 1e-9, 0.0).when(m1 > m2, float("inf")).otherwise(float("-inf"))
    value = F.when((v1 < 1e-9) & (v2 < 1e-9), F.lit(0.0)).when(pooled < 1e-9, flat).otherwise((m1 - m2) / F.nullif(pooled, F.lit(0.0)))
    return F.when((n1 >= 2) & (n2 >= 2), value)


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(special.t_two_sided(t, df))


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(special.f_tail(f, d1.to_numpy(float), d2.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(special.chi2_tail(x, df))


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series(special.normal_two_sided(z))


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    tables, place = np.unique(np.stack([a, b, c, d], axis=1), axis=0, return_inverse=True)  # k-mer tables repeat
    return pd.Series(np.array([special.fisher_two_sided(*map(int, x)) for x in tables], float)[place.ravel()])


@F.pandas_udf(T.DoubleType())
def ks_two_sample_p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    keys, place = np.unique(np.stack([d.round(12), n1, n2], axis=1), axis=0, return_inverse=True)
    return pd.Series(np.array([special.ks_two_sample(x, int(m), int(n)) for x, m, n in keys], float)[place.ravel()])


def welch_p(t: str, v1: str, n1: str, v2: str, n2: str) -> Column:
    """Two-sided p of Welch's t, with the Welch-Satterthwaite degrees of freedom."""
    a, b = F.col(v1) / F.col(n1), F.col(v2) / F.col(n2)
    df = (a + b) * (a + b) / F.nullif(a * a / (F.col(n1) - 1) + b * b / (F.col(n2) - 1), F.lit(0.0))
    return t_p(t, df)


def mann_whitney_p(u: str, n1: str, n2: str, ties: str) -> Column:
    """Two-sided p of U by the normal approximation, with continuity and tie correction (``ties``: sum of t^3 - t)."""
    n = F.col(n1) + F.col(n2)
    var = F.col(n1) * F.col(n2) / 12.0 * (n + 1 - F.col(ties) / (n * (n - 1)))
    z = F.greatest(F.abs(F.col(u) - F.col(n1) * F.col(n2) / 2.0) - 0.5, F.lit(0.0)) / F.nullif(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0))
    return F.coalesce(normal_p(z), F.lit(1.0))


def corr_p(r: str, n: str) -> Column:
    """Two-sided p of a correlation over n pairs; 1 for r = 0, 0 for |r| = 1."""
    df = F.col(n) - 2
    return F.when(F.abs(r) >= 1, 0.0).otherwise(t_p(F.col(r) * F.sqrt(df / F.greatest(1 - F.col(r) * F.col(r), F.lit(1e-300))), df.cast("double")))


def r6(c: Column | str) -> Column:
    """Rounded to six places, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
