"""Exact quantiles by distributed selection.

Values are counted by bucket of a scale that does not fall as they rise, the bucket that holds a wanted rank is cut into
finer ones, and only the values of the finest bucket are counted one by one. All steps are counts with map-side combine:
no buffer or task ever holds a group's values, equal values are one row, and nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stages import cut

#: Buckets a factor of e on the first, logarithmic scale, and the least size it tells from 0.
STEPS = 1 << 10
SMALLEST = 1e-12
#: Parts of a bucket on the second, linear scale. What is left differs in the last 2^-30 of a value or so.
PARTS = 1 << 20


def _coarse(v: str) -> Column:
    """A bucket that never falls as ``v`` rises: the logarithm's; infinite values have the outermost ones."""
    size = F.when(F.abs(v) == float("inf"), F.lit(1 << 40)).otherwise(F.floor(F.log1p(F.least(F.abs(v), F.lit(1e290)) / SMALLEST) * STEPS))
    return F.when(F.col(v) < 0, -size).otherwise(size)


def _fine(v: str) -> Column:
    """A part of the bucket from ``_lo`` to ``_hi``; bounds and value are halved first, so that no difference is infinite."""
    width = F.col("_hi") / 2 - F.col("_lo") / 2
    return F.when(width > 0, F.least(F.lit(PARTS), F.floor((F.col(v) / 2 - F.col("_lo") / 2) / width * PARTS))).otherwise(F.lit(0)).cast("long")


def _holding(counted: DataFrame, wanted: DataFrame, by: list[str], bucket: str, *keep: str) -> DataFrame:
    """by, _p, _rank and the bucket of each wanted rank: the first whose running count is over it. The rank is then one
    within the bucket. ``wanted`` and the buckets of a group are few."""
    part = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)
    ends = counted.withColumn("_end", F.sum("_c").over(part)).withColumn("_begin", F.col("_end") - F.col("_c"))
    return wanted.join(ends, by).filter((F.col("_rank") >= F.col("_begin")) & (F.col("_rank") < F.col("_end"))).select(*by, "_p", "_side", "_share", (F.col("_rank") - F.col("_begin")).alias("_rank"), bucket, *keep)


def quantiles(df: DataFrame, value: str, at: Sequence[float], *by: str, out: str = "q") -> DataFrame:
    """A row per value of ``by`` (one row in all without): ``out``, an array of the quantiles ``at`` of ``value`` with
    linear interpolation between order statistics, as ``percentile`` has it.

    Nulls and NaN don't count; a group without values has no row, a table without any has one of null. Rows are read
    three times: what ``df`` costs to make should be cut before.
    """
    by = list(by)
    key = [f"_k{i}" for i in range(len(by))]
    own = df.select(*[F.struct(F.col(b).alias("v")).alias(k) for b, k in zip(by, key)], F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    if not by:
        key, own = ["_k"], own.withColumn("_k", F.lit(0))
    coarse = own.withColumn("_a", _coarse("_v")).groupBy(*key, "_a").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # a quantile lies between the orders floor(r) and ceil(r), r = p (n - 1)
    total = coarse.groupBy(*key).agg(F.sum("_c").alias("_n"))
    r = F.col("p") * (F.col("_n") - 1)
    each = total.select(*key, "_n", F.posexplode(F.array(*[F.lit(float(p)) for p in at])).alias("_p", "p")).select(*key, "_p", (r - F.floor(r)).alias("_share"), F.explode(F.array(F.floor(r), F.ceil(r))).alias("_rank"))
    wanted = each.groupBy(*key, "_p", "_share").agg(F.array_sort(F.collect_list("_rank")).alias("_r")).select(*key, "_p", "_share", F.posexplode("_r").alias("_side", "_rank"))
    first = cut(_holding(coarse, wanted, key, "_a", "_lo", "_hi"))
    inside = own.withColumn("_a", _coarse("_v")).join(F.broadcast(first.select(*key, "_a", "_lo", "_hi").distinct()), [*key, "_a"]).withColumn("_b", _fine("_v"))
    second = cut(_holding(inside.groupBy(*key, "_a", "_b").agg(F.count("*").alias("_c")), first, [*key, "_a"], "_b"))
    left = inside.join(F.broadcast(second.select(*key, "_a", "_b").distinct()), [*key, "_a", "_b"]).groupBy(*key, "_a", "_b", "_v").agg(F.count("*").alias("_c"))
    third = _holding(left, second, [*key, "_a", "_b"], "_v")
    pairs = third.groupBy(*key, "_p", "_share").agg(F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_l"), F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_h"))
    q = F.when(F.col("_l") == F.col("_h"), F.col("_l")).otherwise((1 - F.col("_share")) * F.col("_l") + F.col("_share") * F.col("_h"))
    rows = pairs.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", q.alias("q")))), lambda s: s["q"]).alias(out))
    if not by:
        return rows.agg(F.first(out).alias(out))
    return rows.select(*[F.col(f"{k}.v").alias(b) for b, k in zip(by, key)], out)
