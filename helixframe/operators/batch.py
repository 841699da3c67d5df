"""Platform (batch) effects: tests, effect sizes, correction. Moments combine on the map side: one shuffle by gene."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import avg_rank, benjamini_hochberg, chi2_p, cohens_d, f_p, ks_two_sample_p


def anova(expr: DataFrame) -> DataFrame:
    """gene_id, f, df1, df2 of a one-way ANOVA over platforms; f is null without spread within platforms."""
    by = expr.groupBy("gene_id", "platform").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")).filter("n > 0")
    all_ = by.groupBy("gene_id").agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = by.join(all_.select("gene_id", "gm"), "gene_id").groupBy("gene_id").agg(F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))).alias("between"))
    out = all_.join(between, "gene_id").withColumn("df1", F.col("k") - 1).withColumn("df2", F.col("n") - F.col("k"))
    f = (F.col("between") / F.nullif("df1", F.lit(0))) / F.nullif(F.col("within") / F.nullif("df2", F.lit(0)), F.lit(0.0))
    return out.select("gene_id", f.alias("f"), "df1", "df2")


def kruskal(expr: DataFrame) -> DataFrame:
    """gene_id, h (tie-corrected), df, flat (a platform has one value only: p is 1 there)."""
    ranked = expr.withColumn("r", avg_rank("value", "gene_id"))
    by = ranked.groupBy("gene_id", "platform").agg(F.count("*").alias("n"), F.sum("r").alias("rs"), (F.min("value") == F.max("value")).alias("flat"))
    sums = by.groupBy("gene_id").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("rs") * F.col("rs") / F.col("n")).alias("q"), F.bool_or("flat").alias("flat"))
    ties = expr.groupBy("gene_id", "value").agg(F.count("*").alias("t")).groupBy("gene_id").agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n")
    raw = 12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    h = raw / F.nullif(1 - F.col("ties") / (n * n * n - n), F.lit(0.0))
    return sums.join(ties, "gene_id").select("gene_id", h.alias("h"), (F.col("k") - 1).alias("df"), "flat")


def residual_effects(expr: DataFrame) -> DataFrame:
    """ANOVA and Kruskal-Wallis p per gene, each adjusted; platforms with one sample are left out."""
    big = expr.groupBy("platform").agg(F.countDistinct("sample_id").alias("n")).filter("n >= 2").select("platform")
    own = expr.join(F.broadcast(big), "platform")
    a = anova(own).withColumn("anova_pvalue", F.coalesce(f_p("f", F.col("df1").cast("double"), F.col("df2").cast("double")), F.lit(1.0)))
    k = kruskal(own).withColumn("kruskal_pvalue", F.when(F.col("flat") | F.col("h").isNull(), 1.0).otherwise(chi2_p(F.coalesce("h", F.lit(0.0)), F.col("df").cast("double"))))
    both = a.select("gene_id", "anova_pvalue").join(k.select("gene_id", "kruskal_pvalue"), "gene_id")
    return benjamini_hochberg(benjamini_hochberg(both, "anova_pvalue", "anova_pvalue_adj"), "kruskal_pvalue", "kruskal_pvalue_adj")


def affected_share(expr: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per cent of all genes whose raw ANOVA p is under ``alpha``."""
    p = anova(expr).withColumn("p", f_p("f", F.col("df1").cast("double"), F.col("df2").cast("double")))
    return p.agg((100.0 * F.count_if(F.col("p") < alpha) / F.count("*")).alias("pct_affected"))


def platform_bias(expr: DataFrame) -> DataFrame:
    """Per gene and platform against all others: mean difference, variance ratio, Cohen's d (sample variances)."""
    own = expr.groupBy("gene_id", "platform").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    a, b = own.alias("a"), own.alias("b")
    # the rest's moments from the other platforms' moments: no second pass over values
    pairs = a.join(b, F.expr("a.gene_id = b.gene_id and a.platform <> b.platform"))
    rest = pairs.groupBy("a.gene_id", "a.platform").agg(
        F.first("a.n").alias("n1"), F.first("a.m").alias("m1"), F.first("a.v").alias("v1"), F.sum("b.n").alias("n2"), (F.sum(F.expr("b.n * b.m")) / F.sum("b.n")).alias("m2"),
        F.collect_list(F.struct("b.n", "b.m", "b.v")).alias("parts"),
    )
    ss = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + F.coalesce(p["v"], F.lit(0.0)) * (p["n"] - 1) + p["n"] * (p["m"] - F.col("m2")) * (p["m"] - F.col("m2")))
    moments = rest.withColumn("v2", ss / F.nullif(F.col("n2") - 1, F.lit(0)))
    ratio = F.when(F.col("v2") > 1e-9, F.col("v1") / F.nullif("v2", F.lit(0.0))).when(F.col("v1") > 1e-9, float("inf")).otherwise(1.0)
    d = cohens_d(*[F.col(c) for c in ("n1", "m1", "v1", "n2", "m2", "v2")])
    return moments.select("gene_id", "platform", (F.col("m1") - F.col("m2")).alias("mean_difference"), ratio.alias("variance_ratio"), d.alias("cohen_d"))


def problem_platform(bias: DataFrame) -> DataFrame:
    """The platform with the largest mean |d|, the first by name where several have it."""
    by = bias.groupBy("platform").agg(F.avg(F.abs("cohen_d")).alias("mean_abs_d"))
    return by.orderBy(F.desc(F.round("mean_abs_d", 9)), "platform").limit(1)


def location_scale(expr: DataFrame, problem: str, target_gene: str | None = None) -> DataFrame:
    """Values of the ``problem`` platform moved and scaled to the other platforms' mean and population deviation."""
    own = F.col("platform") == problem
    stats = expr.groupBy("gene_id").agg(*[f(F.when(c, F.col("value"))).alias(n) for n, f, c in (("mp", F.avg, own), ("sp", F.stddev_pop, own), ("mr", F.avg, ~own), ("sr", F.stddev_pop, ~own))])
    moved = F.when(F.col("sp") < 1e-6, F.col("value") - F.col("mp") + F.col("mr")).otherwise((F.col("value") - F.col("mp")) / F.nullif("sp", F.lit(0.0)) * F.col("sr") + F.col("mr"))
    touch = own if target_gene is None else own & (F.col("gene_id") != target_gene)
    return expr.join(stats, "gene_id").select("gene_id", "sample_id", "platform", F.when(touch, moved).otherwise(F.col("value")).alias("value"))


def preservation(before: DataFrame, after: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Per gene: correlation of values before and after, and whether all are close."""
    both = before.select("gene_id", "sample_id", F.col("value").alias("a")).join(after.select("gene_id", "sample_id", F.col("value").alias("b")), ["gene_id", "sample_id"])
    r = F.when((F.stddev_pop("a") > 1e-9) & (F.stddev_pop("b") > 1e-9), F.covar_pop("a", "b") / (F.stddev_pop("a") * F.stddev_pop("b"))).otherwise(1.0)
    return both.groupBy("gene_id").agg(r.alias("r"), F.bool_and(F.abs(F.col("a") - F.col("b")) <= atol + rtol * F.abs("b")).alias("preserved"))


def ks_pairs(expr: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov D per gene and pair of platforms."""
    counts = expr.groupBy("gene_id", "platform", "value").agg(F.count("*").alias("c"))
    sizes = expr.groupBy("gene_id", "platform").agg(F.count("*").alias("n"))
    pairs = sizes.alias("p").join(sizes.alias("q"), F.expr("p.gene_id = q.gene_id and p.platform < q.platform")).select("p.gene_id", F.col("p.platform").alias("p1"), F.col("q.platform").alias("p2"), F.col("p.n").alias("n1"), F.col("q.n").alias("n2"))
    steps = pairs.join(counts, "gene_id").filter("platform = p1 or platform = p2")
    at = steps.groupBy("gene_id", "p1", "p2", "n1", "n2", "value").agg(F.sum(F.when(F.col("platform") == F.col("p1"), F.col("c") / F.col("n1")).otherwise(-F.col("c") / F.col("n2"))).alias("s"))
    from pyspark.sql import Window as W

    gap = at.withColumn("g", F.abs(F.sum("s").over(W.partitionBy("gene_id", "p1", "p2").orderBy("value").rowsBetween(W.unboundedPreceding, 0))))
    return gap.groupBy("gene_id", "p1", "p2").agg(F.max("g").alias("d"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))


def combat(expr: DataFrame, covariate: str | None = None) -> DataFrame:
    """Parametric empirical-Bayes correction of platform location and scale (Johnson et al. 2007), as column value.

    With ``covariate`` (a numeric column of the sample) what goes with it is kept: its slope within platforms is fitted
    with the platforms' means. Pass 1 standardises genes by pooled moments; pass 2 takes each platform's hyper-parameters
    over all genes (a row a platform); then every gene's platform effects are shrunk by the fixed-point rule.
    """
    c = F.col(covariate).cast("double") if covariate else F.lit(0.0)
    expr = expr.withColumn("_c", c)
    own = expr.groupBy("gene_id", "platform").agg(
        F.count("*").alias("n"), F.avg("value").alias("my"), F.var_pop("value").alias("vy"), F.avg("_c").alias("mc"), F.var_pop("_c").alias("vc"), F.covar_pop("value", "_c").alias("vyc"))
    slope = own.groupBy("gene_id").agg(F.coalesce(F.sum(F.col("n") * F.col("vyc")) / F.nullif(F.sum(F.col("n") * F.col("vc")), F.lit(0.0)), F.lit(0.0)).alias("slope"))
    # moments of what is left without the covariate's part
    own = own.join(slope, "gene_id").withColumn("m", F.col("my") - F.col("slope") * F.col("mc"))
    own = own.withColumn("v", F.greatest(F.col("vy") - 2 * F.col("slope") * F.col("vyc") + F.col("slope") * F.col("slope") * F.col("vc"), F.lit(0.0)))
    pooled = own.groupBy("gene_id").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sqrt(F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("gs"))
    z = own.join(pooled, "gene_id").filter("gs > 1e-9")
    z = z.withColumn("g", (F.col("m") - F.col("gm")) / F.col("gs")).withColumn("d", F.greatest(F.col("v") * F.col("n") / F.nullif(F.col("n") - 1, F.lit(0)) / (F.col("gs") * F.col("gs")), F.lit(1e-9)))
    hyper = z.groupBy("platform").agg(F.avg("g").alias("gbar"), F.var_samp("g").alias("t2"), F.avg("d").alias("dm"), F.var_samp("d").alias("dv"))
    shrink = z.join(F.broadcast(hyper), "platform").select("gene_id", "platform", "gm", "gs", "slope", "n", "g", "d", "gbar", "t2", "dm", "dv")

    def solve(frames):
        for f in frames:
            n, g, d, gbar, t2 = (f[x].to_numpy(float) for x in ("n", "g", "d", "gbar", "t2"))
            dv = np.maximum(f.dv.to_numpy(float), 1e-12)
            dm = f.dm.to_numpy(float)
            a, b = (2 * dv + dm**2) / dv, (dm * dv + dm**3) / dv
            gs, ds = g.copy(), d.copy()
            for _ in range(200):
                g2 = (n * t2 * g + ds * gbar) / (n * t2 + ds)
                d2 = (b + 0.5 * ((n - 1) * d + n * (g - g2) ** 2)) / (n / 2 + a - 1)
                if np.all(np.abs(g2 - gs) < 1e-9) and np.all(np.abs(d2 - ds) < 1e-9):
                    break
                gs, ds = g2, d2
            yield f[["gene_id", "platform", "gm", "gs", "slope"]].assign(gstar=gs, dstar=ds)

    stars = shrink.mapInPandas(solve, "gene_id string, platform string, gm double, gs double, slope double, gstar double, dstar double")
    part = F.col("slope") * F.col("_c")
    fixed = ((F.col("value") - part - F.col("gm")) / F.col("gs") - F.col("gstar")) / F.sqrt("dstar") * F.col("gs") + F.col("gm") + part
    return expr.join(stars, ["gene_id", "platform"], "left").select("gene_id", "sample_id", "platform", F.coalesce(fixed, F.col("value")).alias("value"))


def ks_tests(expr: DataFrame) -> DataFrame:
    """ks_pairs with p; a gene that is constant over both platforms, or a platform with one sample, has no test."""
    return ks_pairs(expr).filter("n1 > 1 and n2 > 1 and d > 0").withColumn("p_value", ks_two_sample_p(F.col("d"), F.col("n1").cast("double"), F.col("n2").cast("double")))


def hierarchical(expr: DataFrame, target_gene: str, alpha: float = 0.01, most: float = 0.05) -> DataFrame:
    """Location-scale correction of the platform that differs most, where over the share ``most`` of genes still have
    platform effects (adjusted Kruskal-Wallis p under ``alpha``) and the target is there; the target keeps its values."""
    if expr.filter(F.col("gene_id") == target_gene).limit(1).count() == 0:
        return expr
    left = residual_effects(expr.filter(F.col("gene_id") != target_gene)).agg((F.count_if(F.col("kruskal_pvalue_adj") < alpha) / F.nullif(F.count("*"), F.lit(0))).alias("s")).first()["s"]
    if (left or 0) <= most:
        return expr
    return location_scale(expr, problem_platform(platform_bias(expr)).first()["platform"], target_gene)


def repaired(effects: DataFrame) -> DataFrame:
    """Residual effects as later steps want them: gene_id as text, missing adjusted p as 1."""
    return effects.withColumn("gene_id", F.col("gene_id").cast("string")).withColumns({c: F.coalesce(c, F.lit(1.0)) for c in effects.columns if c.endswith("_adj")})
