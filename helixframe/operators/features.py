"""Feature analytics: significance, interactions, group comparison, profiles.

Features are few; rows may be very many. So a feature is never one task's share: ranks are made range by range, moments
combine on the map side, and mutual information is taken over cells of the plane with what their borders need.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import adjusted, cohens_d, corr_p, f_p, mann_whitney_p, safe_corr, spread_position, spread_rank, t_p, welch_p
from ..functions.information import mutual_information
from ..functions.quantiles import quantiles
from ..functions.stages import cut

# Mean and standard deviation of the reference profiles' features.
REFERENCE_PROFILES = {
    "high_expression": {"UTR5_length": (120.0, 30.0), "UTR3_length": (800.0, 150.0), "GC3_content": (65.0, 5.0), "CAI": (0.75, 0.05)},
    "optimal_codons": {"CAI": (0.8, 0.05), "GC3_content": (70.0, 5.0)},
    "stable_mRNA": {"UTR5_length": (100.0, 25.0), "UTR3_length": (600.0, 100.0), "polyA_signal_present": (1.0, 0.0)},
}


def long_features(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """keep..., feature, x without nulls: every feature is then one group of one aggregate."""
    return df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(keep, features, "feature", "x").filter("x is not null")


def significance(df: DataFrame, features: list[str], target: str, p_values: bool = True, key: str | None = None, method: str = "fdr_bh", least: int = 10) -> DataFrame:
    """Pearson and Spearman of each feature with the target, over features with ``least`` rows or more.

    p is at least n^-2 and adjusted over features by ``method``. With ``key`` the mutual information too, by which rows
    are then sorted. Regions follow from the names.
    """
    kept = [target] + ([key] if key else [])
    own = cut(long_features(df, features, kept).filter(F.col(target).isNotNull()))
    ranked = spread_rank(spread_rank(own, "x", "rx", "feature"), target, "ry", "feature")
    out = ranked.groupBy("feature").agg(safe_corr("x", target).alias("pearson_r"), safe_corr("rx", "ry").alias("spearman_rho"), F.count("*").alias("n_samples")).filter(F.col("n_samples") >= least)
    out = out.withColumn("effect_size", (F.abs("pearson_r") + F.abs("spearman_rho")) / 2)
    if p_values:
        floor = 1.0 / (F.col("n_samples") * F.col("n_samples"))
        for r, p in (("pearson_r", "pearson_p"), ("spearman_rho", "spearman_p")):
            raw = out.withColumn(p, F.greatest(corr_p(r, "n_samples"), floor))
            out = adjusted(raw, p, f"{p}_adjusted", method).withColumn(f"{p}_adjusted", F.greatest(f"{p}_adjusted", floor))
        out = out.withColumn("is_significant", (F.col("pearson_p_adjusted") < 0.05) | (F.col("spearman_p_adjusted") < 0.05))
    if key:
        out = out.join(F.broadcast(mutual_information(own, "feature", "x", target, key)), "feature").orderBy(F.desc("mi"), "feature")
    return out


def region(feature: str) -> F.Column:
    """UTR5, CDS or UTR3 by a feature's name."""
    name = F.col(feature)
    return F.when(name.rlike("^UTR5|kozak|TOP|quadruplex"), "UTR5").when(name.rlike("^UTR3|polyA|ARE|miRNA"), "UTR3").otherwise("CDS")


def regional_significance(df: DataFrame, features: list[str], targets: list[str], least: int = 3) -> DataFrame:
    """The library's variant: several targets at once, three rows are enough, with the region of each feature."""
    out = None
    for t in targets:
        own = significance(df, [f for f in features if f != t], t, least=least).withColumn("target", F.lit(t)).withColumn("region", region("feature"))
        out = own if out is None else out.unionByName(own)
    return out


def interactions(df: DataFrame, features: list[str], key: str, information: bool = True) -> DataFrame:
    """Spearman of every pair of features over rows that have all of them, and the pair's mutual information, by which
    pairs are then sorted."""
    # nulls are dropped afterwards: a filter would go below the features and make each twice
    whole = cut(df.select(key, *features)).dropna(subset=features)
    ranked = spread_rank(long_features(whole, features, [key]), "x", "r", "feature")
    wide = ranked.groupBy(key).pivot("feature", features).agg(F.first("r"))
    pairs = list(combinations(features, 2))
    row = wide.agg(*[safe_corr(a, b).alias(f"{a}*{b}") for a, b in pairs])
    out = row.unpivot([], [f"{a}*{b}" for a, b in pairs], "pair", "correlation")
    if information:
        each = F.explode(F.array(*[F.struct(F.lit(f"{a}*{b}").alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])).alias("p")
        mi = mutual_information(whole.select(key, each).select(key, "p.*"), "pair", "x", "y", key)
        out = out.join(F.broadcast(mi), "pair")
    kind = F.when(F.col("correlation") > 0, "synergistic").otherwise("antagonistic")
    named = out.select(F.split("pair", "\\*")[0].alias("feature1"), F.split("pair", "\\*")[1].alias("feature2"), "correlation", *(["mi"] if information else []), kind.alias("interaction_type"))
    return named.orderBy(F.desc("mi"), "feature1", "feature2") if information else named


def interaction_gain(df: DataFrame, pairs: list[tuple[str, str]], y: str, p_values: bool = False) -> DataFrame:
    """For each pair (a, b): R squared of y on a, b and of y on a, b, a*b, from centred moments in one aggregate.

    With ``p_values`` the F test of the product's correlation with y (degrees 1 and n - 2), adjusted over pairs.
    """
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("feature1"), F.lit(q).alias("feature2"), F.col(p).cast("double").alias("a"), F.col(q).cast("double").alias("b")) for p, q in pairs])).alias("p")
    own = df.select(F.col(y).cast("double").alias("y"), each).select("y", "p.*").dropna().withColumn("m", F.col("a") * F.col("b"))
    names = ("a", "b", "m", "y")
    s = own.groupBy("feature1", "feature2").agg(*[F.covar_pop(p, q).alias(f"{p}{q}") for i, p in enumerate(names) for q in names[i:]], F.count("*").alias("n"))
    c = F.col
    det2 = c("aa") * c("bb") - c("ab") * c("ab")
    r2 = (c("ay") * c("ay") * c("bb") - 2 * c("ay") * c("by") * c("ab") + c("by") * c("by") * c("aa")) / F.nullif(det2 * c("yy"), F.lit(0.0))
    # partial covariances given a and b add the third term
    ka, kb = (c("am") * c("bb") - c("bm") * c("ab")) / F.nullif(det2, F.lit(0.0)), (c("bm") * c("aa") - c("am") * c("ab")) / F.nullif(det2, F.lit(0.0))
    left, var = c("my") - ka * c("ay") - kb * c("by"), c("mm") - ka * c("am") - kb * c("bm")
    gain = left * left / F.nullif(var * c("yy"), F.lit(0.0))
    rm = c("my") * c("my") / F.nullif(c("mm") * c("yy"), F.lit(0.0))
    out = s.select("feature1", "feature2", "n", r2.alias("r2_base"), (r2 + gain).alias("r2_full"), gain.alias("delta_r2"), (rm / F.nullif(1 - rm, F.lit(0.0)) * (c("n") - 2)).alias("f"))
    if not p_values:
        return out
    tested = out.withColumn("p_value", f_p(F.coalesce("f", F.lit(0.0)), F.lit(1.0), (F.col("n") - 2).cast("double")))
    return adjusted(tested, "p_value", "p_adjusted").orderBy(F.desc("delta_r2"), "feature1", "feature2")


def group_comparison(df: DataFrame, features: list[str], group: str, least: int = 5, p_values: bool = False, population: bool = False) -> DataFrame:
    """Group 1 against group 0 per feature: means, medians, difference, Cohen's d, Mann-Whitney U, Welch's t.

    Features need ``least`` rows in both groups. With ``p_values`` fold change, both tests' p and U's adjusted.
    ``population`` takes deviations over n instead of n - 1.
    """
    long = cut(long_features(df, features, [group]))
    own = spread_rank(long, "x", "rk", "feature")
    is1, is0 = F.col(group) == 1, F.col(group) == 0
    agg = []
    for tag, cond in (("1", is1), ("0", is0)):
        v = F.when(cond, F.col("x"))
        agg += [F.count(v).alias(f"n{tag}"), F.avg(v).alias(f"mean{tag}"), (F.var_pop(v) if population else F.var_samp(v)).alias(f"v{tag}")]
    out = own.groupBy("feature").agg(*agg, F.sum(F.when(is1, F.col("rk"))).alias("rs")).filter((F.col("n1") >= least) & (F.col("n0") >= least))
    medians = quantiles(long, "x", [0.5], "feature", group).groupBy("feature").agg(*[F.max(F.when(F.col(group) == int(tag), F.col("q")[0])).alias(f"median{tag}") for tag in "10"])
    out = out.join(F.broadcast(medians), "feature")
    d = cohens_d(*[F.col(c) for c in ("n1", "mean1", "v1", "n0", "mean0", "v0")])
    t = (F.col("mean1") - F.col("mean0")) / F.nullif(F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0")), F.lit(0.0))
    u = F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2.0
    out = out.withColumn("difference", F.col("mean1") - F.col("mean0")).withColumn("cohens_d", d).withColumn("u", u).withColumn("t", t)
    base = ["feature", "n1", "n0", "mean1", "mean0", "median1", "median0", "difference", "cohens_d", "u", "t"]
    if not p_values:
        return out.select(*base)
    ties = long.groupBy("feature", "x").agg(F.count("*").alias("c")).groupBy("feature").agg(F.sum((F.col("c") * F.col("c") * F.col("c") - F.col("c")).cast("double")).alias("ties"))
    tested = out.join(F.broadcast(ties), "feature").withColumn("fold_change", F.col("mean1") / F.nullif("mean0", F.lit(0.0)))
    tested = tested.withColumn("mann_whitney_p", mann_whitney_p("u", "n1", "n0", "ties")).withColumn("welch_p", F.coalesce(welch_p("t", "v1", "n1", "v0", "n0"), F.lit(1.0)))
    return adjusted(tested.select(*base, "fold_change", "mann_whitney_p", "welch_p"), "mann_whitney_p", "p_adjusted").withColumn("significant", F.col("p_adjusted") < 0.05)


def category_comparison(df: DataFrame, features: list[str], category: str, reference: str, p_values: bool = True) -> DataFrame:
    """Every category but ``reference`` against it, with at least three rows each and population deviations."""
    names = [r[0] for r in df.select(category).distinct().collect() if r[0] not in (None, reference)]  # a row a category
    out = None
    for n in sorted(names):
        pair = df.filter(F.col(category).isin(n, reference)).withColumn("_g", (F.col(category) == n).cast("int"))
        own = group_comparison(pair, features, "_g", 3, p_values, True).withColumn("category", F.lit(n))
        out = own if out is None else out.unionByName(own)
    return out


def significant_summary(compared: DataFrame, by: str = "category") -> DataFrame:
    """Per category: significant features, and the one with the largest |d|."""
    hit = F.when(F.col("significant"), F.abs("cohens_d"))
    return compared.groupBy(by).agg(F.count_if("significant").alias("n_significant"), F.count("*").alias("n_features"), F.max_by("feature", F.struct(hit, "feature")).alias("strongest"))


def similarity(df: DataFrame, profile: dict[str, tuple[float, float]], key: str = "id") -> DataFrame:
    """Distance of each row from a reference profile (feature -> mean, deviation): z per feature, the mean of |z|,
    1 / (1 + that), and its percentile (mean rank / n). Features with no deviation or not in ``df`` take no part."""
    own = {f: v for f, v in profile.items() if f in df.columns and v[1] > 0}
    z = {f: (F.col(f).cast("double") - m) / sd for f, (m, sd) in own.items()}
    there = sum((F.col(f).isNotNull().cast("int") for f in own), F.lit(0))
    total = sum((F.abs(F.coalesce(v, F.lit(0.0))) for v in z.values()), F.lit(0.0))
    out = cut(df.select(key, *[v.alias(f"{f}_z") for f, v in z.items()], (total / F.nullif(there, F.lit(0))).alias("mean_abs_z")).withColumn("reference_similarity", 1 / (1 + F.col("mean_abs_z"))))
    ranked = spread_rank(out, "reference_similarity", "_r", total="_n")
    return ranked.withColumn("similarity_percentile", F.col("_r") * 100.0 / F.col("_n")).select(*out.columns, "similarity_percentile")


def similarity_bands(similar: DataFrame) -> DataFrame:
    """Mean |z| of each feature for the rows of high (75 per cent on), medium and low (under 25) similarity."""
    p = F.col("similarity_percentile")
    band = F.when(p >= 75, "high").when(p >= 25, "medium").otherwise("low").alias("band")
    zs = [c for c in similar.columns if c.endswith("_z") and c != "mean_abs_z"]
    return similar.groupBy(band).agg(*[F.avg(F.abs(c)).alias(c[:-2]) for c in zs], F.count("*").alias("n"))


def f_regression(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """feature, r, f = r^2 / (1 - r^2) * (n - 2), and f over the largest f."""
    own = long_features(df, features, [target]).groupBy("feature").agg(safe_corr("x", target).alias("r"), F.count("*").alias("n"))
    r2 = F.col("r") * F.col("r")
    out = own.withColumn("f", r2 / F.nullif(1 - r2, F.lit(0.0)) * (F.col("n") - 2))
    return out.withColumn("normalized_importance", F.col("f") / F.nullif(F.max("f").over(W.partitionBy()), F.lit(0.0)))


QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def profiles(df: DataFrame, features: list[str], cv: str, mean: str, key: str = "id", share: float = 0.2) -> DataFrame:
    """Statistics of each feature over all rows and over the ``share`` of rows with the least cv (stability), the largest
    mean (expression), and the least sum of both mean ranks (balanced): mean, and the range from 10 to 90 per cent of the
    subset, widened by a tenth of the mean where it is empty. The other columns are the population's."""
    needed = list(dict.fromkeys([key, cv, mean, *features]))
    own = spread_position(spread_position(df.select(*needed), cv, key, "k1"), mean, key, "k2", descending=True)
    own = spread_rank(own, cv, "r1", total="_rows").withColumn("_m", -F.col(mean))
    own = spread_rank(own, "_m", "r2").withColumn("_s", F.col("r1") + F.col("r2"))
    own = spread_position(own, "_s", key, "k3").withColumn("_top", F.floor(F.col("_rows") * share))
    subsets = (("stability", "k1"), ("expression", "k2"), ("balanced", "k3"))
    flags = cut(own).select(key, *[(F.col(k) <= F.col("_top")).alias(f"in_{n}") for n, k in subsets], *features)
    out = long_features(flags, features, [f"in_{n}" for n, _ in subsets])
    out = cut(out)
    aggs = [F.avg("x").alias("population_mean"), F.stddev_samp("x").alias("population_std")]
    for n, _ in subsets:
        v = F.when(F.col(f"in_{n}"), F.col("x"))
        aggs.append(F.avg(v).alias(f"{n}_profile_mean"))
    wide = out.groupBy("feature").agg(*aggs).join(quantiles(out, "x", QUANTILES, "feature"), "feature")
    each = F.explode(F.array(*[F.when(F.col(f"in_{n}"), F.lit(n)) for n, _ in subsets])).alias("subset")
    ends = quantiles(out.select("feature", "x", each).filter("subset is not null"), "x", [0.1, 0.9], "feature", "subset", out="r")
    ends = ends.groupBy("feature").agg(*[F.max(F.when(F.col("subset") == n, F.col("r"))).alias(f"_{n}") for n, _ in subsets])
    wide = wide.join(ends, "feature", "left")
    cols = [F.col("q")[i].alias(f"population_q{int(q * 100)}") for i, q in enumerate(QUANTILES)]
    for n, _ in subsets:
        lo, hi, m = F.col(f"_{n}")[0], F.col(f"_{n}")[1], F.abs(f"{n}_profile_mean") * 0.1
        cols += [F.col(f"{n}_profile_mean"), F.when(lo < hi, lo).otherwise(lo - m).alias(f"{n}_range_lo"), F.when(lo < hi, hi).otherwise(hi + m).alias(f"{n}_range_hi")]
    return wide.select("feature", region("feature").alias("region"), "population_mean", "population_std", *cols)


def widened(lo: str, hi: str, mean: str, width: float) -> tuple[F.Column, F.Column]:
    """A range at least ``width`` wide: an empty one is laid around the mean (or from its lower end, for mean 0), a
    narrow one around its middle."""
    empty, narrow, half = F.col(lo) >= F.col(hi), F.col(hi) - F.col(lo) < width, width / 2
    middle = F.when(empty & (F.col(mean) == 0), F.col(lo) + half).when(empty, F.col(mean)).otherwise((F.col(lo) + F.col(hi)) / 2)
    return F.when(empty | narrow, middle - half).otherwise(F.col(lo)), F.when(empty | narrow, middle + half).otherwise(F.col(hi))


def formatted(feature: str, value: str) -> F.Column:
    """A value as text: lengths whole, GC in per cent with one place, CAI with two, others with one; near zero "0"."""
    v = F.col(value)
    by_name = F.when(F.col(feature).contains("_length"), F.format_string("%d", v.cast("long"))).when(F.col(feature).contains("GC"), F.concat(F.format_string("%.1f", v), F.lit("%"))).when(F.col(feature) == "CAI", F.format_string("%.2f", v))
    return F.coalesce(by_name, F.when(F.abs(v) < 0.001, "0").otherwise(F.format_string("%.1f", v)))


# The wording of recommendations by feature, and those that hold always; the template sequences.
RANGE_TEXTS = {
    "UTR5_length": "Keep 5' UTR length between %s and %s nucleotides", "UTR5_GC": "Maintain 5' UTR GC content between %s and %s",
    "GC3_content": "Maintain GC content at the third codon position (GC3) between %s and %s",
    "UTR3_length": "Design 3' UTR with length between %s and %s nucleotides", "UTR3_GC": "Maintain 3' UTR GC content between %s and %s",
}
CAI_TEXT = "Target a Codon Adaptation Index (CAI) of approximately %s"
GENERAL_TEXTS = {
    "UTR5": "Design a 5' UTR with optimal length and GC content to ensure efficient translation initiation",
    "CDS": "Optimize codon usage based on CHO-specific preferences while maintaining moderate GC content",
    "UTR3": "Include a 3' UTR with appropriate stability elements to ensure mRNA longevity",
}
FIXED_TEXTS = {"UTR5": "Include a strong Kozak consensus sequence (GCCACC) around the start codon", "UTR3": "Include at least one canonical polyadenylation signal (AATAAA) in the 3' UTR"}
PRIORITY_TEXT = "Codon optimization to achieve target CAI"
TEMPLATES = {"5UTR_template": "GCCGCCACCAUGG", "3UTR_template": "AAUAAAGAAUUUCUGAUUUUUUUAAAAA"}


def recommendations(profiled: DataFrame, priorities: int = 5) -> DataFrame:
    """(section, position, text) from ``profiles``: what holds for each region with its balanced ranges, what holds in
    general for the regions that are there, and the first ``priorities`` of all (codons, general, then by region)."""
    lo, hi = formatted("feature", "balanced_range_lo"), formatted("feature", "balanced_range_hi")
    said = F.create_map(*[F.lit(x) for kv in RANGE_TEXTS.items() for x in kv])[F.col("feature")]
    text = F.when(F.col("feature") == "CAI", F.format_string(CAI_TEXT, formatted("feature", "balanced_profile_mean"))).otherwise(F.replace(F.regexp_replace(said, "%s and", F.concat(lo, F.lit(" and"))), F.lit("%s"), hi))
    order = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(("UTR5_length", "UTR5_GC", "CAI", "GC3_content", "UTR3_length", "UTR3_GC")) for x in (f, i)]), F.col("feature"))
    own = cut(profiled).filter(F.col("feature").isin(*RANGE_TEXTS, "CAI"))
    spark = profiled.sparkSession
    by_region = own.select(F.col("region").alias("section"), order.alias("place"), text.alias("text"))
    always = spark.createDataFrame([(k, 90, v) for k, v in FIXED_TEXTS.items()], "section string, place int, text string")
    general = own.select("region").distinct().join(spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(GENERAL_TEXTS.items())], "region string, place int, text string"), "region").select(F.lit("general").alias("section"), "place", "text")
    codons = own.filter("feature = 'CAI'").select(F.lit("codons").alias("section"), F.lit(0).alias("place"), F.lit(PRIORITY_TEXT).alias("text"))
    every = by_region.unionByName(always).unionByName(general)
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(("codons", "general", "UTR5", "CDS", "UTR3")) for x in (k, i)]), F.col("section"))
    first = every.unionByName(codons).orderBy(rank, "place").limit(priorities).withColumn("place", rank * 100 + F.col("place")).withColumn("section", F.lit("priority"))
    position = F.row_number().over(W.partitionBy("section").orderBy("place"))  # a few rows a section
    return every.unionByName(first).select("section", position.alias("position"), "text")


def templates(protein: str | None = None) -> dict[str, str]:
    """Template sequences of the regions; with a protein the note that stands for its optimised coding sequence."""
    return TEMPLATES | {"CDS_optimized": f"Optimized sequence for: {protein[:20]}..." if protein else ""}


def impact(ranked: DataFrame, order: str, key: str = "feature") -> DataFrame:
    """Fixed scores max(10 - i / 2, 1 / 2) by priority and their running total (no model takes part)."""
    by = W.orderBy(F.desc(F.round(order, 9)), key)
    own = ranked.withColumn("priority", F.row_number().over(by)).withColumn("estimated_impact", F.greatest(10.0 - 0.5 * (F.col("priority") - 1), F.lit(0.5)))
    return own.select(key, "priority", "estimated_impact", F.sum("estimated_impact").over(W.orderBy("priority").rowsBetween(W.unboundedPreceding, 0)).alias("cumulative_impact"))
