"""Ranking, consensus, panels and binary markers, over association rows (gene_id, method, coefficient, p_value)."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import avg_rank
from ..functions.information import ksg
from ..functions.linkage import leaf_order
from ..functions.stages import cut
from .association import spearman


def top_n(df: DataFrame, group: str, score: str, n: int, key: str = "gene_id") -> DataFrame:
    """The ``n`` best rows of each group, ties by key; Spark limits each group before its shuffle."""
    k = F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), key))
    return df.withColumn("position", k).filter(F.col("position") <= n)


def overlap(tops: DataFrame, group: str = "method", key: str = "gene_id") -> DataFrame:
    """Shared keys, union and Jaccard index of each pair of groups, from at most n keys a group."""
    sets = tops.groupBy(group).agg(F.collect_set(key).alias("s"))
    a, b = sets.select(F.col(group).alias("a"), F.col("s").alias("sa")), sets.select(F.col(group).alias("b"), F.col("s").alias("sb"))
    pairs = a.join(b, F.col("a") < F.col("b"))  # a row per group on either side
    both, either = F.size(F.array_intersect("sa", "sb")), F.size(F.array_union("sa", "sb"))
    return pairs.select("a", "b", both.cast("long").alias("shared"), either.cast("long").alias("either"), (both / F.nullif(either, F.lit(0))).alias("jaccard"))


def consensus(rows: DataFrame, by: str, groups: int, least: int, min_r: float = 0.5, top: int = 100) -> DataFrame:
    """Genes with |coefficient| >= ``min_r`` in at least max(least, groups // 2) values of ``by``; score is the count
    times the mean |r|, times 1.2 where signs agree and 0.8 where not."""
    own = rows.filter(F.abs("coefficient") >= min_r).groupBy("gene_id").agg(
        F.countDistinct(by).alias("count"), F.avg("coefficient").alias("avg_correlation"), F.avg(F.abs("coefficient")).alias("avg_abs_correlation"), F.max(F.abs("coefficient")).alias("max_abs_correlation"),
        (F.bool_and(F.col("coefficient") > 0) | F.bool_and(F.col("coefficient") < 0)).alias("same_direction"),
    ).filter(F.col("count") >= max(least, groups // 2))
    score = F.col("count") * F.col("avg_abs_correlation") * F.when(F.col("same_direction"), 1.2).otherwise(0.8)
    return own.withColumn("consensus_score", score).orderBy(F.desc(F.round("consensus_score", 9)), "gene_id").limit(top)


def platform_correlations(x: DataFrame, least_samples: int = 5) -> DataFrame:
    """Spearman within each platform that has enough samples: gene_id, platform, coefficient, n."""
    return spearman(x, "platform").filter(F.col("n") >= least_samples).withColumnRenamed("r", "coefficient")


def composite_rank(rows: DataFrame, expr: DataFrame, stability: DataFrame | None = None, min_r: float = 0.5, max_p: float = 0.05) -> DataFrame:
    """final_score = .40 correlation + .30 level + .15 expression stability + .15 rank stability.

    Genes pass by raw p; z moments (population) are over the genes that pass. ``stability`` has rank_stability_perc.
    """
    passed = rows.filter((F.abs("coefficient") >= min_r) & (F.col("p_value") <= max_p)).withColumn("rank_score", F.abs("coefficient") / (F.col("p_value") + 1e-10))
    log_p = F.ln(F.greatest(F.lit(1e-300), F.least(F.lit(1.0), F.col("p_value"))))
    genes = passed.groupBy("gene_id").agg(
        F.count("*").alias("num_methods"), F.array_join(F.sort_array(F.collect_list("method")), ", ").alias("methods"), F.avg("rank_score").alias("mean_corr_rank_score"),
        F.avg("coefficient").alias("mean_correlation"), F.avg(F.abs("coefficient")).alias("mean_abs_correlation"), F.exp(F.avg(log_p)).alias("geo_mean_p_value"),
    )
    levels = expr.groupBy("gene_id").agg(F.avg("value").alias("expression_level"), F.stddev_pop("value").alias("_sd"))
    levels = levels.withColumn("expression_variability_cv", F.when(F.abs("expression_level") > 1e-9, F.col("_sd") / F.nullif("expression_level", F.lit(0.0))))
    own = genes.join(levels, "gene_id", "left")
    moments = own.agg(F.max("mean_corr_rank_score").alias("_top"), F.avg("expression_level").alias("_ml"), F.stddev_pop("expression_level").alias("_sl"), F.avg("expression_variability_cv").alias("_mv"), F.stddev_pop("expression_variability_cv").alias("_sv"))
    own = own.join(F.broadcast(moments))
    spread = lambda c: F.when(F.col(c) < 1e-9, 1.0).otherwise(F.col(c))
    sigmoid = lambda z: 1 / (1 + F.exp(-z))
    level = sigmoid((F.col("expression_level") - F.col("_ml")) / spread("_sl"))
    steady = F.coalesce(1 - sigmoid((F.col("expression_variability_cv") - F.col("_mv")) / spread("_sv")), F.lit(0.0))
    own = own.join(stability.select("gene_id", "rank_stability_perc"), "gene_id", "left") if stability is not None else own.withColumn("rank_stability_perc", F.lit(0.0))
    own = own.withColumn("correlation_score", F.least(F.lit(1.0), F.col("mean_corr_rank_score") / F.when(F.col("_top") == 0, 1.0).otherwise(F.col("_top"))))
    own = own.withColumn("expression_level_score", level).withColumn("expression_stability_score", steady)
    own = own.withColumn("rank_stability_score", F.least(F.lit(1.0), F.coalesce("rank_stability_perc", F.lit(0.0)) / 100))
    final = 0.40 * F.col("correlation_score") + 0.30 * F.col("expression_level_score") + 0.15 * F.col("expression_stability_score") + 0.15 * F.col("rank_stability_score")
    return own.withColumn("final_score", final).drop("_sd", "_top", "_ml", "_sl", "_mv", "_sv")


def binary_auc(x: DataFrame, top: int = 5000) -> DataFrame:
    """AUC of each of the ``top`` genes by variance for y over its median, from rank sums; under .5 it is turned."""
    best = x.groupBy("gene_id").agg(F.var_pop("value").alias("v")).orderBy(F.desc("v"), "gene_id").limit(top).select("gene_id")
    cut = x.select("sample_id", "y").distinct().agg(F.percentile("y", 0.5).alias("_cut"))
    own = x.join(F.broadcast(best), "gene_id").join(F.broadcast(cut)).withColumn("pos", F.col("y") > F.col("_cut")).withColumn("rk", avg_rank("value", "gene_id"))
    sums = own.groupBy("gene_id").agg(F.sum(F.when(F.col("pos"), F.col("rk"))).alias("s"), F.count_if("pos").alias("np"), F.count_if(~F.col("pos")).alias("nn"), F.avg("value").alias("mean_expr"))
    auc = (F.col("s") - F.col("np") * (F.col("np") + 1) / 2.0) / F.nullif(F.col("np") * F.col("nn"), F.lit(0))
    out = sums.withColumn("raw", auc)
    return out.select("gene_id", F.greatest("raw", 1 - F.col("raw")).alias("auc"), F.when(F.col("raw") >= 0.5, "positive").otherwise("negative").alias("direction"), "mean_expr")


def optimal_thresholds(x: DataFrame, markers: DataFrame, steps: int = 20) -> DataFrame:
    """For each marker the threshold, of ``steps`` between its 5th and 95th percentile, with the best balanced
    accuracy; the first wins ties. y counts as positive over its median."""
    cut = x.select("sample_id", "y").distinct().agg(F.percentile("y", 0.5).alias("_cut"))
    own = x.join(F.broadcast(markers.select("gene_id", "direction")), "gene_id").join(F.broadcast(cut)).withColumn("pos", F.col("y") > F.col("_cut"))
    ends = own.groupBy("gene_id").agg(F.percentile("value", 0.05).alias("lo"), F.percentile("value", 0.95).alias("hi"))
    grid = ends.select("gene_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.struct(i.alias("i"), (F.col("lo") + (F.col("hi") - F.col("lo")) * i / (steps - 1)).alias("thr")))).alias("g")).select("gene_id", "g.*")
    hit = F.when(F.col("direction") == "positive", F.col("value") >= F.col("thr")).otherwise(F.col("value") < F.col("thr"))
    c = own.join(grid, "gene_id").withColumn("hit", hit).groupBy("gene_id", "i", "thr", "direction").agg(
        F.count_if(F.col("hit") & F.col("pos")).alias("tp"), F.count_if(F.col("hit") & ~F.col("pos")).alias("fp"), F.count_if(~F.col("hit") & ~F.col("pos")).alias("tn"), F.count_if(~F.col("hit") & F.col("pos")).alias("fn")
    )
    sens, spec = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.col("tn") / F.nullif(F.col("tn") + F.col("fp"), F.lit(0))
    scored = c.withColumn("sensitivity", sens).withColumn("specificity", spec).withColumn("balanced_accuracy", (sens + spec) / 2)
    k = F.row_number().over(W.partitionBy("gene_id").orderBy(F.desc(F.round("balanced_accuracy", 9)), "i"))
    return scored.withColumn("k", k).filter("k = 1").select("gene_id", F.col("thr").alias("optimal_threshold"), "balanced_accuracy", "sensitivity", "specificity", "tp", "fp", "tn", "fn", "direction")


def loocv(columns: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Leave-one-out R squared and RMSE of the linear model, from the hat matrix."""
    a = np.column_stack([np.ones(len(y)), columns])
    h = a @ np.linalg.pinv(a)
    e = (y - h @ y) / np.maximum(1 - np.diag(h), 1e-12)
    return float(1 - (e @ e) / ((y - y.mean()) ** 2).sum()), float(np.sqrt((e @ e) / len(y)))


KINDS = ("minimal_redundancy", "max_correlation", "max_score")


def pair_information(vectors: DataFrame, genes: DataFrame) -> DataFrame:
    """a, b, mi for all pairs of ``genes`` (a report over about a hundred; panels need no such table)."""
    own = vectors.join(F.broadcast(genes.select("gene_id")), "gene_id", "left_semi")
    a, b = own.select(F.col("gene_id").alias("a"), F.col("values").alias("va")), own.select(F.col("gene_id").alias("b"), F.col("values").alias("vb"))

    def mi(frames):
        for f in frames:
            yield f.assign(mi=[_information(np.asarray(p, float), np.asarray(q, float)) for p, q in zip(f["va"], f["vb"], strict=True)])[["a", "b", "mi"]]

    pairs = a.join(b, F.col("a") < F.col("b")).repartition(F.xxhash64("a", "b"))
    return pairs.mapInPandas(mi, "a string, b string, mi double")


def _information(p: np.ndarray, q: np.ndarray) -> float:
    """Mutual information over the samples that both have."""
    whole = ~(np.isnan(p) | np.isnan(q))
    return ksg(p[whole], q[whole])


def _least_redundant(own: DataFrame, size: int) -> list[str]:
    """The greedy choice of ``size`` genes from (gene_id, score, values): the score less the mean information with those
    chosen; the best score, then id, wins ties.

    A step is one narrow pass. Information is never negative, so the score less what the information with some of the
    chosen takes away bounds a gene's worth: tasks go through their genes from the best score down and leave a gene as
    soon as its bound is no better than the best they have. A task gives its best gene, and the best of these is chosen.
    """
    chosen: list[str] = []
    values: list[np.ndarray] = []
    while len(chosen) < size:

        def best(frames, chosen=tuple(chosen), values=tuple(values)):
            found = None
            for f in frames:
                for g, score, v in f.sort_values(["score", "gene_id"], ascending=[False, True])[["gene_id", "score", "values"]].itertuples(index=False):
                    worth = score
                    if g in chosen or found and worth < found[0]:
                        continue
                    v = np.asarray(v, float)
                    for c in values:
                        worth -= _information(c, v) / len(values)
                        if found and worth < found[0]:
                            break
                    key = (worth, score)
                    if found is None or key > found[:2] or key == found[:2] and g < found[2]:
                        found = (worth, score, g, v)
            if found:
                yield pd.DataFrame({"worth": [found[0]], "score": [found[1]], "gene_id": [found[2]], "values": [found[3]]})

        top = own.mapInPandas(best, "worth double, score double, gene_id string, values array<double>").orderBy(F.desc("worth"), F.desc("score"), "gene_id").first()
        if top is None:
            break
        chosen.append(top["gene_id"])
        values.append(np.array(top["values"], float))
    return chosen


def panels(vectors: DataFrame, candidates: DataFrame, y: list[float], sizes: tuple[int, ...] = (3, 5, 10), kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Greedy marker panels over ``candidates`` (gene_id, score, correlation), however many.

    max_score takes the best scores, max_correlation the largest |correlation|, minimal_redundancy (and any other name)
    the score less the mean information with those chosen; the first in order of score, then id, wins ties. Candidates
    without values are left out, and samples without all of a panel's values. Only the chosen genes' values, at most the
    largest size a kind, come to the driver.
    """
    spark = vectors.sparkSession
    own = cut(vectors.select("gene_id", "values").join(candidates.select("gene_id", "score", F.coalesce(F.abs("correlation"), F.lit(0.0)).alias("level")), "gene_id"))
    target, out = np.array(y, float), []
    for kind in kinds:
        if kind in ("max_score", "max_correlation"):
            first = [F.desc("level")] if kind == "max_correlation" else []
            chosen = [r["gene_id"] for r in own.orderBy(*first, F.desc("score"), "gene_id").limit(max(sizes)).select("gene_id").collect()]
        else:
            chosen = _least_redundant(own, max(sizes))
        names = spark.createDataFrame([(g,) for g in chosen], "gene_id string")
        values = {r["gene_id"]: np.array(r["values"], float) for r in own.join(F.broadcast(names), "gene_id", "left_semi").select("gene_id", "values").collect()}
        info = {p: _information(values[p[0]], values[p[1]]) for p in combinations(chosen, 2)}
        for size in sorted(k for k in sizes if k <= len(chosen)):
            a = np.column_stack([values[g] for g in chosen[:size]])
            whole = ~np.isnan(a).any(axis=1) & ~np.isnan(target)
            r2, rmse = loocv(a[whole], target[whole])
            shared = [info[p] for p in combinations(chosen[:size], 2)]
            out.append((kind, size, r2, rmse, float(np.mean(shared)) if shared else 0.0, chosen[:size]))
    return spark.createDataFrame(out, "panel_type string, size int, r2_loocv double, rmse_loocv double, mean_information double, genes array<string>")


def panel_gains(paneled: DataFrame) -> DataFrame:
    """Each panel's R squared and what its size adds to the next smaller one of its kind (a row a panel)."""
    before = F.lag("r2_loocv").over(W.partitionBy("panel_type").orderBy("size"))
    return paneled.select("panel_type", "size", "r2_loocv", "rmse_loocv", (F.col("r2_loocv") - F.coalesce(before, F.lit(0.0))).alias("gain"))


def binary_markers(x: DataFrame, top: int = 5000, least_auc: float = 0.7, best: int = 50, folds: int = 3) -> DataFrame:
    """The ``best`` genes whose cross-validated AUC is at least ``least_auc``, by .7 cv_auc + .3 auc.

    A logistic model of one gene is monotone in it, with the sign of the difference of the training rows' class means
    (classes weighted alike). So a fold's AUC is the rank AUC of its rows, or one less that, by that sign. Folds are
    stratified: samples of a class in order of sample_id, dealt in turn.
    """
    strong = binary_auc(x, top)
    cut = x.select("sample_id", "y").distinct().agg(F.percentile("y", 0.5).alias("_cut"))
    classes = x.select("sample_id", "y").distinct().join(F.broadcast(cut)).withColumn("pos", F.col("y") > F.col("_cut"))
    classes = classes.withColumn("fold", (F.row_number().over(W.partitionBy("pos").orderBy("sample_id")) - 1) % folds).select("sample_id", "pos", "fold")  # a row a sample
    own = x.join(F.broadcast(classes), "sample_id").join(strong.select("gene_id"), "gene_id", "left_semi").withColumn("rk", avg_rank("value", "gene_id", "fold"))
    pos, neg = F.col("pos"), ~F.col("pos")
    by = own.groupBy("gene_id", "fold").agg(F.sum(F.when(pos, F.col("rk"))).alias("s"), F.count_if(pos).alias("np"), F.count_if(neg).alias("nn"), F.sum(F.when(pos, F.col("value"))).alias("vp"), F.sum(F.when(neg, F.col("value"))).alias("vn"))
    rest = lambda c: F.sum(c).over(W.partitionBy("gene_id")) - F.col(c)
    by = by.withColumn("up", rest("vp") / F.nullif(rest("np"), F.lit(0)) >= rest("vn") / F.nullif(rest("nn"), F.lit(0)))
    auc = (F.col("s") - F.col("np") * (F.col("np") + 1) / 2.0) / F.nullif(F.col("np") * F.col("nn"), F.lit(0))
    cv = by.withColumn("a", F.when(F.col("up"), auc).otherwise(1 - auc)).groupBy("gene_id").agg(F.when(F.count("a") == F.count("*"), F.avg("a")).otherwise(0.0).alias("cv_auc"))
    out = strong.join(cv, "gene_id").filter(F.col("cv_auc") >= least_auc).withColumn("marker_score", 0.7 * F.col("cv_auc") + 0.3 * F.col("auc"))
    return out.select("gene_id", "auc", "cv_auc", "direction", "mean_expr", "marker_score").orderBy(F.desc(F.round("marker_score", 9)), "gene_id").limit(best)


def compare_methods(rows: DataFrame, x: DataFrame, top: int = 20, folds: int = 5) -> DataFrame:
    """method, mean_correlation, mean_significance (-log10 p), predictive_power (R squared over contiguous folds of the
    linear model on its ``top`` genes, at least 0) and overall_score, the mean of the three scaled to 0..1 over methods
    (.5 where all are alike); rounded to three places."""
    best = rows.withColumn("_k", F.row_number().over(W.partitionBy("method").orderBy(F.desc("rank_score"), "gene_id"))).filter(F.col("_k") <= top)
    stats = best.groupBy("method").agg(F.avg(F.abs("coefficient")).alias("mean_correlation"), F.avg(-F.log10(F.coalesce("p_value", F.lit(1.0)) + 1e-300)).alias("mean_significance"))
    own = x.join(F.broadcast(best.select("gene_id", "method")), "gene_id")
    vectors = own.groupBy("method", "gene_id").agg(F.sort_array(F.collect_list(F.struct("sample_id", "value", "y"))).alias("v")).select("method", "gene_id", F.col("v.value").alias("values"), F.col("v.y").alias("ys"))

    def power(f: pd.DataFrame) -> pd.DataFrame:  # at most ``top`` rows
        f = f.sort_values("gene_id")
        a, y = np.stack([np.asarray(v, float) for v in f["values"]]).T, np.asarray(f["ys"].iloc[0], float)
        scores = []
        for part in np.array_split(np.arange(len(y)), folds):
            rest = np.setdiff1d(np.arange(len(y)), part)
            m, ym = a[rest].mean(0), y[rest].mean()
            guess = ym + (a[part] - m) @ (np.linalg.pinv(a[rest] - m) @ (y[rest] - ym))
            total = ((y[part] - y[part].mean()) ** 2).sum()
            scores.append(1 - ((y[part] - guess) ** 2).sum() / total if total > 0 else 0.0)
        return pd.DataFrame({"method": [f["method"].iloc[0]], "predictive_power": [max(0.0, float(np.mean(scores)))]})

    out = stats.join(vectors.groupBy("method").applyInPandas(power, "method string, predictive_power double"), "method")
    over = W.partitionBy()  # a row a method
    cols = ("mean_correlation", "mean_significance", "predictive_power")
    scaled = [F.when(F.max(c).over(over) > F.min(c).over(over), (F.col(c) - F.min(c).over(over)) / F.nullif(F.max(c).over(over) - F.min(c).over(over), F.lit(0.0))).otherwise(0.5) for c in cols]
    out = out.withColumn("overall_score", sum(scaled[1:], scaled[0]) / 3)
    return out.select("method", *[F.round(c, 3).alias(c) for c in (*cols, "overall_score")]).orderBy(F.desc("overall_score"), "method")


def with_symbols(rows: DataFrame, genes: DataFrame) -> DataFrame:
    """``rows`` with sym from ``genes`` (gene_id, sym); the id where there is none."""
    names = genes.groupBy("gene_id").agg(F.min("sym").alias("sym"))
    return rows.join(names, "gene_id", "left").withColumn("sym", F.coalesce("sym", "gene_id"))


def co_edges(scores: DataFrame, top: int = 20, least: float = 0.1) -> DataFrame:
    """Pairs of the ``top`` genes by |coefficient| with |r_i * r_j| >= ``least`` (a product, not a correlation)."""
    best = scores.orderBy(F.desc(F.round(F.abs("coefficient"), 9)), "gene_id").limit(top)
    a, b = best.select(F.col("gene_id").alias("a"), F.col("coefficient").alias("ra")), best.select(F.col("gene_id").alias("b"), F.col("coefficient").alias("rb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (F.col("ra") * F.col("rb")).alias("weight")).filter(F.abs("weight") >= least)


def co_matrix(scores: DataFrame, top: int = 20) -> DataFrame:
    """gene_i, gene_j, value, place_i, place_j: products of the ``top`` genes' coefficients (1 for a gene with itself) and
    where both stand in the leaves of the average-linkage tree over 1 - |value|. A row a gene of the report comes to the
    driver; genes without a coefficient take no part."""
    rows = scores.filter(F.col("coefficient").isNotNull() & ~F.isnan("coefficient")).orderBy(F.desc(F.round(F.abs("coefficient"), 9)), "gene_id").limit(top).select("gene_id", "coefficient").collect()
    r = np.array([x["coefficient"] for x in rows], float)
    value = np.outer(r, r)
    np.fill_diagonal(value, 1.0)
    place = {i: k for k, i in enumerate(leaf_order(np.maximum(1 - np.abs(value), 0)))}
    cells = [(rows[i]["gene_id"], rows[j]["gene_id"], float(value[i, j]), place[i], place[j]) for i in range(len(rows)) for j in range(len(rows))]
    return scores.sparkSession.createDataFrame(cells, "gene_i string, gene_j string, value double, place_i int, place_j int")
