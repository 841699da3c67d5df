"""Registered queries over the given tables, with the SQL that DuckDB runs for the same rows.

Statistics are rounded to six places on both sides. p-values have SQL where a closed form or a finite series gives them
(three platforms make F and chi-squared tails elementary). What has no SQL (trees, resamples, seeded or iterative fits) is
held against plain numpy, or against its defining property, in tests/test_operators.py and tests/test_analyses.py.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.columns import benjamini_hochberg, f_p
from ..functions.sequences import GENETIC_CODE, UTR3_MOTIFS, UTR5_MOTIFS
from ..operators import association as A
from ..operators import batch as B
from ..operators import descriptive as D
from ..operators import features as X
from ..operators import ranking as R
from ..operators import sequence as Q
from ..operators import validation as V
from ..sources import tables as T
from ..sources.matrix import to_vectors
from .registry import ORACLE_SQL, QUERIES, bh_sql, fisher_p_sql, normal_p_sql, query, rounded, t_p_sql
from .registry import select_rounded as _r

__all__ = ["ORACLE_SQL", "QUERIES"]

FEATURES = ["UTR5_length", "UTR5_GC", "UTR5_AUG_count", "UTR3_length", "UTR3_GC", "miRNA_seed_matches", "GC3_content", "CAI"]


CORR = "coalesce(CASE WHEN stddev_pop({x}) > 1e-9 AND stddev_pop({y}) > 1e-9 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END, 0.0)"
RANK = "rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0"
SPEARMAN = f"""rk AS (SELECT gene_id, sample_id, platform, value, y, {RANK.format(by='gene_id', v='value')} AS rx, {RANK.format(by='gene_id', v='y')} AS ry FROM x),
sp AS (SELECT gene_id, {CORR.format(x='rx', y='ry')} AS r, count(*) AS n FROM rk GROUP BY 1)"""


# --- layout and description -------------------------------------------------------------------------------------------


@query(T.EXPR_SQL + "SELECT gene_id, sample_id, platform, value FROM e")
def expr_long(spark, sf):
    return T.expression(spark, sf)


@query(T.EXPR_SQL + "SELECT platform, count(*) AS n_samples FROM samples GROUP BY 1")
def platform_counts(spark, sf):
    return T.samples(spark, sf).groupBy("platform").agg(F.count("*").alias("n_samples"))


@query(T.EXPR_SQL + f"""SELECT count(DISTINCT gene_id) AS n_genes, (SELECT count(DISTINCT sample_id) FROM e) AS n_samples,
  (SELECT round(avg(m), 6) FROM (SELECT avg(value) AS m FROM e GROUP BY sample_id)) AS mean_of_means,
  (SELECT round(median(m), 6) FROM (SELECT median(value) AS m FROM e GROUP BY sample_id)) AS median_of_medians FROM e""")  # fmt: skip
def basic_stats(spark, sf):
    return rounded(D.basic_stats(T.expression(spark, sf)))


GENE_STATS = "gs AS (SELECT gene_id, avg(value) AS mean, stddev_samp(value) AS std, stddev_samp(value) / nullif(avg(value), 0) AS cv FROM e GROUP BY 1)"


@query(T.EXPR_SQL + f", {GENE_STATS} SELECT gene_id, {_r('mean', 'std', 'cv')} FROM gs WHERE cv <= (SELECT quantile_cont(cv, 0.3) FROM gs)")
def gene_cv_consistent(spark, sf):
    return rounded(D.consistent_genes(T.expression(spark, sf)))


@query(T.EXPR_SQL + f", {GENE_STATS} SELECT gene_id, {_r('mean', 'std', 'std / (mean + 1e-10) AS ratio')} FROM gs WHERE std / (mean + 1e-10) <= 1.5")
def constant_genes(spark, sf):
    return rounded(D.constant_genes(T.expression(spark, sf), 1.5))


for _m, _sql in {
    "log1p": "ln(1 + value)",
    "log2": "log2(value + 1e-10)",
    "zscore": "(value - avg(value) OVER (PARTITION BY sample_id)) / nullif(stddev_samp(value) OVER (PARTITION BY sample_id), 0)",
    "quantile": f"({RANK.format(by='sample_id', v='value')}) / count(*) OVER (PARTITION BY sample_id)",
}.items():
    query(T.EXPR_SQL + f"SELECT gene_id, sample_id, {_r(_sql + ' AS norm')} FROM e", f"normalize_{_m}")(lambda spark, sf, m=_m: rounded(D.normalise(T.expression(spark, sf), m).select("gene_id", "sample_id", "norm")))


@query(f"SELECT event_id, {_r('(value - avg(value) OVER (PARTITION BY event_type)) / nullif(stddev_pop(value) OVER (PARTITION BY event_type), 0) AS z')} FROM events")
def platform_zscore(spark, sf):
    return rounded(D.group_zscore(T.read(spark, sf, "events").select("event_id", "event_type", "value"), "event_type", "value").select("event_id", "z"))


@query(T.EXPR_SQL + f"SELECT gene_id, sample_id, {_r('CASE WHEN value = 0 THEN 0.1 * (SELECT min(value) FROM e WHERE value > 0) ELSE value END AS value')} FROM e")
def zero_replacement(spark, sf):
    return rounded(D.replace_zeros(T.expression(spark, sf)).select("gene_id", "sample_id", "value"))


@query(T.EXPR_SQL + "SELECT sample_id, y, CASE WHEN y >= (SELECT median(y) FROM tg) THEN 'High TG' ELSE 'Low TG' END AS tg_group FROM tg")
def target_high_low(spark, sf):
    return D.high_low(T.target(T.expression(spark, sf)))


@query(T.EXPR_SQL + "SELECT sample_id, count(*) FILTER (value > 0) AS n_expressed FROM e GROUP BY 1")
def expressed_per_sample(spark, sf):
    return D.expressed_per_sample(T.expression(spark, sf))


# --- batch effects ----------------------------------------------------------------------------------------------------

MOMENTS = "mo AS (SELECT gene_id, platform, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM e GROUP BY 1, 2)"


@query(T.EXPR_SQL + f""", {MOMENTS}, g AS (SELECT gene_id, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS gm, sum(n * v) AS w FROM mo GROUP BY 1),
b AS (SELECT gene_id, sum(mo.n * (m - gm) * (m - gm)) AS b FROM mo JOIN g USING (gene_id) GROUP BY 1)
SELECT gene_id, {_r('(b / (k - 1)) / nullif(w / (n - k), 0) AS f')}, k - 1 AS df1, CAST(n - k AS BIGINT) AS df2 FROM g JOIN b USING (gene_id)""")
def anova_platform(spark, sf):
    return rounded(B.anova(T.expression(spark, sf)))


@query(T.EXPR_SQL + f""", r AS (SELECT *, {RANK.format(by='gene_id', v='value')} AS rk FROM e),
p AS (SELECT gene_id, platform, count(*) AS n, sum(rk) AS s FROM r GROUP BY 1, 2),
q AS (SELECT gene_id, sum(n) AS n, count(*) AS k, sum(s * s / n) AS q FROM p GROUP BY 1),
t AS (SELECT gene_id, sum(c * c * c - c) AS t FROM (SELECT gene_id, count(*) AS c FROM e GROUP BY gene_id, value) GROUP BY 1)
SELECT gene_id, {_r('(12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / nullif(1 - t / CAST(n * n * n - n AS DOUBLE), 0) AS h')}, k - 1 AS df FROM q JOIN t USING (gene_id)""")
def kruskal_platform(spark, sf):
    return rounded(B.kruskal(T.expression(spark, sf)).select("gene_id", "h", "df"))


# three platforms: F has 2 degrees above, chi-squared 2, so both tails are elementary
ANOVA = f"""{MOMENTS}, g AS (SELECT gene_id, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS gm, sum(n * v) AS w FROM mo GROUP BY 1),
b AS (SELECT gene_id, sum(mo.n * (m - gm) * (m - gm)) AS b FROM mo JOIN g USING (gene_id) GROUP BY 1),
an AS (SELECT gene_id, (b / (k - 1)) / nullif(w / (n - k), 0) AS f, k - 1 AS df1, CAST(n - k AS BIGINT) AS df2 FROM g JOIN b USING (gene_id)),
ap AS (SELECT *, power(df2 / (df2 + 2.0 * f), df2 / 2.0) AS p FROM an)"""
KRUSKAL = f"""r AS (SELECT *, {RANK.format(by='gene_id', v='value')} AS rk FROM e),
p AS (SELECT gene_id, platform, count(*) AS n, sum(rk) AS s, min(value) = max(value) AS flat FROM r GROUP BY 1, 2),
q AS (SELECT gene_id, sum(n) AS n, count(*) AS k, sum(s * s / n) AS q, bool_or(flat) AS flat FROM p GROUP BY 1),
t AS (SELECT gene_id, sum(c * c * c - c) AS t FROM (SELECT gene_id, count(*) AS c FROM e GROUP BY gene_id, value) GROUP BY 1),
kw AS (SELECT gene_id, (12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / nullif(1 - t / CAST(n * n * n - n AS DOUBLE), 0) AS h, k - 1 AS df, flat FROM q JOIN t USING (gene_id)),
kp AS (SELECT gene_id, CASE WHEN flat OR h IS NULL THEN 1.0 ELSE exp(-h / 2) END AS p FROM kw)"""
_EFFECTS = f"""{ANOVA}, {KRUSKAL}, ef AS (SELECT ap.gene_id, coalesce(ap.p, 1.0) AS anova_pvalue, kp.p AS kruskal_pvalue FROM ap JOIN kp USING (gene_id)),
{bh_sql('anova_pvalue', 'ef')}, h2 AS (SELECT gene_id, anova_pvalue, bh AS anova_pvalue_adj, kruskal_pvalue FROM hb),
""" + bh_sql("kruskal_pvalue", "h2").replace("hk AS", "hk2 AS").replace("FROM hk)", "FROM hk2)").replace("hb AS", "hb2 AS")


@query(T.EXPR_SQL + f", {_EFFECTS} SELECT gene_id, {_r('anova_pvalue', 'kruskal_pvalue', 'anova_pvalue_adj', 'bh AS kruskal_pvalue_adj')} FROM hb2")
def residual_effects(spark, sf):
    return rounded(B.residual_effects(T.expression(spark, sf)))


@query(T.EXPR_SQL + f", {ANOVA} SELECT {_r('100.0 * count(*) FILTER (p < 0.05) / count(*) AS pct_affected')} FROM ap")
def affected_share(spark, sf):
    return rounded(B.affected_share(T.expression(spark, sf)))


BIAS = """bs AS (SELECT e.gene_id, p.platform, count(*) FILTER (e.platform = p.platform) AS n1, avg(value) FILTER (e.platform = p.platform) AS m1, var_samp(value) FILTER (e.platform = p.platform) AS v1,
  count(*) FILTER (e.platform <> p.platform) AS n2, avg(value) FILTER (e.platform <> p.platform) AS m2, var_samp(value) FILTER (e.platform <> p.platform) AS v2
  FROM e, (SELECT DISTINCT platform FROM samples) p GROUP BY 1, 2),
bias AS (SELECT gene_id, platform, m1 - m2 AS mean_difference, CASE WHEN v2 > 1e-9 THEN v1 / v2 ELSE 1.0 END AS variance_ratio,
  CASE WHEN v1 < 1e-9 AND v2 < 1e-9 THEN 0.0 ELSE (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) END AS cohen_d FROM bs)"""


@query(T.EXPR_SQL + f", {BIAS} SELECT gene_id, platform, {_r('mean_difference', 'variance_ratio', 'cohen_d')} FROM bias")
def platform_bias_cohend(spark, sf):
    return rounded(B.platform_bias(T.expression(spark, sf)))


@query(T.EXPR_SQL + f", {BIAS} SELECT platform, {_r('avg(abs(cohen_d)) AS mean_abs_d')} FROM bias GROUP BY 1 ORDER BY avg(abs(cohen_d)) DESC, 1 LIMIT 1")
def problem_platform(spark, sf):
    return rounded(B.problem_platform(B.platform_bias(T.expression(spark, sf))))


LOC = f"""{BIAS}, wp AS (SELECT platform AS wp FROM bias GROUP BY 1 ORDER BY round(avg(abs(cohen_d)), 9) DESC, 1 LIMIT 1),
lc AS (SELECT gene_id, avg(value) FILTER (platform = wp) AS mp, stddev_pop(value) FILTER (platform = wp) AS sp, avg(value) FILTER (platform <> wp) AS mr,
  stddev_pop(value) FILTER (platform <> wp) AS sr FROM e, wp GROUP BY 1),
fx AS (SELECT e.gene_id, sample_id, platform, value AS raw, CASE WHEN platform <> wp OR gene_id = (SELECT min(gene_id) FROM e) THEN value WHEN sp < 1e-6 THEN value - mp + mr ELSE (value - mp) / nullif(sp, 0) * sr + mr END AS value
  FROM e JOIN lc USING (gene_id), wp)"""


def _location_scale(e):
    """Correction of the platform that differs most; the target keeps its values."""
    worst = B.problem_platform(B.platform_bias(e)).first()["platform"]
    return B.location_scale(e, worst, e.agg(F.min("gene_id")).first()[0])


@query(T.EXPR_SQL + f", {LOC} SELECT gene_id, sample_id, {_r('value')} FROM fx")
def location_scale_correction(spark, sf):
    return rounded(_location_scale(T.expression(spark, sf)).select("gene_id", "sample_id", "value"))


@query(T.EXPR_SQL + f""", {LOC} SELECT gene_id, {_r('CASE WHEN stddev_pop(raw) > 1e-9 AND stddev_pop(value) > 1e-9 THEN covar_pop(raw, value) / (stddev_pop(raw) * stddev_pop(value)) ELSE 1.0 END AS r')},
  bool_and(abs(raw - value) <= 1e-8 + 1e-5 * abs(value)) AS preserved FROM fx GROUP BY 1""")
def target_preservation(spark, sf):
    e = T.expression(spark, sf)
    return rounded(B.preservation(e, _location_scale(e)))


@query(T.EXPR_SQL + f""", sz AS (SELECT gene_id, platform, count(*) AS n FROM e GROUP BY 1, 2),
pr AS (SELECT a.gene_id, a.platform AS p1, b.platform AS p2, a.n AS n1, b.n AS n2 FROM sz a JOIN sz b ON a.gene_id = b.gene_id AND a.platform < b.platform),
st AS (SELECT pr.gene_id, p1, p2, n1, n2, value, sum(CASE WHEN platform = p1 THEN 1.0 / n1 ELSE -1.0 / n2 END) AS s FROM pr JOIN e ON e.gene_id = pr.gene_id AND (platform = p1 OR platform = p2) GROUP BY ALL),
cu AS (SELECT *, abs(sum(s) OVER (PARTITION BY gene_id, p1, p2 ORDER BY value ROWS UNBOUNDED PRECEDING)) AS g FROM st)
SELECT gene_id, p1, p2, {_r('max(g) AS d')}, max(n1) AS n1, max(n2) AS n2 FROM cu GROUP BY 1, 2, 3""")
def ks_platform_pairs(spark, sf):
    return rounded(B.ks_pairs(T.expression(spark, sf)))


@query()
def combat_correction(spark, sf):
    return rounded(B.combat(T.expression(spark, sf)))


# --- association ------------------------------------------------------------------------------------------------------


@query(T.EXPR_SQL + f"SELECT gene_id, {_r(CORR.format(x='value', y='y') + ' AS r')}, count(*) AS n FROM x GROUP BY 1")
def corr_pearson(spark, sf):
    return rounded(A.pearson(T.genes_and_target(T.expression(spark, sf))))


@query(T.EXPR_SQL + f", {SPEARMAN} SELECT gene_id, {_r('r')}, n FROM sp")
def corr_spearman(spark, sf):
    return rounded(A.spearman(T.genes_and_target(T.expression(spark, sf)), dense=True))


@query(T.EXPR_SQL + f""", pq AS (SELECT a.gene_id, sum(sign(a.value - b.value) * sign(a.y - b.y)) AS s, sum(abs(sign(a.value - b.value))) AS nx, sum(abs(sign(a.y - b.y))) AS ny
  FROM x a JOIN x b ON a.gene_id = b.gene_id GROUP BY 1)
SELECT gene_id, {_r('coalesce(s / nullif(sqrt(CAST(nx AS DOUBLE) * ny), 0), 0.0) AS r')} FROM pq""")
def corr_kendall(spark, sf):
    return rounded(A.kendall(T.genes_and_target(T.expression(spark, sf))).select("gene_id", "r"))


@query(T.EXPR_SQL + f"SELECT gene_id, {_r('covar_pop(value, y) / var_pop(value) AS slope', 'corr(value, y) * corr(value, y) AS r2')}, count(*) AS n FROM x GROUP BY 1 HAVING stddev_pop(value) > 1e-9")
def corr_regression_slope(spark, sf):
    return rounded(A.regression(T.genes_and_target(T.expression(spark, sf))).select("gene_id", "slope", "r2", "n"))


@query(T.EXPR_SQL + f""", {SPEARMAN}, pv AS (SELECT gene_id, 'spearman' AS method, r AS coefficient, {t_p_sql('r', 'n')} AS p_value FROM sp), {bh_sql('p_value', 'pv', 'method')}
SELECT gene_id, method, {_r('coefficient', 'p_value', 'bh AS p_adjusted')} FROM hb ORDER BY round(abs(coefficient), 9) DESC, gene_id LIMIT 20""")
def spearman_top20(spark, sf):
    x = T.genes_and_target(T.expression(spark, sf))
    rows = A.correlations(x, ("spearman",)).orderBy(F.desc(F.round(F.abs("coefficient"), 9)), "gene_id").limit(20)
    return rounded(rows.drop("rank_score"))


_KENDALL = f"""kt AS (SELECT gene_id, sum(c * (c - 1)) AS t1, sum(c * (c - 1) * (2 * c + 5)) AS t2, sum(c * (c - 1) * (c - 2)) AS t3 FROM (SELECT gene_id, count(*) AS c FROM x GROUP BY gene_id, value) GROUP BY 1),
yt AS (SELECT sum(c * (c - 1)) AS u1, sum(c * (c - 1) * (2 * c + 5)) AS u2, sum(c * (c - 1) * (c - 2)) AS u3 FROM (SELECT count(*) AS c FROM tg GROUP BY y)),
kq AS (SELECT a.gene_id, sum(sign(a.value - b.value) * sign(a.y - b.y)) AS s, sum(abs(sign(a.value - b.value))) AS nx, sum(abs(sign(a.y - b.y))) AS ny FROM x a JOIN x b ON a.gene_id = b.gene_id GROUP BY 1),
kn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM tg),
kz AS (SELECT gene_id, coalesce(s / nullif(sqrt(CAST(nx AS DOUBLE) * ny), 0), 0.0) AS r, s / 2.0 / nullif(sqrt((n * (n - 1) * (2 * n + 5) - t2 - u2) / 18 + t1 * u1 / (2 * n * (n - 1)) + t3 * u3 / (9 * n * (n - 1) * (n - 2))), 0) AS z FROM kq JOIN kt USING (gene_id), yt, kn)"""
_ALL = f"""{SPEARMAN}, {_KENDALL}, pe AS (SELECT gene_id, {CORR.format(x='value', y='y')} AS r, count(*) AS n, covar_pop(value, y) / nullif(var_pop(value), 0) AS slope, stddev_pop(value) AS sd FROM x GROUP BY 1),
am AS (SELECT gene_id, 'spearman' AS method, r AS coefficient, {t_p_sql('r', 'n')} AS p_value FROM sp UNION ALL SELECT gene_id, 'pearson', r, {t_p_sql('r', 'n')} FROM pe
  UNION ALL SELECT gene_id, 'regression', slope, {t_p_sql('r', 'n')} FROM pe WHERE sd > 1e-9 UNION ALL SELECT gene_id, 'kendall', r, {normal_p_sql('coalesce(z, 0.0)')} FROM kz), {bh_sql('p_value', 'am', 'method')}"""


@query(T.EXPR_SQL + f", {_ALL} SELECT gene_id, method, {_r('coefficient', 'p_value', 'bh AS p_adjusted')} FROM hb")
def correlations_linear(spark, sf):
    return rounded(A.correlations(T.genes_and_target(T.expression(spark, sf))).drop("rank_score"))


@query()
def correlations_all(spark, sf):
    return rounded(A.correlations(T.genes_and_target(T.expression(spark, sf)), (*A.METHODS, "decision_tree", "random_forest")))


@query()
def bootstrap_rank_stability(spark, sf):
    return rounded(A.bootstrap(T.genes_and_target(T.expression(spark, sf)), methods=A.METHODS))


BH = f"""{SPEARMAN}, pv AS (SELECT gene_id, 1 - abs(r) AS p FROM sp), ps AS (SELECT *, row_number() OVER (ORDER BY round(p, 9), gene_id) AS k, count(*) OVER () AS m FROM pv)
SELECT gene_id, {_r('p', 'least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS adjusted')} FROM ps"""


@query(T.EXPR_SQL + ", " + BH)
def bh_adjust_ranked(spark, sf):
    p = A.spearman(T.genes_and_target(T.expression(spark, sf))).select("gene_id", (1 - F.abs("r")).alias("p"))
    return rounded(benjamini_hochberg(p, "p", "adjusted"))


# --- ranking and consensus --------------------------------------------------------------------------------------------

METHODS_SQL = f"""{SPEARMAN}, pe AS (SELECT gene_id, {CORR.format(x='value', y='y')} AS r FROM x GROUP BY 1),
me AS (SELECT gene_id, 'spearman' AS method, r AS coefficient FROM sp UNION ALL SELECT gene_id, 'pearson', r FROM pe)"""


def _methods(spark, sf):
    x = T.genes_and_target(T.expression(spark, sf))
    one = lambda df, m: df.select("gene_id", F.lit(m).alias("method"), F.col("r").alias("coefficient"))
    return one(A.spearman(x, dense=True), "spearman").unionByName(one(A.pearson(x), "pearson"))


TOPS = f"tp AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY round(abs(coefficient), 9) DESC, gene_id) AS position FROM me QUALIFY position <= 20)"


def _tops(spark, sf):
    return R.top_n(_methods(spark, sf).withColumn("s", F.round(F.abs("coefficient"), 9)), "method", "s", 20).drop("s")


@query(T.EXPR_SQL + f", {METHODS_SQL}, {TOPS} SELECT gene_id, method, {_r('coefficient')}, position FROM tp")
def method_topn_per_group(spark, sf):
    return rounded(_tops(spark, sf))


@query(T.EXPR_SQL + f""", {METHODS_SQL}, {TOPS} SELECT 'pearson' AS a, 'spearman' AS b, count(*) FILTER (c = 2) AS shared, count(*) AS either, {_r('count(*) FILTER (c = 2) / CAST(count(*) AS DOUBLE) AS jaccard')}
  FROM (SELECT gene_id, count(*) AS c FROM tp GROUP BY 1)""")
def method_overlap_jaccard(spark, sf):
    return rounded(R.overlap(_tops(spark, sf)))


def _consensus_sql(rows: str, by: str, least: int, min_r: float) -> str:
    return f"""cs AS (SELECT gene_id, count(DISTINCT {by}) AS count, avg(coefficient) AS avg_correlation, avg(abs(coefficient)) AS avg_abs_correlation, max(abs(coefficient)) AS max_abs_correlation,
  bool_and(coefficient > 0) OR bool_and(coefficient < 0) AS same_direction FROM {rows} WHERE abs(coefficient) >= {min_r} GROUP BY 1 HAVING count(DISTINCT {by}) >= {least})
SELECT gene_id, count, {_r('avg_correlation', 'avg_abs_correlation', 'max_abs_correlation')}, same_direction, {_r('count * avg_abs_correlation * CASE WHEN same_direction THEN 1.2 ELSE 0.8 END AS consensus_score')}
FROM cs ORDER BY round(count * avg_abs_correlation * CASE WHEN same_direction THEN 1.2 ELSE 0.8 END, 9) DESC, gene_id LIMIT 100"""


@query(T.EXPR_SQL + f", {METHODS_SQL}, " + _consensus_sql("me", "method", 1, 0.1))
def method_consensus(spark, sf):
    return rounded(R.consensus(_methods(spark, sf), "method", 2, 1, 0.1))


@query(T.EXPR_SQL + f""", rp AS (SELECT gene_id, platform, {RANK.format(by='gene_id, platform', v='value')} AS rx, {RANK.format(by='gene_id, platform', v='y')} AS ry FROM x),
pc AS (SELECT gene_id, platform, {CORR.format(x='rx', y='ry')} AS coefficient, count(*) AS n FROM rp GROUP BY 1, 2 HAVING count(*) >= 5), """ + _consensus_sql("pc", "platform", 2, 0.1))
def platform_consensus(spark, sf):
    return rounded(R.consensus(R.platform_correlations(T.genes_and_target(T.expression(spark, sf))), "platform", 3, 2, 0.1))


_SIG = "1 / (1 + exp(-({v} - {m}) / (CASE WHEN {s} < 1e-9 THEN 1.0 ELSE {s} END)))"


@query(T.EXPR_SQL + f""", {_ALL}, ok AS (SELECT *, abs(coefficient) / (p_value + 1e-10) AS rs FROM am WHERE method <> 'regression' AND abs(coefficient) >= 0.1 AND p_value <= 0.05),
ge AS (SELECT gene_id, count(*) AS num_methods, string_agg(method, ', ' ORDER BY method) AS methods, avg(rs) AS rs, avg(coefficient) AS mean_correlation, avg(abs(coefficient)) AS mean_abs_correlation, exp(avg(ln(greatest(1e-300, least(1.0, p_value))))) AS geo_mean_p_value FROM ok GROUP BY 1),
lv AS (SELECT gene_id, avg(value) AS lev, CASE WHEN abs(avg(value)) > 1e-9 THEN stddev_pop(value) / avg(value) END AS cv FROM e GROUP BY 1), gl AS (SELECT * FROM ge JOIN lv USING (gene_id)),
mm AS (SELECT max(rs) AS top, avg(lev) AS ml, stddev_pop(lev) AS sl, avg(cv) AS mv, stddev_pop(cv) AS sv FROM gl),
fs AS (SELECT *, least(1.0, rs / top) AS c_, {_SIG.format(v='lev', m='ml', s='sl')} AS l_, coalesce(1 - {_SIG.format(v='cv', m='mv', s='sv')}, 0.0) AS s_ FROM gl, mm)
SELECT gene_id, num_methods, methods, {_r('mean_correlation', 'mean_abs_correlation', 'geo_mean_p_value', 'lev AS expression_level', 'cv AS expression_variability_cv', 'c_ AS correlation_score', 'l_ AS expression_level_score', 's_ AS expression_stability_score', '0.4 * c_ + 0.3 * l_ + 0.15 * s_ AS final_score')} FROM fs""")
def composite_gene_rank(spark, sf):
    e = T.expression(spark, sf)
    rows = A.correlations(T.genes_and_target(e), ("pearson", "spearman", "kendall"))
    return rounded(R.composite_rank(rows, e, None, 0.1, 0.05).drop("mean_corr_rank_score", "rank_stability_perc", "rank_stability_score"))


@query()
def composite_gene_rank_bootstrap(spark, sf):
    e = T.expression(spark, sf)
    x = T.genes_and_target(e)
    methods = ("pearson", "spearman", "kendall")
    boot = A.bootstrap(x, methods=methods)
    return rounded(R.composite_rank(A.correlations(x, methods), e, boot.groupBy("gene_id").agg(F.max("rank_stability_perc").alias("rank_stability_perc")), 0.1, 0.05))


AUC = f"""ct AS (SELECT quantile_cont(y, 0.5) AS cut FROM tg), lb AS (SELECT gene_id, sample_id, value, y > cut AS pos, {RANK.format(by='gene_id', v='value')} AS rk FROM x, ct),
au AS (SELECT gene_id, (sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / nullif(count(*) FILTER (pos) * count(*) FILTER (NOT pos), 0) AS raw, avg(value) AS mean_expr FROM lb GROUP BY 1),
mk AS (SELECT gene_id, greatest(raw, 1 - raw) AS auc, CASE WHEN raw >= 0.5 THEN 'positive' ELSE 'negative' END AS direction, mean_expr FROM au)"""


@query(T.EXPR_SQL + f", {AUC} SELECT gene_id, {_r('auc')}, direction, {_r('mean_expr')} FROM mk")
def binary_marker_auc(spark, sf):
    return rounded(R.binary_auc(T.genes_and_target(T.expression(spark, sf))))


@query(T.EXPR_SQL + f""", {AUC}, en AS (SELECT gene_id, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM x GROUP BY 1),
gr AS (SELECT gene_id, i, lo + (hi - lo) * i / 19 AS thr FROM en, range(20) t(i)),
ht AS (SELECT lb.gene_id, i, thr, direction, pos, CASE WHEN direction = 'positive' THEN value >= thr ELSE value < thr END AS hit FROM lb JOIN mk USING (gene_id) JOIN gr USING (gene_id)),
cn AS (SELECT gene_id, i, thr, direction, count(*) FILTER (hit AND pos) AS tp, count(*) FILTER (hit AND NOT pos) AS fp, count(*) FILTER (NOT hit AND NOT pos) AS tn, count(*) FILTER (NOT hit AND pos) AS fn FROM ht GROUP BY ALL),
sc AS (SELECT *, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS sensitivity, tn / nullif(CAST(tn + fp AS DOUBLE), 0) AS specificity FROM cn),
bs AS (SELECT *, (sensitivity + specificity) / 2 AS balanced_accuracy FROM sc),
kk AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY round(balanced_accuracy, 9) DESC, i) AS k FROM bs)
SELECT gene_id, {_r('thr AS optimal_threshold', 'balanced_accuracy', 'sensitivity', 'specificity')}, tp, fp, tn, fn, direction FROM kk WHERE k = 1""")
def optimal_thresholds(spark, sf):
    x = T.genes_and_target(T.expression(spark, sf))
    return rounded(R.optimal_thresholds(x, R.binary_auc(x)))


@query(T.EXPR_SQL + f""", {SPEARMAN}, bt AS (SELECT gene_id, r FROM sp ORDER BY round(abs(r), 9) DESC, gene_id LIMIT 20)
SELECT a.gene_id AS a, b.gene_id AS b, {_r('a.r * b.r AS weight')} FROM bt a JOIN bt b ON a.gene_id < b.gene_id WHERE abs(a.r * b.r) >= 0.01""")
def cocorrelation_edges(spark, sf):
    s = A.spearman(T.genes_and_target(T.expression(spark, sf))).select("gene_id", F.col("r").alias("coefficient"))
    return rounded(R.co_edges(s, 20, 0.01))


@query()
def panel_greedy_loocv(spark, sf):
    e = T.expression(spark, sf)
    best = A.spearman(T.genes_and_target(e), dense=True).orderBy(F.desc(F.abs("r")), "gene_id").limit(100)
    y = [r["y"] for r in T.target(e).orderBy("sample_id").collect()]  # a row a sample
    return rounded(R.panels(to_vectors(e), best.select("gene_id", F.abs("r").alias("score"), F.col("r").alias("correlation")), y))


# --- validation -------------------------------------------------------------------------------------------------------

DIST = """pd AS (SELECT a.vec_id AS i, a.label AS label, b.vec_id AS j, b.label AS other, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"""


@query(f"""WITH {DIST}, m AS (SELECT i, label, other, avg(d) AS m FROM pd GROUP BY 1, 2, 3),
s AS (SELECT i, max(m) FILTER (label = other) AS a, min(m) FILTER (label <> other) AS b FROM m GROUP BY 1)
SELECT {_r('avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0.0)) AS silhouette')} FROM s""")
def silhouette_by_label(spark, sf):
    return rounded(V.silhouette(T.read(spark, sf, "embeddings")))


@query(f"""WITH {DIST}, k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(d, 6), j) AS p FROM pd QUALIFY p <= 15)
SELECT {_r('avg(s) AS same_label_share')} FROM (SELECT i, avg(CASE WHEN label = other THEN 1.0 ELSE 0.0 END) AS s FROM k GROUP BY 1)""")
def knn_mixing(spark, sf):
    return rounded(V.knn_mixing(T.read(spark, sf, "embeddings")))


@query()
def sample_pca(spark, sf):
    return rounded(V.stage_pca({"raw": T.expression(spark, sf)}, 2))


# --- sequences --------------------------------------------------------------------------------------------------------

GC = "length(regexp_replace({s}, '[^GCS]', '', 'g')) * 100.0 / nullif(length(regexp_replace({s}, '[^GCSATUW]', '', 'g')), 0)"
UTR = f"""SELECT id, length(utr5) AS UTR5_length, {GC.format(s='utr5')} AS UTR5_GC, len(regexp_extract_all(utr5, 'ATG')) AS UTR5_AUG_count,
  regexp_matches(utr5, 'GCCACC|CCACC') AS kozak_sequence_present, regexp_matches(utr5, '^C[CT]{{4,15}}') AS TOP_motif_present,
  regexp_matches(utr5, 'G{{3,}}.{{1,7}}G{{3,}}.{{1,7}}G{{3,}}.{{1,7}}G{{3,}}') AS G_quadruplex_present, length(utr3) AS UTR3_length, {GC.format(s='utr3')} AS UTR3_GC,
  regexp_matches(utr3, 'AATAAA') AS polyA_signal_present, regexp_matches(utr3, 'ATTTA') AS ARE_motifs_present, len(regexp_extract_all(utr3, 'A[ACGT]{{6}}A')) AS miRNA_seed_matches, quality FROM q"""
_CODE = "(VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in GENETIC_CODE.items()) + ") code(codon, aa)"
CODONS = f"""cd AS (SELECT id, codon, count(*) AS n FROM (SELECT id, substring(cds, CAST(3 * i + 1 AS INT), 3) AS codon FROM (SELECT id, cds, unnest(range(length(cds) // 3)) AS i FROM q WHERE length(cds) > 0 AND length(cds) % 3 = 0)) GROUP BY 1, 2),
aa AS (SELECT cd.*, code.aa, max(n) OVER (PARTITION BY id, code.aa) AS top FROM cd JOIN {_CODE} USING (codon)),
fam AS (SELECT aa, count(*) AS k FROM {_CODE} GROUP BY 1),
gc3 AS (SELECT id, sum(CASE WHEN substring(codon, 3, 1) IN ('G', 'C') THEN n ELSE 0 END) * 100.0 / sum(n) AS GC3_content,
  coalesce(exp(sum(CASE WHEN k > 1 AND aa <> '*' THEN n * ln(CAST(n AS DOUBLE) / top) END) / nullif(sum(CASE WHEN k > 1 AND aa <> '*' THEN n END), 0)), 0.0) AS CAI FROM aa JOIN fam USING (aa) GROUP BY 1)"""
FEAT = f"ut AS ({UTR}), ft AS (SELECT ut.*, GC3_content, CAI FROM ut LEFT JOIN gc3 USING (id))"
SEQ_FEAT = T.SEQ_SQL + f", {CODONS}, {FEAT}"


def _features(spark, sf):
    return Q.transcript_features(T.sequences(spark, sf), ("quality",))


@query(T.SEQ_SQL + f", ut AS ({UTR}) SELECT * EXCLUDE (UTR5_GC, UTR3_GC, quality), {_r('UTR5_GC', 'UTR3_GC')} FROM ut")
def seq_utr_features(spark, sf):
    return rounded(Q.utr_features(T.sequences(spark, sf)))


@query(T.SEQ_SQL + f", {CODONS} SELECT id, codon, n, {_r('n / CAST(sum(n) OVER (PARTITION BY id) AS DOUBLE) AS freq')} FROM cd")
def codon_usage_long(spark, sf):
    return rounded(Q.codon_usage(T.sequences(spark, sf)))


@query(T.SEQ_SQL + f", {CODONS} SELECT id, {_r('GC3_content', 'CAI')} FROM gc3")
def codon_gc3_cai(spark, sf):
    return rounded(Q.gc3_cai(T.sequences(spark, sf)).filter("GC3_content is not null"))


KMERS = "km AS (SELECT id, quality, substring(cds, CAST(i + 1 AS INT), 6) AS motif FROM (SELECT *, unnest(range(greatest(length(cds) - 5, 0))) AS i FROM q))"


@query(T.SEQ_SQL + f", {KMERS} SELECT motif AS kmer, count(*) AS n FROM km GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def kmer_topn(spark, sf):
    return Q.kmer_counts(T.sequences(spark, sf), "cds", 6, 30)


@query(T.SEQ_SQL + f""", {KMERS}, pr AS (SELECT motif, quality, id, count(*) AS c FROM km GROUP BY 1, 2, 3),
sz AS (SELECT count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0 FROM q),
kb AS (SELECT motif, CAST(sum(CASE WHEN quality = 1 THEN c ELSE 0 END) AS BIGINT) AS count1, CAST(sum(CASE WHEN quality = 0 THEN c ELSE 0 END) AS BIGINT) AS count0, count(*) FILTER (quality = 1) AS seq1, count(*) FILTER (quality = 0) AS seq0 FROM pr GROUP BY 1)
SELECT motif, count1, count0, seq1, seq0, n1, n0, {_r('count1 / CAST(n1 AS DOUBLE) AS freq1', 'CASE WHEN count0 > 0 THEN count0 ELSE 0.5 END / CAST(n0 AS DOUBLE) AS freq0', '(count1 / CAST(n1 AS DOUBLE)) / (CASE WHEN count0 > 0 THEN count0 ELSE 0.5 END / CAST(n0 AS DOUBLE)) AS fold')}
FROM kb, sz WHERE count1 > 0""")
def kmer_enrichment_fold(spark, sf):
    return rounded(Q.kmer_enrichment(T.sequences(spark, sf), "cds", "quality", 6, None))


_KMER3 = KMERS.replace("cds", "utr3")


@query(T.SEQ_SQL + f""", {_KMER3}, pr AS (SELECT motif, quality, id, count(*) AS c FROM km GROUP BY 1, 2, 3), sz AS (SELECT count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0 FROM q),
kb AS (SELECT motif, CAST(sum(CASE WHEN quality = 1 THEN c ELSE 0 END) AS BIGINT) AS count1, CAST(sum(CASE WHEN quality = 0 THEN c ELSE 0 END) AS BIGINT) AS count0, count(*) FILTER (quality = 1) AS seq1, count(*) FILTER (quality = 0) AS seq0 FROM pr GROUP BY 1),
kf AS (SELECT *, count1 / CAST(n1 AS DOUBLE) AS freq1, CASE WHEN count0 > 0 THEN count0 ELSE 0.5 END / CAST(n0 AS DOUBLE) AS freq0, {fisher_p_sql('seq1', '(n1 - seq1)', 'seq0', '(n0 - seq0)')} AS p_value FROM kb, sz WHERE count1 > 0), {bh_sql('p_value', 'kf')}
SELECT motif, count1, count0, seq1, seq0, n1, n0, {_r('freq1', 'freq0', 'freq1 / freq0 AS fold', 'p_value', 'bh AS p_adjusted')} FROM hb ORDER BY freq1 / freq0 DESC, motif LIMIT 30""")
def motif_enrichment(spark, sf):
    return rounded(Q.kmer_enrichment(T.sequences(spark, sf), "utr3", "quality", 6, 30))


def _presence_sql(column: str, motifs: dict[str, str]) -> str:
    parts = " UNION ALL ".join(f"SELECT '{m}' AS motif, count(*) FILTER (quality = 1 AND regexp_matches({column}, '{p}')) AS seq1, count(*) FILTER (quality = 0 AND regexp_matches({column}, '{p}')) AS seq0, count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0 FROM q WHERE length({column}) > 0" for m, p in motifs.items())
    return T.SEQ_SQL + f", mp AS ({parts}) SELECT motif, seq1, seq0, n1, n0, {_r('seq1 / CAST(n1 AS DOUBLE) AS freq1', 'seq0 / CAST(n0 AS DOUBLE) AS freq0', 'seq1 * (n0 - seq0) / nullif(CAST(seq0 * (n1 - seq1) AS DOUBLE), 0) AS odds_ratio')} FROM mp"


@query(_presence_sql("utr5", UTR5_MOTIFS))
def motif_presence_utr5(spark, sf):
    return rounded(Q.motif_presence(T.sequences(spark, sf), "utr5", UTR5_MOTIFS, "quality", p_values=False))


@query(_presence_sql("utr3", UTR3_MOTIFS))
def motif_presence_utr3(spark, sf):
    return rounded(Q.motif_presence(T.sequences(spark, sf), "utr3", UTR3_MOTIFS, "quality", p_values=False))


@query(_presence_sql("utr3", UTR3_MOTIFS).rsplit("SELECT motif", 1)[0].rstrip() + f""", mf AS (SELECT *, {fisher_p_sql('seq1', '(n1 - seq1)', 'seq0', '(n0 - seq0)')} AS p_value FROM mp), {bh_sql('p_value', 'mf')}
SELECT motif, seq1, seq0, n1, n0, {_r('seq1 / CAST(n1 AS DOUBLE) AS freq1', 'seq0 / CAST(n0 AS DOUBLE) AS freq0', 'seq1 * (n0 - seq0) / nullif(CAST(seq0 * (n1 - seq1) AS DOUBLE), 0) AS odds_ratio', 'p_value', 'bh AS p_adjusted')} FROM hb""")
def motif_presence_p(spark, sf):
    return rounded(Q.motif_presence(T.sequences(spark, sf), "utr3", UTR3_MOTIFS, "quality"))


@query(T.SEQ_SQL + f", ut AS ({UTR}) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({c}) AS n FROM ut" for c in ("kozak_sequence_present", "TOP_motif_present", "G_quadruplex_present", "polyA_signal_present", "ARE_motifs_present")))
def motif_flag_totals(spark, sf):
    return Q.motif_flag_totals(Q.utr_features(T.sequences(spark, sf)))


@query(T.SEQ_SQL + f", {CODONS}, cf AS (SELECT id, codon, n / CAST(sum(n) OVER (PARTITION BY id) AS DOUBLE) AS freq FROM cd) SELECT codon, {_r('sum(freq) / (SELECT count(DISTINCT id) FROM cf) AS mean_freq')} FROM cf GROUP BY 1")
def mean_codon_usage(spark, sf):
    return rounded(Q.mean_codon_usage(Q.codon_usage(T.sequences(spark, sf))))


@query(T.EXPR_SQL + f""", {GENE_STATS}, ct AS (SELECT quantile_cont(cv, 1/3.0) AS lo, quantile_cont(cv, 2/3.0) AS hi FROM gs)
SELECT gene_id, {_r('cv')}, CASE WHEN cv <= lo THEN 'High' WHEN cv <= hi THEN 'Medium' ELSE 'Low' END AS stability_category FROM gs, ct""")
def stability_category(spark, sf):
    return rounded(Q.stability_category(D.gene_stats(T.expression(spark, sf)).select("gene_id", "cv"), "cv"))


# --- features ---------------------------------------------------------------------------------------------------------

LONGF = "lf AS (" + " UNION ALL ".join(f"SELECT id, quality, GC3_content AS y, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM ft WHERE {f} IS NOT NULL" for f in FEATURES) + ")"
OTHERS = [f for f in FEATURES if f != "GC3_content"]


@query(SEQ_FEAT + f""", {LONGF}, rf AS (SELECT *, {RANK.format(by='feature', v='x')} AS rx, {RANK.format(by='feature', v='y')} AS ry FROM lf WHERE feature <> 'GC3_content' AND y IS NOT NULL),
sg AS (SELECT feature, {CORR.format(x='x', y='y')} AS pearson_r, {CORR.format(x='rx', y='ry')} AS spearman_rho, count(*) AS n_samples FROM rf GROUP BY 1 HAVING count(*) >= 10)
SELECT feature, {_r('pearson_r', 'spearman_rho', '(abs(pearson_r) + abs(spearman_rho)) / 2 AS effect_size')}, n_samples FROM sg""")
def feature_significance(spark, sf):
    return rounded(X.significance(_features(spark, sf), OTHERS, "GC3_content", p_values=False))


_SIGNIFICANT = f"""{LONGF}, rf AS (SELECT *, {RANK.format(by='feature', v='x')} AS rx, {RANK.format(by='feature', v='y')} AS ry FROM lf WHERE feature <> 'GC3_content' AND y IS NOT NULL),
sg AS (SELECT feature, {CORR.format(x='x', y='y')} AS pearson_r, {CORR.format(x='rx', y='ry')} AS spearman_rho, count(*) AS n_samples FROM rf GROUP BY 1 HAVING count(*) >= 10),
s1 AS (SELECT *, 1.0 / (n_samples * n_samples) AS fl, greatest({t_p_sql('pearson_r', 'n_samples')}, 1.0 / (n_samples * n_samples)) AS pearson_p, greatest({t_p_sql('spearman_rho', 'n_samples')}, 1.0 / (n_samples * n_samples)) AS spearman_p FROM sg),
{bh_sql('pearson_p', 's1')}, s2 AS (SELECT feature, pearson_r, spearman_rho, n_samples, fl, pearson_p, spearman_p, greatest(bh, fl) AS pearson_p_adjusted FROM hb),
""" + bh_sql("spearman_p", "s2").replace("hk AS", "hk2 AS").replace("FROM hk)", "FROM hk2)").replace("hb AS", "hb2 AS")


@query(SEQ_FEAT + f""", {_SIGNIFICANT} SELECT feature, {_r('pearson_r', 'spearman_rho', '(abs(pearson_r) + abs(spearman_rho)) / 2 AS effect_size', 'pearson_p', 'spearman_p', 'pearson_p_adjusted', 'greatest(bh, fl) AS spearman_p_adjusted')}, n_samples,
  pearson_p_adjusted < 0.05 OR greatest(bh, fl) < 0.05 AS is_significant FROM hb2""")
def feature_significance_p(spark, sf):
    return rounded(X.significance(_features(spark, sf), OTHERS, "GC3_content"))


_WHOLE = "wh AS (SELECT * FROM ft WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in OTHERS) + ")"
_RANKED = _WHOLE + ", rr AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS {f}" for f in OTHERS) + " FROM wh)"


@query(SEQ_FEAT + f", {_RANKED}, ia AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, {CORR.format(x=a, y=b)} AS correlation FROM rr" for a, b in combinations(OTHERS, 2))
       + f") SELECT feature1, feature2, {_r('correlation')}, CASE WHEN correlation > 0 THEN 'synergistic' ELSE 'antagonistic' END AS interaction_type FROM ia")
def feature_interaction_pairs(spark, sf):
    return rounded(X.interactions(_features(spark, sf), OTHERS, "id", information=False))


_PAIRS = list(combinations(["UTR5_GC", "UTR3_GC", "UTR3_length", "CAI"], 2))


@query(SEQ_FEAT + ", dd AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b, GC3_content AS y, CAST({a} AS DOUBLE) * {b} AS m FROM ft WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND GC3_content IS NOT NULL" for a, b in _PAIRS) + f"""),
cc AS (SELECT feature1, feature2, count(*) AS n, covar_pop(a,a) AS aa, covar_pop(a,b) AS ab, covar_pop(a,m) AS am, covar_pop(a,y) AS ay, covar_pop(b,b) AS bb, covar_pop(b,m) AS bm, covar_pop(b,y) AS by_, covar_pop(m,m) AS mm, covar_pop(m,y) AS my, covar_pop(y,y) AS yy FROM dd GROUP BY 1, 2),
kk AS (SELECT *, aa * bb - ab * ab AS det FROM cc), k2 AS (SELECT *, (am * bb - bm * ab) / det AS ka, (bm * aa - am * ab) / det AS kb, (ay * ay * bb - 2 * ay * by_ * ab + by_ * by_ * aa) / (det * yy) AS r2 FROM kk),
k3 AS (SELECT *, (my - ka * ay - kb * by_) AS l, mm - ka * am - kb * bm AS vr, my * my / (mm * yy) AS rm FROM k2)
SELECT feature1, feature2, n, {_r('r2 AS r2_base', 'r2 + l * l / (vr * yy) AS r2_full', 'l * l / (vr * yy) AS delta_r2', 'rm / (1 - rm) * (n - 2) AS f')} FROM k3""")
def interaction_delta_r2(spark, sf):
    return rounded(X.interaction_gain(_features(spark, sf), _PAIRS, "GC3_content"))


@query(SEQ_FEAT + f""", {LONGF}, rg AS (SELECT *, {RANK.format(by='feature', v='x')} AS rk FROM lf),
gg AS (SELECT feature, count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0, avg(x) FILTER (quality = 1) AS mean1, avg(x) FILTER (quality = 0) AS mean0, median(x) FILTER (quality = 1) AS median1,
  median(x) FILTER (quality = 0) AS median0, var_samp(x) FILTER (quality = 1) AS v1, var_samp(x) FILTER (quality = 0) AS v0, sum(rk) FILTER (quality = 1) AS rs FROM rg GROUP BY 1)
SELECT feature, n1, n0, {_r('mean1', 'mean0', 'median1', 'median0', 'mean1 - mean0 AS difference', 'CASE WHEN v1 < 1e-9 AND v0 < 1e-9 THEN 0.0 ELSE (mean1 - mean0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 0) END AS cohens_d', 'rs - n1 * (n1 + 1) / 2.0 AS u', '(mean1 - mean0) / nullif(sqrt(v1 / n1 + v0 / n0), 0) AS t')}
FROM gg WHERE n1 >= 5 AND n0 >= 5""")
def group_feature_comparison(spark, sf):
    return rounded(X.group_comparison(_features(spark, sf), FEATURES, "quality"))


def _similar_sql(profile: str) -> str:
    own = {f: v for f, v in X.REFERENCE_PROFILES[profile].items() if v[1] > 0}
    zs = ", ".join(f"({f} - {m}) / {sd} AS {f}_z" for f, (m, sd) in own.items())
    total, there = " + ".join(f"coalesce(abs({f}_z), 0)" for f in own), " + ".join(f"CAST({f}_z IS NOT NULL AS INT)" for f in own)
    return SEQ_FEAT + f""", zz AS (SELECT id, {zs} FROM ft), z2 AS (SELECT *, ({total}) / nullif({there}, 0) AS z FROM zz), yy AS (SELECT *, 1 / (1 + z) AS sim FROM z2),
sm AS (SELECT id, {', '.join(f'{f}_z' for f in own)}, z AS mean_abs_z, sim AS reference_similarity, (rank() OVER (ORDER BY sim) + (count(*) OVER (PARTITION BY sim) - 1) / 2.0) * 100.0 / count(*) OVER () AS similarity_percentile FROM yy)"""


for _p in X.REFERENCE_PROFILES:
    _cols = [f"{f}_z" for f, v in X.REFERENCE_PROFILES[_p].items() if v[1] > 0] + ["mean_abs_z", "reference_similarity", "similarity_percentile"]
    query(_similar_sql(_p) + f" SELECT id, {_r(*_cols)} FROM sm", f"reference_similarity_{_p}")(lambda spark, sf, p=_p: rounded(X.similarity(_features(spark, sf), X.REFERENCE_PROFILES[p])))


@query(_similar_sql("high_expression") + " SELECT CASE WHEN similarity_percentile >= 75 THEN 'high' WHEN similarity_percentile >= 25 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, "
       + _r(*[f"avg(abs({f}_z)) AS {f}" for f in X.REFERENCE_PROFILES["high_expression"]]) + " FROM sm GROUP BY 1")
def similarity_radar(spark, sf):
    return rounded(X.similarity_bands(X.similarity(_features(spark, sf), X.REFERENCE_PROFILES["high_expression"])))


FREG = f"""{LONGF}, fr AS (SELECT feature, {CORR.format(x='x', y='y')} AS r, count(*) AS n FROM lf WHERE feature <> 'GC3_content' AND y IS NOT NULL GROUP BY 1),
fv AS (SELECT *, r * r / nullif(1 - r * r, 0) * (n - 2) AS f FROM fr)"""


def _freg(spark, sf):
    return X.f_regression(_features(spark, sf).filter("GC3_content is not null"), OTHERS, "GC3_content")


@query(SEQ_FEAT + f", {FREG} SELECT feature, {_r('r')}, n, {_r('f', 'f / max(f) OVER () AS normalized_importance')} FROM fv")
def f_regression_select(spark, sf):
    return rounded(_freg(spark, sf))


@query(SEQ_FEAT + f""", {FREG}, pp AS (SELECT feature, row_number() OVER (ORDER BY round(f, 9) DESC, feature) AS priority FROM fv),
im AS (SELECT *, greatest(10.0 - 0.5 * (priority - 1), 0.5) AS estimated_impact FROM pp)
SELECT feature, priority, {_r('estimated_impact', 'sum(estimated_impact) OVER (ORDER BY priority ROWS UNBOUNDED PRECEDING) AS cumulative_impact')} FROM im""")
def optimization_impact(spark, sf):
    return rounded(X.impact(_freg(spark, sf), "f"))


_PROFILED = ["UTR5_length", "UTR5_GC", "UTR3_length", "UTR3_GC", "GC3_content", "CAI"]
_SUBSETS = (("stability", "k1"), ("expression", "k2"), ("balanced", "k3"))


def _range_sql(name: str, k: str) -> list[str]:
    v, m = f"quantile_cont(x, {{q}}) FILTER ({k} <= top)", f"abs(avg(x) FILTER ({k} <= top)) * 0.1"
    lo, hi = v.format(q=0.1), v.format(q=0.9)
    return [f"avg(x) FILTER ({k} <= top) AS {name}_profile_mean", f"CASE WHEN {lo} < {hi} THEN {lo} ELSE {lo} - {m} END AS {name}_range_lo", f"CASE WHEN {lo} < {hi} THEN {hi} ELSE {hi} + {m} END AS {name}_range_hi"]


PROFILE_SQL = f"""k1 AS (SELECT *, row_number() OVER (ORDER BY UTR3_length, id) AS k1, row_number() OVER (ORDER BY UTR5_AUG_count DESC, id) AS k2, count(*) OVER () AS total,
  rank() OVER (ORDER BY UTR3_length) + (count(*) OVER (PARTITION BY UTR3_length) - 1) / 2.0 + rank() OVER (ORDER BY UTR5_AUG_count DESC) + (count(*) OVER (PARTITION BY UTR5_AUG_count) - 1) / 2.0 AS rs FROM ft),
k3 AS (SELECT *, row_number() OVER (ORDER BY rs, id) AS k3, CAST(floor(0.2 * total) AS BIGINT) AS top FROM k1),
pl AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x, k1, k2, k3, top FROM k3 WHERE {f} IS NOT NULL" for f in _PROFILED)})"""


@query(SEQ_FEAT + f""", {PROFILE_SQL} SELECT feature, CASE WHEN feature LIKE 'UTR5%' THEN 'UTR5' WHEN feature LIKE 'UTR3%' THEN 'UTR3' ELSE 'CDS' END AS region,
  {_r('avg(x) AS population_mean', 'stddev_samp(x) AS population_std', *[f'quantile_cont(x, {q}) AS population_q{int(q * 100)}' for q in X.QUANTILES], *[c for n, k in _SUBSETS for c in _range_sql(n, k)])} FROM pl GROUP BY 1""")
def optimal_profiles(spark, sf):
    return rounded(_profiles(spark, sf))


def _profiles(spark, sf):
    return X.profiles(_features(spark, sf), _PROFILED, "UTR3_length", "UTR5_AUG_count")


@query(T.EXPR_SQL + f", {ANOVA} SELECT gene_id, {_r('f', 'p AS p_value')}, df1, df2 FROM ap")
def anova_p(spark, sf):
    a = B.anova(T.expression(spark, sf))
    return rounded(a.withColumn("p_value", f_p("f", F.col("df1").cast("double"), F.col("df2").cast("double"))))
