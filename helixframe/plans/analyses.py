"""Further registered queries: lookups and joins, corrections and their validation, panels and markers, models and design,
and the tables behind plots. As in catalogue.py, statistics are rounded to six places and have SQL where SQL can say them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import benjamini_hochberg, bonferroni, fold, held_out, r6
from ..functions.sequences import UTR5_MOTIFS, transcribe
from ..functions.stages import cut, scratch
from ..operators import association as A
from ..operators import batch as B
from ..operators import counts as C
from ..operators import descriptive as D
from ..operators import features as X
from ..operators import modelling as L
from ..operators import nbglm as NB
from ..operators import ranking as R
from ..operators import sequence as Q
from ..operators import validation as V
from ..sources import matrix as M
from ..sources import splits
from ..sources import tables as T
from ..sources.matrix import to_vectors
from ..streaming.moments import windowed_correlation
from . import plotdata as P
from .catalogue import CORR, FEATURES, GENE_STATS, METHODS_SQL, OTHERS, PROFILE_SQL, SEQ_FEAT, SPEARMAN, _features, _profiles, _range_sql
from .registry import bh_sql, normal_p_sql, query, rounded
from .registry import select_rounded as _r

# --- sources, predicates, joins ----------------------------------------------------------------------------------------


def _genes(spark, sf):
    return T.read(spark, sf, "part").select(F.concat_ws("|", "p_brand", "p_type").alias("gene_id"), F.col("p_brand").alias("sym")).distinct()


@query(T.EXPR_SQL + "SELECT sample_id, platform FROM samples WHERE platform <> 'Unknown'")
def platform_map(spark, sf):
    return M.platform_map(T.samples(spark, sf))


@query(T.EXPR_SQL + "SELECT gene_id FROM e GROUP BY 1 HAVING bool_and(value > 0)")
def expressed_everywhere(spark, sf):
    return T.expression(spark, sf).groupBy("gene_id").agg(F.bool_and(F.col("value") > 0).alias("all_")).filter("all_").select("gene_id")


@query(T.EXPR_SQL + f"SELECT gene_id, sample_id, {_r('coalesce(nullif(value, 0), avg(nullif(value, 0)) OVER (PARTITION BY gene_id)) AS value')} FROM e")
def row_mean_imputation(spark, sf):
    e = T.expression(spark, sf)
    return rounded(D.impute_row_mean(e.withColumn("value", F.nullif("value", F.lit(0.0)))).select("gene_id", "sample_id", "value"))


@query(T.EXPR_SQL + """, k AS (SELECT sample_id, platform FROM samples WHERE sample_id NOT LIKE '%|1995')
SELECT e.sample_id, coalesce(k.platform, 'Unknown') AS platform, count(*) AS n FROM e LEFT JOIN k USING (sample_id) GROUP BY 1, 2""")
def unknown_platforms(spark, sf):
    known = T.samples(spark, sf).filter("sample_id not like '%|1995'")
    return M.with_platform(T.expression(spark, sf).drop("platform"), known).groupBy("sample_id", "platform").agg(F.count("*").alias("n"))


@query(T.EXPR_SQL + f", {GENE_STATS}, mt AS (SELECT DISTINCT p_brand || '|' || p_type AS gene_id, p_brand AS sym FROM part WHERE p_brand < 'Brand#3') SELECT gs.gene_id, mt.sym, {_r('mean')} FROM mt RIGHT JOIN gs ON mt.gene_id = gs.gene_id")
def metadata_right_join(spark, sf):
    stats = D.gene_stats(T.expression(spark, sf)).select("gene_id", "mean")
    return rounded(M.with_metadata(_genes(spark, sf).filter("sym < 'Brand#3'"), stats).select("gene_id", "sym", "mean"))


@query(T.EXPR_SQL + f", {SPEARMAN} SELECT sp.gene_id, coalesce(g.sym, sp.gene_id) AS sym, {_r('r')} FROM sp LEFT JOIN (SELECT DISTINCT p_brand || '|' || p_type AS gene_id, p_brand AS sym FROM part WHERE p_brand < 'Brand#3') g USING (gene_id)")
def symbol_lookup(spark, sf):
    rows = A.spearman(T.genes_and_target(T.expression(spark, sf)), dense=True).select("gene_id", "r")
    return rounded(R.with_symbols(rows, _genes(spark, sf).filter("sym < 'Brand#3'")).select("gene_id", "sym", "r"))


@query(T.EXPR_SQL + ", ac AS (SELECT DISTINCT 'SRR' || CAST(year(o_orderdate) AS VARCHAR) || '_1' AS accession FROM orders WHERE year(o_orderdate) > 1994) SELECT sample_id, accession FROM samples LEFT JOIN ac ON regexp_extract(sample_id, '(\\d+)', 1) = regexp_extract(accession, '(\\d+)', 1)")
def accession_join(spark, sf):
    years = T.read(spark, sf, "orders").select(F.year("o_orderdate").alias("y")).filter("y > 1994").distinct()
    return M.join_by_accession(T.samples(spark, sf), years.select(F.concat(F.lit("SRR"), F.col("y").cast("string"), F.lit("_1")).alias("accession")), accession="accession").select("sample_id", "accession")


@query(T.EXPR_SQL + f", {GENE_STATS}, ps AS (SELECT gene_id, least(1.0, cv / 3) AS p FROM gs) SELECT gene_id, {_r('p', 'least(1.0, p * count(*) OVER ()) AS adjusted')} FROM ps")
def bonferroni_adjust(spark, sf):
    p = D.gene_stats(T.expression(spark, sf)).select("gene_id", F.least(F.lit(1.0), F.col("cv") / 3).alias("p"))
    return rounded(bonferroni(cut(p), "p", "adjusted"))


_MED = ", ".join(f"coalesce(CAST({f} AS DOUBLE), (SELECT median(CAST({f} AS DOUBLE)) FROM ft)) AS {f}" for f in FEATURES)


@query(SEQ_FEAT + f", md AS (SELECT id, {_MED} FROM ft) SELECT id, {_r(*FEATURES)} FROM md")
def median_imputation(spark, sf):
    return rounded(L.clean_features(cut(_features(spark, sf).select("id", *FEATURES)), FEATURES))


@query(SEQ_FEAT + " SELECT feature FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) - count({f}) AS gone, count(*) AS n FROM ft" for f in FEATURES) + ") WHERE gone <= 0.5 * n")
def dense_features(spark, sf):
    return spark.createDataFrame([(f,) for f in L.dense_features(_features(spark, sf), FEATURES)], "feature string")


# --- corrections and validation ----------------------------------------------------------------------------------------


def _with_year(spark, sf):
    """The matrix with the sample's year as a covariate."""
    return cut(T.expression(spark, sf).withColumn("year", F.substring_index("sample_id", "|", -1).cast("double")))


@query()
def pairwise_information(spark, sf):
    e = cut(T.expression(spark, sf))
    best = A.spearman(T.genes_and_target(e), dense=True).orderBy(F.desc(F.abs("r")), "gene_id").limit(100)
    return rounded(R.pair_information(to_vectors(e), best))


@query()
def cocorrelation_heatmap(spark, sf):
    s = A.spearman(T.genes_and_target(T.expression(spark, sf)), dense=True).select("gene_id", F.col("r").alias("coefficient"))
    return rounded(R.co_matrix(s))


@query()
def nb_regression(spark, sf):
    return rounded(NB.regress(_with_year(spark, sf), ["year"]))


@query()
def combat_seq_design_correction(spark, sf):
    return rounded(NB.correct(_with_year(spark, sf), ["year"]))


@query()
def combat_seq_correction(spark, sf):
    return rounded(C.combat_seq(T.expression(spark, sf)))


@query()
def combat_covariate_correction(spark, sf):
    e = T.expression(spark, sf)
    return rounded(B.combat(e.join(F.broadcast(T.target(e)), "sample_id"), "y"))


@query()
def ruv_correction(spark, sf):
    return rounded(V.remove_unwanted(T.expression(spark, sf)))


@query()
def batch_effect_detection(spark, sf):
    return rounded(V.detect_batch_effect(cut(T.expression(spark, sf))))


@query()
def ks_platform_pairs_p(spark, sf):
    return rounded(B.ks_tests(T.expression(spark, sf)))


@query()
def correction_validation(spark, sf):
    e = cut(T.expression(spark, sf))
    return rounded(V.validate_correction(e, cut(B.combat(e))))


@query()
def pca_stages(spark, sf):
    e = cut(T.expression(spark, sf))
    everywhere = e.groupBy("gene_id").agg(F.bool_and(F.col("value") > 0).alias("all_")).filter("all_")
    return rounded(V.stage_pca({"raw": e, "filtered": e.join(everywhere, "gene_id", "left_semi"), "corrected": B.combat(e)}))


# --- association, panels, markers --------------------------------------------------------------------------------------


@query()
def correlations_with_bootstrap(spark, sf):
    x = cut(T.genes_and_target(T.expression(spark, sf)))
    return rounded(A.with_bootstrap(A.correlations(x), A.bootstrap(x, methods=A.METHODS)))


@query()
def gene_regression_model(spark, sf):
    x = T.genes_and_target(T.expression(spark, sf))
    best = A.spearman(x, dense=True).orderBy(F.desc(F.round(F.abs("r"), 9)), "gene_id").limit(20)
    return rounded(A.gene_regression(x, best))


_BIN = f"""ct AS (SELECT quantile_cont(y, 0.5) AS cut FROM tg), cl AS (SELECT sample_id, y > cut AS pos FROM tg, ct),
cf AS (SELECT *, (row_number() OVER (PARTITION BY pos ORDER BY sample_id) - 1) % 3 AS fold FROM cl),
xv AS (SELECT gene_id, value, pos, fold FROM x JOIN cf USING (sample_id)),
aa AS (SELECT gene_id, (sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / nullif(count(*) FILTER (pos) * count(*) FILTER (NOT pos), 0) AS raw, avg(value) AS mean_expr
  FROM (SELECT *, rank() OVER (PARTITION BY gene_id ORDER BY value) + (count(*) OVER (PARTITION BY gene_id, value) - 1) / 2.0 AS rk FROM xv) GROUP BY 1),
fr AS (SELECT *, rank() OVER (PARTITION BY gene_id, fold ORDER BY value) + (count(*) OVER (PARTITION BY gene_id, fold, value) - 1) / 2.0 AS rk FROM xv),
fb AS (SELECT gene_id, fold, sum(rk) FILTER (pos) AS s, count(*) FILTER (pos) AS np, count(*) FILTER (NOT pos) AS nn, sum(value) FILTER (pos) AS vp, sum(value) FILTER (NOT pos) AS vn FROM fr GROUP BY 1, 2),
fu AS (SELECT *, (sum(vp) OVER w - vp) / nullif(sum(np) OVER w - np, 0) >= (sum(vn) OVER w - vn) / nullif(sum(nn) OVER w - nn, 0) AS up, (s - np * (np + 1) / 2.0) / nullif(np * nn, 0) AS a FROM fb WINDOW w AS (PARTITION BY gene_id)),
cv AS (SELECT gene_id, CASE WHEN count(a) = count(*) THEN avg(CASE WHEN up THEN a ELSE 1 - a END) ELSE 0.0 END AS cv_auc FROM fu GROUP BY 1),
bm AS (SELECT gene_id, greatest(raw, 1 - raw) AS auc, cv_auc, CASE WHEN raw >= 0.5 THEN 'positive' ELSE 'negative' END AS direction, mean_expr, 0.7 * cv_auc + 0.3 * greatest(raw, 1 - raw) AS marker_score FROM aa JOIN cv USING (gene_id))"""


@query(T.EXPR_SQL + f", {_BIN} SELECT gene_id, direction, {_r('auc', 'cv_auc', 'mean_expr', 'marker_score')} FROM bm WHERE cv_auc >= 0.5 ORDER BY round(marker_score, 9) DESC, gene_id LIMIT 50")
def binary_markers_cv(spark, sf):
    return rounded(R.binary_markers(cut(T.genes_and_target(T.expression(spark, sf))), least_auc=0.5))


@query()
def method_comparison(spark, sf):
    x = cut(T.genes_and_target(T.expression(spark, sf)))
    return rounded(R.compare_methods(cut(A.correlations(x)), x))


@query()
def panel_information_gain(spark, sf):
    e = cut(T.expression(spark, sf))
    best = A.spearman(T.genes_and_target(e), dense=True).orderBy(F.desc(F.abs("r")), "gene_id").limit(100)
    y = [r["y"] for r in T.target(e).orderBy("sample_id").collect()]  # a row a sample
    return rounded(R.panel_gains(R.panels(to_vectors(e), best.select("gene_id", F.abs("r").alias("score"), F.col("r").alias("correlation")), y)))


# --- sequences ---------------------------------------------------------------------------------------------------------

_N4 = "kn AS (SELECT substring(s, CAST(i + 1 AS INT), 4) AS kmer FROM (SELECT *, unnest(range(greatest(length(s) - 3, 0))) AS i FROM (SELECT regexp_replace(upper(text), '[^ACGTN]', '', 'g') AS s FROM documents)))"


@query(f"WITH {_N4} SELECT kmer, count(*) AS n FROM kn WHERE kmer NOT LIKE '%N%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def kmer_topn_without_n(spark, sf):
    d = T.read(spark, sf, "documents").select(F.regexp_replace(F.upper("text"), "[^ACGTN]", "").alias("s"))
    return Q.kmer_counts(d, "s", 4, 30, skip_n=True)


@query(T.SEQ_SQL + "SELECT id, replace(utr5, 'T', 'U') AS rna FROM q")
def transcription(spark, sf):
    return T.sequences(spark, sf).select("id", transcribe("utr5").alias("rna"))


@query()
def rna_structure_metrics(spark, sf):
    return rounded(Q.rna_structures(T.sequences(spark, sf), "utr5"))


@query()
def energy_by_region(spark, sf):
    return rounded(Q.energy_by_region(T.sequences(spark, sf), {"UTR5": "utr5", "UTR3": "utr3"}))


@query()
def region_motif_enrichment(spark, sf):
    return rounded(Q.region_motifs(cut(T.sequences(spark, sf)), "utr5", UTR5_MOTIFS, "quality"))


# --- features, models, design ------------------------------------------------------------------------------------------


@query()
def feature_mutual_information(spark, sf):
    return rounded(X.significance(_features(spark, sf), OTHERS, "GC3_content", key="id", method="bonferroni"))


@query()
def regional_feature_significance(spark, sf):
    return rounded(X.regional_significance(cut(_features(spark, sf)), OTHERS, ["GC3_content", "UTR3_length"]))


@query()
def feature_interaction_information(spark, sf):
    return rounded(X.interactions(_features(spark, sf), OTHERS, "id"))


@query()
def interaction_regression(spark, sf):
    names = ["UTR5_GC", "UTR3_GC", "UTR3_length", "CAI"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    return rounded(X.interaction_gain(_features(spark, sf), pairs, "GC3_content", p_values=True))


_U = f"""lf AS ({" UNION ALL ".join(f"SELECT quality, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM ft WHERE {f} IS NOT NULL" for f in FEATURES)}),
rg AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rk FROM lf),
gg AS (SELECT feature, count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0, avg(x) FILTER (quality = 1) AS m1, avg(x) FILTER (quality = 0) AS m0, sum(rk) FILTER (quality = 1) AS rs FROM rg GROUP BY 1 HAVING count(*) FILTER (quality = 1) >= 5 AND count(*) FILTER (quality = 0) >= 5),
ti AS (SELECT feature, CAST(sum(c * c * c - c) AS DOUBLE) AS t FROM (SELECT feature, count(*) AS c FROM lf GROUP BY feature, x) GROUP BY 1),
zu AS (SELECT feature, n1, n0, m1, m0, greatest(abs(rs - n1 * (n1 + 1) / 2.0 - n1 * n0 / 2.0) - 0.5, 0) / nullif(sqrt(greatest(n1 * n0 / 12.0 * (n1 + n0 + 1 - t / ((n1 + n0) * (n1 + n0 - 1.0))), 0.0)), 0) AS z FROM gg JOIN ti USING (feature)),
mw AS (SELECT *, {normal_p_sql('coalesce(z, 0.0)')} AS p FROM zu)"""


@query(SEQ_FEAT + f", {_U}, {bh_sql('p', 'mw')} SELECT feature, n1, n0, {_r('m1 / nullif(m0, 0) AS fold_change', 'p AS mann_whitney_p', 'bh AS p_adjusted')}, bh < 0.05 AS significant FROM hb")
def group_comparison_p(spark, sf):
    out = X.group_comparison(_features(spark, sf), FEATURES, "quality", p_values=True)
    return rounded(out.select("feature", "n1", "n0", "fold_change", "mann_whitney_p", "p_adjusted", "significant"))


@query()
def group_comparison_welch(spark, sf):
    return rounded(X.group_comparison(_features(spark, sf), FEATURES, "quality", p_values=True).select("feature", "t", "welch_p"))


def _categories(spark, sf):
    return cut(_features(spark, sf).join(T.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), "id"))


@query()
def category_comparison(spark, sf):
    return rounded(X.category_comparison(_categories(spark, sf), ["UTR5_GC", "UTR3_GC", "CAI"], "lang", "en"))


@query()
def category_summary(spark, sf):
    return rounded(X.significant_summary(X.category_comparison(_categories(spark, sf), ["UTR5_GC", "UTR3_GC", "CAI"], "lang", "en")))


@query(SEQ_FEAT + ", rg AS (" + " UNION ALL ".join(f"SELECT '{n}' AS region, {c} AS value FROM ft" for n, c in (("UTR5", "UTR5_GC"), ("UTR3", "UTR3_GC"), ("CDS", "GC3_content"))) + f") SELECT region, {_r('avg(value) AS mean', 'stddev_samp(value) AS std', 'min(value) AS min', 'max(value) AS max')} FROM rg GROUP BY 1")
def region_summary(spark, sf):
    own = X.long_features(_features(spark, sf).select("id", F.col("UTR5_GC").alias("UTR5"), F.col("UTR3_GC").alias("UTR3"), F.col("GC3_content").alias("CDS")), ["UTR5", "UTR3", "CDS"], ["id"])
    return rounded(P.region_summary(own, "feature", "x").withColumnRenamed("feature", "region"))


def _selected(method):
    def run(spark, sf):
        return rounded(L.select_features(cut(_features(spark, sf).select("id", *FEATURES)), OTHERS, "GC3_content", "id", method))

    return run


for _m in ("statistical", "rfe", "lasso", "statistical,rfe,lasso"):
    query(None, "feature_selection_" + ("combined" if "," in _m else _m))(_selected(_m))


_fits: dict = {}  # the last fit: what several queries read


def _fitted(spark, sf):
    """The fit with the reference's hundred trees and five folds, and its rows. Rows that are alike in a hash of their
    content are fitted once an application."""
    own = cut(_features(spark, sf).select("id", *FEATURES))
    row = F.xxhash64(*own.columns)
    content = own.agg(F.count("*"), F.bit_xor(row), F.sum(F.pmod(row, F.lit(1 << 31)))).first()
    key = (spark.sparkContext.applicationId, *content)
    if key not in _fits:
        _fits.clear()
        _fits[key] = L.fit_models(own, OTHERS, "GC3_content")
    return _fits[key], own


@query()
def ridge_gbt_model(spark, sf):
    """Metrics over the folds and of the held-out fifth."""
    return rounded(_fitted(spark, sf)[0].metrics)


@query()
def model_predictions(spark, sf):
    fitted, own = _fitted(spark, sf)
    return rounded(fitted.predict(own).select("id", "GC3_content", *L.MODELS, "error", "abs_error"))


@query()
def model_importance(spark, sf):
    return rounded(_fitted(spark, sf)[0].importance())


@query()
def optimisation_sweep(spark, sf):
    return rounded(L.optimisation_sweep(*_fitted(spark, sf)))


@query()
def optimisation_contour(spark, sf):
    return rounded(L.contour(*_fitted(spark, sf), "UTR5_GC", "UTR3_GC"))


@query()
def fold_assignment(spark, sf):
    return _features(spark, sf).select("id", fold("id", 5).cast("long").alias("fold"), held_out("id").alias("held_out"))


@query()
def design_recommendations(spark, sf):
    return rounded(X.recommendations(_profiles(spark, sf)))


@query(SEQ_FEAT + f""", {PROFILE_SQL}, rn AS (SELECT feature, {', '.join(_range_sql('balanced', 'k3'))} FROM pl GROUP BY 1),
wd AS (SELECT *, CASE WHEN balanced_range_lo >= balanced_range_hi THEN CASE WHEN balanced_profile_mean = 0 THEN balanced_range_lo + 5 ELSE balanced_profile_mean END ELSE (balanced_range_lo + balanced_range_hi) / 2 END AS mid,
  balanced_range_lo >= balanced_range_hi OR balanced_range_hi - balanced_range_lo < 10 AS narrow FROM rn)
SELECT feature, {_r('CASE WHEN narrow THEN mid - 5 ELSE balanced_range_lo END AS lo', 'CASE WHEN narrow THEN mid + 5 ELSE balanced_range_hi END AS hi')} FROM wd""")
def design_ranges(spark, sf):
    lo, hi = X.widened("balanced_range_lo", "balanced_range_hi", "balanced_profile_mean", 10.0)
    return _profiles(spark, sf).select("feature", r6(lo).alias("lo"), r6(hi).alias("hi"))


@query(SEQ_FEAT + f""", {PROFILE_SQL}, rn AS (SELECT feature, avg(x) FILTER (k3 <= top) AS v FROM pl GROUP BY 1)
SELECT feature, CASE WHEN feature LIKE '%\\_length' ESCAPE '\\' THEN format('{{:d}}', CAST(trunc(v) AS BIGINT)) WHEN feature LIKE '%GC%' THEN format('{{:.1f}}', v) || '%' ELSE format('{{:.2f}}', v) END AS shown FROM rn""")
def design_values_formatted(spark, sf):
    return _profiles(spark, sf).select("feature", X.formatted("feature", "balanced_profile_mean").alias("shown"))


@query()
def design_templates(spark, sf):
    """Templates with the note for the sequence of the first transcript as protein."""
    first = T.sequences(spark, sf).agg(F.min("cds").alias("p")).first()["p"]
    return spark.createDataFrame(sorted(X.templates(first).items()), "name string, sequence string")


# --- plot data ---------------------------------------------------------------------------------------------------------


def _tops(spark, sf, n=10):
    x = cut(T.genes_and_target(T.expression(spark, sf)))
    return x, P.top_genes(A.spearman(x, dense=True), "r", n)


_TOP10 = "t10 AS (SELECT gene_id FROM sp ORDER BY round(abs(r), 9) DESC, gene_id LIMIT 10)"


@query(T.EXPR_SQL + f", {SPEARMAN}, {_TOP10} SELECT e.gene_id, e.platform, e.sample_id, e.value FROM e JOIN t10 USING (gene_id)")
def plot_expression_by_platform(spark, sf):
    e = cut(T.expression(spark, sf))
    return P.expression_by_platform(e, P.top_genes(A.spearman(T.genes_and_target(e), dense=True), "r", 10))


@query()
def plot_scatter_matrix(spark, sf):
    return P.scatter_matrix(*_tops(spark, sf))


@query(T.EXPR_SQL + f""", vt AS (SELECT gene_id FROM e GROUP BY 1 ORDER BY round(var_pop(value), 6) DESC, gene_id LIMIT 50)
SELECT gene_id, platform, sample_id, {_r('coalesce((value - avg(value) OVER (PARTITION BY gene_id)) / nullif(stddev_pop(value) OVER (PARTITION BY gene_id), 0), 0.0) AS z')} FROM e JOIN vt USING (gene_id)""")
def plot_platform_heatmap(spark, sf):
    return rounded(P.platform_heatmap(T.expression(spark, sf)))


_FP = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


@query(SEQ_FEAT + ", fc AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, {CORR.format(x=f'CAST({a} AS DOUBLE)', y=f'CAST({b} AS DOUBLE)')} AS r FROM ft WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _FP) + f") SELECT feature1, feature2, {_r('r')} FROM fc")
def plot_feature_correlations(spark, sf):
    return rounded(P.feature_correlations(_features(spark, sf), FEATURES))


@query(T.SEQ_SQL + "SELECT id, length(cds) AS cds_length, length(cds) - length(replace(replace(cds, 'G', ''), 'C', '')) AS gc FROM q")
def fasta_ranges_scan(spark, sf):
    """The sequences as FASTA files of 60 letters a line, read back by ranges of bytes."""
    path = scratch(spark, "fasta")
    lines = F.regexp_replace("cds", "(.{60})", "$1\n")
    T.sequences(spark, sf).select(F.concat(F.lit(">"), F.col("id").cast("string"), F.lit(" coding\n"), lines)).write.text(path)
    gc = F.length("seq") - F.length(F.translate("seq", "GC", ""))
    return splits.fasta(spark, path).select(F.col("record_id").cast("long").alias("id"), F.length("seq").cast("long").alias("cds_length"), gc.cast("long").alias("gc"))


@query(T.EXPR_SQL + f"SELECT gene_id, count(*) AS n, {_r('sum(value) AS total')} FROM e WHERE platform = 'HiSeq' GROUP BY 1")
def matrix_ranges_scan(spark, sf):
    """The wide matrix as text, read back by ranges of bytes; of the samples only one platform's."""
    path = scratch(spark, "matrix")
    own = {r["sample_id"]: r["platform"] for r in T.samples(spark, sf).collect()}  # a row a sample
    wide = T.expression(spark, sf).groupBy(F.col("gene_id").alias(M.META[0])).pivot("sample_id", sorted(own)).agg(F.sum("value"))
    head = [F.col(M.META[0]), F.substring_index(M.META[0], "|", 1).alias(M.META[1])]
    wide.select(*head, *[F.col(f"`{c}`") for c in sorted(own)]).write.option("sep", "\t").option("header", True).csv(path)
    hiseq = splits.expression(spark, path, sorted(c for c, p in own.items() if p == "HiSeq"))
    return rounded(M.to_long(hiseq).groupBy("gene_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@query(T.EXPR_SQL + f", {GENE_STATS}, st AS (SELECT count(*) AS n_genes, avg(cv) AS cv FROM gs) SELECT n_genes, {_r('cv AS mean_cv')} FROM st")
def sql_views(spark, sf):
    """The matrix as a view, and a statement over it."""
    from ..control import register_views

    session = register_views({"expression_long": T.expression(spark, sf)})
    return rounded(session.sql("WITH g AS (SELECT gene_id, stddev_samp(value) / nullif(avg(value), 0) AS cv FROM expression_long GROUP BY gene_id) SELECT count(*) AS n_genes, avg(cv) AS mean_cv FROM g"))


@query(T.EXPR_SQL + f", {METHODS_SQL}, mp AS (SELECT gene_id, method, 1 - abs(coefficient) AS p FROM me), {bh_sql('p', 'mp', 'method')} SELECT gene_id, method, {_r('p', 'bh AS adjusted')} FROM hb")
def adjusted_by_method(spark, sf):
    """Benjamini-Hochberg within each method, of per-gene p from its |r|."""
    x = T.genes_and_target(T.expression(spark, sf))
    one = lambda df, m: df.select("gene_id", F.lit(m).alias("method"), (1 - F.abs("r")).alias("p"))
    return rounded(benjamini_hochberg(one(A.spearman(x, dense=True), "spearman").unionByName(one(A.pearson(x), "pearson")), "p", "adjusted", "method"))


# --- events ------------------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT date_trunc('day', ts) AS d, event_type, value AS x, CAST(hour(ts) AS DOUBLE) AS y FROM events WHERE value IS NOT NULL AND ts IS NOT NULL)
SELECT CAST(d AS DATE) AS day, event_type, count(*) AS n, round(covar_samp(x, y), 6) + 0.0 AS covariance,
  CASE WHEN stddev_samp(x) > 0 AND stddev_samp(y) > 0 THEN round(covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)), 6) + 0.0 END AS r FROM w GROUP BY 1, 2""")
def event_correlation(spark, sf):
    """Does an event's value go with the hour: a day and type; the streaming operator on the table."""
    own = windowed_correlation(T.read(spark, sf, "events").filter("value IS NOT NULL"), F.col("value"), F.hour("ts"))
    return rounded(own.select(F.col("start").cast("date").alias("day"), "event_type", "n", "covariance", "r"))
