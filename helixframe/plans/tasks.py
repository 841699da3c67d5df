"""The two analyses end to end, over DataFrames of any origin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..control import register_views, step
from ..functions.stages import cut
from ..operators import association, batch, counts, descriptive, features, modelling, ranking, sequence, validation


def correct(expr: DataFrame, config: EngineConfig) -> DataFrame:
    """Platform correction where it is called for: more than ``trigger_pct`` per cent of genes affected, or platforms
    that stand apart in the space of samples. Zeros are replaced, counts corrected by their model, and what is left by
    location and scale. The target stays as it is."""
    if expr.select("platform").distinct().count() < 2:
        return expr
    if not validation.needs_correction(validation.detect_batch_effect(expr), config.trigger_pct):
        return expr
    target = F.col("gene_id") == config.target_gene
    fixed = counts.combat_seq(descriptive.replace_zeros(expr.filter(~target)))
    own = cut(fixed.unionByName(expr.filter(target).select(*fixed.columns)))
    return batch.hierarchical(own, config.target_gene, config.advanced_alpha)


def markers(expr: DataFrame, config: EngineConfig) -> dict[str, DataFrame]:
    """Task 1 on (gene_id, sample_id, platform, value): correction, association, ranking, consensus, binary markers."""
    with step("correction"):
        own = cut(correct(expr, config) if config.correct_batches else expr)
    y = own.filter(F.col("gene_id") == config.target_gene).select("sample_id", F.col("value").alias("y"))
    x = own.filter(F.col("gene_id") != config.target_gene).join(F.broadcast(y), "sample_id")  # y has a row a sample
    rows = cut(association.correlations(x, config.methods))
    boot = cut(association.bootstrap(x, config.bootstrap_iterations, config.top_n, config.confidence_level, methods=config.methods)) if config.run_bootstrap else None
    stability = boot.groupBy("gene_id").agg(F.max("rank_stability_perc").alias("rank_stability_perc")) if boot is not None else None
    auc = ranking.binary_markers(x, best=config.top_n)
    out = {
        "processed": own,
        "correlations": association.with_bootstrap(rows, boot),
        "method_comparison": ranking.compare_methods(rows, x),
        "ranked": ranking.composite_rank(rows, own, stability, config.min_correlation, config.max_p_value),
        "methods": ranking.consensus(rows, "method", len(config.methods), 1, config.min_correlation, config.top_n),
        "platforms": ranking.consensus(ranking.platform_correlations(x), "platform", own.select("platform").distinct().count(), 2, config.min_correlation, 100),
        "binary": auc,
        "thresholds": ranking.optimal_thresholds(x, auc, 30),
    }
    register_views(out)
    return out


def design(expr: DataFrame, seqs: DataFrame, config: EngineConfig, group: str | None = None) -> dict[str, DataFrame]:
    """Task 2 on the matrix and (id = gene_id, utr5, cds, utr3): stable genes, features, significance, profiles, impact."""
    stable = descriptive.consistent_genes(expr, config.constant_expression_cv_threshold)
    own = stable.select(F.col("gene_id").alias("id"), F.col("mean").alias("mean_expression"), "cv").join(seqs, "id", "left")
    table = cut(sequence.transcript_features(own, ("mean_expression", "cv")))
    names = ["UTR5_length", "UTR5_GC", "UTR5_AUG_count", "UTR3_length", "UTR3_GC", "miRNA_seed_matches", "GC3_content", "CAI"]
    chosen = modelling.select_features(table, modelling.dense_features(table, names), "cv", "id", config.selection, config.max_features)
    profiled = cut(features.profiles(table, names, "cv", "mean_expression"))
    out = {
        "features": sequence.stability_category(table, "cv"),
        "codons": sequence.codon_usage(own),
        "significance": features.significance(table, names, "cv", key="id"),
        "interactions": features.interactions(table, names, "id"),
        "selected": chosen,
        "profiles": profiled,
        "recommendations": features.recommendations(profiled),
        "impact": features.impact(chosen, "importance"),
    }
    if group:
        out["motifs"] = sequence.kmer_enrichment(seqs, "utr5", group, config.kmer_size)
    register_views(out)
    return out
