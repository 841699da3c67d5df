"""Transcript features, codon usage and k-mers over (id, utr5, cds, utr3, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.columns import benjamini_hochberg, fisher_p
from ..functions.folding import minimum_free_energy
from ..functions.quantiles import quantiles
from ..functions.stages import cut


def utr_features(seqs: DataFrame, patterns: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """UTR features of (id, utr5, utr3), with the columns ``keep``; ``patterns`` replaces those of S.PATTERNS by name."""
    p = S.PATTERNS | (patterns or {})
    return seqs.select(
        "id", *keep, F.length("utr5").alias("UTR5_length"), S.gc_percent("utr5").alias("UTR5_GC"), F.regexp_count("utr5", F.lit("ATG")).alias("UTR5_AUG_count"),
        F.col("utr5").rlike(p["kozak"]).alias("kozak_sequence_present"), F.col("utr5").rlike(p["top"]).alias("TOP_motif_present"), F.col("utr5").rlike(p["g_quadruplex"]).alias("G_quadruplex_present"),
        F.length("utr3").alias("UTR3_length"), S.gc_percent("utr3").alias("UTR3_GC"), F.col("utr3").rlike(p["poly_a"]).alias("polyA_signal_present"), F.col("utr3").rlike(p["are"]).alias("ARE_motifs_present"),
        F.regexp_count("utr3", F.lit(p["mirna_seed"])).alias("miRNA_seed_matches"),
    )


def codon_usage(seqs: DataFrame) -> DataFrame:
    """id, codon, freq: share of each codon in its sequence."""
    own = seqs.select("id", F.explode(S.codons("cds")).alias("codon")).groupBy("id", "codon").agg(F.count("*").alias("n"))
    return own.withColumn("freq", F.col("n") / F.sum("n").over(W.partitionBy("id")))


def gc3_cai(seqs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Third-base GC per cent and the self-relative CAI: geometric mean of each codon's count over that of its most
    common synonym, over amino acids with several codons; stops aside. Sequences without codons have nulls.

    Counts are made in the row, for its distinct codons (64 at most), so no sequence is exploded or shuffled.
    """
    amino = {c: a for c, a in S.GENETIC_CODE.items() if a != "*" and S.AMINO.count(a) > 1}
    # explode of one array each: a step that the optimizer does not merge, so the codons are made once a row
    own = seqs.select("id", *keep, F.explode(F.array(S.codons("cds"))).alias("_cs")).withColumn("_ds", F.array_distinct("_cs"))
    family = F.create_map(*[F.lit(x) for pair in amino.items() for x in pair])
    counted = own.withColumn("_e", F.transform("_ds", lambda c: F.struct(family[c].alias("aa"), F.size(F.filter("_cs", lambda x: x == c)).cast("double").alias("n"))))
    counted = counted.withColumn("_e", F.filter("_e", lambda e: e["aa"].isNotNull()))
    counted = counted.select("id", *keep, "_cs", F.explode(F.array("_e")).alias("_e"))
    tops = F.transform("_e", lambda e: F.struct(e["n"].alias("n"), F.array_max(F.transform(F.filter("_e", lambda x: x["aa"] == e["aa"]), lambda x: x["n"])).alias("top")))
    counted = counted.withColumn("_t", tops)
    plus = lambda f: F.aggregate("_t", F.lit(0.0), lambda acc, e: acc + f(e))
    cai = F.coalesce(F.exp(plus(lambda e: e["n"] * F.ln(e["n"] / e["top"])) / F.nullif(plus(lambda e: e["n"]), F.lit(0.0))), F.lit(0.0))
    gc3 = F.size(F.filter("_cs", lambda c: F.substring(c, 3, 1).isin("G", "C"))) * 100.0 / F.nullif(F.size("_cs"), F.lit(0))
    return counted.select("id", *keep, gc3.alias("GC3_content"), F.when(F.size("_cs") > 0, cai).alias("CAI"))


def transcript_features(seqs: DataFrame, keep: tuple[str, ...] = (), patterns: dict[str, str] | None = None) -> DataFrame:
    """UTR and coding features of every row of ``seqs`` in one pass."""
    utr = utr_features(seqs, patterns, (*keep, "cds"))
    return gc3_cai(utr, tuple(c for c in utr.columns if c not in ("id", "cds")))


def with_coding_features(base: DataFrame, utr: DataFrame, coding: DataFrame) -> DataFrame:
    """UTR features with the coding ones of the same id (left); where ``utr`` has no row at all, ``base`` (id, ...) with
    its coding features (inner) and null UTR columns, so the columns stay the same but for those of ``base``."""
    if not utr.isEmpty():
        return utr.join(coding, "id", "left")
    empty = {f.name: F.lit(None).cast(f.dataType) for f in utr.schema if f.name not in base.columns}
    return base.join(coding, "id").withColumns(empty)


def kmer_counts(seqs: DataFrame, column: str, k: int, top: int | None = None, skip_n: bool = False) -> DataFrame:
    """kmer and n, overlapping ones counted; with ``skip_n`` those with an N do not count. Ties in ``top`` go by name."""
    out = seqs.select(F.explode(S.kmers(column, k)).alias("kmer"))
    out = (out.filter(~F.col("kmer").contains("N")) if skip_n else out).groupBy("kmer").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "kmer").limit(top) if top else out


def kmer_enrichment(seqs: DataFrame, column: str, group: str, k: int = 6, top: int | None = 30) -> DataFrame:
    """k-mers of group 1 against group 0: occurrences, frequency per sequence (0.5 for none in group 0), fold; Fisher's
    exact test on presence, adjusted over all k-mers, then the ``top`` by fold."""
    sizes = seqs.groupBy().agg(F.count_if(F.col(group) == 1).alias("n1"), F.count_if(F.col(group) == 0).alias("n0"))
    # a row's k-mers are counted in the row, so one shuffle with map-side sums is left
    grams = seqs.select(group, F.explode(F.array(F.sort_array(S.kmers(column, k)))).alias("g")).filter(F.size("g") > 0)
    ends = F.filter(F.sequence(F.lit(1), F.size("g")), lambda i: (i == F.size("g")) | (F.element_at("g", i) != F.get(F.col("g"), i)))
    runs = grams.select(group, "g", F.explode(F.array(ends)).alias("e")).select(group, F.explode(F.transform("e", lambda e, j: F.struct(F.element_at("g", e).alias("motif"), (e - F.when(j > 0, F.get(F.col("e"), j - 1)).otherwise(0)).alias("c")))).alias("r"))
    per = runs.select(group, "r.motif", "r.c")
    c1, c0 = F.col(group) == 1, F.col(group) == 0
    by = per.groupBy("motif").agg(F.sum(F.when(c1, F.col("c")).otherwise(0)).alias("count1"), F.sum(F.when(c0, F.col("c")).otherwise(0)).alias("count0"), F.count_if(c1).alias("seq1"), F.count_if(c0).alias("seq0"))
    own = by.filter("count1 > 0").join(F.broadcast(sizes))
    own = own.withColumn("freq1", F.col("count1") / F.nullif("n1", F.lit(0))).withColumn("freq0", F.when(F.col("count0") > 0, F.col("count0")).otherwise(0.5) / F.nullif("n0", F.lit(0)))
    own = own.withColumn("fold", F.col("freq1") / F.col("freq0"))
    if top is None:
        return own
    tested = own.withColumn("p_value", fisher_p("seq1", F.col("n1") - F.col("seq1"), "seq0", F.col("n0") - F.col("seq0")))
    return benjamini_hochberg(tested, "p_value", "p_adjusted").orderBy(F.desc("fold"), "motif").limit(top)


def stability_category(df: DataFrame, value: str) -> DataFrame:
    """High, Medium or Low by thirds of ``value``; low values are High."""
    df = cut(df)
    thirds = quantiles(df, value, [1 / 3, 2 / 3], out="_q")
    label = F.when(F.col(value) <= F.col("_q")[0], "High").when(F.col(value) <= F.col("_q")[1], "Medium").otherwise("Low")
    return df.join(F.broadcast(thirds)).withColumn("stability_category", label).drop("_q")


def motif_presence(seqs: DataFrame, column: str, motifs: dict[str, str], group: str, p_values: bool = True) -> DataFrame:
    """Fixed patterns in group 1 against group 0: sequences that have them, shares, odds ratio, Fisher's exact test."""
    counts = []
    for g in (1, 0):
        counts += [F.count_if((F.col(group) == g) & F.col(column).rlike(m)).alias(f"{name}|{g}") for name, m in motifs.items()]
    wide = seqs.filter(F.length(column) > 0).agg(*counts, F.count_if(F.col(group) == 1).alias("n1"), F.count_if(F.col(group) == 0).alias("n0"))
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("motif"), F.col(f"`{m}|1`").alias("seq1"), F.col(f"`{m}|0`").alias("seq0")) for m in motifs])).alias("r")
    out = wide.select("n1", "n0", rows).select("r.*", "n1", "n0")
    odds = F.col("seq1") * (F.col("n0") - F.col("seq0")) / F.nullif(F.col("seq0") * (F.col("n1") - F.col("seq1")), F.lit(0))
    out = out.withColumn("freq1", F.col("seq1") / F.nullif("n1", F.lit(0))).withColumn("freq0", F.col("seq0") / F.nullif("n0", F.lit(0))).withColumn("odds_ratio", odds)
    if not p_values:
        return out
    tested = out.withColumn("p_value", fisher_p("seq1", F.col("n1") - F.col("seq1"), "seq0", F.col("n0") - F.col("seq0")))
    return benjamini_hochberg(tested, "p_value", "p_adjusted")


def de_novo(seqs: DataFrame, column: str, group: str, sizes: tuple[int, ...] = (4, 5, 6), ratio: float = 2.0, best: int = 5, least: int = 10) -> dict[str, str]:
    """Name and pattern of the ``best`` k-mers of each size that are over ``ratio`` times as frequent in group 1 (per
    sequence) as in group 0; none if group 1 has under ``least`` sequences. A few rows come to the driver."""
    own = seqs.filter(F.length(column) > 0)
    if own.filter(F.col(group) == 1).limit(least).count() < least:
        return {}
    out = {}
    for k in sizes:
        rows = kmer_enrichment(own, column, group, k, None).filter(~F.col("motif").contains("N"))
        f1, f0 = F.col("count1") / F.col("n1"), F.col("count0") / F.greatest("n0", F.lit(1))
        top = rows.filter(f1 > ratio * f0).orderBy(F.desc(f1 / F.greatest(f0, F.lit(0.001))), "motif").limit(best)
        out |= {f"de_novo_{k}mer_{r['motif']}": r["motif"] for r in top.select("motif").collect()}
    return out


def region_motifs(seqs: DataFrame, column: str, motifs: dict[str, str], group: str) -> DataFrame:
    """motif_presence of the fixed and the de-novo motifs, fold over shares of at least .001, by adjusted p, then fold."""
    out = motif_presence(seqs, column, motifs | de_novo(seqs, column, group), group)
    fold = F.col("freq1") / F.greatest("freq0", F.lit(0.001))
    return out.withColumn("fold_enrichment", fold).withColumn("significant", F.col("p_adjusted") < 0.05).orderBy("p_adjusted", F.desc("fold_enrichment"), "motif")


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores by a hash of ``keys``: folding takes far longer than moving a sequence, however few files there are."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def rna_structures(seqs: DataFrame, column: str, most: int | None = None, least_length: int = 10, span: int = 200) -> DataFrame:
    """id, structure, mfe, normalized_mfe, length, hairpins, loops, gc_content of the sequences of ``least_length`` on; the
    first ``most`` by id, all by default. ``mfe`` is over structures whose pairs are at most ``span`` apart."""
    own = seqs.filter(F.length(column) >= least_length).select("id", F.col(column).alias("seq"))
    own = own.orderBy("id").limit(most) if most else own
    folded = _dealt(own, "id").withColumn("structure", S.folded("seq")).withColumn("mfe", minimum_free_energy(span)("seq"))
    return folded.select("id", "structure", "mfe", (F.col("mfe") / F.length("seq")).alias("normalized_mfe"), *S.rna_metrics("structure", "seq"))


def energy_by_region(seqs: DataFrame, regions: dict[str, str], least_length: int = 10, span: int = 200) -> DataFrame:
    """region, n, and mean, std, min and max of the least free energy a nucleotide, over all sequences of ``least_length``
    on; ``regions`` names a column each. Only partial sums meet by region."""
    rows = seqs.select("id", F.explode(F.array(*[F.struct(F.lit(r).alias("region"), F.col(c).alias("seq")) for r, c in regions.items()])).alias("r")).select("id", "r.*")
    own = _dealt(rows.filter(F.length("seq") >= least_length), "id", "region").withColumn("e", minimum_free_energy(span)("seq") / F.length("seq"))
    return own.groupBy("region").agg(F.count("e").alias("n"), F.avg("e").alias("mean"), F.stddev_samp("e").alias("std"), F.min("e").alias("min"), F.max("e").alias("max"))


def motif_flag_totals(features: DataFrame) -> DataFrame:
    """How many transcripts have each boolean feature."""
    flags = [c for c, t in features.dtypes if t == "boolean"]
    return features.agg(*[F.count_if(F.col(c)).alias(c) for c in flags]).unpivot([], flags, "feature", "n")


def mean_codon_usage(usage: DataFrame, top: int | None = None) -> DataFrame:
    """Mean share of each codon over all transcripts, those without it counting 0."""
    total = usage.agg(F.countDistinct("id").alias("_n"))
    out = usage.groupBy("codon").agg(F.sum("freq").alias("_s")).join(F.broadcast(total)).select("codon", (F.col("_s") / F.col("_n")).alias("mean_freq"))
    return out.orderBy(F.desc(F.round("mean_freq", 9)), "codon").limit(top) if top else out
