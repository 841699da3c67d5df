import numpy as np
import pytest

from helixframe.config import EngineConfig
from helixframe.operators import association, batch, descriptive
from helixframe.plans import tasks
from helixframe.sources import matrix
from helixframe.streaming.moments import windowed_moments


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    platforms = ["HiSeq"] * 9 + ["NextSeq"] * 8 + ["NovaSeq"] * 7
    y = rng.normal(10, 2, 24)
    rows = []
    for g in range(12):
        v = np.full(24, 3.0) if g == 11 else np.abs(rng.normal(5, 1, 24) + 0.3 * g * (y - 10) / 2 + (np.arange(24) < 9) * 2)
        rows += [(f"g{g:02d}", f"s{i:02d}", platforms[i], float(v[i])) for i in range(24)]
    rows += [("PRODUCT-TG", f"s{i:02d}", platforms[i], float(y[i])) for i in range(24)]
    return spark.createDataFrame(rows, "gene_id string, sample_id string, platform string, value double").persist()


def x_of(data):
    y = data.filter("gene_id = 'PRODUCT-TG'").selectExpr("sample_id", "value as y")
    return data.filter("gene_id <> 'PRODUCT-TG'").join(y, "sample_id")


def test_association_against_numpy(data):
    x = x_of(data)
    pdf = x.toPandas()
    r = {a.gene_id: a.r for a in association.pearson(x).collect()}
    s = {a.gene_id: a.r for a in association.spearman(x).collect()}
    k = {a.gene_id: a.r for a in association.kendall(x).collect()}
    for gene, own in pdf.groupby("gene_id"):
        if gene == "g11":
            assert (r[gene], s[gene], k[gene]) == (0, 0, 0)
            continue
        assert r[gene] == pytest.approx(np.corrcoef(own["value"], own.y)[0, 1])
        assert s[gene] == pytest.approx(np.corrcoef(own["value"].rank(), own.y.rank())[0, 1])
        a, b = own["value"].to_numpy(), own.y.to_numpy()
        assert k[gene] == pytest.approx((np.sign(a[:, None] - a) * np.sign(b[:, None] - b)).sum() / (24 * 23))
    assert "g11" not in {a.gene_id for a in association.regression(x).collect()}
    rows = association.correlations(x, ("pearson", "decision_tree")).collect()
    assert all(a.p_adjusted >= a.p_value - 1e-12 for a in rows)


def test_correction(data):
    fixed = batch.combat(data.filter("gene_id <> 'PRODUCT-TG'"))
    assert batch.affected_share(fixed).first()[0] < batch.affected_share(data).first()[0]
    moved = batch.location_scale(data, "HiSeq", "PRODUCT-TG")
    kept = {r.gene_id: r.preserved for r in batch.preservation(data, moved).collect()}
    assert kept["PRODUCT-TG"] and kept["g11"] and not kept["g03"]


def test_bootstrap_is_the_same_for_any_partitioning(data):
    x = x_of(data)
    one, two = (sorted(association.bootstrap(d, 40, 3).collect()) for d in (x.coalesce(1), x.repartition(5)))
    assert [(a.gene_id, a.rank_stability_perc) for a in one] == [(a.gene_id, a.rank_stability_perc) for a in two]
    assert sum(a.rank_stability_perc for a in one) == pytest.approx(300)


def test_task_and_config(data, monkeypatch):
    monkeypatch.setenv("HELIXFRAME_METHODS", "pearson, spearman")
    monkeypatch.setenv("HELIXFRAME_MIN_CORRELATION", "0.2")
    config = EngineConfig(bootstrap_iterations=20).from_env()
    assert config.methods == ("pearson", "spearman") and config.min_correlation == 0.2
    out = tasks.markers(data, config)
    ranked = out["ranked"].orderBy("final_score", ascending=False).collect()
    assert ranked and all(0 <= r.final_score <= 1 for r in ranked)
    assert out["thresholds"].count() > 0
    with pytest.raises(ValueError):
        EngineConfig().with_values({"run_bootstrap": "perhaps"})


def test_sources(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("ensembl_transcript_id\tsym\tensembl_peptide_id\ts1\ts2\nT1\tA\tP\t1.5\tx\nT2\tB\t\t0\t2\n")
    wide = matrix.read_expression(spark, str(tmp_path / "m.tsv"))
    assert sorted((r.gene_id, r.sample_id, r.value) for r in matrix.to_long(wide).filter("value is not null").collect()) == [("T1", "s1", 1.5), ("T2", "s1", 0.0), ("T2", "s2", 2.0)]
    (tmp_path / "f.fa").write_text(">T1|G|S extra\nacg\nTT\n>T2|x\nAA\n>T3\n\n>T1|G|S\nCC\n>T4\ngg")
    table = matrix.sequence_table(matrix.read_fasta(spark, str(tmp_path / "f.fa")), "CDS")
    assert sorted((r[0], r.CDS_Seq) for r in table.collect()) == [("T1", "ACGTT"), ("T4", "GG")]
    (tmp_path / "x.tsv").write_text("Experiment\tSample\tdescription\nE\ts1\tIllumina HiSeq 2000 HiSeq\nE\ts2\tother\n")
    assert [r.platform for r in matrix.read_manifest(spark, str(tmp_path / "x.tsv")).orderBy("Sample").collect()] == ["HiSeq", "Unknown"]


def test_consistent_genes(data):
    got = {r.gene_id for r in descriptive.consistent_genes(data, 0.3).collect()}
    assert "g11" in got and len(got) == 4


def test_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 2.0D value union all select timestamp'2024-01-01 00:20:00', 'a', 4.0D").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = windowed_moments(stream).writeStream.outputMode("complete").format("memory").queryName("moments").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r["mean"]) for r in spark.sql("select * from moments").collect()] == [(2, 3.0)]
