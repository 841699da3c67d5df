"""Operators without SQL against plain Python, the stream's co-moments, and the package on workers."""

import itertools
import os
import random
import statistics
import subprocess
import sys
import textwrap
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helixframe.functions.columns import fold, held_out
from helixframe.operators import batch, features, sequence
from helixframe.streaming.moments import windowed_correlation


def test_categories_against_the_reference(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["en", "de", "fr", None]), r.gauss(0, 1), r.gauss(0, 1)) for i in range(300)] + [(900, "xx", 1.0, 1.0)]
    rows = [(i, c, a + 3 * (c == "de"), b) for i, c, a, b in rows]
    df = spark.createDataFrame(rows, "id long, lang string, a double, b double")
    compared = features.category_comparison(df, ["a", "b"], "lang", "en")
    got = {(x.category, x.feature): x for x in compared.collect()}
    assert {k for k in got if k[0] != "xx"} == {(c, f) for c in ("de", "fr") for f in "ab"}
    for (c, f), x in got.items():
        if c == "xx":
            continue
        one, zero = ([row[{"a": 2, "b": 3}[f]] for row in rows if row[1] == k] for k in (c, "en"))
        assert (x.n1, x.n0) == (len(one), len(zero)) and x.difference == pytest.approx(statistics.fmean(one) - statistics.fmean(zero))
        assert x.median1 == pytest.approx(statistics.median(one))
    assert got["de", "a"].significant and got["de", "a"].mann_whitney_p < 1e-9
    best = {x.category: x for x in features.significant_summary(compared).collect()}
    assert best["de"].strongest == "a" and best["de"].n_significant >= 1


def test_folds_depend_on_the_key_alone(spark):
    df = spark.range(20_000).withColumn("id", F.concat(F.lit("t"), "id"))
    pick = lambda d: {r.id: (r.f, r.h) for r in d.select("id", fold("id", 5).alias("f"), held_out("id").alias("h")).collect()}
    one = pick(df)
    assert one == pick(df.repartition(7)) and set(f for f, _ in one.values()) == set(range(5))
    assert all(abs(sum(f == k for f, _ in one.values()) - 4000) < 300 for k in range(5)) and abs(sum(h for _, h in one.values()) - 4000) < 300
    assert pick(df.withColumn("id", F.concat("id", F.lit("")))) == one


def test_coding_features_without_utr_rows(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, mean double")
    coding = spark.createDataFrame([("a", 0.5), ("c", 0.7)], "id string, CAI double")
    utr = spark.createDataFrame([("a", 9), ("z", 8)], "id string, UTR5_length int")
    assert sorted(tuple(r) for r in sequence.with_coding_features(base, utr, coding).collect()) == [("a", 9, 0.5), ("z", 8, None)]
    out = sequence.with_coding_features(base, utr.filter(F.lit(False)), coding)
    assert [r.asDict() for r in out.collect()] == [{"id": "a", "mean": 1.0, "CAI": 0.5, "UTR5_length": None}]


def test_stream_of_co_moments_equals_the_table(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"2024-01-0{1 + i // 100} {r.randrange(24):02}:00:00", r.choice("ab"), r.choice([None, r.gauss(0, 1)]), float(i % 7)) for i in range(300)] + [("2024-01-02 01:00:00", "c", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "t string, event_type string, x double, y double").withColumn("ts", F.to_timestamp("t"))
    for part in range(3):  # replayed in three batches
        df.filter(f"pmod(hash(t, x, y), 3) = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windowed_correlation(stream, F.col("x"), F.col("y")).writeStream.outputMode("complete").format("memory").queryName("co").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    show = lambda d: {(r.start, r.event_type): (r.n, r.covariance and round(r.covariance, 9), r.r and round(r.r, 9)) for r in d.collect()}
    want = show(windowed_correlation(df, F.col("x"), F.col("y")))
    assert show(spark.sql("select * from co")) == want and len(want) == 7
    plain = {(x.day, x.event_type): x.r for x in df.filter("x is not null").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.corr("x", "y").alias("r")).collect()}
    assert all(v[2] == pytest.approx(plain[k[0].date(), k[1]], abs=1e-8) for k, v in want.items() if v[2] is not None)


def test_workers_have_the_package_from_any_folder(tmp_path):
    root = Path(__file__).resolve().parents[1]
    code = f"""
        import importlib.util, sys
        spec = importlib.util.spec_from_file_location("__spark_entry__", {str(root / "__spark_entry__.py")!r})
        entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        print("least", entry.queries()["rna_structure_metrics"](spark, "/root/testdata/sf0.001").agg({{"mfe": "min"}}).first())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "least Row" in done.stdout, done.stderr[-2000:]


def test_two_sample_p_counts_all_arrangements(spark):
    r = random.Random(3)
    n1, n2 = 5, 6
    rows = [(f"g{g}", f"s{i}", "A" if i < n1 else "B", r.gauss(0, 1) + (g % 4) * (i < n1)) for g in range(12) for i in range(n1 + n2)]
    got = {x.gene_id: x for x in batch.ks_tests(spark.createDataFrame(rows, "gene_id string, sample_id string, platform string, value double")).collect()}
    distance = lambda own: max(abs(sum(i <= k for i in own) / n1 - (k + 1 - sum(i <= k for i in own)) / n2) for k in range(n1 + n2))
    every = [distance(c) for c in itertools.combinations(range(n1 + n2), n1)]
    for g in {x[0] for x in rows}:
        ordered = sorted((v, p) for gene, _, p, v in rows if gene == g)
        d = distance([k for k, (_, p) in enumerate(ordered) if p == "A"])
        assert got[g].d == pytest.approx(d) and got[g].p_value == pytest.approx(sum(x >= d - 1e-9 for x in every) / len(every), abs=1e-9)


def test_region_motifs_with_those_found(spark):
    r = random.Random(4)
    seq = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    rows = [(i, seq(20) + ("GATTACAGAT" if i % 2 and i % 10 else "") + seq(20), i % 2) for i in range(200)] + [(900, "", 1), (901, None, 0)]
    df = spark.createDataFrame(rows, "id long, utr5 string, quality int")
    got = {x.motif: x for x in sequence.region_motifs(df, "utr5", {"fixed": "GATTACA", "none": "QQQ"}, "quality").collect()}
    own = [(s, q) for _, s, q in rows if s]
    for name, pattern in (("fixed", "GATTACA"), *((m, m.rsplit("_", 1)[1]) for m in got if m.startswith("de_novo"))):
        assert (got[name].seq1, got[name].seq0) == tuple(sum(pattern in s for s, q in own if q == k) for k in (1, 0))
    assert got["fixed"].significant and not got["none"].significant and got["none"].seq1 == 0
    for k in (4, 5, 6):  # the five most enriched of each size
        counts = [Counter(s[j : j + k] for s, q in own if q == g for j in range(len(s) - k + 1)) for g in (1, 0)]
        f1, f0 = ({m: c / sum(q == g for _, q in own) for m, c in counts[1 - g].items()} for g in (1, 0))
        ratio = {m: f / max(f0.get(m, 0), 0.001) for m, f in f1.items() if f > 2 * f0.get(m, 0)}
        best = sorted(ratio, key=lambda m: (-round(ratio[m], 9), m))[:5]
        assert {m for m in got if m.startswith(f"de_novo_{k}mer")} == {f"de_novo_{k}mer_{m}" for m in best}
