"""python -m helixframe.cli --task markers|design --expression F --manifest F [--sequences cds,utr5,utr3] --out DIR
[--config TOML --experiment N | --list-experiments] [--methods a,b] [--top-n N] [--skip-batch-correction] [--verbose]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig, experiments
from .control import set_up_logging, step
from .plans import tasks
from .sources import matrix


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="helixframe", description=__doc__)
    p.add_argument("--task", choices=("markers", "design"), default="markers")
    p.add_argument("--list-experiments", action="store_true")
    p.add_argument("--skip-batch-correction", action="store_true")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--methods")
    p.add_argument("--top-n", type=int)
    p.add_argument("--log")
    for name in ("expression", "manifest", "sequences", "out", "config"):
        p.add_argument(f"--{name}")
    p.add_argument("--experiment", type=int)
    a = p.parse_args(argv)
    set_up_logging(a.log, a.verbose)
    if a.list_experiments:
        for n, values in sorted(experiments(a.config).items()):
            print(n, values.get("description", ""))
        return 0
    config = EngineConfig()
    config = (config.from_toml(a.config, a.experiment) if a.experiment else config).from_env()
    own = {"methods": a.methods, "top_n": a.top_n, "correct_batches": False if a.skip_batch_correction else None}
    config = config.with_values({k: v for k, v in own.items() if v is not None})
    spark = SparkSession.builder.appName("helixframe").getOrCreate()
    samples = matrix.read_manifest(spark, a.manifest).select(F.col("Sample").alias("sample_id"), "platform")
    expr = matrix.to_long(matrix.read_expression(spark, a.expression)).join(F.broadcast(samples), "sample_id").select("gene_id", "sample_id", "platform", "value")
    if a.task == "markers":
        out = tasks.markers(expr, config)
    else:
        cds, utr5, utr3 = (matrix.sequence_table(matrix.read_fasta(spark, f), k) for f, k in zip(a.sequences.split(","), ("CDS", "UTR5", "UTR3"), strict=True))
        key = matrix.META[0]
        seqs = cds.join(utr5, key, "left").join(utr3, key, "left").select(F.col(key).alias("id"), F.col("UTR5_Seq").alias("utr5"), F.col("CDS_Seq").alias("cds"), F.col("UTR3_Seq").alias("utr3"))
        out = tasks.design(expr, seqs, config)
    for name, df in out.items():
        with step(name):
            matrix.write_matrix(df, f"{a.out}/{name}")
    if "recommendations" in out:
        matrix.write_sections(out["recommendations"], f"{a.out}/recommendations.json")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
