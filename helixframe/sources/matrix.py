"""Sources and sinks of expression matrices, manifests and FASTA files, the two layouts, and lookups by id."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

META = ("ensembl_transcript_id", "sym", "ensembl_peptide_id")
#: Fixed value: the platform names that descriptions carry.
PLATFORM = "(HiSeq|NovaSeq|NextSeq)"


def read_expression(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Wide matrix: three string columns, then a double per sample; text that is no number becomes null."""
    names = spark.read.option("sep", sep).option("header", True).csv(path).columns
    if missing := [c for c in META[:2] if c not in names]:
        raise ValueError(f"missing columns: {missing}")
    raw = spark.read.option("sep", sep).option("header", True).schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).csv(path)
    number = lambda c: F.nanvl(F.expr(f"try_cast(`{c}` AS DOUBLE)"), F.lit(None).cast("double")).alias(c)
    return raw.select(*[F.col(c) if c in META else number(c) for c in names])


def read_manifest(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    out = spark.read.option("sep", sep).option("header", True).schema("Experiment string, Sample string, description string").csv(path)
    return out.withColumn("platform", platform("description"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, seq); records without an id or a sequence are dropped."""
    parts = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v"))
    head = F.regexp_extract("v", r"^([^\s]*)", 1)
    body = F.regexp_replace(F.regexp_replace("v", r"^[^\n]*\n?", ""), r"\s", "")
    return parts.select(head.alias("record_id"), body.alias("seq")).filter("record_id <> '' and seq <> ''")


def sequence_table(fasta: DataFrame, kind: str) -> DataFrame:
    """Ids split at | into transcript, gene and symbol (one or three parts, others go), sequences in upper case;
    of repeated transcripts one row, the least by id and sequence."""
    parts = F.split("record_id", "\\|")
    own = fasta.withColumn("p", parts).filter(F.size("p").isin(1, 3))
    cols = own.select(F.col("p")[0].alias(META[0]), F.get("p", F.lit(1)).alias(f"{kind}_ID"), F.get("p", F.lit(2)).alias(f"{kind}_sym"), F.upper("seq").alias(f"{kind}_Seq"))
    return cols.groupBy(META[0]).agg(F.min(F.struct(f"{kind}_ID", f"{kind}_sym", f"{kind}_Seq")).alias("m")).select(META[0], "m.*")


def load_all(spark: SparkSession, files: dict[str, str]) -> dict[str, DataFrame]:
    """Tables by name for paths by name: expression, manifest, cds, utr5, utr3. Schemas are checked here; a file that is
    not there or lacks a column raises."""
    readers = {"expression": read_expression, "manifest": read_manifest} | {k: lambda s, p, k=k: sequence_table(read_fasta(s, p), k.upper()) for k in ("cds", "utr5", "utr3")}
    if unknown := sorted(set(files) - set(readers)):
        raise KeyError(f"unknown files: {unknown}")
    return {k: readers[k](spark, p) for k, p in files.items()}


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A matrix that write_matrix wrote, or a CSV of one: there a leading column of row numbers goes and the rest is read
    as read_expression does."""
    if not path.endswith(".csv"):
        return spark.read.parquet(path)
    names = spark.read.option("header", True).csv(path).columns
    out = read_expression(spark, path, ",")
    return out.drop(names[0]) if names[0] in ("", "_c0") or names[0].startswith("Unnamed:") else out


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under their other names, where the other name is not there already."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})


# The patterns of cell line, treatment and growth phase in descriptions.
CONDITIONS = {"cell_line": "(CHO-K1|DG44|CHOK1)", "treatment": "(NaBu|\\d+°C|\\d+mM NH3)", "growth_phase": "(exponential|stationary)"}


def conditions(df: DataFrame, description: str = "description") -> DataFrame:
    """``df`` with cell_line, treatment and growth_phase, null where the description has none."""
    return df.withColumns({c: F.nullif(F.regexp_extract(description, p, 1), F.lit("")) for c, p in CONDITIONS.items()})


def platform_map(samples: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Samples with a known platform."""
    return samples.filter("platform <> 'Unknown'").select(sample, "platform")


def with_platform(rows: DataFrame, samples: DataFrame, sample: str = "sample_id") -> DataFrame:
    """``rows`` with the platform of their sample, "Unknown" where the manifest has none."""
    known = samples.groupBy(sample).agg(F.min("platform").alias("platform"))
    return rows.join(known, sample, "left").withColumn("platform", F.coalesce("platform", F.lit("Unknown")))


def join_by_accession(rows: DataFrame, manifest: DataFrame, sample: str = "sample_id", accession: str = "Sample") -> DataFrame:
    """``rows`` with the manifest row whose accession has the same first run of digits."""
    digits = lambda c: F.nullif(F.regexp_extract(c, "(\\d+)", 1), F.lit(""))
    return rows.withColumn("_d", digits(sample)).join(manifest.withColumn("_d", digits(accession)), "_d", "left").drop("_d")


def with_metadata(metadata: DataFrame, corrected: DataFrame, key: str = "gene_id") -> DataFrame:
    """All rows of ``corrected`` with their metadata in front (a right join)."""
    return metadata.join(corrected, key, "right")


def gene_info(genes: DataFrame, name: str) -> DataFrame:
    """The row of ``genes`` (gene_id, sym, ...) whose id is ``name``, else whose symbol is; raises if there is none."""
    found = genes.filter((F.col("gene_id") == name) | (F.col("sym") == name)).orderBy(F.col("gene_id") != name, "gene_id").limit(1)
    if not found.count():
        raise ValueError(f"no gene {name!r}")
    return found


def platform(description: str) -> F.Column:
    found = F.regexp_extract(description, PLATFORM, 1)
    return F.when(F.coalesce(found, F.lit("")) == "", "Unknown").otherwise(found)


def to_long(wide: DataFrame) -> DataFrame:
    """gene_id, sym, sample_id, value."""
    values = [f.name for f in wide.schema if isinstance(f.dataType, T.NumericType)]
    out = wide.unpivot([c for c in META[:2] if c in wide.columns], values, "sample_id", "value")
    return out.withColumnRenamed(META[0], "gene_id")


def to_vectors(long: DataFrame) -> DataFrame:
    """gene_id and its values in order of sample_id: the layout for per-gene kernels, one shuffle by gene."""
    return long.groupBy("gene_id").agg(F.sort_array(F.collect_list(F.struct("sample_id", "value"))).alias("v")).select("gene_id", F.col("v.value").alias("values"))


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Arrays are joined by ', '."""
    flat = [F.concat_ws(", ", f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_matrix(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> dict[str, float]:
    """The one row of ``metrics`` as JSON: numbers only, those that are not finite left out."""
    row = metrics.first().asDict()
    out = {k: v for k, v in row.items() if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)}
    _write_text(metrics.sparkSession, path, json.dumps(out, indent=2))
    return out


def write_sections(rows: DataFrame, path: str, section: str = "section", position: str = "position", text: str = "text") -> dict[str, list[str]]:
    """Texts by section, in order of position, as JSON (recommendations: some tens of rows)."""
    out: dict[str, list[str]] = {}
    for r in rows.orderBy(section, position).collect():
        out.setdefault(r[section], []).append(r[text])
    _write_text(rows.sparkSession, path, json.dumps(out, indent=2))
    return out


def _write_text(spark: SparkSession, path: str, body: str) -> None:
    """A small file in whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(bytearray(body.encode()))
    finally:
        stream.close()
