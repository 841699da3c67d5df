"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Each stage works on all that its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, langid, lines, near_dup, packing
from helixframe.llm.common import materialise, release, small_batches, table

#: Documents whose language is less certain than this are rejected, as are those without letters.
LEAST_SCORE = 0.4
#: Documents whose five-word shingles are this similar (per cent) are near copies; op9's 85 is that query's own.
NEAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = langid.predict(docs, langid.train(docs))
    return out.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines of later copies, n_chars follows; a document that loses all its lines goes."""
    small_batches(spark)
    out = lines.delete_repeated_lines(docs)
    left = out.filter((F.col("n_removed") == 0) | (F.col("text") != ""))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least doc_id."""
    small_batches(spark)
    kept = near_dup.near_duplicates(docs, NEAR).filter("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, F.expr("doc_id <=> _kept"), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


#: (name, function of (spark, docs, sf_dir)); each result is written as Parquet and read again as the next one's docs.
STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", pack),
]

#: No stage but the joins of decontamination is SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        release(docs)
        docs = kept
    return docs
