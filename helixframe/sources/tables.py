"""The given tables as an expression matrix, samples with platforms, and transcript sequences.

Genes are part brands and types, samples are nations and order years, a value is the quantity ordered (0 if none);
platforms come out of a description by region. Sequences are the letters A, C, G, T of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrix import platform

#: The gene that others are compared with: the first by name.
MIN_LENGTH = 60


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nk, y (nation and year), sample_id, description, platform: a row per nation and year (bounded by both)."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nk"))
    n = read(spark, sf_dir, "nation")
    pairs = o.join(c, o.o_custkey == c.c_custkey).select("nk", "y").distinct().join(F.broadcast(n), F.col("nk") == F.col("n_nationkey"))
    name = F.element_at(F.array(*map(F.lit, ("HiSeq", "NextSeq", "NovaSeq"))), F.col("n_regionkey") % 3 + 1)
    named = pairs.select("nk", "y", F.concat_ws("|", "n_name", F.col("y").cast("string")).alias("sample_id"), F.concat(F.lit("Illumina "), name, F.lit(" sequencing of "), "n_name").alias("description"))
    return named.withColumn("platform", platform("description"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, description, platform: a row per nation and year (bounded by both)."""
    return _keyed_samples(spark, sf_dir).select("sample_id", "description", "platform")


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene_id, sample_id, platform, value; dense. Sums and the join with the grid are by nation and year; a sample's name
    is made once a sample."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nk"))
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("gene_id"))
    joined = li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    cells = joined.groupBy("gene_id", "nk", "y").agg(F.sum("l_quantity").alias("v"))
    genes = p.select("gene_id").distinct()
    grid = genes.crossJoin(F.broadcast(_keyed_samples(spark, sf_dir).select("nk", "y", "sample_id", "platform")))  # the matrix itself is genes x samples
    return grid.join(cells, ["gene_id", "nk", "y"], "left").select("gene_id", "sample_id", "platform", F.coalesce("v", F.lit(0.0)).alias("value"))


def target(expr: DataFrame) -> DataFrame:
    """sample_id, y of the first gene by name (a row per sample, so it is small by nature)."""
    first = expr.agg(F.min("gene_id").alias("t"))
    return expr.join(F.broadcast(first), F.col("gene_id") == F.col("t")).select("sample_id", F.col("value").alias("y"))


def genes_and_target(expr: DataFrame) -> DataFrame:
    """Rows of all other genes with y, the target's value in the sample."""
    first = expr.agg(F.min("gene_id").alias("t"))
    others = expr.join(F.broadcast(first), F.col("gene_id") != F.col("t")).drop("t")
    return others.join(F.broadcast(target(expr)), "sample_id")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, utr5, cds, utr3, quality of documents with at least MIN_LENGTH + 30 letters and a label."""
    # explode of one array each: a step that the optimizer does not merge, so a text's letters are taken once
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.regexp_replace(F.upper("text"), "[^ACGT]+", ""))).alias("s"))
    own = d.filter(F.length("s") >= MIN_LENGTH + 30).withColumn("half", F.expr(f"((length(s) - {MIN_LENGTH}) div 6) * 3"))
    cut = own.select(F.col("doc_id").alias("id"), F.expr(f"substring(s, 1, {MIN_LENGTH})").alias("utr5"), F.expr(f"substring(s, {MIN_LENGTH + 1}, cast(half as int))").alias("cds"), F.expr(f"substring(s, {MIN_LENGTH + 1} + cast(half as int))").alias("utr3"))
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return cut.join(labels, "id")


EXPR_SQL = """
WITH cells AS (
  SELECT p_brand || '|' || p_type AS gene_id, n_name || '|' || CAST(year(o_orderdate) AS VARCHAR) AS sample_id, sum(l_quantity) AS v
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
samples AS (
  SELECT DISTINCT n_name || '|' || CAST(year(o_orderdate) AS VARCHAR) AS sample_id,
    CASE n_regionkey % 3 WHEN 0 THEN 'HiSeq' WHEN 1 THEN 'NextSeq' ELSE 'NovaSeq' END AS platform
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
genes AS (SELECT DISTINCT p_brand || '|' || p_type AS gene_id FROM part),
e AS (
  SELECT g.gene_id, s.sample_id, s.platform, coalesce(c.v, 0.0) AS value
  FROM genes g CROSS JOIN samples s LEFT JOIN cells c ON c.gene_id = g.gene_id AND c.sample_id = s.sample_id),
tg AS (SELECT sample_id, value AS y FROM e WHERE gene_id = (SELECT min(gene_id) FROM e)),
x AS (SELECT e.*, tg.y FROM e JOIN tg USING (sample_id) WHERE gene_id <> (SELECT min(gene_id) FROM e))
"""

SEQ_SQL = """
WITH d AS (SELECT doc_id AS id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM documents),
h AS (SELECT id, s, ((length(s) - 60) // 6) * 3 AS half FROM d WHERE length(s) >= 90),
q AS (SELECT h.id, substring(s, 1, 60) AS utr5, substring(s, 61, half) AS cds, substring(s, 61 + half) AS utr3, quality
      FROM h JOIN labels l ON l.doc_id = h.id)
"""
