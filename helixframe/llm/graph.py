"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def components(links: DataFrame) -> DataFrame:
    """(v, label) for every end of ``links`` (a, b): the least id that is reachable.

    Every round takes the least label among neighbours and then jumps to the label's own label, so the rounds grow
    with the logarithm of the longest chain. Labels are written each round; a round's shuffles combine on the map side.
    """
    edges = materialise(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a != b").distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("m"))
        least = labels.join(near, F.col("v") == F.col("a"), "left").select("v", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        of = labels.select(F.col("v").alias("_v"), F.col("label").alias("_label"))
        jumped = least.join(of, F.col("label") == F.col("_v"), "left").select("v", "was", F.least("label", "_label").alias("label"))
        step = materialise(jumped, "labels")
        changed = step.filter("was != label").limit(1).count()
        release(labels)
        labels = step.select("v", "label")
        labels._helix_path = step._helix_path
        if not changed:
            release(edges)
            return labels
