"""Cutting the lineage of a table that several steps read, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The application's checkpoint folder: in spark.checkpoint.dir, or a new local one in local mode where that is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = sc.getConf().get("spark.checkpoint.dir")
        if base is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="helixframe-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df``, worked out once and written to the checkpoint folder. Plans that read it several times stay small, and
    lost executors lose nothing of it."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
