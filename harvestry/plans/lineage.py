"""Cutting lineage with reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def saved(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder the cluster names in spark.checkpoint.dir.

    Where that is unset, a local master gets a folder of its own; on a cluster that would be the driver's disk, so it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
                raise ValueError("spark.checkpoint.dir must name a shared folder")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def where_once(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition) that is not pushed under df's own columns, whose expressions would then be run once for each time the condition
    names them.  The optimizer moves no filter under a column that is not deterministic."""
    return df.withColumn("_once", F.monotonically_increasing_id()).where((F.col("_once") >= 0) & condition).drop("_once")
