"""Lineage cuts between long operator chains."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and continue from there, so that later
    branches read the result instead of recomputing it and a lost executor costs little."""
    if getattr(df, "_is_cut", False):
        return df
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    out = df.checkpoint(eager=True)
    out._is_cut = True
    return out
