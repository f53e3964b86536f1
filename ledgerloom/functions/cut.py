"""Cutting a plan where several branches read one result: a reliable checkpoint in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, written once to spark.checkpoint.dir; a temporary folder is used only where a local session sets none."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        own = sc.getConf().get("spark.checkpoint.dir")
        if own is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(own or "file://" + tempfile.mkdtemp(prefix="ledgerloom-"))
    return df.checkpoint()
