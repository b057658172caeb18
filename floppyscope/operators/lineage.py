"""Cutting lineage where two runs over the same rows must see them in the same places."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the folder of ``spark.checkpoint.dir``, which all executors share.
    Only where that is unset and the master is local, as in tests, a temporary folder stands in."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="floppyscope-"))
    return df.checkpoint()
