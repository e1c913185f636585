"""What operators need of a session."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame


def reliable(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the folder of spark.checkpoint.dir; where none is named and Spark is local, as in tests, one on this machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints", "graphloom"))
    return df.checkpoint()
