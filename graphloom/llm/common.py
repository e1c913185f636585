"""Helpers that the training-data operators share.

Operators read only the columns they name and give new columns names of their
own, so further columns of the input, whatever their names, do not matter.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch; texts can be long, so a batch stays at some MB.
BATCH_ROWS = 512
#: Rows of a few numbers that are sent to every executor.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts small; those of numbers alone can have more ``rows``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where the session names none, as in tests, one on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints", "graphloom"))
    return sc.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in :func:`shared_folder`, so that a lost executor loses nothing of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def few(rows: DataFrame, n: int | None = None) -> DataFrame:
    """``rows`` to be sent to every executor if there are at most BROADCAST_ROWS of them (``n``, if known), else as they are."""
    n = rows.limit(BROADCAST_ROWS + 1).count() if n is None else n
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def beta_strength(groups: DataFrame, n: str, k: str, least: float, most: float) -> tuple[float, float]:
    """(overall rate, prior strength) of beta-binomial groups, by moments.

    One aggregated row reaches the driver. The strength is the intraclass
    correlation turned round, kept within ``least`` and ``most``.
    """
    g = groups.where(F.col(n) > 0).select(F.col(n).cast("double").alias("n"), F.col(k).cast("double").alias("k"))
    r = g.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum("k").alias("k"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"),
    ).first()
    if not r["groups"]:
        return 0.0, most
    rate = r["k"] / r["n"]
    if rate <= 0 or rate >= 1 or r["groups"] < 2:
        return rate, most
    spread = (r["kk"] - r["k"] * r["k"] / r["n"]) / (rate * (1 - rate))
    room = r["n"] - r["nn"] / r["n"] - (r["groups"] - 1)
    rho = (spread - (r["groups"] - 1)) / room if room > 0 else 0.0
    return rate, most if rho <= 0 else min(most, max(least, 1 / rho - 1))
