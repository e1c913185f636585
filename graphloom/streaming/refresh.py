"""Incremental refresh: new versions of files arrive as a stream and replace what the table has of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import best_first


def merged(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Files of ``known`` with those of ``batch`` (path, generation, deleted, ...) in their place: the last generation of each path."""
    both = known.withColumn("deleted", F.lit(False)).unionByName(batch, allowMissingColumns=True)
    return best_first(both, ["path"], [F.desc("generation"), F.desc("deleted")]).where("NOT deleted").drop("deleted")


def follow(stream: DataFrame, table: str, checkpoint: str):
    """Start a query that merges each micro-batch into the Parquet folder ``table``, written aside and then named by generation."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = f"{table}/generation={epoch - 1}"
        known = spark.read.parquet(before) if epoch else spark.createDataFrame([], batch.drop("deleted").schema)
        merged(known, batch).write.mode("overwrite").parquet(f"{table}/generation={epoch}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
