"""Tables of a graph as Parquet, a folder for each repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def write_repo(df: DataFrame, path: str) -> None:
    """Replace the folders of the repositories in ``df`` (repo_id) and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)


def read_repo(spark: SparkSession, path: str, repo_id: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if repo_id is None else df.where(F.col("repo_id") == repo_id)


def evolve(df: DataFrame, schema) -> DataFrame:
    """``df`` with the columns of a newer schema that it lacks, as nulls."""
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in df.columns])


def as_json(df: DataFrame) -> DataFrame:
    """One column, json, an object for each row."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
