"""The corpus pipeline: quality rules, language ID, near duplicates, packing.

Each stage reads what the one before it wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import common, langid, packing, quality, simhash

STAGES = [
    ("quality", quality.keep_good),
    ("language", langid.keep_known),
    ("near_duplicates", simhash.keep_firsts),
    ("packing", packing.pack_all),
]

#: SQL has no language model, no XXH64 and no tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written beside the checkpoints and read again."""
    docs = common.table(spark, sf_dir, "documents")
    place = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
