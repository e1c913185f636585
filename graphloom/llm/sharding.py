"""Sharding: weighted rendezvous hashing, DataFrame functions only.

Every (key, shard) pair has an exponential variate drawn from a hash of the
pair, divided by the shard's weight; a record goes to the shard with the least.
A shard more takes records only into itself, since the others' variates stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Parts of each shard that are numbered apart, so that no shard is one task.
PARTS = 64
SHARDS = 40


def _cost(key: Column, shard: Column | int, weight: Column | float) -> Column:
    shard = shard if isinstance(shard, Column) else F.lit(shard)
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, of a string key (null: as the empty string); the lower number on a tie."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    k = F.coalesce(key, F.lit(""))
    w = F.array(*[F.lit(float(x)) for x in weights])
    costs = F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda s: F.struct(_cost(k, s.cast("int"), F.get(w, s)).alias("cost"), s.cast("int").alias("shard")))
    return F.array_min(costs)["shard"]


def grown(key: Column, shard: Column, weights: Sequence[float], weight: float = 1.0) -> Column:
    """The shard once another, of ``weight``, has joined those of ``weights``; ``shard`` is :func:`rendezvous` of these."""
    k = F.coalesce(key, F.lit(""))
    w = F.array(*[F.lit(float(x)) for x in weights])
    new = len(weights)
    return F.when(_cost(k, new, weight) < _cost(k, shard, F.get(w, shard)), F.lit(new)).otherwise(shard)


def numbered(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot", parts: int = PARTS) -> DataFrame:
    """``df`` with a gapless number from 0 within each value of ``shard``.

    Rows are ordered by a hash part of ``order``'s columns, then by them. Each
    part is numbered by a task of its own and begins where those before it
    end; the table of these beginnings has at most shards x ``parts`` rows.
    Equal rows may swap numbers.
    """
    part, ahead = f"__part_{slot}", f"__ahead_{slot}"
    dealt = df.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy(shard, part).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(F.col(shard).alias("__s"), F.col(part).alias("__p"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias(ahead))
    own = dealt.withColumn("__rn", F.row_number().over(Window.partitionBy(shard, part).orderBy(*order)))
    joined = own.join(F.broadcast(begins), (own[shard] == begins["__s"]) & (own[part] == begins["__p"]))
    return joined.withColumn(slot, (F.col(ahead) + F.col("__rn") - 1).cast("long")).drop(part, ahead, "__rn", "__s", "__p")


def shard_documents(docs: DataFrame, weights: Sequence[float], parts: int = PARTS) -> DataFrame:
    """Shard, slot and size of every document.

    Needs doc_id and text. A null text has no bytes, a null doc_id is a key of
    its own; rows of one doc_id share a shard, however many. An empty table
    gives none.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    key = F.col("doc_id").cast("string")
    rows = docs.select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    shard = rendezvous(key, weights)
    rows = rows.withColumn("shard", shard)
    rows = rows.withColumn("grown_shard", grown(key, F.col("shard"), weights))
    return numbered(rows, "shard", ["doc_id", "text_crc32", "size"], parts=parts)


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op6_rendezvous_sharding": op6_rendezvous_sharding}
ORACLES: dict[str, str] = {}
