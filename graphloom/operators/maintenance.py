"""Changes of stored tables: file diff, wipes, healing, collection, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable


def file_diff(known: DataFrame, found: DataFrame) -> DataFrame:
    """(path, change) over both: added, changed, unchanged or deleted, by content hash."""
    k = known.select("path", F.col("content_hash").alias("old"))
    f = found.select("path", F.col("content_hash").alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return k.join(f, "path", "full_outer").select("path", kind.alias("change"))


def wipe_files(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges without those of ``files`` (id): edges out of them go, edges into them lose their target."""
    dead_files = files.select(F.col("id").alias("file_id"))
    dead = symbols.join(dead_files, "file_id", "left_semi").select(F.col("id").alias("dead"))
    kept_symbols = symbols.join(dead_files, "file_id", "left_anti")
    out = edges.join(dead, edges["src"] == dead["dead"], "left_anti")
    gone = dead.withColumnRenamed("dead", "gone")
    out = out.join(gone, out["dst"] == gone["gone"], "left").withColumn("dst", F.when(F.col("gone").isNull(), F.col("dst"))).drop("gone")
    return kept_symbols, out


def heal(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges without a target bound by qname to ``symbols`` (qname, id); confidence 0 becomes 2, others stay."""
    names = symbols.groupBy(F.col("qname").alias("dst_qname")).agg(F.min("id").alias("__id"))
    open_ = edges.where(F.col("dst").isNull() & F.col("dst_qname").isNotNull())  # the others need no partner, and would all meet at null
    bound = F.col("__id").isNotNull()
    healed = open_.join(names, "dst_qname", "left").withColumn("confidence", F.when(bound & (F.col("confidence") == 0), 2).otherwise(F.col("confidence"))).withColumn("dst", F.col("__id"))
    return edges.where(F.col("dst").isNotNull() | F.col("dst_qname").isNull()).unionByName(healed.select(edges.columns))


def collect_orphans(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols without the externals that no edge reaches."""
    used = edges.where(F.col("dst").isNotNull()).select(F.col("dst").alias("id")).distinct()
    orphans = symbols.where("kind = 'external'").join(used, "id", "left_anti").select("id")
    return symbols.join(orphans, "id", "left_anti")


def merge_detections(old: DataFrame, new: DataFrame) -> DataFrame:
    """By name the row of the highest confidence; the new one on a tie."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy("name").orderBy(F.desc("confidence"), F.desc("__new"))
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """The first edge, by id, for each (kind, src, dst_qname, line, sink_id, via); nulls are alike."""
    keys = ["kind", "src", "dst_qname", "line", "sink_id", "via"]
    w = Window.partitionBy(*keys).orderBy("id")
    return edges.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def with_ids(df: DataFrame, order: list[str], above: int = 0, name: str = "id") -> DataFrame:
    """Ids from ``above`` + 1 on in a stable order, without one task for all rows.

    Rows are dealt by ranges of ``order``; each range counts from where those
    before it end. Equal rows may swap ids.
    """
    ranged = reliable(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.broadcast(sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__from")))  # a row for each range
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__rn", own).join(begins, "__part").withColumn(name, (F.col("__from") + F.col("__rn") + above).cast("bigint")).drop("__part", "__rn", "__from")


def update_column(df: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` replaced where ``new`` (key, column) has a value."""
    n = new.select(key, F.col(column).alias("__new"))
    return df.join(n, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def dedup_parameters(params: DataFrame, name_most: int = 128, type_most: int = 64) -> DataFrame:
    """The first parameter, by id, of each (entrypoint, name, location), with names and types cut as they are stored."""
    cut = params.withColumns({"name": F.substring("name", 1, name_most), "type_ref": F.substring("type_ref", 1, type_most)})
    rn = F.row_number().over(Window.partitionBy("entrypoint_id", "name", "location").orderBy("id"))
    return cut.withColumn("__rn", rn).where("__rn = 1").drop("__rn")
