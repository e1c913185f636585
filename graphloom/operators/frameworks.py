"""Which frameworks a repository uses, from its dependencies, imports, files and symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.framework_values import FRAMEWORKS
from ..functions.patterns import catalog_regex
from .relational import noisy_or

#: Languages whose imports tell of a framework of the first.
FAMILY = {"javascript": ("javascript", "typescript", "tsx")}
LEAST = 0.5


def signal_rows(frameworks: Sequence[tuple] = FRAMEWORKS) -> list[tuple]:
    """(framework, language, ord, kind, pattern, weight), numbered within a framework."""
    return [(name, language, i, kind, pattern, weight) for name, language, signals in frameworks for i, (kind, pattern, weight) in enumerate(signals)]


def fired(spark: SparkSession, facts: DataFrame, present: DataFrame, frameworks: Sequence[tuple] = FRAMEWORKS) -> DataFrame:
    """Signals that fire in a repository: repo_id, framework, language, ord, weight, evidence (the least value that fits).

    ``facts`` has repo_id, kind (dependency, import, file, symbol), language
    (null for files and symbols) and value; ``present`` has repo_id and language.
    Plain signals meet facts by value; globs are literal patterns over facts of
    their kind. Dependencies ignore case.
    """
    value = F.when(F.col("kind") == "dependency", F.lower("value")).otherwise(F.col("value"))
    seen = facts.where(F.col("value").isNotNull()).select("repo_id", "kind", F.col("language").alias("own"), value.alias("value")).distinct()
    rows = [(n, la, i, k, p.lower() if k == "dependency" else p, w) for n, la, i, k, p, w in signal_rows(frameworks)]
    schema = "framework string, language string, ord int, kind string, pattern string, weight double"
    plain = F.broadcast(spark.createDataFrame([r for r in rows if not set("*?[") & set(r[4])], schema))
    globs = [r for r in rows if set("*?[") & set(r[4])]
    hits = seen.join(plain.withColumnRenamed("pattern", "value"), ["kind", "value"])
    tests = F.array(*[F.when((F.col("kind") == k) & F.col("value").rlike(catalog_regex(p)), F.struct(F.lit(n).alias("framework"), F.lit(la).alias("language"), F.lit(i).alias("ord"), F.lit(w).alias("weight"))) for n, la, i, k, p, w in globs])
    more = seen.select("repo_id", "kind", "own", "value", F.explode(F.array_compact(tests)).alias("s")).select("repo_id", "kind", "own", "value", "s.*") if globs else hits.limit(0)
    columns = ["repo_id", "kind", "own", "value", "framework", "language", "ord", "weight"]
    both = hits.select(columns).unionByName(more.select(columns))
    same = F.col("own") == F.col("language")
    for first, family in FAMILY.items():
        same = same | ((F.col("kind") == "import") & (F.col("language") == first) & F.col("own").isin(*family))
    both = both.where(F.col("kind").isin("file", "symbol") | same)
    both = both.join(present.select("repo_id", "language").distinct(), ["repo_id", "language"], "left_semi")
    return both.groupBy("repo_id", "framework", "language", "ord", "weight").agg(F.min("value").alias("evidence"))


def detected(spark: SparkSession, facts: DataFrame, present: DataFrame, frameworks: Sequence[tuple] = FRAMEWORKS, least: float = LEAST) -> DataFrame:
    """repo_id, framework, language, confidence, evidence (in the signals' order) of every framework that is sure enough."""
    got = fired(spark, facts, present, frameworks).withColumn("key", F.struct("repo_id", "framework", "language"))
    sure = noisy_or(got, "key", "weight", least)
    why = got.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "evidence"))), lambda x: x["evidence"]).alias("evidence"))
    return sure.join(why, "key").select("key.*", "confidence", "evidence")
