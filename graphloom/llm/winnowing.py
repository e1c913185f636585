"""Document fingerprints by winnowing, with DataFrame functions only.

A text's words are hashed, and a cyclic polynomial (rotate and exclusive-or)
makes the rolling hashes of all runs of GRAM words: two shifted copies of the
hashes of half as many words make the next. In each window of WINDOW hashes
the least is chosen, the rightmost of equal ones, since the place stands in the
low bits. Any run of GRAM + WINDOW - 1 words that two texts share has a chosen
hash in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, reliable, table

#: Both are powers of two.
GRAM, WINDOW = 4, 4
#: Bits of a chosen value that hold the place, counted down; the hash is above them.
PLACE_BITS = 24
_LAST = (1 << PLACE_BITS) - 1


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _joined(by: int):
    return lambda a, b: _rotated(a, by).bitwiseXOR(b)


def _shifted(a: Column, by: int, f) -> Column:
    """f(a[i], a[i + by]) for all i that have both."""
    n = F.size(a) - by
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(by + 1), n), f)


def winnowed(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``df`` with ``out``: the chosen values of the column ``text``, as an array of longs.

    A value's high 40 bits are the hash; :func:`place` gives its place. Fewer
    words than ``gram`` are one run, fewer runs than ``window`` one window; a
    text without a word (or null) has none.
    """
    if gram & (gram - 1) or window & (window - 1):
        raise ValueError("gram and window must be powers of two")
    w, h, v = f"__w_{out}", f"__h_{out}", f"__v_{out}"
    words = F.filter(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    df = df.withColumn(w, F.transform(words, lambda x: F.xxhash64(x)))
    short = F.when(F.size(w) > 0, F.array(F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: _rotated(a, 1).bitwiseXOR(x)))).otherwise(F.slice(w, 1, 0))
    df = df.withColumn(h, F.col(w))
    by = 1
    while by < gram:
        df = df.withColumn(h, F.when(F.size(w) >= gram, _shifted(F.col(h), by, _joined(by))).otherwise(F.col(h)))
        by *= 2
    df = df.withColumn(h, F.when(F.size(w) >= gram, F.col(h)).otherwise(short))
    df = df.withColumn(v, F.transform(h, lambda x, i: F.shiftleft(F.shiftright(x, PLACE_BITS), PLACE_BITS).bitwiseOR(F.lit(_LAST).cast("bigint") - i.cast("bigint").bitwiseAND(F.lit(_LAST).cast("bigint")))))
    by = 1
    least = F.col(v)
    m = f"__m_{out}"
    df = df.withColumn(m, least)
    while by < window:
        df = df.withColumn(m, F.when(F.size(v) >= window, _shifted(F.col(m), by, lambda a, b: F.least(a, b))).otherwise(F.col(m)))
        by *= 2
    chosen = F.when(F.size(v) >= window, F.array_distinct(m)).when(F.size(v) > 0, F.array(F.array_min(v))).otherwise(F.col(v))
    return df.withColumn(out, chosen).drop(w, h, v, m)


def place(value: Column) -> Column:
    """The place (first word, from 0) of a chosen value."""
    return F.lit(_LAST).cast("bigint") - value.bitwiseAND(F.lit(_LAST).cast("bigint"))


def hashes(values: Column) -> Column:
    """The different hashes among chosen values."""
    return F.array_distinct(F.transform(values, lambda x: F.shiftright(x, PLACE_BITS)))


def fingerprint(values: Column) -> Column:
    """A digest of chosen values, hashes and places."""
    return F.md5(F.concat_ws(",", F.transform(values, lambda x: F.hex(x))))


def likeness(a: Column, b: Column) -> Column:
    """Common part of two sets of hashes: Jaccard, 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and next_text: the text of the next row by doc_id, and after the last, of the first.

    Null ids come first; rows of one id follow by a hash of their text, and
    rows that also agree in it have the same next. The order is made from ids
    and hashes alone, in ranges; each range's first key is all the driver
    gets. Texts move by key, once for themselves and once as next ones.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("rows"))
    keys = reliable(keys.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").withColumn("range", F.spark_partition_id()))
    firsts = keys.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("first"), F.max("rows").alias("most")).orderBy("range").collect()
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    ahead = [(r["range"], n["first"]["doc_id"], n["first"]["h"]) for r, n in zip(firsts, firsts[1:] + firsts[:1])]
    ahead = spark.createDataFrame(ahead, f"range int, first_id {kind}, first_h bigint")
    own = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "h")
    follow = keys.withColumn("lead", F.lead(F.struct("doc_id", "h")).over(own)).join(F.broadcast(ahead), "range")
    to = F.when(F.col("lead").isNotNull(), F.col("lead")).otherwise(F.struct(F.col("first_id").alias("doc_id"), F.col("first_h").alias("h")))
    follow = follow.select(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h"), to["doc_id"].alias("n_id"), to["h"].alias("n_h"))
    texts = rows
    if any(r["most"] > 1 for r in firsts):
        texts = rows.dropDuplicates(["doc_id", "h"])
    ahead_of = follow.join(texts, F.col("n_id").eqNullSafe(texts["doc_id"]) & (F.col("n_h") == texts["h"])).select("k_id", "k_h", F.col("text").alias("next_text"))
    return rows.join(ahead_of, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h"))).select("doc_id", "text", "next_text")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its edited text, with their likenesses.

    The edited text has the last half of its code points replaced by as many of
    the next text. Null texts are empty; two empty fingerprints are alike (1);
    an empty table gives no rows.
    """
    df = with_next(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    df = winnowed(winnowed(winnowed(df, "text", "own"), "edited", "other"), "next_text", "following")
    df = df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "other", *[hashes(F.col(c)).alias(f"{c}_set") for c in ("own", "other", "following")])
    return df.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own_set"), F.col("other_set")).alias("near_edited"), likeness(F.col("own_set"), F.col("following_set")).alias("near_next"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))


QUERIES = {"op3_winnowing": op3_winnowing}
ORACLES: dict[str, str] = {}
