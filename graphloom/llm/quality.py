"""Quality rules: text rules by document, then verdicts by host.

Each document is measured by text rules. Failures are summed by host (the
``source`` of a document), a beta prior fitted to all hosts shrinks each host's
rate, and the hosts' verdicts go back to their documents: all documents of a
host whose rate surely exceeds ``HOST_OUT`` go, and in a host whose rate surely
exceeds ``HOST_STRICT`` those go that fail any rule. The base rules hold for
every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, beta_strength, few, reliable, table

#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
HOST_OUT, HOST_STRICT, Z = 0.9, 0.5, 1.96
STRENGTH = (2.0, 1000.0)

_WHITE = bytes(range(9, 14)) + b" "
_CONTINUED = bytes(range(0x80, 0xC0))


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text in UTF-8.

    bytes.split() without argument splits at space and 0x09 to 0x0D, no others.
    """
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0
    chars = len(text.translate(None, _WHITE + _CONTINUED))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    return n, chars, symbols, dup, repeated(words)


def repeated(words: list[bytes]) -> int:
    """Words that lie in a window of three found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(first := set(windows)) == len(windows):
        return 0
    seen: set[tuple] = set()
    twice = {w for w in windows if w in seen or seen.add(w)} if first else set()
    n, end = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [measure(t or b"") for t in b.column("__text").to_pylist()]
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([b.column("__row"), *(pa.array(c, pa.int64()) for c in cols)], ["__row", *MEASURES])


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The columns ``keep`` of ``docs``, the measures of its text (null: no words), base_failed and n_failed."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("__row"), F.col("text").cast("binary").alias("__text"))
    row = rows.schema["__row"].dataType.simpleString()
    out = rows.mapInArrow(_measures, f"__row {row}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    out = out.select("__row.*", *MEASURES)
    n = F.col("n_words")
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    soft = [F.col("word_chars") < 2 * n, F.col("word_chars") > 20 * n, 3 * F.col("n_symbols") > n, 10 * F.col("n_dup_lines") > n]
    return out.withColumn("base_failed", base).withColumn("n_failed", base.cast("int") + sum((s.cast("int") for s in soft), F.lit(0)))


def host_verdicts(rows: DataFrame, host: str = "source", z: float = Z, strength: tuple[float, float] = STRENGTH) -> DataFrame:
    """Posterior rate of failing documents for every host (null counts as a host): __host, host_rate, host_low.

    host_low is the rate's lower bound, ``z`` standard deviations below.
    """
    hosts = rows.groupBy(F.col(host).alias("__host")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("n_failed") > 0).cast("long")).alias("k"))
    rate, m = beta_strength(hosts, "n", "k", *strength)
    mean = (F.col("k") + m * rate) / (F.col("n") + m)
    out = hosts.select("__host", mean.alias("host_rate"), (F.col("n") + m + 1).alias("__w"))
    low = F.col("host_rate") - z * F.sqrt(F.greatest(F.col("host_rate") * (1 - F.col("host_rate")), F.lit(0.0)) / F.col("__w"))
    return out.select("__host", "host_rate", F.greatest(low, F.lit(0.0)).alias("host_low"))


def judged(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """:func:`measured`, host_rate, host_low and kept, for every row of ``docs``.

    Needs doc_id, text and source. A null or empty text has no words and fails;
    a null source is a host of its own; an empty table gives no rows.
    """
    rows = reliable(measured(docs, keep))
    hosts = few(reliable(host_verdicts(rows)))
    out = rows.join(hosts, rows["source"].eqNullSafe(hosts["__host"]), "left").drop("__host")
    gone = F.col("base_failed") | (F.col("host_low") > HOST_OUT) | ((F.col("host_low") > HOST_STRICT) & (F.col("n_failed") > 0))
    return out.withColumn("kept", ~F.coalesce(gone, F.col("base_failed")))


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *MEASURES, "base_failed", "kept")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the documents that the rules and their host's verdict keep.

    Null and empty texts go, a null source is a host, repeated rows are judged
    each; an empty table stays one. All columns are kept, of any name.
    """
    cols = docs.columns
    own = [f"c{i}" for i in range(len(cols))]  # a column of the documents may bear any name
    renamed = docs.select(*[F.col(c).alias(o) for c, o in zip(cols, own)], "text", "source")
    return judged(renamed, (*own, "source")).where("kept").select(*[F.col(o).alias(c) for c, o in zip(cols, own)])


QUERIES = {"op7_host_quality": op7_host_quality}

ORACLES = {
    "op7_host_quality": """
WITH w AS (
  SELECT doc_id, source, text,
         list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i+1], ws[i+2]) AS c
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM win WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
          OR 3 * n_symbols > n_words OR 10 * n_dup_lines > n_words) AS failed
  FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(failed::INT) AS DOUBLE) AS k FROM f GROUP BY source),
s AS (SELECT count(*) AS g, sum(n) AS n, sum(n * n) AS nn, sum(k) AS k, sum(k * k / n) AS kk, sum(k) / sum(n) AS r FROM h),
t AS (
  SELECT r, CASE WHEN r <= 0 OR r >= 1 OR g < 2 THEN 1000.0
                 WHEN n - nn / n - (g - 1) <= 0 OR ((kk - k * k / n) / (r * (1 - r)) - (g - 1)) <= 0 THEN 1000.0
                 ELSE least(1000.0, greatest(2.0, (n - nn / n - (g - 1)) / ((kk - k * k / n) / (r * (1 - r)) - (g - 1)) - 1)) END AS m
  FROM s),
v AS (
  SELECT source, (k + m * r) / (n + m) AS hr,
         (k + m * r) / (n + m) - 1.96 * sqrt(greatest((k + m * r) / (n + m) * (1 - (k + m * r) / (n + m)), 0) / (n + m + 1)) AS low
  FROM h, t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR low > 0.9 OR (low > 0.5 AND failed)) AS kept
FROM f LEFT JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
}
