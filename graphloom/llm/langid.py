"""Language ID: bit-sliced Bloom filters over character n-grams.

A filter has SLOTS rows, each a bit mask with one bit for every language: the
languages' Bloom filters side by side. The masks at an n-gram's slots, joined
by AND, are all languages that may contain it. A text's n-grams are looked up
at once, each language's hits are counted, the count that false positives
explain (the language's fill to the power of the probes) is taken off, and the
largest corrected count decides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, reliable, table

N, SLOTS_LOG2, PROBES = 4, 20, 2
SLOTS = 1 << SLOTS_LOG2
#: Learning takes about so many labelled rows at most, drawn by a hash of the row, as many of every language that has so many; prediction takes all rows.
LEARN_ROWS = 20_000
#: An n-gram belongs to a language if it has so many rows there, and so large a part of its rate where it is most frequent; a language's model has so many n-grams at most.
LEAST_ROWS, LEAST_RATE, MODEL_GRAMS = 3, 0.2, 200_000
#: Languages in one word of a mask; a filter has as many words as it needs.
WORD_LANGUAGES = 63
#: Code points that are looked up at a time, so that a very long text needs no more memory.
CHUNK = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point, whether it is a letter, and whether it is a letter or a mark on one (as vowel signs are)."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    return np.array([k == "L" for k in kinds]), np.array([k in "LM" for k in kinds])


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points with every run of others than letters and marks as one 0, and one 0 at either end; empty without a letter."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter, kept = _letters()
    if not letter[a].any():
        return a[:0]
    a = np.where(kept[a], a, 0)
    a = np.concatenate(([0], a, [0])).astype(np.uint32)
    return a[np.concatenate(([True], (a[1:] != 0) | (a[:-1] != 0)))]


def grams(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of all n-grams of the code points (of the whole, if shorter)."""
    n = min(N, len(codes))
    h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for i in range(n):
        h *= np.uint64(0x100000001B3)
        h += codes[i : len(codes) - n + 1 + i]
    h *= _MULT
    h ^= h >> np.uint64(29)
    return h


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - SLOTS_LOG2)
    return h >> shift, (h * _SECOND) >> shift


class Filters:
    """The filters of languages, most frequent first, and the rates of their false positives. ``masks`` has WORD_LANGUAGES languages in each column."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        self.bits = [(i // WORD_LANGUAGES, np.uint64(1 << i % WORD_LANGUAGES)) for i in range(len(languages))]
        fill = np.array([np.count_nonzero(masks[:, w] & bit) / SLOTS for w, bit in self.bits])
        self.false = np.minimum(fill**PROBES, 0.999)

    def predict(self, text: str | None) -> tuple[str, float, int]:
        """(language, score, n-grams). Without a letter, or without languages: und, 0.

        The score is the winner's corrected share of the n-grams. Equal shares
        give the language of more rows, then the first by name; so does a text
        of which no language holds an n-gram, with score 0.
        """
        codes = _codes(text or "")
        if not len(codes) or not self.languages:
            return "und", 0.0, 0
        hits, n = np.zeros(len(self.languages)), 0
        for at in range(0, max(1, len(codes) - N + 1), CHUNK):
            h = grams(codes[at : at + CHUNK + N - 1])
            a, b = _slots(h)
            m = self.masks[a.astype(np.int64)] & self.masks[b.astype(np.int64)]
            n += len(m)
            hits += [np.count_nonzero(m[:, w] & bit) for w, bit in self.bits]
        right = np.clip((hits / n - self.false) / (1 - self.false), 0, 1)
        best = int(right.argmax())
        return self.languages[best], float(right[best]), n


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, rows) sums of a task's batches; flushed at a bound."""
    by: dict[str, list[np.ndarray]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in by.items():
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            for i in range(0, len(g), 100_000):
                k = len(g[i : i + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array(g[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000].astype(np.int64))], ["lang", "gram", "rows"])
        by.clear()

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            codes = _codes(text or "")
            for at in range(0, len(codes), CHUNK):
                g = np.unique(grams(codes[at : at + CHUNK + N - 1]))
                by.setdefault(lang, []).append(g)
                held += len(g)
        if held > 4_000_000:
            yield from out()
            held = 0
    yield from out()


def learn(labelled: DataFrame, learn_rows: int = LEARN_ROWS) -> Filters:
    """Filters from the rows of ``labelled`` (lang, text, doc_id).

    Rows with a null lang teach nothing. A hash of the row chooses about
    ``learn_rows``: all of the languages of few rows, an equal number of the
    others. The counts of their n-grams are summed by the executors; the driver
    gets those that pass, MODEL_GRAMS of the most frequent for each language.
    """
    arrow_batches(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes, key=lambda k: (-sizes[k], k))
    if not languages:
        return Filters([], np.zeros((SLOTS, 1), np.uint64))
    left, drawn = float(learn_rows), {}
    for i, k in enumerate(reversed(languages)):  # what small languages leave goes to the larger ones
        drawn[k] = min(float(sizes[k]), left / (len(languages) - i))
        left -= drawn[k]
    spark = labelled.sparkSession
    shares = F.broadcast(spark.createDataFrame([(k, drawn[k] / sizes[k]) for k in languages], "lang string, share double"))
    rows = rows.join(shares.select("lang", "share"), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1 << 30)) < F.col("share") * F.lit(1 << 30))
    sums = rows.select("lang", "text").mapInArrow(_learn, "lang string, gram bigint, rows bigint")
    sums = reliable(sums.groupBy("gram", "lang").agg(F.sum("rows").alias("rows")).where(F.col("rows") >= LEAST_ROWS))
    least = dict.fromkeys(languages, 0)
    seen = dict.fromkeys(languages, 0)
    for r in sums.groupBy("lang", "rows").agg(F.count(F.lit(1)).alias("n")).orderBy("lang", F.desc("rows")).toLocalIterator():
        seen[r["lang"]] += r["n"]  # an n-gram that is too many, and those that are no more frequent, are left out
        if seen[r["lang"]] > MODEL_GRAMS and not least[r["lang"]]:
            least[r["lang"]] = r["rows"] + 1
    floors = F.broadcast(spark.createDataFrame([(k, i, drawn[k], least[k]) for i, k in enumerate(languages)], "lang string, place int, drawn double, least bigint"))
    rated = sums.join(floors, "lang").where("rows >= least").withColumn("rate", F.col("rows") / F.col("drawn"))
    most = rated.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("place", "rate")).alias("in"))
    got = most.select("gram", F.transform(F.filter("in", lambda x: x["rate"] >= LEAST_RATE * F.col("most")), lambda x: x["place"]).alias("places")).toArrow()
    gram = got.column("gram").to_numpy().view(np.uint64)
    lists = got.column("places").combine_chunks()
    of = np.repeat(np.arange(len(gram)), np.asarray(lists.value_lengths()))
    place = np.asarray(lists.flatten()).astype(np.int64)
    masks = np.zeros((SLOTS, -(-len(languages) // WORD_LANGUAGES)), np.uint64)
    for s in _slots(gram):
        np.bitwise_or.at(masks, (s.astype(np.int64)[of], place // WORD_LANGUAGES), np.uint64(1) << (place % WORD_LANGUAGES).astype(np.uint64))
    return Filters(languages, masks)


def predictor(spark: SparkSession, filters: Filters):
    """A function for mapInArrow: adds lang_pred and score to rows of __row and __text."""
    sent = spark.sparkContext.broadcast((filters.languages, filters.masks))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(*sent.value)
        for b in batches:
            got = [own.predict(t) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["__row", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, filters: Filters, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, with lang_pred and score of its whole text.

    Only the text decides. A null text, or one without a letter, is ``und``
    with score 0; equal texts get equal results; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("__row"), F.col("text").alias("__text"))
    kind = rows.schema["__row"].dataType.simpleString()
    out = rows.mapInArrow(predictor(docs.sparkSession, filters), f"__row {kind}, lang_pred string, score double")
    return out.select("__row.*", "lang_pred", "score")


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def op1_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = learn(docs.where(~held_out()))
    return identify(docs, filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: A document of whose n-grams no language holds so large a share is in none of them.
LEAST_SCORE = 0.2


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the documents that are in one of the learned languages.

    Null texts and texts without a letter go, rows that are repeated are judged
    each, a null lang only teaches nothing; where no row has a lang, and in an
    empty table, nothing is learned and all stay. All columns are kept, of any name.
    """
    cols = docs.columns
    filters = learn(docs)
    if not filters.languages:
        return docs
    renamed = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)], F.col("text"))
    out = identify(renamed, filters, tuple(f"c{i}" for i in range(len(cols))))
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])


QUERIES = {"op1_language_bitmask": op1_language_bitmask}
ORACLES: dict[str, str] = {}
