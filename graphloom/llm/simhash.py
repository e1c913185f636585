"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit of a fingerprint gets a non-zero vector of r + 1 bits, fixed and
spread evenly. Table v, for each of the 2^(r+1) - 1 non-zero v, compares the
bits whose vector has odd product with v. For any r differing bits some v is
orthogonal to all their vectors, so every pair within r bits agrees in some
table. A bucket of very many different fingerprints is covered again by other
masks, until so few bits are free that it must be small; what is still large is
dealt into parts of which every two meet.

The pipeline's stage brings texts together by the SimHashes of their words in
the same way and then compares all their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_batches, few, reliable, table

BITS, RADIUS, WORDS = 64, 4, 4
#: The pipeline's stage: shingles of five words, a similarity of 0.8; differing bits of the words' SimHashes that are sure to meet, and
#: those above which a pair that meets is not compared (unlike texts differ in 32, texts alike at 0.8 in 10 at most, give or take 3).
STAGE_WORDS, LIKE, STAGE_RADIUS, FAR = 5, 0.8, 9, 14
#: A bucket of more rows is covered again, by so many levels at most; then it is dealt into parts.
BUCKET, LEVELS = 4096, 4
#: Cells of a tally of shingles; one table of how many serves to find centres; members of a block's part; shingles of a clump's part.
CELLS, CENTRE_TABLES, BLOCK, CLUMP = 128, 6, 1024, 1 << 18
#: Pairs for each node of a bucket, above which tallies are looked at first.
DENSE = 2
#: Frequent shingles that are known to every executor.
COMMON_KEYS = 100_000
#: Rows of numbers, and bytes of shingles, in an Arrow batch.
NUMBER_ROWS, SENT_BYTES = 1 << 14, 1 << 22
_MASK = (1 << 64) - 1
_MULT = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of a text in UTF-8: shingles of ``words`` words, repeats included; 0 without a word."""
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(parts), 42)], np.uint64)
        return int(hashes[0])
    line = memoryview(b" ".join(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(parts) - words + 1
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        h = np.array([digest(line[a:b], 42) for a, b in zip(begins[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist())], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprinter(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_signed(fingerprint(t or b"", words)) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array(got, pa.int64())], ["__row", "__fp"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` and __fp, the fingerprint of its whole text (null: 0) as a signed long."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("__row"), F.col("text").cast("binary").alias("__text"))
    kind = rows.schema["__row"].dataType.simpleString()
    return rows.mapInArrow(fingerprinter(words), f"__row {kind}, __fp bigint").select("__row.*", "__fp")


def covering(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bit places of which some agrees for any ``radius`` differing bits."""
    n = (1 << (radius + 1)) - 1
    spread = [1 << i for i in range(radius + 1)]  # all dimensions first, so that few masks are empty
    spread += sorted(set(range(1, n + 1)) - set(spread), key=lambda v: xxhash.xxh64_intdigest(v.to_bytes(4, "little")))
    vector = {b: spread[i % n] for i, b in enumerate(bits)}  # each vector as often as the others
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() & 1) for v in range(1, n + 1)]


@cache
def tables(radius: int, level: int = 0) -> tuple[int, ...]:
    """The masks of a level: any two fingerprints within ``radius`` agree on one of them.

    A radius above four is split: the bits fall into parts, and the parts' radii
    add up so that the differing bits cannot exceed all of them. Each level
    deals the bits out anew, so its masks cut the buckets of the level before.
    """
    bits = sorted(range(BITS), key=lambda b: xxhash.xxh64_intdigest(bytes([b, level])))
    parts = -(-(radius + 1) // 5)
    radii = [(radius + 1 + parts - 1 - i) // parts - 1 for i in range(parts)]
    return tuple(m for i, r in enumerate(radii) for m in covering(bits[i::parts], r))


def _keys(rows: DataFrame, masks: tuple[int, ...], seed: int) -> DataFrame:
    """``rows``, once for each mask, with the key of its bucket there (within the bucket ``key`` of before, if any)."""
    cols = [c for c in rows.columns if c != "key"]
    cuts = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(_signed(m)).alias("m")) for v, m in enumerate(masks)])
    before = [F.col("key")] if "key" in rows.columns else [F.lit(seed)]
    cut = rows.select(*rows.columns, F.explode(cuts).alias("__t"))
    return cut.select(*cols, F.xxhash64(*before, "__t.v", F.col("__fp").bitwiseAND(F.col("__t.m"))).alias("key"))


def dealt(rows: DataFrame, most: int, weight: str | None = None) -> DataFrame:
    """``rows`` (key, __node and others) with buckets of more than ``most`` (rows, or sum of ``weight``) dealt into parts, every two of which meet under a key of their own."""
    size = F.sum(weight) if weight else F.count(F.lit(1))
    parts = reliable(rows.groupBy("key").agg(F.ceil(size / most).alias("__parts")).where("__parts > 1"))
    n = parts.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return rows
    cut = rows.join(few(parts, n), "key", "left").withColumn("__part", F.pmod(F.xxhash64("__node", "key"), F.col("__parts")))
    met = cut.withColumn("__other", F.explode(F.when(F.col("__parts").isNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("__parts") - 1))))
    own = F.when(F.col("__parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("__part", "__other"), F.greatest("__part", "__other")))
    return met.withColumn("key", own).select(*rows.columns)


def buckets(nodes: DataFrame, radius: int = RADIUS, most: int = BUCKET, levels: int = LEVELS) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``nodes`` (__fp, __node and others) with the key of a bucket: pairs within the radius share one.

    Returns the rows in buckets of ``most`` at most, and the others, if any. A
    larger bucket is covered again by the next level's masks, which leaves half
    of its free bits; only what is still larger after ``levels`` is in the
    second table. If ``nodes`` has ``group``, buckets of one group alone are left
    out where they are large. Keys are hashes: buckets that share one by chance
    only bring together more than they need.
    """
    grouped = "group" in nodes.columns
    cols = ("key", *nodes.columns)
    level, done = nodes, None
    for depth in range(levels):
        cut = _keys(level, tables(radius, depth), depth)
        sums = [F.count(F.lit(1)).alias("n"), *([(F.min("group") != F.max("group")).alias("mixed")] if grouped else [])]
        large = reliable(cut.groupBy("key").agg(*sums).where(F.col("n") > most))
        n = large.limit(BROADCAST_ROWS + 1).count()
        small = (cut.join(few(large.select("key"), n), "key", "left_anti") if n else cut).select(*cols)
        done = small if done is None else done.unionByName(small)
        if not n:
            return done, None
        level = cut.join(few((large.where("mixed") if grouped else large).select("key"), n), "key").select(*cols)
    return done, level


def _by_bucket(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Columns key and ``names`` of whole buckets at a time, from batches sorted by key."""
    held: list[np.ndarray] | None = None
    for b in batches:
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", *names)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        end = int(np.searchsorted(cols[0], cols[0][-1], "left")) if len(cols[0]) else 0
        if end:
            yield [c[:end] for c in cols]
        held = [c[end:] for c in cols]
    if held is not None and len(held[0]):
        yield held


def _near(key: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places, first before second, of one key and within the radius; in each part a place comes once on either side."""
    i, d = np.arange(len(key)), 0
    while len(i):
        d += 1
        i = i[i + d < len(key)]
        i = i[key[i] == key[i + d]]
        near = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
        if len(near):
            yield near, near + d


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least place of each component, once the pairs are joined to ``root``."""
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _stars(node: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    """(src, dst): for every node but the least of its component, that one."""
    least = node.copy()
    np.minimum.at(least, root, node)
    own = np.flatnonzero(least[root] != node)
    return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(least[root][own])], ["src", "dst"])


def _forest(radius: int):
    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, node in _by_bucket(batches, ("__fp", "__node")):
            fp, root = fp.view(np.uint64), np.arange(len(key))
            held, n = [], 0
            for pair in _near(key, fp, radius):
                held.append(pair)
                n += len(pair[0])
                if n > 1 << 20:
                    root, held, n = _joined(root, *map(np.concatenate, zip(*held))), [], 0
            if held:
                root = _joined(root, *map(np.concatenate, zip(*held)))
            yield _stars(node, root)

    return forest


def sorted_buckets(rows: DataFrame) -> DataFrame:
    arrow_batches(rows.sparkSession, NUMBER_ROWS)
    return rows.repartition("key").sortWithinPartitions("key")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(src, dst), dst < src: a forest in each bucket that joins what is linked there, a star for each component."""
    small, rest = buckets(fps.select("__fp", "__node"), radius)
    rows = small if rest is None else small.unionByName(dealt(rest, BUCKET))
    return sorted_buckets(rows).mapInArrow(_forest(radius), "src bigint, dst bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(src, dst): for every node of ``edges`` but the smallest of its component, that smallest node.

    Large and small stars in turn (each node's neighbours are tied to the
    smallest among them) until nothing changes: a number of rounds that grows
    with the logarithm of the longest chain. Up to BROADCAST_ROWS edges the
    smallest neighbours are sent to the edges; beyond, both meet by node.
    """
    edges = reliable(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct())
    seen, n = None, edges.count()
    while n:
        parts = n // 20_000 + 1  # a few edges need no more files
        edges = edges.coalesce(parts)
        both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("m", "src"))
        large = both.join(few(least, 2 * n), "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(few(low, n), "src")
        small = small.select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").unionByName(low.select("src", F.col("m").alias("dst"))).distinct()
        edges = reliable(small.coalesce(parts))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        n = now[0]
        if now == seen:
            return edges
        seen = now
    return edges


def grouped(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``rows`` (doc_id, __fp and others) with component_id, the smallest doc_id that can be reached.

    Equal fingerprints are one node, named by their smallest doc_id; rows with
    a null doc_id reach others but name no component unless they are alone.
    """
    fps = reliable(rows.groupBy("__fp").agg(F.min("doc_id").alias("__least")))
    nodes = fps.select("__fp", F.col("__least").alias("__node")).where(F.col("__node").isNotNull())
    if fps.where(F.col("__least").isNull()).limit(1).count():
        # fingerprints of rows without a doc_id only: a node of their own below all others, taken off again at the end
        alone = fps.where(F.col("__least").isNull()).select("__fp", F.lit(None).cast(nodes.schema["__node"].dataType).alias("__node"))
        return _with_unnamed(rows, nodes, alone, radius)
    ends = components(links(_spread(nodes), radius)).select(F.col("src").alias("__node"), F.col("dst").alias("component_id"))
    named = nodes.join(ends, "__node", "left").select("__fp", F.coalesce("component_id", "__node").alias("component_id"))
    return rows.join(named, "__fp", "left")


def _spread(nodes: DataFrame) -> DataFrame:
    """``nodes`` in partitions that stay small when each row is multiplied by the masks."""
    return nodes.repartition(max(nodes.sparkSession.sparkContext.defaultParallelism, nodes.count() // 20_000), "__fp")


def _with_unnamed(rows: DataFrame, nodes: DataFrame, alone: DataFrame, radius: int) -> DataFrame:
    """:func:`grouped` where some fingerprints have no doc_id: the fingerprint itself, in a separate range, is their node.

    Components are formed over both; one is named by the smallest doc_id in it,
    and by null where it has none.
    """
    every = nodes.select("__fp", F.col("__node").alias("__name")).unionByName(alone.select("__fp", F.col("__node").cast(nodes.schema["__node"].dataType).alias("__name")))
    every = reliable(every.withColumn("__node", F.col("__fp")))  # the fingerprints are distinct, so they can stand for the nodes
    ends = components(links(_spread(every), radius)).select(F.col("src").alias("__node"), F.col("dst").alias("__end"))
    joined = every.join(ends, "__node", "left").withColumn("__end", F.coalesce("__end", "__node"))
    names = joined.groupBy("__end").agg(F.min("__name").alias("component_id"))
    return rows.join(joined.select("__fp", "__end").join(names, "__end").select("__fp", "component_id"), "__fp", "left")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text).

    A null or empty text has fingerprint zero and is linked like any other;
    repeated rows are in one component; rows without a doc_id link others, and
    their component is null if no row in it has one; an empty table gives no rows.
    """
    out = grouped(reliable(fingerprints(docs, words)), radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def _word_hashes(text: bytes) -> np.ndarray:
    parts = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))


def _shingles(h: np.ndarray, words: int = STAGE_WORDS) -> np.ndarray:
    k = min(words, len(h))
    if not k:
        return h
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * _MULT
        out ^= out >> np.uint64(29)
    return np.unique(out)


def shingle_set(text: bytes, words: int = STAGE_WORDS) -> np.ndarray:
    """64-bit hashes of a text's different shingles, in order; a text of fewer words is one shingle."""
    return _shingles(_word_hashes(text), words)


def word_print(text: bytes) -> tuple[int, int, int, np.ndarray]:
    """(SimHash of a text's different words, hash of its sequence of words, number n of its different shingles, tally of these).

    The tally counts the shingles in CELLS cells by hash, modulo 4: the low
    bits of all cells, then the high ones; see :func:`apart`.
    """
    h = _word_hashes(text)
    tally = np.zeros(CELLS // 32, np.int64)
    if not len(h):
        return 0, 0, 0, tally
    words, ones = np.unique(h), np.zeros(64, np.int64)
    for at in range(0, len(words), 1 << 16):
        ones += np.unpackbits(words[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    own = _shingles(h)
    cells = np.bincount((own >> np.uint64(57)).astype(np.int64), minlength=CELLS)
    tally[:] = np.packbits([cells & 1, cells >> 1 & 1]).view(np.int64)
    return int(np.packbits(2 * ones > len(words), bitorder="little").view("<u8")[0]), xxhash.xxh3_64_intdigest(h.tobytes(), 1), len(own), tally


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles of one text the other has not, at least, by rows of their tallies: each cell's difference the shorter way round."""
    x, half = (a ^ b).view(np.uint64), a.shape[1] // 2
    return (np.bitwise_count(x[:, :half]).astype(np.int64) + 2 * np.bitwise_count(x[:, half:] & ~x[:, :half])).sum(1)


def may_be_alike(n: np.ndarray, m: np.ndarray, tally: np.ndarray, other: np.ndarray) -> np.ndarray:
    """False where the numbers of shingles or the tallies rule out a similarity of LIKE."""
    may = np.minimum(n, m) >= LIKE * np.maximum(n, m) - 1e-6
    may[may] = apart(tally[may], other[may]) <= (1 - LIKE) / (1 + LIKE) * (n[may] + m[may]) + 1e-6
    return may


_TALLY = tuple(f"__t{i}" for i in range(CELLS // 32))
_PRINT = ("__fp", "__same", "__n", *_TALLY)


def _word_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [word_print(t or b"") for t in b.column("__text").to_pylist()]
        tally = np.array([g[3] for g in got], np.int64).reshape(-1, len(_TALLY))
        cols = [np.array([_signed(g[k]) for g in got], np.int64) for k in range(3)] + list(tally.T)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in cols)], ["doc_id", *_PRINT])


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every node of a bucket with others that it may be alike to, within STAGE_RADIUS: the one of these that has most others itself."""
    for key, fp, node, n, *tally in _by_bucket(batches, ("__fp", "__node", "__n", *_TALLY)):
        fp, tally = fp.view(np.uint64), np.stack(tally, 1)
        degree, rank, best = np.zeros(len(key), np.int64), np.empty(len(key), np.int64), np.full(len(key), -1)
        for counted in (False, True):
            for a, b in _near(key, fp, STAGE_RADIUS):
                may = may_be_alike(n[a], n[b], tally[a], tally[b])
                a, b = a[may], b[may]
                if counted:
                    best[a] = np.maximum(best[a], rank[b])
                    best[b] = np.maximum(best[b], rank[a])
                else:
                    degree[a] += 1
                    degree[b] += 1
            if not counted:
                order = np.lexsort((-node, degree))
                rank[order] = np.arange(len(key))
        own = np.flatnonzero(best >= 0)
        other = order[best[own]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[own], node[other], degree[other])], ["src", "dst", "degree"])


def _sparse_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket's nodes within FAR bits, of like numbers of shingles and not of one group.

    Where these are more than DENSE for each node, the nodes that have any are
    returned instead, each as a pair with itself.
    """
    for key, fp, node, group, n in _by_bucket(batches, ("__fp", "__node", "group", "__n")):
        bucket = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        size = np.bincount(bucket)
        count, any_ = np.zeros(len(size), np.int64), np.zeros(len(key), bool)
        for told in (False, True):
            dense = count > DENSE * size
            for a, b in _near(key, fp.view(np.uint64), FAR):
                may = (group[a] != group[b]) & (np.minimum(n[a], n[b]) >= LIKE * np.maximum(n[a], n[b]) - 1e-6)
                a, b = a[may], b[may]
                if not told:
                    count += np.bincount(bucket[a], minlength=len(size))
                    continue
                much = dense[bucket[a]]
                any_[a[much]] = any_[b[much]] = True
                a, b = node[a[~much]], node[b[~much]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["src", "dst"])
        own = pa.array(np.unique(node[any_]))
        yield pa.RecordBatch.from_arrays([own, own], ["src", "dst"])


def _clumped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest in each bucket over its nodes within FAR bits, not of one group, that may be alike: a star for each component, not its pairs."""
    for key, fp, node, group, n, *tally in _by_bucket(batches, ("__fp", "__node", "group", "__n", *_TALLY)):
        tally, root = np.stack(tally, 1), np.arange(len(key))
        held, many = [], 0
        for a, b in _near(key, fp.view(np.uint64), FAR):
            other = (group[a] != group[b]) & (root[a] != root[b])
            a, b = a[other], b[other]
            may = may_be_alike(n[a], n[b], tally[a], tally[b])
            held.append((a[may], b[may]))
            many += len(held[-1][0])
            if many > len(key):
                root, held, many = _joined(root, *map(np.concatenate, zip(*held))), [], 0
        if held:
            root = _joined(root, *map(np.concatenate, zip(*held)))
        yield _stars(node, root)


def cells_of(own: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles modulo 4, in as many cells as it has shingles or half as many."""
    bits = max(2, len(own).bit_length() - 1)
    return (np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 3).astype(np.uint8)


def _packed(own: np.ndarray) -> bytes:
    c = cells_of(own)
    return np.int64(len(own)).tobytes() + (c[::4] | c[1::4] << 2 | c[2::4] << 4 | c[3::4] << 6).tobytes()


def _unpacked(x: np.ndarray) -> tuple[int, np.ndarray]:
    return int(x[:8].view(np.int64)[0]), np.stack([x[8:] >> k & 3 for k in (0, 2, 4, 6)], 1).ravel()


def cells_apart(a: np.ndarray, b: np.ndarray) -> int:
    """How many shingles of one set the other has not, at least, by the :func:`cells_of` both."""
    while len(a) != len(b):
        a, b = (a.reshape(-1, 2).sum(1) & 3, b) if len(a) > len(b) else (a, b.reshape(-1, 2).sum(1) & 3)
    d = (a.astype(np.int8) - b.astype(np.int8)) & 3
    return int(np.minimum(d, 4 - d).sum(dtype=np.int64))


def _sent(exact: bool):
    """What stands for each text's shingles, once for every block that it is sent to: all of them, or their cells."""
    kinds = {"block": pa.int64(), "part": pa.int64(), "member": pa.bool_(), "__node": pa.int64(), "shingles": pa.binary()}

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for node, text, to in zip(b.column("__node").to_pylist(), b.column("__text").to_pylist(), b.column("to").to_pylist()):
                own = shingle_set(text or b"")
                own = own.tobytes() if exact else _packed(own)
                for x in to:
                    rows.append((x["block"], x["part"], x["block"] != node, node, own))
                    held += len(own) + 64
                    if held > SENT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))

    return sent


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    a, b = a.view(np.uint64), b.view(np.uint64)
    if min(len(a), len(b)) < LIKE * max(len(a), len(b)) - 1e-6:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= LIKE * (len(a) + len(b) - both) - 1e-9


def _perhaps(a: np.ndarray, b: np.ndarray) -> bool:
    (n, x), (m, y) = _unpacked(a), _unpacked(b)
    return min(n, m) >= LIKE * max(n, m) - 1e-6 and cells_apart(x, y) <= (1 - LIKE) / (1 + LIKE) * (n + m) + 1e-6


def _judged(exact: bool):
    """Members of a block that are alike (or may be) to its head, which stands first in each part."""
    good = _alike if exact else _perhaps

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, np.zeros(0, np.uint8)
        for b in batches:
            src, dst = [], []
            for block, part, member, node, x in zip(*(b.column(c).to_pylist() for c in ("block", "part", "member", "__node")), b.column("shingles")):
                own = np.frombuffer(x.as_buffer(), np.uint8)
                if not member:
                    at, head = (block, part), own.copy()
                elif at == (block, part) and good(own.copy(), head):
                    src.append(node)
                    dst.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return judged


def _met(pairs: DataFrame, texts: DataFrame, exact: bool) -> DataFrame:
    """Those of ``pairs`` that :func:`_judged` leaves: src is sent to the block of dst, as is dst itself; a block of many is dealt into parts of BLOCK, each with dst."""
    sizes = pairs.groupBy("dst").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    members = pairs.join(sizes, "dst").select(F.col("src").alias("__node"), F.col("dst").alias("block"), F.pmod(F.xxhash64("src"), F.col("parts")).alias("part"))
    heads = sizes.select(F.col("dst").alias("__node"), F.col("dst").alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    to = reliable(members.unionByName(heads).groupBy("__node").agg(F.collect_list(F.struct("block", "part")).alias("to")))
    arrow_batches(texts.sparkSession)
    sets = texts.join(few(to, 2 * pairs.count()), "__node").select("__node", "__text", "to").mapInArrow(_sent(exact), "block bigint, part bigint, member boolean, __node bigint, shingles binary")
    rows = sets.repartition("block", "part").sortWithinPartitions("block", "part", "member")
    return reliable(rows.mapInArrow(_judged(exact), "src bigint, dst bigint"))


def alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (src, dst; each once) of ``texts`` (__node, __text) whose shingles, all of them, are alike at LIKE or more.

    Cells, of a fiftieth of the size, rule out most others before the shingles are compared.
    """
    return _met(_met(reliable(pairs), texts, False), texts, True)


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(b.num_rows):  # a row at a time, as texts can be long
            own = shingle_set(b.column("__text")[at].as_py() or b"").tobytes()
            yield pa.RecordBatch.from_arrays([b.column("__row").slice(at, 1), b.column("to").slice(at, 1), pa.array([own], pa.binary())], ["__row", "to", "shingles"])


def _linked(node: np.ndarray, group: np.ndarray, fp: np.ndarray, tally: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
    """The components of a clump's texts of which two within FAR bits are alike by all shingles, as stars; what is joined already is not compared again."""
    n = np.array([len(x) for x in sets])
    ends = np.cumsum(n)
    every, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = [codes[e - k : e] for e, k in zip(ends.tolist(), n.tolist())]
    first, root = np.unique(group, return_index=True, return_inverse=True)[1:]
    root, mark = first[root], np.zeros(len(every), bool)
    for i in range(len(node) - 1):
        later = np.arange(i + 1, len(node))
        later = later[(root[later] != root[i]) & (np.bitwise_count(fp[later] ^ fp[i]) <= FAR)]
        at = np.full(len(later), i)
        later = later[may_be_alike(n[at], n[later], tally[at], tally[later])]
        if not len(later):
            continue
        mark[codes[i]] = True
        both = np.array([np.count_nonzero(mark[codes[j]]) for j in later.tolist()])
        mark[codes[i]] = False
        good = later[both >= LIKE * (n[i] + n[later] - both) - 1e-9]
        if len(good):
            root = _joined(root, np.full(len(good), i), good)
    return _stars(node, root)


def _linked_in_clumps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, rows = None, []
    for b in batches:
        shingles = b.column("shingles")
        for at, row in enumerate(zip(*(b.column(c).to_pylist() for c in ("key", "__node", "group", "__fp", *_TALLY)))):
            if row[0] != key and rows:
                yield _of_rows(rows)
                rows = []
            key = row[0]
            rows.append((row[1:], np.frombuffer(shingles[at].as_buffer(), np.uint64).copy()))
    if rows:
        yield _of_rows(rows)


def _of_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = np.array([r[0] for r in rows], np.int64)
    return _linked(cols[:, 0], cols[:, 1], cols[:, 2].copy().view(np.uint64), np.ascontiguousarray(cols[:, 3:]), [r[1] for r in rows])


def links_in_clumps(forest: DataFrame, held: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """(src, dst): a forest of the links by all shingles between those of ``held`` that ``forest`` joins.

    Two texts that may be alike are in one clump, a component of ``forest``. Each
    text's shingles are sent there once, and all pairs are compared in place, so
    that rows go with the texts and not with their pairs; a clump of more than
    ``most`` shingles is dealt into parts of which every two meet.
    """
    ends = components(forest)
    clump = reliable(ends.select(F.col("src").alias("__node"), F.col("dst").alias("key")).unionByName(ends.select(F.col("dst").alias("__node"), F.col("dst").alias("key")).distinct()))
    n = clump.count()
    own = reliable(held.join(few(clump, n), "__node").select("key", *held.columns))
    row = F.struct(*held.columns)
    to = reliable(dealt(own, most, "__n").groupBy("__node").agg(F.first(row).alias("__row"), F.collect_list("key").alias("to")))
    arrow_batches(texts.sparkSession)
    kind = to.schema["__row"].dataType.simpleString()
    sets = texts.join(few(to, n), "__node").select("__row", "__text", "to").mapInArrow(_with_shingles, f"__row {kind}, to array<bigint>, shingles binary")
    rows = sets.select(F.explode("to").alias("key"), "__row.*", "shingles").repartition("key").sortWithinPartitions("key")
    return reliable(rows.mapInArrow(_linked_in_clumps, "src bigint, dst bigint").distinct())


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in b.column("__text").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t or b"").view(np.int64))], ["key"])


def prefix(own: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, least frequent first (``often`` tells how often the sorted ``common`` are).

    So many that sets alike at LIKE or more share one: they share ceil(LIKE n) of
    either set's n, whatever the order, if only all sets are in the same one.
    """
    n = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        n = np.where(common[at] == own, often[at], 0)
    return own[np.argsort(n, kind="stable")[: len(own) - math.ceil(LIKE * len(own) - 1e-6) + 1]]


def shingle_buckets(nodes: DataFrame, crowded: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """``nodes`` that are in ``crowded`` (__node, each once) once for each shingle of their :func:`prefix`, as its key.

    Shingles of more than ``most`` texts stand last in all sets; up to
    COMMON_KEYS of them are known to the driver. This order is only for speed.
    """
    spark = nodes.sparkSession
    crowded = reliable(crowded)
    body = texts.join(few(crowded), "__node", "left_semi").select("__node", "__text")
    often = body.select("__text").mapInArrow(_all_shingles, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    found = often.orderBy(F.desc("n"), "key").limit(COMMON_KEYS).toArrow()
    common = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(common)
    sent = spark.sparkContext.broadcast((common[order], found.column("n").to_numpy()[order]))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, text in zip(b.column("__node").to_pylist(), b.column("__text").to_pylist()):
                own = prefix(shingle_set(text or b""), *sent.value)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), node))], ["key", "__node"])

    return dealt(nodes.join(body.mapInArrow(keys, "key bigint, __node bigint"), "__node").select("key", *nodes.columns), most)


def near_copies(docs: DataFrame, most: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): one node for each different sequence of words in ``docs`` (doc_id, text), and for every
    node but the least of its group, that one.

    Texts are linked if the SimHashes of their different words share a bucket,
    as all within STAGE_RADIUS bits do and most that differ in a few more, and
    the Jaccard similarity of their shingles of five words is LIKE or more.
    First each text is held against a centre near it, found in a few of the
    tables, which joins the groups of many copies; then against all others
    in its buckets that are not of its group; where most of a bucket are near each
    other, no pairs are made: texts whose tallies allow it form clumps, in which
    all are compared (:func:`links_in_clumps`). Texts of buckets with more
    than ``most`` of them, of several groups, meet by shingles that they must
    have in common (:func:`shingle_buckets`).
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    body = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("__text"))
    prints = body.mapInArrow(_word_prints, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in _PRINT))
    kinds = prints.groupBy("__same", "__fp", "__n").agg(F.min("doc_id").alias("__node"), *[F.first(c).alias(c) for c in _TALLY])
    nodes = _spread(reliable(kinds.drop("__same")))
    texts = body.withColumnRenamed("doc_id", "__node")
    first = _keys(nodes, tables(STAGE_RADIUS)[::CENTRE_TABLES], 0)
    sizes = reliable(first.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts")).where("parts > 1"))
    if n := sizes.limit(BROADCAST_ROWS + 1).count():  # whatever lies apart here meets below
        first = first.join(few(sizes, n), "key", "left").withColumn("key", F.xxhash64("key", F.pmod(F.xxhash64("__node", "key"), F.coalesce("parts", F.lit(1)))))
    centres = sorted_buckets(first.select("key", *nodes.columns)).mapInArrow(_centres, "src bigint, dst bigint, degree bigint")
    stars = alike(centres.groupBy("src").agg(F.max_by("dst", F.struct("degree", F.negative("dst"))).alias("dst")), texts)
    ends = components(stars).select(F.col("src").alias("__node"), F.col("dst").alias("group"))
    held = nodes.join(few(ends), "__node", "left").select("__fp", "__node", F.coalesce("group", "__node").alias("group"), "__n", *_TALLY)
    pair = "src bigint, dst bigint"
    met, rest = buckets(held.select("__fp", "__node", "group", "__n"), STAGE_RADIUS, most, 1)
    found = reliable(sorted_buckets(met).mapInArrow(_sparse_candidates, pair).distinct())
    pairs, crowded = found.where("src <> dst"), found.where("src = dst").select(F.col("src").alias("__node"))
    links, dense = stars.unionByName(alike(pairs, texts)), []
    if crowded.limit(1).count():
        again = buckets(held.join(few(crowded), "__node").select(held.columns), STAGE_RADIUS, most, 1)[0]  # its larger buckets are among those of rest
        dense.append(sorted_buckets(again).mapInArrow(_clumped, pair))
    if rest is not None:
        dense.append(sorted_buckets(shingle_buckets(held, rest.select("__node").distinct(), texts, most)).mapInArrow(_clumped, pair))
    if dense:
        links = links.unionByName(links_in_clumps(reduce(DataFrame.unionByName, dense), held, texts, CLUMP))
    return nodes.select("__node"), components(links)


def keep_firsts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: of every group of exact and near copies (:func:`near_copies`), the document of the smallest doc_id.

    Texts without a word are one group. Of rows that share a doc_id one is the
    document, that of the least hash of its text (then the least text); documents without a doc_id stay.
    """
    cols = docs.columns
    known = docs.where(F.col("doc_id").isNotNull())
    if known.groupBy("doc_id").count().where("count > 1").limit(1).count():
        order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
        own = [F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]
        ranked = known.select(*own, "doc_id", "text").withColumn("__rank", F.row_number().over(order)).where("__rank = 1")
        known = ranked.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
    nodes, ends = near_copies(known)
    firsts = nodes.join(few(ends.select(F.col("src").alias("__node"))), "__node", "left_anti").select(F.col("__node").alias("__first"))
    kept = known.join(few(firsts), known["doc_id"] == firsts["__first"], "left_semi")
    return kept.unionByName(docs.where(F.col("doc_id").isNull())).select(*cols)


QUERIES = {"op4_covering_simhash": op4_covering_simhash}
ORACLES: dict[str, str] = {}
