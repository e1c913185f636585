"""Best-fit packing of tokenized documents: best-two-fit over a histogram.

Documents become pieces of at most ``size`` tokens. Pieces of one length are
alike, so the plan is made from the number of pieces of each length, of which
there are ``size`` at most, however large the corpus. A bin is filled greedily
with the longest pieces that fit; then its smallest piece is taken out again if
two unpacked pieces fit the gap more tightly. The same bin is repeated as often
as the pieces allow. Pieces of a length are numbered, and the plan says which
number goes where.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, reliable, table
from .sharding import numbered

SIZE = 2048
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Words that a worker keeps; beyond, it keeps the first half.
KEPT_WORDS = 400_000


class Tokens:
    """Ids of a byte-level BPE vocabulary, as the tokenizers library gives them for ``json_path``.

    Words are parted where one space lies between two others than white space,
    which its pattern always parts; words met before are looked up. New ones go
    through tiktoken with the same vocabulary, ``ranks_path``.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(max(ranks.values()) + 1, bool)  # ids whose bytes begin with a space
        for b, i in ranks.items():
            self.begins[i] = b[:1] == b" "
        with open(json_path) as f:
            self.special = [(a["content"], a["id"]) for a in json.load(f)["added_tokens"]]
        self.kept: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers; the strings of special tokens are these tokens."""
        for s, i in self.special:
            if s in text:
                return np.array([i], "<u4").tobytes().join(self.plain(t) for t in text.split(s))
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def _meet(self, new: list[str]) -> None:
        ids = np.array(self.bpe.encode_ordinary(" " + " ".join(new)), "<u4")
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(new):
            raise AssertionError("a word has been parted in another place")
        raw = ids.tobytes()
        if len(self.kept) + len(new) > KEPT_WORDS:  # words met early are the frequent ones
            self.kept = dict(list(self.kept.items())[: KEPT_WORDS // 2])
        self.kept.update(zip(new, (raw[a:b] for a, b in zip((4 * starts).tolist(), [*(4 * starts[1:]).tolist(), len(raw)]))))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts (null: none), four bytes each."""
        out = []
        for at in range(0, len(texts), 64):
            some = texts[at : at + 64]
            split = [(t or "").split(" ") for t in some]
            found = [list(map(self.kept.get, words)) for words in split]
            gaps = [[i for i, x in enumerate(f) if x is None] for f in found]
            new = {words[i] for words, g in zip(split, gaps) for i in g}
            if clean := [w for w in new if self._clean(w)]:
                self._meet(clean)
            kept = self.kept
            for t, words, f, g in zip(some, split, found, gaps):
                try:
                    for i in g:
                        if i:
                            f[i] = kept[words[i]]
                except KeyError:  # white space touches a space, or a special token is there
                    out.append(self.plain(t))
                    continue
                if words[0][-1:].isspace():
                    out.append(self.plain(t))
                else:
                    f[0] = self.plain(words[0])
                    out.append(b"".join(f))
        return out

    def _clean(self, word: str) -> bool:
        return bool(word) and not word[0].isspace() and not word[-1].isspace() and not any(s in word for s, _ in self.special)


@lru_cache(2)
def tokens(json_path: str, ranks_path: str) -> Tokens:
    return Tokens(json_path, ranks_path)


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: one, or whole ``size`` ones behind a first that may be shorter."""
    first = n % size or size
    return [(0, first), *((a, size) for a in range(first, n, size))] if n else []


def cutter(json_path: str, ranks_path: str, size: int, end: int = 0):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tail = tokens(json_path, ranks_path), np.array([end], "<u4").tobytes()
        for b in batches:
            ids, rows, raw = b.column("doc_id").to_pylist(), [], own.encode_batch(b.column("__text").to_pylist())
            for doc, r in zip(ids, raw):
                r += tail
                rows += [(doc, k, s, n, zlib.crc32(r[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cuts(len(r) // 4, size))]
            cols = list(zip(*rows)) or [()] * 5
            kinds = [b.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, json_path: str, ranks_path: str, size: int = SIZE) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text; null: empty), each document's ids ending with id 0."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.selectExpr("doc_id", "text AS __text").mapInArrow(cutter(json_path, ranks_path, size), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, rows, first sequence, offset) runs that pack ``counts`` pieces of each length.

    Numbers ``first`` and up of a length go to sequences ``first sequence`` and
    up, one to each, at the offset.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    lengths = sorted(left)
    runs, sequence = [], 0

    def fit(room: int, taken: dict[int, int]) -> int:
        """The longest length of which a piece is left that fits; 0 if none does."""
        i = bisect_right(lengths, room)
        while i and left[lengths[i - 1]] <= taken.get(lengths[i - 1], 0):
            i -= 1
        return lengths[i - 1] if i else 0

    while lengths:
        bin_: list[int] = []
        taken: dict[int, int] = {}
        room = size
        while room and (n := fit(room, taken)):
            times = min(room // n, left[n] - taken.get(n, 0))
            bin_ += [n] * times
            taken[n] = taken.get(n, 0) + times
            room -= n * times
        if room and len(bin_) > 1:
            out = bin_[-1]
            gap = room + out
            taken[out] -= 1
            best = (out, 0, 0)
            spare = [n for n in lengths if n < gap and left[n] > taken.get(n, 0)]
            a, b = 0, len(spare) - 1
            while a <= b:
                both = spare[a] + spare[b]
                if both > gap:
                    b -= 1
                    continue
                if both > best[0] and (a < b or left[spare[a]] - taken.get(spare[a], 0) > 1):
                    best = (both, spare[b], spare[a])
                a += 1
            if best[1]:
                bin_[-1:] = best[1:]
                for n in best[1:]:
                    taken[n] = taken.get(n, 0) + 1
            else:
                taken[out] += 1
        times = min(left[n] // k for n, k in taken.items() if k)
        at = 0
        for n in bin_:
            runs.append((n, used[n], times, sequence, at))
            used[n] += times
            left[n] -= times
            at += n
        sequence += times
        if any(not left[n] for n in bin_):
            lengths = [n for n in lengths if left[n]]
    return runs


def placer(runs: list[tuple[int, int, int, int, int]]):
    """A function for mapInArrow that adds sequence_id and offset by length and number."""
    t = np.array(sorted(runs), np.int64).reshape(-1, 5)
    keys = t[:, 0] << 44 | t[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, slot = b.column("length").to_numpy(), b.column("__number").to_numpy()
            at = np.searchsorted(keys, n << 44 | slot, side="right") - 1
            seq = t[at, 3] + slot - t[at, 1] if len(at) else n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in PIECE), pa.array(seq), pa.array(t[at, 4] if len(at) else n)], [*PIECE, "sequence_id", "offset"])

    return place


PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Sequence and offset of every piece of ``cut`` (see :func:`pieces`).

    The driver holds a number for each length, and the plan. Repeated rows are
    packed each; an empty table gives no rows.
    """
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [c for c in ("length", "doc_id", "piece", "ids_crc32") if c in cut.columns]
    rows = numbered(cut.select(*PIECE), "length", order, slot="__number", parts=16)
    kind = cut.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(placer(plan(counts, size)), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str, size: int = SIZE) -> DataFrame:
    """The packed pieces of every row of ``docs`` (doc_id, text).

    A null or empty text is its end id alone. Rows of one doc_id are documents
    each; the files are on every executor.
    """
    return pack(reliable(pieces(docs, json_path, ranks_path, size)), size)


def _packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS))


def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(table(spark, sf_dir, "documents"))


def pack_all(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the packed pieces of all documents; see :func:`pack_documents` for nulls, repeated rows and empty tables. Only doc_id and text are read."""
    return _packed(docs)


QUERIES = {"op5_best_two_fit": op5_best_two_fit}
ORACLES: dict[str, str] = {}
