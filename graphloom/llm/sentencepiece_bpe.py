"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A word's symbols are code points; an agenda holds its adjacent pairs that make
a piece, ordered by the piece's score, then from the left. The best pair is
merged, pairs with the neighbours enter the agenda, and pairs that no longer
stand are passed over. What is no piece in the end becomes byte pieces. No
piece of such a vocabulary holds a space mark after another character, so words
(with the space marks before them) are encoded apart, and each worker keeps the
words it has met. Every word that it meets first is encoded and decoded by the
sentencepiece library too, all those of an Arrow batch in one call, and a
difference ends the job.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from sentencepiece import sentencepiece_model_pb2

from .common import arrow_batches, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Words that a worker keeps; beyond, it keeps the first quarter.
KEPT_WORDS = 1_000_000

#: Longer words have an agenda of their own, a heap.
LONG = 40
NONE = 1 << 62
_SPREAD, _SLOTS_LOG2 = np.uint64(0x9E3779B97F4A7C15), 20
#: Symbols have so many bits.
_BITS, _FREE = 21, 1 << 16
_MASK = (1 << _BITS) - 1
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, check: bool = True):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix or not norm.add_dummy_prefix:
            raise ValueError("a BPE model with identity normalization and a space mark before each word is needed")
        self.dummy = norm.add_dummy_prefix
        pieces = [(p.piece, p.score, p.type or _NORMAL) for p in model.pieces]
        if any(SPACE in p.lstrip(SPACE) for p, _, k in pieces if k == _NORMAL) or any(k == _USER for _, _, k in pieces):
            raise ValueError("a piece reaches over the space between words")
        ranked = sorted((-s, i) for i, (_, s, k) in enumerate(pieces) if k == _NORMAL)
        rank, last, at = {}, None, -1
        for s, i in ranked:  # equal scores share a rank: the leftmost pair goes first
            at += s != last
            rank[i], last = at, s
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == _NORMAL}
        #: Symbols: pieces by id, and any character that is no piece by _FREE + code point.
        self.symbols = dict(self.ids)
        for p in self.ids:
            for c in p:
                self.symbols.setdefault(c, _FREE + ord(c))
        if len(pieces) > _FREE:
            raise ValueError("too many pieces")
        #: By two neighbours: rank of what they make, and its symbol.
        self.merges: dict[int, int] = {}
        for p, i in self.ids.items():
            for at in range(1, len(p)):
                left, right = self.symbols.get(p[:at]), self.symbols.get(p[at:])
                if left is not None and right is not None:
                    self.merges[left << _BITS | right] = rank[i] << _BITS | i
        self.symbol_at = _FREE + np.arange(0x110000, dtype=np.int32)
        for p, i in self.symbols.items():
            if len(p) == 1:
                self.symbol_at[ord(p)] = i
        self.slot_key, self.slot_value = np.full(1 << _SLOTS_LOG2, -1), np.full(1 << _SLOTS_LOG2, NONE)
        for k, v in self.merges.items():
            at = (k * int(_SPREAD) & 0xFFFFFFFFFFFFFFFF) >> 64 - _SLOTS_LOG2
            while self.slot_key[at] != -1:
                at = (at + 1) & ((1 << _SLOTS_LOG2) - 1)
            self.slot_key[at], self.slot_value[at] = k, v
        self.bytes_of = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(pieces) if k == _BYTE}
        self.byte_at = {i: b for b, i in self.bytes_of.items()}
        self.control = {i for i, (_, _, k) in enumerate(pieces) if k == _CONTROL}
        self.unknown = next(i for i, (_, _, k) in enumerate(pieces) if k == _UNKNOWN)
        self.eos = next(i for i, (p, _, k) in enumerate(pieces) if p == (train.eos_piece or "</s>"))
        self.pieces = [p for p, _, _ in pieces]
        self.plain = [p.replace(SPACE, " ") for p in self.pieces]
        self.special = {i for i, (_, _, k) in enumerate(pieces) if k != _NORMAL}
        #: Ids in decimal of words (without their space mark) met so far, and decoded words that differ from the word.
        self.kept: dict[str, str] = {}
        self.changed: dict[str, str] = {}
        self.library = sentencepiece.SentencePieceProcessor(model_file=path) if check else None

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word whose spaces are SPACE."""
        find = self.merges.get
        at = [self.symbols.get(c, _FREE + ord(c)) for c in word]
        n = len(at)
        agenda = [m >> _BITS << 32 | i for i, (a, b) in enumerate(zip(at, at[1:])) if (m := find(a << _BITS | b)) is not None]
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            top = heappop(agenda)
            i = top & 0xFFFFFFFF
            if (a := at[i]) is None or (j := after[i]) == n or (m := find(a << _BITS | at[j])) is None or m >> _BITS != top >> 32:
                continue  # one of the two has been merged since
            at[i] = a = m & _MASK
            at[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := find(a << _BITS | at[k])) is not None:
                    heappush(agenda, m >> _BITS << 32 | i)
            if (h := before[i]) >= 0 and (m := find(at[h] << _BITS | a)) is not None:
                heappush(agenda, m >> _BITS << 32 | h)
        return self._pieces([s for s in at if s is not None])

    def _pieces(self, symbols: list[int]) -> list[int]:
        """Ids of symbols: characters that are no piece become byte pieces, or a run of them one unknown."""
        if not symbols or max(symbols) < _FREE:
            return symbols
        out: list[int] = []
        run = False
        for s in symbols:
            if free := s >= _FREE:
                if self.bytes_of:
                    out += [self.bytes_of[b] for b in chr(s - _FREE).encode("utf-8", "replace")]
                elif not run:
                    out.append(self.unknown)
            else:
                out.append(s)
            run = free
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What neighbours make, as in ``merges``; NONE if they make no piece."""
        key = left.astype(np.int64) << _BITS | right
        key[(left < 0) | (right < 0)] = -2
        slot = (key.view(np.uint64) * _SPREAD >> np.uint64(64 - _SLOTS_LOG2)).astype(np.int64)
        out = np.full(len(key), NONE)
        todo = np.arange(len(key))
        while len(todo):
            there = self.slot_key[slot]
            hit = there == key
            out[todo[hit]] = self.slot_value[slot[hit]]
            on = ~hit & (there != -1)
            todo, key, slot = todo[on], key[on], (slot[on] + 1) & ((1 << _SLOTS_LOG2) - 1)
        return out

    def encode_words(self, words: Sequence[str]) -> list[list[int]]:
        """:meth:`encode_word` of many words at once: a row of ranks is the agenda of each, and every round merges the best pair of every word."""
        out: list[list[int]] = [[] for _ in words]
        order = sorted((len(w), i) for i, w in enumerate(words))
        while order and order[-1][0] > LONG:
            _, i = order.pop()
            out[i] = self.encode_word(words[i])
        for begin in range(0, len(order), 4096):
            rows = np.array([i for _, i in order[begin : begin + 4096]])
            size = np.array([n for n, _ in order[begin : begin + 4096]])
            wide = int(size[-1]) + 1
            at = np.full((len(rows), wide), -2, np.int32)
            at[np.arange(wide) < size[:, None]] = self.symbol_at[np.frombuffer("".join([words[i] for i in rows]).encode("utf-32-le", "surrogatepass"), np.uint32)]
            made = np.full(at.shape, NONE)
            made[:, :-1] = self._pairs(at[:, :-1].ravel(), at[:, 1:].ravel()).reshape(len(rows), -1)
            place = np.arange(wide)
            while len(rows):
                j = made.argmin(1)
                each = np.arange(len(rows))
                best = made[each, j]
                if (done := best == NONE).any():
                    for i, n, ids in zip(rows[done].tolist(), size[done].tolist(), at[done].tolist()):
                        out[i] = self._pieces(ids[:n])
                    go = ~done
                    rows, size, at, made, j, best = rows[go], size[go], at[go], made[go], j[go], best[go]
                    each = np.arange(len(rows))
                    if not len(rows):
                        break
                at[each, j] = best & _MASK
                stay = place <= j[:, None]
                at[:, :-1] = np.where(stay[:, :-1], at[:, :-1], at[:, 1:])
                made[:, :-1] = np.where(stay[:, :-1], made[:, :-1], made[:, 1:])
                size -= 1
                made[each, j] = self._pairs(at[each, j], at[each, j + 1])
                left = np.flatnonzero(j > 0)
                made[left, j[left] - 1] = self._pairs(at[left, j[left] - 1], at[left, j[left]])
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids: pieces joined, runs of byte pieces as UTF-8, marks as spaces, the first space dropped."""
        if self.special.isdisjoint(ids):
            text = "".join([self.plain[i] for i in ids])
        else:
            parts: list[bytes] = []
            for i in ids:
                if i in self.byte_at:
                    parts.append(bytes([self.byte_at[i]]))
                elif i not in self.control:
                    parts.append((" ⁇ " if i == self.unknown else self.plain[i]).encode())
            text = b"".join(parts).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text

    def _meet(self, new: list[str]) -> None:
        """Encode and decode words not met before, all in one call of the library too."""
        ids = self.encode_words([SPACE + w for w in new])
        together = [i for x in ids for i in x]
        text = self.decode(together)
        if self.library is not None:
            for w, x, y in zip(new, ids, self.library.encode([w or SPACE for w in new], num_threads=1)):
                if x != y and w:
                    raise AssertionError(f"the library encodes {w!r} as {y}, not as {x}")
            if self.library.decode(together) != text:
                raise AssertionError("the library decodes the ids of these words to another text")
        if len(self.kept) + len(new) > KEPT_WORDS:  # words met early are the frequent ones
            self.kept = dict(islice(self.kept.items(), KEPT_WORDS // 4))
        self.kept.update((w, " ".join(map(str, x))) for w, x in zip(new, ids))
        if text != " ".join(new):
            self.changed.update((w, t) for w, x in zip(new, ids) if (t := self.decode(x)) != w)

    def encode_text(self, text: str) -> tuple[int, str, str]:
        """As :meth:`encode_batch`, for a text in which spaces touch."""
        ids = [i for w in _WORD.findall(SPACE + text.replace(" ", SPACE)) for i in self.encode_word(w)]
        decoded = self.decode(ids)
        if self.library is not None and (ids != self.library.encode(text) or decoded != self.library.decode(ids)):
            raise AssertionError(f"the library encodes {text[:200]!r} in another way")
        return len(ids) + 1, " ".join(map(str, [*ids, self.eos])), decoded

    def encode_batch(self, texts: Sequence[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, ids in decimal joined by spaces, decoded text) of texts; the end id is the last."""
        out, end = [], f" {self.eos}"
        for at in range(0, len(texts), 64):
            some = texts[at : at + 64]
            split = [t.split(" ") if t and SPACE not in t and "  " not in t and t[0] != " " != t[-1] else None for t in some]
            found = [list(map(self.kept.get, words)) if words else [] for words in split]
            gaps = [[i for i, x in enumerate(f) if x is None] for f in found]
            if new := list({words[i] for words, g in zip(split, gaps) for i in g}):
                self._meet(new)
            kept, changed = self.kept, self.changed
            for words, f, g in zip(split, found, gaps):
                for i in g:
                    f[i] = kept[words[i]]
            for t, words, f in zip(some, split, found):
                if not t:
                    out.append((1, str(self.eos), ""))
                elif words is None:
                    out.append(self.encode_text(t))
                else:
                    ids = " ".join(f) + end
                    if changed and not changed.keys().isdisjoint(words):
                        t = " ".join([changed.get(w, w) for w in words])
                    out.append((ids.count(" ") + 1, ids, t))
        if len(self.changed) > KEPT_WORDS:
            self.kept, self.changed = {}, {}
        return out


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            got = own.encode_batch(b.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.large_string()).cast(pa.string()), pa.array([g[2] for g in got], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encode


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by a space, the end id last) and decoded text of every row of ``docs``.

    ``path`` is the model file, on every executor. A null or empty text has the
    end id alone and decodes to an empty text; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    return docs.selectExpr("doc_id", "text AS __text").mapInArrow(encoder(path), "doc_id bigint, n_tokens bigint, ids string, decoded string")


def digests(path: str):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in encoder(path)(batches):
            ids, decoded = b.column("ids").to_pylist(), b.column("decoded").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), pa.array([_sha(x) for x in ids]), pa.array([_sha(x) for x in decoded])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def op2_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    arrow_batches(spark)
    path = public_tokenizers.path(MODEL)
    return docs.selectExpr("doc_id", "text AS __text").mapInArrow(digests(path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


QUERIES = {"op2_piece_agenda": op2_piece_agenda}
ORACLES: dict[str, str] = {}
