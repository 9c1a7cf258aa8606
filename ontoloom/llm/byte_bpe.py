"""Byte-level BPE encoding and decoding by two tiers.

Tier one: a minimal perfect hash over the vocabulary answers for whole pre-tokens. Tier two: what it doesn't
hold is merged with a heap over doubly linked bytes, lowest rank first and leftmost on ties. A pre-token's
ids don't depend on its neighbours, so each worker remembers them in a cache of bounded size.

Defined results: a null or empty text has no ids; each match of the pattern is encoded separately and special
tokens are ordinary text; ids are carried as little-endian unsigned 32-bit integers, in Arrow binary; repeated
rows and null ids pass through; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import id_text

DEFAULT_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DEFAULT_PATTERN = public_tokenizers.PATTERN
#: Entries of one generation of a cache, of which two are kept (about 0.25 KB an entry), and the longest text that is one.
CACHE_SIZE, LONGEST = 125_000, 48
#: Signs that are a match of their own after a word, unless more of their kind follow.
SIGNS = (".", ",", ";", ":", "!", "?", ")")
_M64 = (1 << 64) - 1
#: Where a text has no two whitespace characters in a row, none but space and line feed, and none at its ends,
#: every space starts a new match of the pattern, so the pieces between spaces can be encoded by themselves.
_OTHER_SPACE = re.compile(r"[^\S \n]")


def _odd(text: str) -> bool:
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or bool(_OTHER_SPACE.search(text))



class PerfectHash:
    """A minimal perfect hash by displacement: one seed for each bucket, n slots for n keys."""

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        buckets: dict[int, list[int]] = {}
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets.setdefault(h % n, []).append(i)
        self.seeds, taken = [0] * n, bytearray(n)
        self.keys, self.values = [b""] * n, [0] * n
        singles = []
        for b, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                singles.append((b, members[0]))
                continue
            seed = 1
            while True:
                slots = [self._slot(hashes[i], seed) for i in members]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                seed += 1
            self.seeds[b] = seed
            for i, s in zip(members, slots, strict=True):
                taken[s], self.keys[s], self.values[s] = 1, keys[i], values[i]
        free = (s for s in range(n) if not taken[s])
        for b, i in singles:  # a bucket of one names its slot itself
            s = next(free)
            self.seeds[b], self.keys[s], self.values[s] = -s - 1, keys[i], values[i]

    def _slot(self, h: int, seed: int) -> int:
        x = (h ^ (seed * 0x9E3779B97F4A7C15 & _M64)) * 0xBF58476D1CE4E5B9 & _M64
        return (x >> 29) % self.n

    def get(self, key: bytes) -> int:
        """The value, or -1 if key is none of the keys."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        seed = self.seeds[h % self.n]
        s = -seed - 1 if seed < 0 else self._slot(h, seed)
        return self.values[s] if self.keys[s] == key else -1


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: a heap of mergeable neighbours over linked bytes.

    An entry holds rank, start and end as bit fields of one integer, in that order.
    """
    n, rank = len(word), ranks.get
    bits = n.bit_length()
    low, two = (1 << bits) - 1, 2 * bits
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [r << two | i << bits | i + 2 for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        x = heappop(heap)
        stop, i = x & low, x >> bits & low
        mid = after[i]
        if mid <= i or mid >= n or after[mid] != stop:  # one of the two has been merged since
            continue
        after[i], after[mid] = stop, -1
        if stop < n:
            before[stop] = i
            end = after[stop]
            if (r := rank(word[i:end])) is not None:
                heappush(heap, r << two | i << bits | end)
        p = before[i]
        if p >= 0 and (r := rank(word[p:stop])) is not None:
            heappush(heap, r << two | p << bits | stop)
    out, i = [], 0
    while i < n:
        end = after[i]
        out.append(ranks[word[i:end]])
        i = end
    return out


class Cache:
    """Two generations of a dict: when the young one is full it becomes the old one."""

    def __init__(self, size: int = CACHE_SIZE):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        v = self.young.get(key)
        if v is None and (v := self.old.get(key)) is not None:
            self.put(key, v)
        return v

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value


class Codec:
    def __init__(self, ranks_path: str = DEFAULT_RANKS, pattern: str = DEFAULT_PATTERN):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # \s as the Unicode property, which excludes the separators U+001C to U+001F
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.plain = pattern == DEFAULT_PATTERN
        self.whole = PerfectHash(list(self.ranks), list(self.ranks.values()))
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.words, self.pieces, self.tokens = Cache(), Cache(CACHE_SIZE // 3), Cache(CACHE_SIZE // 8)

    def _ids(self, token: str) -> bytes:
        word = token.encode()
        r = self.whole.get(word)
        return r.to_bytes(4, "little") if r >= 0 else array("I", merge(word, self.ranks)).tobytes()

    def _token(self, token: str) -> bytes:
        """Of one match of the pattern."""
        if token[0] == " " and len(token) > 1:
            return self._word(token[1:])
        ids = self.tokens.get(token)
        if ids is None:
            ids = self._ids(token)
            if len(token) <= LONGEST:
                self.tokens.put(token, ids)
        return ids

    def _word(self, word: str) -> bytes:
        """Of a space and the word, where both are one match."""
        ids = self.words.get(word)
        if ids is None:
            ids = self._ids(" " + word)
            if len(word) <= LONGEST:
                self.words.put(word, ids)
        return ids

    def _line(self, p: str, space: bool) -> bytes:
        """Of p without whitespace; mostly it is a word, or a word and one sign, whose matches need no pattern."""
        one = self._word if space else self._token
        if self.plain and p.isalpha():
            return one(p)
        if space and (ids := self.pieces.get(p)) is not None:
            return ids
        if self.plain and p[-1:] in SIGNS and p[:-1].isalpha():
            ids = one(p[:-1]) + self._token(p[-1])
        else:
            ids = self._matches(" " + p if space else p)
        if space and len(p) <= LONGEST:
            self.pieces.put(p, ids)
        return ids

    def _piece(self, p: str, space: bool = True) -> bytes:
        if "\n" not in p:
            return self._line(p, space)
        first, *rest = p.split("\n")
        feed = self._token("\n")
        return self._line(first, space) + b"".join(feed + self._line(x, False) for x in rest)

    def _matches(self, text: str) -> bytes:
        return b"".join(map(self._token, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _odd(text):
            return self._matches(text)
        first, *rest = text.split(" ")
        found = list(map(self.words.young.get, rest))
        if None in found:
            known = self.pieces.young.get
            found = [x or known(p) or self._piece(p) for x, p in zip(found, rest, strict=True)]
        return self._piece(first, False) + b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(ranks_path: str = DEFAULT_RANKS, pattern: str = DEFAULT_PATTERN) -> Codec:
    return Codec(ranks_path, pattern)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = DEFAULT_RANKS, pattern: str = DEFAULT_PATTERN) -> DataFrame:
    """(doc_id, ids binary, n_tokens, round_trip): one row per row of docs, without a shuffle.

    round_trip says whether the decoded ids are the text's bytes again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            texts = b["text"].to_pylist()
            ids = [c.encode(t) for t in texts]
            same = [c.decode(x) == t.encode() for x, t in zip(ids, texts, strict=True)]
            yield pa.record_batch([b["doc_id"], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])

    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {_kind(docs, id_col)}, ids binary, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, ranks_path: str = DEFAULT_RANKS, pattern: str = DEFAULT_PATTERN) -> DataFrame:
    """(doc_id, data binary) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            yield pa.record_batch([b["doc_id"], pa.array([c.decode(x.as_py() or b"") for x in b["ids"]], pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {_kind(encoded, 'doc_id')}, data binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = DEFAULT_RANKS, pattern: str = DEFAULT_PATTERN) -> DataFrame:
    """Encode and decode in one pass over the texts; only digests leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            n, a, d = [], [], []
            for t in b["text"]:
                ids = c.encode(t.as_py())
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.record_batch([b["doc_id"], pa.array(n, pa.int64()), pa.array(a), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {_kind(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _kind(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()
