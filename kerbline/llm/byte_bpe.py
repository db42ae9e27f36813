"""Byte-level BPE: a minimal perfect hash over the vocabulary, then a heap over linked bytes for what it misses.

Tier one resolves a pre-token that is itself a vocabulary entry. Tier two merges the lowest rank first
over a doubly linked list of byte positions. Texts are cut at spaces, and what stands between
them is remembered with its ids, so only new parts meet the pattern. Input texts may be null or empty (no ids), of any length
(one pre-token of n bytes costs n log n); repeated rows are encoded each for itself and an empty table
gives an empty table. Other columns of the input pass through unless they bear the name of the result.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Callable
from itertools import filterfalse

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens, and parts between spaces, in each of the two generations that a worker remembers.
REMEMBERED = 120_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PerfectHash:
    """Minimal perfect hash by levels of bit arrays: a key stays on the first level where its bit is its own; its
    number is the count of set bits before it (Limasset et al., 2017)."""

    def __init__(self, keys: list[bytes]):
        hashes = [xxhash.xxh3_128_intdigest(k) for k in keys]
        low, high = (np.array([h >> s & 0xFFFFFFFFFFFF for h in hashes], np.int64) for s in (0, 64))
        left, self.levels, numbers, taken = np.arange(len(keys)), [], [], 0
        while len(left):
            size = 2 * len(left) + 1
            bit = (low[left] + (len(self.levels) + 1) * high[left]) % size
            alone = np.bincount(bit, minlength=size) == 1
            number = np.where(alone, taken + np.cumsum(alone) - 1, -1)
            self.levels.append((size, number.tolist(), number))
            mine = alone[bit]
            numbers.append((number[bit[mine]], left[mine]))
            left, taken = left[~mine], taken + int(alone.sum())
        self.order = np.empty(len(keys), np.int64)
        for at, which in numbers:
            self.order[at] = which
        self.keys = [keys[i] for i in self.order.tolist()]

    def find(self, key: bytes) -> int:
        """The key's place in the list given, or -1."""
        h = xxhash.xxh3_128_intdigest(key)
        at, step = h & 0xFFFFFFFFFFFF, h >> 64 & 0xFFFFFFFFFFFF
        for size, number, _ in self.levels:
            at += step
            if (i := number[at % size]) >= 0:
                return int(self.order[i]) if self.keys[i] == key else -1
        return -1


    def find_all(self, keys: list[bytes]) -> list[int]:
        """What find() gives for each of the keys."""
        step, at = (np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2).T & np.uint64(0xFFFFFFFFFFFF)).astype(np.int64)
        found, left = np.full(len(keys), -1), np.arange(len(keys))
        for size, _, number in self.levels:
            at = at + step
            got = number[at % size]
            found[left[got >= 0]] = got[got >= 0]
            left, at, step = (x[got < 0] for x in (left, at, step))
        own = self.keys
        return [o if i >= 0 and own[i] == k else -1 for k, i, o in zip(keys, found.tolist(), self.order[found].tolist())]


def pairs_of(rank: dict[bytes, int]) -> list[int]:
    """The rank of every two bytes, -1 without one, by first * 256 + second."""
    return [rank.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]


def merge(piece: bytes, rank: dict[bytes, int], pairs: list[int]) -> list[int]:
    """Ids of a piece: join the leftmost adjacent pair of lowest rank until no pair has one.

    `end[i]` is where the part that begins at byte i ends, and so where its neighbour begins; 0 once it was joined. `now[i]` is the rank
    of the part and its neighbour, which tells a pair on the heap that has changed meanwhile: pairs only get longer, so no rank comes again.
    """
    n, get, push, pop = len(piece), rank.get, heapq.heappush, heapq.heappop
    now = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]
    heap = [r * n + i for i, r in enumerate(now) if r >= 0]
    end, before = list(range(1, n + 1)), list(range(-1, n))
    heapq.heapify(heap)
    while heap:
        r, i = divmod(pop(heap), n)
        if now[i] != r:
            continue
        j = end[i]
        end[i] = k = end[j]
        end[j], before[k], now[j if k < n else i] = 0, i, -1
        if k < n:
            now[i] = r = get(piece[i : end[k]], -1)
            if r >= 0:
                push(heap, r * n + i)
        if (p := before[i]) >= 0:
            now[p] = r = get(piece[p:k], -1)
            if r >= 0:
                push(heap, r * n + p)
    return [rank[piece[i:e]] for i, e in enumerate(end) if e]


class Pieces(common.Recent):
    """Pre-token to the int32 bytes of its ids, the last ones remembered; what is missing goes through the two tiers."""

    def __init__(self, rank: dict[bytes, int]):
        super().__init__(self.tiers, REMEMBERED)
        self.rank, self.pairs, keys = rank, pairs_of(rank), list(rank)
        self.hash, self.ids = PerfectHash(keys), [rank[k] for k in keys]

    def tiers(self, piece: str) -> bytes:
        raw = piece.encode()
        i = self.hash.find(raw)
        return array("i", (self.ids[i],) if i >= 0 else merge(raw, self.rank, self.pairs)).tobytes()

    def __missing__(self, piece: str) -> bytes:
        return super().__missing__(piece) if len(piece) < 100 else self.tiers(piece)


class Parts(common.Recent):
    """What stands behind a space, up to the next one, to the int32 bytes of the ids of both."""

    #: A word, signs behind it: with the space before it, a pre-token each.
    WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+)([!-/:-@\[-`{-~]*)").fullmatch

    def __init__(self, pieces: Pieces, cut: Callable[[str], list[str]]):
        super().__init__(self.tiers, REMEMBERED)
        self.pieces, self.cut = pieces, cut

    def tiers(self, part: str) -> bytes:
        first, *more = self.cut(" " + part)
        return self[first[1:]] + b"".join(map(self.pieces.__getitem__, more)) if more else self.pieces.tiers(first)

    def __missing__(self, part: str) -> bytes:
        return super().__missing__(part) if len(part) < 100 else self.tiers(part)

    def fill(self, parts: set[str]) -> None:
        """Learn words that are not remembered, many at a time; other parts are cut by the pattern when they are asked for."""
        self.room(len(parts))
        older, words, signed = self.older, set(), []
        for p in parts:
            if (got := older.get(p)) is not None:
                self[p] = got
            elif len(p) < 100 and (m := self.WORD(p)):
                word, signs = m.groups()
                words.add(word)
                if signs:
                    signed.append((p, word, signs))
        words = [w for w in words if w not in self]
        raw, own = [b" " + w.encode() for w in words], self.pieces
        for w, k, i in zip(words, raw, own.hash.find_all(raw)):
            self[w] = older.get(w) or array("i", (own.ids[i],) if i >= 0 else merge(k, own.rank, own.pairs)).tobytes()
        for p, word, signs in signed:
            self[p] = self[word] + own[signs]


class Codec:
    #: A space amid white space or behind it at the end: there, a pre-token may hold it behind other signs.
    AMID = re.compile(r"\s (?!\S)").search

    def __init__(self, path: str, pattern: str):
        self.pieces, self.cut = Pieces(read_ranks(path)), regex.compile(pattern).findall
        self.parts = Parts(self.pieces, self.cut) if pattern == public_tokenizers.PATTERN else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """By public_tokenizers.PATTERN a pre-token begins at every space that is not AMID, so texts are cut at spaces before the pattern is asked."""
        out, at = [], 0
        while at < len(texts):
            cut, new = [], set()
            while at < len(texts) and len(cut) < 200 and len(new) < REMEMBERED // 8:
                first, *more = [texts[at]] if self.parts is None or self.AMID(texts[at]) else texts[at].split(" ")
                if more:
                    new.update(filterfalse(self.parts.__contains__, more))
                cut.append((first, more))
                at += 1
            if new:
                self.parts.fill(new)
            for first, more in cut:
                ids = [*map(self.pieces.__getitem__, self.cut(first)), *(map(self.parts.__getitem__, more) if more else ())]
                out.append(np.frombuffer(b"".join(ids), np.int32))
        return out


def tokens_of(path: str) -> pa.Array:
    """The bytes of every id; ids that the vocabulary lacks have none."""
    rank = read_ranks(path)
    tokens = [b""] * (max(rank.values()) + 1)
    for k, v in rank.items():
        tokens[v] = k
    return pa.array(tokens, pa.binary())


def decoded(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The bytes that each row's ids stand for end to end; none for null."""
    found = tokens.take(ids.flatten())
    ends = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1) if len(found) else np.zeros(1, np.int32)
    rows = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends[rows].astype(np.int32)), found.buffers()[2] or pa.py_buffer(b"")])


def codec(path: str, pattern: str) -> Codec:
    return common.lasting(__name__, Codec, path, pattern)


def encoded(texts: pa.Array, own: Codec) -> pa.ListArray:
    """The ids of each text."""
    found = own.encode(common.texts_of(texts))
    return common.lists(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """`df` without `text`, with array<int> `out`; null text counts as empty and gives an empty array."""
    path = path or public_tokenizers.path(VOCABULARY)
    kept = [c for c in df.columns if c not in (text, out)]
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept) + f"`{out}` array<int>"

    def make():
        own = codec(path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = encoded(batch.column(text), own)
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), ids], names=[*kept, out])

        return step

    return common.map_batches(df.select(*(f"`{c}`" for c in kept), text), text, make, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """`df` with binary `out`, the bytes that the ids stand for; null ids give no bytes."""
    path = path or public_tokenizers.path(VOCABULARY)
    kept = [c for c in df.columns if c != out]
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept) + f"`{out}` binary"

    def run(batches):
        tokens = common.lasting(__name__, tokens_of, path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), decoded(batch.column(ids), tokens)], names=[*kept, out])

    return df.select(*(f"`{c}`" for c in kept)).mapInArrow(common.releasing(run), schema)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))


def digests(docs: DataFrame) -> DataFrame:
    """Encode, decode the ids again, and give counts and digests of both; a task does so in one Python worker, not two at a time."""
    path = public_tokenizers.path(VOCABULARY)

    def make():
        own, tokens = codec(path, public_tokenizers.PATTERN), common.lasting(__name__, tokens_of, path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = encoded(batch.column("text"), own)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, decoded(ids, tokens)], names=["doc_id", "ids", "decoded"])

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    done = common.map_batches(docs.select("doc_id", "text"), "text", make, f"doc_id {kind}, ids array<int>, decoded binary")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
