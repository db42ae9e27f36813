"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Items are put into classes of like length; a window of that many words slides over every text, and running sums over its
word shingles give BITS-bit SimHash fingerprints. Fingerprints are cut into 16-bit blocks; a fingerprint within RADIUS of an item's
differs in some block by at most RADIUS // blocks bits, and each block has a table of the items that near, so all within the radius
are found. Around those windows every alignment of the item's own length is compared: the weighted Jaccard similarity of the
shingles, each weighing as often as it occurs, must reach PERCENT.

Items go through in groups of ITEMS, a broadcast each, so that a benchmark of any size is searched whole. Null and empty texts and
items match nothing; items under five words are one shingle; long texts are cut into overlapping parts; repeated items and rows
match each for itself; an empty benchmark or table gives an empty result. Rows with null ids are searched like others.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import mixed, runs_of, word_hashes

WORDS, PERCENT, BITS, RADIUS, RATIO, STEPS = 5, 75, 128, 35, 1.15, 6
ITEMS, PART = 2048, 16_000
_BLOCKS = BITS // 16
_SALT = np.uint64(0x5851F42D4C957F2D)


#: +1 or -1 for each bit of a byte.
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int16) * 2 - 1


def sums_of(shingles: np.ndarray, kind: type = np.int16) -> np.ndarray:
    """Running sums of +1 or -1 for each bit of each shingle's hash: a row more than there are shingles. They may wrap around:
    only differences of rows less than half the type's range apart are used."""
    n, rows = len(shingles), 32
    wide = np.zeros((-(-n // rows) * rows, 2), np.uint64)
    wide[:n, 0], wide[:n, 1] = shingles, mixed(shingles + _SALT)
    a = _SIGNS.astype(kind, copy=False).take(wide.view(np.uint8), 0).reshape(-1, rows, BITS)
    for j in range(1, rows):  # in steps over many short runs: much faster than one long running sum
        a[:, j] += a[:, j - 1]
    a[1:] += np.cumsum(a[:-1, -1], 0, dtype=kind)[:, None]
    return np.concatenate([np.zeros((1, BITS), kind), a.reshape(-1, BITS)[:n]])


def fingerprints(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """BITS / 64 numbers for each pair of rows of running sums."""
    return np.packbits((after - before > 0).reshape(-1)).view(np.uint64).reshape(-1, BITS // 64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(a[:, k] ^ b[:, k]) for k in range(BITS // 64))


def near_values(value: int, radius: int) -> np.ndarray:
    """All 16-bit numbers within `radius` bits."""
    all_ = np.arange(1 << 16, dtype=np.uint16)
    return np.flatnonzero(np.bitwise_count(all_ ^ np.uint16(value)) <= radius)


class Index:
    """Items of one group, by class of length."""

    def __init__(self, items: list[tuple[int, str]]):
        self.classes: dict[tuple[int, int], list] = {}
        self.items = []
        self.kind = np.int16
        for item, text in items:
            h = word_hashes(pa.array([text]))[0]
            if not len(h):
                continue
            k = min(WORDS, len(h))
            sh = runs_of(h, k)
            length = len(h) if len(h) <= 2 * WORDS else round(2 * WORDS * RATIO ** round(np.log(len(h) / (2 * WORDS)) / np.log(RATIO)))
            sums = sums_of(sh, np.int32)
            self.classes.setdefault((length, k), []).append((len(self.items), fingerprints(sums[:1], sums[-1:])[0]))
            if length > 32_000:
                self.kind = np.int32
            self.items.append((item, len(h), k, Counter(sh.tolist())))
        self.tables = {}
        for key, own in self.classes.items():
            prints = np.stack([p for _, p in own])
            values = prints.view(np.uint16).reshape(len(own), _BLOCKS)
            words = -(-len(own) // 8)
            table = np.zeros((_BLOCKS, 1 << 16, words), np.uint8)
            for i in range(len(own)):
                for b in range(_BLOCKS):
                    table[b, near_values(int(values[i, b]), RADIUS // _BLOCKS), i // 8] |= 1 << i % 8
            self.tables[key] = (np.array([i for i, _ in own]), prints, table)
        self.longest = max([0, *(n for _, n, _, _ in self.items), *(k[0] for k in self.classes)])

    def hits(self, hashes: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first word, slack) for windows within the radius, over texts laid end to end; doc numbers the text of each word."""
        out, n = [], len(hashes)
        last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) if n else np.zeros(0, int)
        first = np.concatenate([[0], last[:-1] + 1]) if n else last
        sums: dict[int, np.ndarray] = {}
        for (length, k), (which, prints, table) in self.tables.items():
            if k not in sums:
                sums[k] = sums_of(runs_of(hashes, k), self.kind)
            prefix, step = sums[k], max(1, length // STEPS)
            slid = n - length + 1
            parts = []
            if slid > 0:
                starts = np.arange(0, slid, step)
                inside = doc[starts] == doc[starts + length - 1]
                parts.append((starts[inside], fingerprints(prefix[0:slid:step], prefix[length - k + 1 : slid + length - k + 1 : step])[inside]))
            fits = last - length + 1 >= first  # besides, the first and the last window of each text
            short = ~fits & (last - first + 1 >= max(k, length * PERCENT // 100 - 1))  # and shorter texts as a whole
            for starts, stops in ((first[fits], first[fits] + length), (last[fits] - length + 1, last[fits] + 1), (first[short], last[short] + 1)):
                if len(starts):
                    parts.append((starts, fingerprints(prefix[starts], prefix[stops - k + 1])))
            for starts, got in parts:
                values = got.view(np.uint16).reshape(len(got), _BLOCKS)
                near = table[0].take(values[:, 0], 0)
                for b in range(1, _BLOCKS):
                    near |= table[b].take(values[:, b], 0)
                at, i = np.divmod(np.flatnonzero(np.unpackbits(near.reshape(-1), bitorder="little").view(bool)), near.shape[1] * 8)
                close = distance(got[at], prints[i]) <= RADIUS
                out += [(int(j), int(x), step + abs(length - self.items[j][1]) + 1) for j, x in zip(which[i[close]].tolist(), starts[at[close]].tolist())]
        return out

    def search(self, hashes: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(text number, item id, similarity, first word, words): the best place of each item in each text, laid end to end;
        of equally similar ones the one with the smallest start."""
        n, best = len(hashes), {}
        tried: dict[int, set[int]] = {}
        own: dict[int, list[int]] = {}
        for i, at, slack in self.hits(hashes, doc):
            item, length, k, weights = self.items[i]
            if k not in own:
                own[k] = runs_of(hashes, k).tolist()
            d, done, seen = int(doc[at]), tried.setdefault(i, set()), own[k]
            lo, hi = int(np.searchsorted(doc, d)), int(np.searchsorted(doc, d, "right"))
            for s in range(max(lo, at - slack), max(lo, min(at + slack, hi - length)) + 1):
                if s in done:
                    continue
                done.add(s)
                have = Counter(seen[s : min(s + length, hi) - k + 1])
                both = (have & weights).total()
                every = have.total() + weights.total() - both
                if 100 * both >= PERCENT * every and both:
                    key = (d, i)
                    old = best.get(key, (0.0, 0))
                    if (both / every, lo - s) > (old[0], -old[1]):
                        best[key] = (both / every, s - lo, min(length, hi - s))
        return [(d, self.items[i][0], *v) for (d, i), v in best.items()]


def search_texts(index: Index, texts: pa.Array) -> list[tuple[int, int, float, int, int]]:
    """As Index.search, for any texts: short ones together, long ones in overlapping parts."""
    out: dict[tuple[int, int], tuple] = {}
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            doc = np.repeat(np.arange(len(held)), [len(h) for _, _, h in held])
            for d, item, sim, at, words in index.search(np.concatenate([h for _, _, h in held]), doc):
                text, base, _ = held[d]
                old = out.get((text, item), (0.0, 0))
                if (sim, -base - at) > (old[0], -old[1]):
                    out[text, item] = (sim, base + at, words)
        held.clear()
        size = 0

    lap = 2 * index.longest
    every, ends = word_hashes(texts)
    for i in range(len(texts)):
        h = every[ends[i] : ends[i + 1]]
        for base in range(0, len(h), PART):
            part = h[base : base + PART + lap]
            if size + len(part) > PART + lap:
                flush()
            held.append((i, base, part))
            size += len(part)
    flush()
    return [(i, item, *v) for (i, item), v in sorted(out.items())]


def indexes(benchmark: DataFrame):
    """Broadcasts of (a name of its own, at most ITEMS items)."""
    context, held = benchmark.sparkSession.sparkContext, []
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        if len(held) == ITEMS:
            yield context.broadcast((uuid.uuid4().hex, held))
            held = []
    if held:
        yield context.broadcast((uuid.uuid4().hex, held))


def built(items) -> Index:
    """The index of a broadcast, made once in each Python worker."""
    key, held = items.value
    kept = common.lasting(__name__, dict)  # one at a time
    if key not in kept:
        kept.clear()
        kept[key] = Index(held)
    return kept[key]


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best place of every item found in every text."""
    schema = "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint"

    def of(items) -> DataFrame:
        def make():
            index = built(items)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[i], *rest) for i, *rest in search_texts(index, batch.column("text"))]
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[x.split()[0] for x in schema.split(", ")])

            return step

        return common.map_batches(docs.select("doc_id", "text"), "text", make, schema)

    out = None
    for items in indexes(benchmark):
        out = of(items) if out is None else out.union(of(items))
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def holds_none(items):
    """A column function: whether a text holds no item of the group."""

    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        index, kept = built(items), np.ones(len(text), bool)
        for at, part in common.parts(text):
            kept[[at + i for i, *_ in search_texts(index, part)]] = False
        common.release()
        return pa.array(kept)

    return clean


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item; only texts go to Python."""
    for items in indexes(benchmark):
        docs = docs.where(holds_none(items)("text"))
    return docs


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
