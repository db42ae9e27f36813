"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, each pair verified once.

Texts are sets of WORDS-word shingles. One pass counts shingles over all texts in a table of fixed size; its counts, ties by hash,
give every set the same rare-first order. Two sets can reach the threshold only if they share a shingle among the first
n - ceil(t n) + 1 of each. Prefix shingles are joined with the size of their set and their position, and the length and positional
filters act on these numbers alone. First all sets of a shingle's list are paired with the list's first set; of the rest, only pairs
whose sets are not connected by then and whose bits (odd cells of the hash range, a bound of what stands in only one of two sets) leave
room for the threshold, so that a group of copies costs about as many pairs as it has members; short lists are done with in one turn, and
later turns read only what the turn before left open. Distinct pairs that are left
get their texts, the hub of a star in chunks; what stands behind the shared shingle must pass the suffix filter (counts
between pivots) before the exact intersection is taken. Lists of very frequent shingles are split and their first sets paired once more.

Equal sets are one class from the start. A set with no word is linked with nothing; null text counts as empty; rows with a null id
link others like all rows and get the smallest id of their class, or null; different texts under one id are different rows; repeated
rows share their class; an empty table gives an empty table. Only doc_id and text are read, so other columns cannot clash. Hashes
have 64 bits; the words are hashed one by one and then combined.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .words import runs_of, shingles, word_hashes

WORDS, PERCENT = 5, 75
#: Counters of the shingle counts (8 bytes each on the driver and in a broadcast, whatever the input).
COUNTERS = 1 << 21
#: A shingle that occurs so many times more often than four times the mean has its list split into parts of about that many sets.
HOT = 20_000
#: Parts that the partners of a hub are dealt to; numbers that rows wanted for verification are told apart by (a broadcast of that size).
CHUNKS, MARKS = 1024, 1 << 18
PIVOTS = 32
#: Numbers of 64 bits that say which cells of the hash range hold an odd number of a set's shingles.
BITS = [f"b{k}" for k in range(8)]
#: Lists up to this length are searched for pairs within the filters before anything is written.
SPAN = 24
#: Stars are repeated while the pairs left number more than so many for each set that is left.
SPARSE = 16
#: Lists with so many entries or fewer are searched for all their pairs between components in the first turn, longer ones by turns.
SHORT = 16
#: Entries of lists that a task gathers before it sends them on; sets that it remembers; how far the parts of a split list lie apart.
BLOCK, SEEN, STEP = 1 << 17, 1 << 17, np.uint64(0x9E3779B97F4A7C15)
#: Words of all texts for each task that writes a table on the way, where that is more than two tasks for each core.
SHARE = 1 << 20
#: Entries, roughly, of the key ranges into which a bucket is cut: a task has one of them in memory at a time.
RANGE = 1 << 17


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n must share with another to reach the threshold."""
    return -(-n * percent // 100)


def needed(n: Column, m: Column, percent: int) -> Column:
    """Shingles that sets of n and m must share to reach the threshold."""
    return F.ceil((n + m) * percent / (100 + percent))


def cell(h: np.ndarray, counters: int) -> np.ndarray:
    return (h & np.uint64(counters - 1)).astype(np.int64)


def shingle_counts(docs: DataFrame, words: int = WORDS, counters: int = COUNTERS) -> np.ndarray:
    """Occurrences of shingles over all texts by hash cell; tasks send compressed parts, added up part by part."""
    parts = 32
    width = counters // parts

    def count(batches):
        total = np.zeros(counters, np.int64)
        for whole in batches:
            for batch in common.slices(whole, "text"):
                h, ends = word_hashes(batch.column("text"))
                found = runs_of(h, words)
                inside = np.ones(len(found), bool)
                for back in range(1, words):  # runs that reach into the next text
                    over = ends[1:-1] - back
                    inside[over[(over >= 0) & (over < len(found))]] = False
                np.add.at(total, cell(found[inside], counters), 1)
        blobs = [zlib.compress(total[k * width : (k + 1) * width].tobytes(), 1) for k in range(parts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(blob), np.int64)
        if total:
            blobs = [zlib.compress(x.tobytes(), 1) for x in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    rows = docs.select("text").mapInArrow(common.releasing(count), schema).repartition(parts, "part").mapInArrow(add, schema).collect()
    out = np.zeros(counters, np.int64)
    for r in rows:
        out[r["part"] * width : (r["part"] + 1) * width] += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out


def rank(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What shingles are ordered by, rare first: the count, then the hash."""
    return np.minimum(counts[cell(h, len(counts))], (1 << 24) - 1).astype(np.uint64) << np.uint64(40) | h >> np.uint64(24)


def rare_first(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The order of a set (sorted, so that equal ranks stand by hash)."""
    return np.argsort(rank(h, counts), kind="stable")


def digest(h: np.ndarray) -> int:
    """A class number: equal sets have equal ones (signed, for Spark)."""
    d = xxhash.xxh3_64_intdigest(h.tobytes())
    return d - (1 << 64) if d >= 1 << 63 else d


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def odd_cells(h: np.ndarray) -> np.ndarray:
    """BITS of a set: those of two sets differ in at most as many places as there are shingles in only one of them."""
    odd = np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=64 * len(BITS)) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def may_link(x: str, y: str, percent: int) -> Column:
    """Whether the bits of two sets leave room for the threshold."""
    n = F.col(f"{x}.n") + F.col(f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in BITS[1:]), F.bit_count(F.col(f"{x}.{BITS[0]}").bitwiseXOR(F.col(f"{y}.{BITS[0]}"))))
    return n - apart >= 2 * needed(F.col(f"{x}.n"), F.col(f"{y}.n"), percent)


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, n, set, bits) of every row."""

    def run(batches):
        for whole in batches:
            for batch in common.slices(whole, "text"):
                found = [(len(h), digest(h) if len(h) else None, odd_cells(h)) for h in shingles(batch.column("text"), words)]
                bits = np.stack([b for _, _, b in found])
                cols = [batch.column("doc_id"), batch.column("key"), pa.array([n for n, _, _ in found], pa.int32()), pa.array([d for _, d, _ in found], pa.int64()), *(pa.array(bits[:, k].copy()) for k in range(len(BITS)))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n", "set", *BITS])

    return docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(common.releasing(run), "doc_id bigint, key bigint, n int, set bigint, " + ", ".join(f"{b} bigint" for b in BITS))


def packed(key: np.ndarray, part: np.ndarray, sets: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[int, int, bytes]:
    """Entries of lists, sorted by key, as one compressed block: (entries, sets in it, block). Keys are differences, each set stands once."""
    own, first, index = np.unique(sets, return_index=True, return_inverse=True)
    columns = [np.diff(key, prepend=np.uint64(0)), part.astype(np.int32), index.astype(np.uint32), pos.astype(np.int32), own.view(np.uint64), n[first].astype(np.int32)]
    raw = b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)  # equal places of all numbers side by side
    return len(key), len(own), pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(k: int, m: int, block: bytes) -> list[np.ndarray]:
    """key, part, set, n and pos of the entries of a block."""
    raw = np.frombuffer(pa.decompress(block, decompressed_size=20 * k + 12 * m, codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for count, kind in ((k, np.uint64), (k, np.int32), (k, np.uint32), (k, np.int32), (m, np.int64), (m, np.int32)):
        size = count * np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + size].reshape(-1, count).T).view(kind).ravel())
        at += size
    key, part, index, pos, own, n = out
    return [np.cumsum(key), part, own[index], n[index], pos]


def prefixes(docs: DataFrame, counts, words: int, percent: int, buckets: int) -> DataFrame:
    """(bucket, cut, k, m, block): the prefixes of all sets, up to BLOCK entries of a task at a time cut into ranges of their keys, so many to each
    bucket that a range holds about RANGE entries, all of a list, and little more than the longest part of a list otherwise.

    A copy that the task remembers (the last SEEN sets at most) is left out before any shuffle. `part` is 0, or for the list of a very frequent shingle
    from 1 on; the key is the shingle, moved by a fixed step for each part, so that the parts of a list lie in different ranges."""

    cuts = max(1, -(-int(counts.value.sum()) * (100 - percent) // (100 * buckets * RANGE)))

    def run(batches):
        own, seen, held, kept = counts.value, set(), 0, []
        hot = 4 * float(own[own > 0].mean()) if own.any() else 0.0

        def blocks():
            key, part, sets, n, pos = (np.concatenate(x) for x in zip(*kept))
            order = np.argsort(key, kind="stable")
            key, part, sets, n, pos = (x[order] for x in (key, part, sets, n, pos))
            cut = ((key >> np.uint64(32)) * np.uint64(buckets * cuts) >> np.uint64(32)).astype(np.int64)
            edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(key)]
            rows = [(*divmod(int(cut[a]), cuts), *packed(*(x[a:b] for x in (key, part, sets, n, pos)))) for a, b in zip(edges, edges[1:])]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "cut", "k", "m", "block"])

        for whole in batches:
            for batch in common.slices(whole, "text"):
                for h in shingles(batch.column("text"), words):
                    if not len(h) or (d := digest(h)) in seen:
                        continue
                    seen.add(d)
                    head = h[rare_first(h, own)[: len(h) - least_overlap(len(h), percent) + 1]]
                    lists = np.maximum(1, np.ceil((own[cell(head, len(own))] - hot) / HOT)).astype(np.int64)
                    part = np.where(lists > 1, 1 + (d >> 7) % lists, 0)
                    kept.append((head + part.astype(np.uint64) * STEP, part.astype(np.int32), np.full(len(head), d, np.int64), np.full(len(head), len(h), np.int32), np.arange(len(head), dtype=np.int32)))
                    held += len(head)
                    if held >= BLOCK:
                        yield blocks()
                        kept.clear()
                        held = 0
                    if len(seen) >= SEEN:
                        seen.clear()
        if kept:
            yield blocks()

    return docs.select("text").mapInArrow(common.releasing(run), "bucket int, cut int, k int, m int, block binary")


def useful(first: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """Whether a row has a partner within the length and positional filters in its list; rows of lists longer than SPAN all count as useful."""
    lists = np.cumsum(first) - 1
    size = np.bincount(lists)
    ok = size[lists] > SPAN
    n, left = n.astype(np.int64), (n - pos).astype(np.int64)
    for d in range(1, min(SPAN, int(size.max()))):
        x, y = slice(None, -d), slice(d, None)
        got = (lists[x] == lists[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
        got &= np.minimum(left[x], left[y]) * (100 + percent) >= (n[x] + n[y]) * percent
        ok[x] |= got
        ok[y] |= got
    return ok


def starts(h: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Whether a list, or a part of a split one, begins at each entry."""
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
    return first


def led(blocks: list[tuple[int, int, bytes]], percent: int) -> list[np.ndarray]:
    """The columns of lists() for the blocks of one range of keys."""
    key, part, s, n, pos = (np.concatenate(x) for x in zip(*(unpacked(*b) for b in blocks)))
    h, size = (key - part.astype(np.uint64) * STEP).view(np.int64), n.astype(np.int64)
    late = size - pos < -(-2 * size * percent // (100 + percent))
    order = np.lexsort((n, s, late, part, h))
    h, part, s, n, pos, late = (x[order] for x in (h, part, s, n, pos, late))
    ok = useful(starts(h, part), n, pos, percent) | (part > 0)
    h, part, s, n, pos, late = (x[ok] for x in (h, part, s, n, pos, late))
    first = starts(h, part)
    lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(h) else np.zeros(0, np.int64)
    again = np.zeros(len(h), bool)
    again[1:] = s[1:] == s[:-1]
    kept = np.where(part > 0, first | ~again, ~first & ~again & ~late[lead])
    at = lead[kept]
    return [*(x[kept] for x in (h, part, s, n, pos)), s[at], n[at], pos[at]]


def lists(heads: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(h, part, set, n, pos, lead, lead_n, lead_pos): members of each prefix shingle's list with its first set, which is not a row itself.

    The first set is one that could pass the positional filter with a set of its own size; a list without such a set links nothing.
    What one part of a split list holds may have its partners in others, so all of it is kept, the first set as a row as well.
    A part of a list lies in one range of keys, and ranges are taken one by one: entries are unpacked, sorted and filtered in one Python worker."""
    schema = "h bigint, part int, set bigint, n int, pos int, lead bigint, lead_n int, lead_pos int"

    def run(batches):
        now, blocks = None, []
        for batch in batches:
            for cut, *block in zip(*(batch.column(c).to_pylist() for c in ("cut", "k", "m", "block"))):
                if cut != now and blocks:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in led(blocks, percent)], names=[x.split()[0] for x in schema.split(", ")])
                    blocks.clear()
                now = cut
                blocks.append(block)
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in led(blocks, percent)], names=[x.split()[0] for x in schema.split(", ")])

    rows = heads.repartitionById(buckets, "bucket").sortWithinPartitions("cut").select("cut", "k", "m", "block")
    return rows.mapInArrow(common.releasing(run), schema)


def near(n: Column, pos: Column, m: Column, at: Column, percent: int) -> Column:
    """Length and positional filters of sets of n and m whose first shared shingle stands at pos and at."""
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(n - pos, m - at) >= needed(n, m, percent))


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """(hub, other, at, to): each pair once, with the places of the first shared shingle that was met."""
    return pairs.groupBy("hub", "other").agg(F.min(F.struct("at", "to")).alias("x")).select("hub", "other", "x.at", "x.to")


def stars(members: DataFrame, leads: DataFrame, percent: int) -> DataFrame:
    """Pairs of each list's first set with the others, and of the first sets of the parts of a split list with one of them."""
    star = members.where(near(*(F.col(c) for c in ("lead_n", "lead_pos", "n", "pos")), percent)).select(F.col("lead").alias("hub"), F.col("set").alias("other"), F.col("lead_pos").alias("at"), F.col("pos").alias("to"))
    split = leads.where("part > 0")
    top = split.groupBy("h").agg(F.min(F.struct("set", "n", "pos")).alias("top"))
    ends = [F.col(c) for c in ("top.n", "top.pos", "n", "pos")]
    more = split.join(top, "h").where(F.col("set") != F.col("top.set")).where(near(*ends, percent)).select(F.col("top.set").alias("hub"), F.col("set").alias("other"), F.col("top.pos").alias("at"), F.col("pos").alias("to"))
    return distinct_pairs(star.union(more))


def open_lists(every: DataFrame, roots: DataFrame, files: int) -> DataFrame:
    """(h, set, n, pos, bits, c, main, m): members of the m entries of lists whose sets lie in several components c, `main` being the largest there."""
    every = every.join(roots, F.col("set") == F.col("node"), "left").withColumn("c", F.coalesce("root", "set")).drop("node", "root")
    every = common.written_few(every, "entries", files)
    several = every.groupBy("h", "c").agg(F.count("*").alias("k")).groupBy("h").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.sum("k").alias("m"), F.count("*").alias("cs")).where("cs > 1").drop("cs")
    return every.join(several, "h")


def fresh(found: DataFrame, done: list[DataFrame], files: int) -> DataFrame:
    """Distinct pairs of `found` that were not verified before."""
    lo, hi = F.least("hub", "other").alias("lo"), F.greatest("hub", "other").alias("hi")
    out = found.groupBy(lo, hi).agg(F.min(F.struct("hub", "other", "at", "to")).alias("x")).select("lo", "hi", "x.*")
    for d in done:
        out = out.join(d.select(lo, hi), ["lo", "hi"], "left_anti")
    return common.written_few(out.drop("lo", "hi"), "pairs", files)


def more_stars(left: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each set outside its list's main component with three sets of that, and with one of the others."""
    one = F.struct("set", "n", "pos", *BITS)
    salted = [F.xxhash64("set", F.lit(3 * turn + k)) for k in range(4)]
    inside = F.col("c") == F.col("main")
    heads = left.groupBy("h").agg(*(F.min_by(F.when(inside, one), F.when(inside, salted[k])).alias(f"y{k}") for k in range(3)), F.min_by(F.when(~inside, one), F.when(~inside, salted[3])).alias("y3"))
    pairs = left.where(~inside).join(heads, "h").select(one.alias("x"), F.explode(F.array(*(f"y{k}" for k in range(4)))).alias("y"))
    pairs = pairs.where((F.col("x.set") != F.col("y.set")) & near(*(F.col(c) for c in ("y.n", "y.pos", "x.n", "x.pos")), percent) & may_link("x", "y", percent))
    return pairs.select(F.col("y.set").alias("hub"), F.col("x.set").alias("other"), F.col("y.pos").alias("at"), F.col("x.pos").alias("to"))


def rest(left: DataFrame, percent: int) -> DataFrame:
    """Whatever is not in its list's main component, with all of the list outside its own."""
    x, y = left.where("c <> main").alias("x"), left.alias("y")
    both = (F.col("x.h") == F.col("y.h")) & (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.main")) | (F.col("x.set") < F.col("y.set")))
    ends = [F.col(c) for c in ("x.n", "x.pos", "y.n", "y.pos")]
    return x.join(y, both & near(*ends, percent) & may_link("x", "y", percent)).select(F.col("x.set").alias("hub"), F.col("y.set").alias("other"), F.col("x.pos").alias("at"), F.col("y.pos").alias("to"))


def may_overlap(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """Suffix filter: whether ordered suffixes can share `least` shingles by their counts between pivots of one of them."""
    if not len(a) or not len(b):
        return least <= 0
    pivots = b[:: max(1, len(b) // PIVOTS)]
    x, y = (np.diff(np.concatenate([[0], np.searchsorted(s, pivots), [len(s)]])) for s in (a, b))
    return int(np.minimum(x, y).sum()) >= least


def linked(a: np.ndarray, b: np.ndarray, at: int, to: int, counts: np.ndarray, percent: int) -> bool:
    """Whether two sets that share the shingle at these places of their orders reach the threshold.

    It need not be the first one that they share, as a pair may come from some of its lists only: what stands before may be shared too."""
    need = -(-(len(a) + len(b)) * percent // (100 + percent))
    if not may_overlap(np.sort(rank(a, counts))[at + 1 :], np.sort(rank(b, counts))[to + 1 :], need - 1 - min(at, to)):
        return False
    small, big = (a, b) if len(a) <= len(b) else (b, a)
    both = int((big[np.minimum(np.searchsorted(big, small), len(big) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, counts, words: int, percent: int, files: int) -> DataFrame:
    """Those of the distinct pairs (hub, other, at, to) that are links (a, b), by their texts."""
    none = F.lit(None).cast("int")
    dealt = pairs.withColumn("chunk", F.pmod(F.xxhash64("other"), F.lit(CHUNKS)).cast("int"))
    hubs = dealt.select("hub", "chunk").distinct().select("hub", "chunk", F.col("hub").alias("set"), none.alias("at"), none.alias("to"))
    asked = hubs.union(dealt.select("hub", "chunk", "other", "at", "to")).join(classes.select("set", "rep"), "set")
    asked = common.written_few(asked, "asked", files)
    mark = lambda c: F.pmod(F.col(c), F.lit(MARKS)).cast("int")
    marks = asked.select(mark("rep.key").alias("mark")).distinct()  # MARKS rows at most
    texts = docs.select("doc_id", row_key().alias("key"), "text").join(F.broadcast(marks), mark("key") == F.col("mark"), "left_semi")
    sent = (
        asked.join(texts, F.col("rep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("rep.key") == F.col("key")))
        .select("hub", "chunk", "set", "at", "to", "text")
        .repartition("hub", "chunk")
        .sortWithinPartitions("hub", "chunk", F.col("at").asc_nulls_first(), "set")
    )

    def run(batches):
        own, now, hub, last = counts.value, None, None, None
        for whole in batches:
            for batch in common.slices(whole, "text"):
                found = []
                rows = zip(*(batch.column(c).to_pylist() for c in ("hub", "chunk", "set", "at", "to")), shingles(batch.column("text"), words))
                for a, chunk, s, at, to, h in rows:
                    if at is None:
                        now, hub = (a, chunk), h
                    elif (a, chunk, s) != last and now == (a, chunk) and linked(hub, h, at, to, own, percent):
                        found.append((a, s))
                    last = (a, chunk, s)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return common.written_few(sent.mapInArrow(common.releasing(run), "a bigint, b bigint"), "verified", files)


def classified(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, int]:
    """(doc_id, key, n, root) for every row, written: root is a number of its component, null where there are no words; the files of a table."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, words))  # COUNTERS numbers
    files = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-int(counts.value.sum()) // SHARE))
    rows = common.written_few(sets_of(docs, words), "sets", files)
    classes = common.written_few(rows.where("set is not null").groupBy("set").agg(F.min(F.struct("doc_id", "key")).alias("rep"), *(F.min(b).alias(b) for b in BITS)), "classes", files)
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = common.written_few(lists(prefixes(docs, counts, words, percent, buckets), percent, buckets), "lists", files)
    leads = whole.select("h", "part", F.col("lead").alias("set"), F.col("lead_n").alias("n"), F.col("lead_pos").alias("pos")).distinct()
    members = whole.where("set <> lead")
    done = [common.written_few(stars(members, leads, percent), "pairs", files)]
    links = verified(docs, classes, done[0], counts, words, percent, files)
    roots, last = components(links, files), None
    every = members.select("h", "set", "n", "pos").union(leads.select("h", "set", "n", "pos"))
    left = common.written_few(open_lists(every, roots, files).join(classes.select("set", *BITS), "set"), "entries", files)
    found, left = rest(left.where(F.col("m") <= SHORT), percent), left.where(F.col("m") > SHORT)
    while True:
        n, pairs = left.groupBy("h").agg(F.count_if(F.col("c") != F.col("main")).alias("k"), F.count("*").alias("m")).agg(F.sum("k"), F.sum(F.col("k") * F.col("m"))).first()
        last_turn = not n or pairs <= SPARSE * n or (last is not None and n > 0.8 * last)
        if n:
            more = rest(left, percent) if last_turn else more_stars(left, percent, len(done))
            found = more if found is None else found.union(more)
        if found is None:
            break
        done.append(fresh(found, done, files))
        links = links.union(verified(docs, classes, done[-1], counts, words, percent, files))
        roots, last, found = components(links, files), n, None
        if last_turn:
            break
        left = common.written_few(open_lists(left.select("h", "set", "n", "pos", *BITS), roots, files), "entries", files)
    roots = common.written_few(roots, "roots", files)
    full = rows.join(roots, F.col("set") == F.col("node"), "left").select("doc_id", "key", F.col("n").cast("bigint").alias("n"), F.coalesce("root", "set").alias("root"))
    return common.written_few(full, "rows", files), files


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    full, files = classified(docs, words, percent)
    least = common.written_few(full.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least", files)
    some = full.where("root is not null").join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return some.union(full.where("root is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))).coalesce(files)


def keep_one(docs: DataFrame) -> DataFrame:
    """All columns of one row of each component, the one of smallest id (null last), then of smallest hash of its row.

    Repeated rows count as one; rows without words stay, each different one once."""
    whole = F.xxhash64(*(F.to_json(c) if docs.schema[c].dataType.typeName() in ("map", "variant") else F.col(f"`{c}`") for c in docs.columns))
    rows, files = classified(docs)
    named = docs.select("doc_id", row_key().alias("key"), whole.alias("row")).groupBy("doc_id", "key", "row").agg(F.count("*").alias("times"))
    every = rows.select("doc_id", "key", "root").distinct().alias("r").join(named.alias("d"), F.col("r.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("r.key") == F.col("d.key")))
    first = F.min(F.struct(F.col("d.doc_id").isNull().alias("none"), F.col("d.doc_id").alias("id"), F.col("d.row").alias("row"), F.col("d.times").alias("times")))
    kept = every.where("root is not null").groupBy("root").agg(first.alias("x")).select("x.id", "x.row", "x.times").union(every.where("root is null").select("d.doc_id", "d.row", "d.times"))
    kept = common.written_few(kept, "kept", files)
    held = docs.withColumn("__row", whole)
    of = lambda k: held.join(k, held["doc_id"].eqNullSafe(k["id"]) & (held["__row"] == k["row"]), "left_semi")
    # Only rows that are repeated have to meet; the texts of others stay where they are read.
    return of(kept.where("times = 1")).unionByName(of(kept.where("times > 1")).dropDuplicates(["doc_id", "__row"])).drop("__row").coalesce(files)


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), one AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS k FROM one a JOIN one b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * k >= 75 * (nx + ny - k) UNION ALL SELECT y, x FROM pairs WHERE 100 * k >= 75 * (nx + ny - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (SELECT min(y) FROM reach r WHERE r.x = s.doc_id) AS component_id FROM sets s
"""
