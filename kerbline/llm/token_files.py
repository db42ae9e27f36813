"""Token ids in patched frame-of-reference blocks.

Documents are ordered by id (null first, then text) over range partitions; each partition writes segments of whole documents.
A segment is a binary image (counts, block table with starts, exceptions, blocks of 512 ids); its documents and where they end stand
in list columns beside it. Block starts let a reader unpack only the blocks that a document lies in. A block keeps its minimum and packs
the differences at the width that a percentile of them needs; the larger ones stand in a list of exceptions. Segments lie in
one column of a Parquet table, so any file system that Spark writes will do and a lost executor's attempt leaves nothing behind.
Null and empty texts hold only the end id; a long text is a segment of its own; repeated rows follow each other; an empty table
gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY, END = "word_bpe_49k.json", 2
BLOCK, SEGMENT, PERCENTILE = 512, 1 << 16, 90
#: Parts that a worker remembers as frequent, and as met once.
REMEMBERED = 200_000


def widths_of(sorted_: np.ndarray, percentile: int) -> np.ndarray:
    """Bits that each row's percentile needs (rows are sorted)."""
    at = sorted_[:, (sorted_.shape[1] - 1) * percentile // 100].astype(np.float64)
    return np.ceil(np.log2(at + 1)).astype(np.uint8)


def to_bits(values: np.ndarray, w: int) -> np.ndarray:
    """Rows of numbers below 2^w, w <= 16, end to end in bits, lowest first: eight numbers make w bytes."""
    v = values.reshape(-1, 2, 4).astype(np.uint64) << (np.arange(4, dtype=np.uint64) * np.uint64(w))
    a, b = (v[:, k, 0] | v[:, k, 1] | v[:, k, 2] | v[:, k, 3] for k in (0, 1))
    both = np.stack([a | b << np.uint64(4 * w), b >> np.uint64(64 - 4 * w)] if w < 16 else [a, b], 1).astype("<u8")
    return np.ascontiguousarray(both.view(np.uint8)[:, :w]).reshape(len(values), -1)


def from_bits(raw: np.ndarray, w: int) -> np.ndarray:
    """The rows that to_bits() packed."""
    both = np.zeros((raw.size // w, 16), np.uint8)
    both[:, :w] = raw.reshape(-1, w)
    low, high = both.view("<u8").T
    mask, step = np.uint64((1 << 4 * w) - 1), np.arange(4, dtype=np.uint64) * np.uint64(w)
    halves = np.stack([low & mask, (low >> np.uint64(4 * w) | high << np.uint64(64 - 4 * w)) & mask] if w < 16 else [low, high], 1)
    return (halves[:, :, None] >> step & np.uint64((1 << w) - 1)).astype(np.uint32).reshape(len(raw), -1)


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """The image of non-negative int32 ids: counts, block table (minimum, width, exceptions, start), then the blocks."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1] if n else 0, np.int64)
    padded[:n] = ids
    rows = padded.reshape(blocks, BLOCK)
    low = rows.min(1) if blocks else np.zeros(0, np.int64)
    diff = (rows - low[:, None]).astype(np.uint32)
    width = widths_of(np.sort(diff, 1), percentile) if blocks else np.zeros(0, np.uint8)
    over = diff >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    count = over.sum(1).astype(np.uint16)
    r, c = np.nonzero(over)
    extra = diff[r, c]
    diff[r, c] = 0
    sizes = width.astype(np.int64) * BLOCK // 8
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        if 0 < w <= 16:
            rows_ = to_bits(diff[mine], int(w))
        else:
            rows_ = np.packbits((diff[mine][:, :, None] >> np.arange(w, dtype=np.uint32) & 1).astype(np.uint8).reshape(len(mine), -1), axis=1, bitorder="little")
        for k, row in zip(mine, rows_):
            packed[k] = row.tobytes()
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.uint32) if blocks else np.zeros(0, np.uint32)
    head = np.array([n, blocks, len(extra)], np.uint32).tobytes()
    table = low.astype(np.uint32).tobytes() + width.tobytes() + count.tobytes() + starts.tobytes()
    return head + table + c.astype(np.uint16).tobytes() + extra.astype(np.uint32).tobytes() + b"".join(packed)


def unpack(image: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids from `first` to before `last` (all), read from the blocks that hold them."""
    n, blocks, extras = np.frombuffer(image, np.uint32, 3).tolist()
    at = 12

    def take(kind: type, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(image, kind, count, at)
        at += got.nbytes
        return got

    low, width, count, starts = take(np.uint32, blocks), take(np.uint8, blocks), take(np.uint16, blocks), take(np.uint32, blocks)
    place, extra = take(np.uint16, extras), take(np.uint32, extras)
    body = np.frombuffer(image, np.uint8, offset=at)
    last = n if last is None else min(last, n)
    a, b = first // BLOCK, -(-last // BLOCK)
    before = np.concatenate([[0], np.cumsum(count, dtype=np.int64)]).tolist()
    low, width, count, starts, some = low[a:b], width[a:b], count[a:b], starts[a:b], slice(before[a], before[max(a, b)])
    diff = np.zeros((len(low), BLOCK), np.uint32)
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        if w:
            raw = body[starts[mine].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 8)]
            if w <= 16:
                diff[mine] = from_bits(raw, int(w))
                continue
            bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(mine), BLOCK, int(w)).astype(np.uint32)
            diff[mine] = (bits << np.arange(w, dtype=np.uint32)).sum(2, dtype=np.uint32)
    diff[np.repeat(np.arange(len(low)), count), place[some]] = extra[some]
    return (diff + low[:, None]).reshape(-1)[first - a * BLOCK : last - a * BLOCK].astype(np.int32)


class Words(common.Recent):
    """Parts between spaces to the bytes of their ids; the tokenizer takes no token across a space.

    Most texts hold only printable ASCII and Latin letters that stay as they are when normalised. Those are put in lower case, and single
    signs behind words set apart, as the tokenizer does; parts that are not remembered are cut into its pieces here, and new pieces
    go through its merges. Other parts, such as those of another script or with special tokens, go through the whole tokenizer.
    Only parts met again are looked up for each text; those met once wait in `older`, so that the table of frequent ones stays small.
    """

    LETTERS = "A-Za-z" + "".join(chr(c) for c in range(0xC0, 0x17F) if c not in (0xD7, 0xF7, 0x130, 0x149))
    ODD = re.compile(rf"[^{LETTERS}!-~ \t\n\r]|<\|").search
    #: Those of these characters that are one byte in Latin-1.
    PLAIN = bytes([9, 10, 13, *range(32, 127), *(ord(c) for c in LETTERS if "\xbf" < c <= "\xff")])
    #: The tokenizer's own pieces, over these characters.
    PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[!-/:-@\[-`{{-~]+").findall
    #: A sign between an ASCII letter or digit and a space: a piece of its own.
    APART = re.compile(r"([!-/:-@\[-`{-~])(?<=[a-z0-9].) ").sub
    #: Bytes that the vocabulary writes as other characters: those that do not print, numbered from 256.
    BYTES = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(self._whole, REMEMBERED)
        self.one = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.one.model)
        words = self.one.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(words.values()) + 1, bool)  # ids that end a piece
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True

    def _whole(self, part: str) -> bytes:
        return array("i", self.one.encode(part, add_special_tokens=False).ids).tobytes()

    def _merged(self, pieces: list[str]) -> list[bytes]:
        (found,) = self.merges.encode_batch_fast([[p if p.isascii() else p.encode().decode("latin-1").translate(self.BYTES) for p in pieces]], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, np.int32)
        cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])] if len(cuts) == len(pieces) + 1 else [self._whole(p) for p in pieces]

    def easy(self, text: str) -> bool:
        """Whether no part needs the whole tokenizer."""
        try:
            return not text.encode("latin-1").translate(None, self.PLAIN) and "<|" not in text
        except UnicodeEncodeError:
            return not self.ODD(text)

    def cut(self, text: str) -> tuple[list[str], bool]:
        """The text's parts, and whether none of them needs the whole tokenizer."""
        if self.easy(text):
            return self.APART(r" \1 ", text.lower()).split(), True
        return [p if self.ODD(p) else p.lower() for p in text.replace("\n", " ").split(" ")], False

    def fill(self, plain: set[str], mixed: set[str]) -> dict[str, bytes]:
        """The ids of parts that are not remembered as frequent, new ones many in one call of the tokenizer."""
        n = 2 * (len(plain) + len(mixed))
        if len(self) + n > self.most:
            self.older = dict(self)
            self.clear()
        elif len(self.older) + n > self.most:
            self.older = {}
        older, out, others, single, several = self.older, {}, [], set(), {}
        for p in plain | mixed:
            if (got := older.get(p)) is not None:
                self[p] = out[p] = got
            elif p in mixed and self.ODD(p):
                others.append(p)
            elif p.isalpha():
                single.add(p)
            else:
                several[p] = self.PIECES(p)
        for at in range(0, len(others), 2048):
            some = others[at : at + 2048]
            for p, e in zip(some, self.one.encode_batch_fast(some, add_special_tokens=False)):
                older[p] = out[p] = array("i", e.ids).tobytes()
        pieces = {x for c in several.values() for x in c if x not in older and x not in self}
        new = list(single | pieces)
        for at in range(0, len(new), 2048):
            older.update(zip(new[at : at + 2048], self._merged(new[at : at + 2048])))
        for p in single:
            out[p] = older[p]
        for p, c in several.items():
            older[p] = out[p] = b"".join([older[x] if x in older else self[x] for x in c])
        return out

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        last, out, at = array("i", [end]).tobytes(), [], 0
        while at < len(texts):
            cut, plain, mixed = [], set(), set()
            while at < len(texts) and len(cut) < 200 and len(plain) + len(mixed) < REMEMBERED // 8:
                parts, easy = self.cut(texts[at])
                got = list(map(self.get, parts))
                gaps = [k for k, x in enumerate(got) if x is None]
                new = [parts[k] for k in gaps]
                (plain if easy else mixed).update(new)
                cut.append((got, gaps, new))
                at += 1
            found = self.fill(plain, mixed)
            for got, gaps, new in cut:
                for k, p in zip(gaps, new):
                    got[k] = found[p]
                got.append(last)
                out.append(np.frombuffer(b"".join(got), np.int32))
        return out


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """One for each Python worker, which serves many tasks."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    """Write (part, place, first: ids of the part before this segment, n_ids, doc_ids, ends, image) rows to `path`."""
    tokenizer = tokenizer or public_tokenizers.path(VOCABULARY)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
        .withColumn("part", F.spark_partition_id())
    )
    schema = "part int, place int, first bigint, n_ids bigint, doc_ids array<bigint>, ends array<bigint>, image binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def run(batches):
        words, place, first = words_of(tokenizer), 0, 0
        part, held, ids, size = None, [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal place, first, held, ids, size
            row = [part, place, first, size, held, np.cumsum([len(x) for x in ids]), pack(np.concatenate(ids))]
            place, first, held, ids, size = place + 1, first + size, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

        for whole in batches:
            for batch in common.slices(whole, "text"):
                for doc, own, in_ in zip(
                    batch.column("doc_id").to_pylist(), words.encode(common.texts_of(batch.column("text")), end), batch.column("part").to_pylist()
                ):
                    if held and (in_ != part or size + len(own) > SEGMENT):
                        yield close()
                    if in_ != part:
                        part, place, first = in_, 0, 0
                    held.append(doc)
                    ids.append(own)
                    size += len(own)
        if held:
            yield close()

    ordered.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def read_tokens(spark, path: str, then: Callable | None = None, schema: str = "doc_id bigint, start bigint, ids array<int>") -> DataFrame:
    """(doc_id, start, ids) for each document, from the files alone; `then` may turn batches of these into batches of another schema."""
    files = spark.read.parquet(path)
    #: One row for each written part: as many as there are files.
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, total = {}, 0
    for r in sizes:
        before[r["part"]], total = total, total + r["n"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part, first, docs, ends, image = (batch.column(c)[k].as_py() for c in ("part", "first", "doc_ids", "ends", "image"))
                starts = np.array([0, *ends[:-1]], np.int64) + first + before[part]
                ids = common.lists(np.array([0, *ends]), pa.array(unpack(image)))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts), ids], names=["doc_id", "start", "ids"])

    return files.select("part", "first", "doc_ids", "ends", "image").mapInArrow((lambda batches: then(run(batches))) if then else run, schema)


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    return written_and_read(common.table(spark, sf_dir, "documents"))


def written_and_read(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = common.scratch(spark, "tokens")
    write_tokens(docs, path)

    def digest(batches):
        for batch in batches:
            col = batch.column("ids")
            values, offsets = col.flatten().to_numpy().astype("<u4"), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy())])
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            cols = [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, path, digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
