"""Prefix trie of conversations by depth-band rollup.

A conversation's prefixes are named by a running hash of its turns (a polynomial modulo 2^127 - 1 over SHA-256 digests), so equal
prefixes of different conversations are one node. Turns are dealt by ranges of their order, never by conversation: each task hashes
what it has, and what a conversation brings along from earlier tasks (one row for each) is put before it, as the hashes of two pieces
give that of the whole. Nodes know their ancestors within a band of HEIGHT depths. Sums over subtrees explode each node to those only;
the band roots' sums make a tree HEIGHT times lower, which is summed the same way, and the completed sums of band roots then go to the
ancestors in the band above. So rounds grow with the logarithm of the depth and no node explodes to more than 2 HEIGHT rows.

Turns are ordered by turn (null first), turns of equal number by the SHA-256 digest of role and text, so repeated rows are turns of
their own. Null roles and texts are empty; long texts count whole. A null conv_id is one conversation without a base, whose own turns
all stay; as a member it counts as larger than any number and its id as an empty string. An empty table has no members, and so no
node, not even a root. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

HEIGHT = 16
PRIME, BASE = (1 << 127) - 1, int.from_bytes(hashlib.sha256(b"base").digest()[:15], "big")
ROOT = bytes(16)
#: Bytes of member ids hashed together.
CHUNK = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """conv_id, at, turn_hash, words of `rows`, with pos (from 1 within the conversation, in that order) and the names of the prefix that ends
    there (node) and of the one before it (parent)."""
    keep = rows.select("conv_id", "at", "turn_hash", "words", *(c for c in order if c not in ("at", "turn_hash", "words")))
    dealt = keep.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).select("conv_id", "at", "turn_hash", "words")
    kind = dict(rows.dtypes)
    schema = f"conv_id {kind['conv_id']}, at {kind['at']}, turn_hash binary, words bigint, pos bigint, node binary, parent binary, part int, summary boolean"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, pos, value, first = TaskContext.get().partitionId(), (), 0, 0, None
        last: pa.RecordBatch | None = None
        for batch in batches:
            out: list[tuple] = []
            for conv, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if (conv,) != now:
                    if now and first is None:
                        first = (now[0], pos, value)
                    now, pos, value = (conv,), 0, 0
                before, value, pos = value, (value * BASE + int.from_bytes(h, "big")) % PRIME, pos + 1
                out.append((pos, value.to_bytes(16, "big"), before.to_bytes(16, "big")))
            n = len(out)
            if n:
                more = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))]
                last = batch.slice(n - 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, *more, pa.array([part] * n, pa.int32()), pa.array([False] * n)], names=names)
        if last is not None:
            ends = [first or (now[0], pos, value), (now[0], pos, value)]
            twice = [c.take(pa.array([0, 0])) for c in last.columns]
            twice[0] = pa.array([e[0] for e in ends], twice[0].type)
            sums = [pa.array([e[1] for e in ends], pa.int64()), pa.array([e[2].to_bytes(16, "big") for e in ends], pa.binary()), pa.nulls(2, pa.binary())]
            yield pa.RecordBatch.from_arrays([*twice, *sums, pa.array([part] * 2, pa.int32()), pa.array([True] * 2)], names=names)

    names = ["conv_id", "at", "turn_hash", "words", "pos", "node", "parent", "part", "summary"]
    done = common.written(dealt.mapInArrow(local, schema), "chains")
    carried = carries(done.where("summary").select("part", "conv_id", "pos", "node").collect())  # two rows for each partition
    out = done.where("not summary").drop("summary")
    if not carried:
        return out.drop("part")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {c: batch.column(k).to_pylist() for k, c in enumerate(batch.schema.names)}
            for i, (part, conv) in enumerate(zip(rows["part"], rows["conv_id"])):
                c = carried.get(part)
                if c is None or c[0] != conv:
                    continue
                k, lead = rows["pos"][i], c[2] * pow(BASE, rows["pos"][i] - 1, PRIME)
                rows["parent"][i] = ((lead + int.from_bytes(rows["parent"][i], "big")) % PRIME).to_bytes(16, "big")
                rows["node"][i] = ((lead * BASE + int.from_bytes(rows["node"][i], "big")) % PRIME).to_bytes(16, "big")
                rows["pos"][i] = k + c[1]
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in batch.schema][:-1], names=batch.schema.names[:-1])

    return out.mapInArrow(joined, schema.removesuffix(", part int, summary boolean"))


def carries(ends: list) -> dict[int, tuple]:
    """part: (conv_id, turns before it, their hash) where a conversation goes on from an earlier part; `ends` holds each part's first and last piece."""
    parts: dict[int, list] = {}
    for part, conv, pos, node in ends:
        parts.setdefault(part, []).append((conv, pos, int.from_bytes(node, "big")))
    out, going = {}, None
    for part in sorted(parts):
        pieces = parts[part]
        if len({p[0] for p in pieces}) == 1:
            first = last = pieces[0]
        else:
            first, last = pieces
            if going is not None and last[0] == going[0]:
                first, last = last, first
        if going is not None and going[0] == first[0]:
            out[part] = going
            first = (first[0], going[1] + first[1], (going[2] * pow(BASE, first[1], PRIME) + first[2]) % PRIME)
        going = first if last[0] == first[0] else last
    return out


def contents(turns: DataFrame) -> DataFrame:
    """conv_id, at (the turn), turn_hash, words: all that is needed of a turn; texts do not travel."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return turns.select("conv_id", F.col("turn").alias("at"), F.substring(F.unhex(F.sha2(named.cast("binary"), 256)), 1, 15).alias("turn_hash"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))


def lead_turns(conv: Column) -> Column:
    """How many of its base's turns a conversation begins with, at most."""
    return F.coalesce(F.crc32(conv.cast("string").cast("binary")) % 4, F.lit(0))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id of every conversation; conv_id, depth, node, parent, words of every turn of the rebuilt ones)."""
    # Equal rows can stand in any order, but not all in one task: their number in the scan tells them apart.
    placed = in_order(contents(turns).withColumn("n", F.monotonically_increasing_id()), ["at", "turn_hash", "n"])
    placed = common.written(placed.select("conv_id", "turn_hash", "words", "pos"), "turns")
    convs = common.written(placed.select("conv_id").distinct(), "conversations")
    base = F.col("conv_id") - F.col("conv_id") % 20
    heads = placed.where((F.col("pos") <= 3) & (F.col("conv_id") == base)).withColumnRenamed("conv_id", "base")
    lead = convs.select("conv_id", base.alias("base"), lead_turns(F.col("conv_id")).alias("h")).where("h > 0").join(heads, "base").where("pos <= h")
    own = placed.where(F.col("pos") > lead_turns(F.col("conv_id")))
    both = lead.select("conv_id", F.lit(0).alias("own"), "pos", "turn_hash", "words").union(own.select("conv_id", F.lit(1), "pos", "turn_hash", "words"))
    chains = in_order(both.withColumnRenamed("pos", "at"), ["own", "at"])
    return convs, chains.select("conv_id", F.col("pos").alias("depth"), "node", "parent", "words")


def banded(path: DataFrame, height: int) -> DataFrame:
    """`path` (conv_id, level, node, ...; level: depth in the tree at hand) with `within`, the node's ancestors in its own band, and, at
    band roots, `above`, those in the band above. A group is a conversation's piece of one band, height + 1 rows at most."""
    band = F.floor(F.col("level") / height)
    edge = (F.col("level") % height == 0) & (F.col("level") > 0)
    rest = [c for c in path.columns if c != "conv_id"]
    dealt = path.select("conv_id", F.struct("level", *(c for c in rest if c != "level")).alias("x"), F.explode(F.when(edge, F.array(band, band - 1)).otherwise(F.array(band))).alias("band"))
    pieces = dealt.groupBy("conv_id", "band").agg(F.array_sort(F.collect_list("x"), lambda a, b: (a["level"] - b["level"]).cast("int")).alias("xs"))
    rows = pieces.select("conv_id", "band", F.posexplode("xs").alias("i", "x"), F.transform("xs", lambda x: x["node"]).alias("nodes"))
    before = F.slice("nodes", F.lit(1), F.col("i"))
    own = F.floor(F.col("x.level") / height) == F.col("band")
    return rows.select("conv_id", *(F.col(f"x.{c}").alias(c) for c in rest), F.when(own, before).alias("within"), F.when(~own, before).alias("above"), own.alias("own"))


def rollup(values: DataFrame, path: DataFrame, top: int, height: int) -> DataFrame:
    """(node, leaves, saved) summed over subtrees. values: node, level, within, above, leaves, saved of each node; path: conv_id, level,
    node of every conversation's nodes; top: the greatest level."""
    add = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    parts = values.select(F.explode(F.concat(F.array("node"), "within")).alias("node"), "leaves", "saved").groupBy("node").agg(*add)
    if top < height:
        return parts
    parts = common.written(parts, "bands")
    roots = path.where(F.col("level") % height == 0).withColumn("level", F.floor(F.col("level") / height))
    higher = banded(roots, height).groupBy("node").agg(F.min("level").alias("level"), F.first("within", True).alias("within"), F.first("above", True).alias("above"))
    full = common.written(rollup(common.written(higher.join(parts, "node"), "roots"), roots, top // height, height), "completed")
    sent = full.join(values.where("above is not null").select("node", "above"), "node").select(F.explode("above").alias("node"), "leaves", "saved")
    return parts.unionByName(sent).groupBy("node").agg(*add)


def member_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): digest of the ascending ids (conv_id) that end at a node. Ids are joined to long pieces where they stand, so even
    a node with a third of all members comes to one task as few rows, and these pass through its hash one at a time."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, node, text, size, n, out = TaskContext.get().partitionId(), None, [], 0, 0, []

        def flush() -> None:
            nonlocal text, size, n
            if text:
                out.append((node, part, n, ",".join(text)))
                text, size, n = [], 0, n + 1

        for batch in batches:
            for at, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != node or size >= CHUNK:
                    flush()
                node = at
                text.append("" if conv is None else str(conv))
                size += len(text[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["node", "part", "n", "ids"])
                out = []
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["node", "part", "n", "ids"])

    kinds = (pa.binary(), pa.int32(), pa.int64(), pa.string())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, None, []
        for batch in batches:
            for at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != node:
                    if digest is not None:
                        out.append((node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["node", "ends_sha256"])
                out = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    order = F.col("conv_id").asc_nulls_last()
    dealt = ends.repartitionByRange("node", order).sortWithinPartitions("node", order).select("node", "conv_id")
    chunks = dealt.mapInArrow(pieces, "node binary, part int, n bigint, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "part", "n").select("node", "ids").mapInArrow(hashed, "node binary, ends_sha256 string")


def trie(turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, chains = rebuilt(turns)
    root = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("words"))
    path = common.written(root.unionByName(chains).withColumnRenamed("depth", "level"), "paths")
    top = path.agg(F.max("level")).first()[0] or 0
    rows = banded(path, height)
    own = F.when(F.col("own"), 1).otherwise(0)
    nodes = rows.groupBy("node").agg(
        F.sum(own).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("level").alias("level"), F.max("words").alias("words"),
        F.first("parent", True).alias("parent"), F.first("within", True).alias("within"), F.first("above", True).alias("above"),
    )
    nodes = common.written(nodes, "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = common.written(nodes.join(children, "node", "left").na.fill(0, ["n_children"]), "nodes")
    leaf, saved = F.when(F.col("n_children") == 0, 1).otherwise(0), (F.col("n_convs") - 1) * F.col("words")
    sums = rollup(nodes.select("node", "level", "within", "above", leaf.cast("bigint").alias("leaves"), saved.alias("saved")), path.select("conv_id", "level", "node"), top, height)
    ends = path.groupBy("conv_id").agg(F.max(F.struct("level", "node")).alias("x")).select("conv_id", "x.node")
    out = nodes.drop("within", "above", "words").join(sums, "node").join(member_hashes(ends), "node", "left")
    out = common.written(out, "trie")
    total = out.agg(F.count("*")).first()[0]
    parents = out.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("met"))
    return common.by_key(out, parents, "parent", "met", total, "left").select(
        "conv_id", F.col("level").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(common.table(spark, sf_dir, "conversations"))


#: crc32 bit by bit; -1 stands for a shift.
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"
SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations),
o AS (SELECT conv_id, list(struct_pack(r := r, t := t) ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || t)) AS turns FROM t GROUP BY 1),
c AS (SELECT conv_id, turns, {_CRC} % 4 AS h FROM o),
b AS (SELECT c.conv_id, list_concat(coalesce(p.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns FROM c LEFT JOIN o p ON p.conv_id = c.conv_id - c.conv_id % 20),
m AS (SELECT conv_id, d, turns[1:d] AS node, d = len(turns) AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM b)),
n AS (SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY 1),
k AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(node[depth].t, '[^\x20\x09-\x0D]+')) END AS saved FROM n LEFT JOIN k USING (node)),
s AS (SELECT node[1:a] AS node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM v) GROUP BY 1)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN s ON v.node = s.node LEFT JOIN n p ON v.depth > 0 AND p.node = v.node[1:v.depth - 1]"""
