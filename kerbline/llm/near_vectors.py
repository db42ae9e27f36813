"""Near-duplicate vectors by an epsilon grid order join.

Vectors of unit length with cosine >= t lie within eps = sqrt(2 - 2t). They are projected on leading principal axes and sorted by grid
cells of side eps (lexicographically); the sequence is cut into blocks that know their bounds. Pairs of blocks whose bounds lie more than
eps apart are skipped, and inside a pair the recursion over intervals of the sequence skips likewise down to LEAF rows; so no pair that
qualifies is lost. There a product of SIEVE leading coordinates and the length of the rest, which is never less than the cosine, leaves a
few rows, and these are compared whole in double precision. A block pair gives partial link counts and a forest of links, never all pairs.

Blocks meet in a cartesian product of the table's partitions: each task reads two partitions from the shared folder, so neither the
disk nor the memory of a task grows with the number of block pairs, which is the square of the blocks where nothing can be skipped.

Equal vectors are one class from the start, named by the hash of their components. Vectors that are null, empty, zero, or hold null
or non-finite components are linked with nothing; those of each length are joined among themselves. Repeated rows count as vectors,
and so do different vectors under one id; null ids take part but name no component; an empty table gives an empty table; other
columns are not read. The given vectors are read several times, as copies of them would fill the disk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components, forest

COSINE, GRID, BOUNDS, SIEVE, BLOCK, BLOCKS, LEAF = 0.9, 4, 8, 31, 4096, 32, 512
#: Bytes of a block's vectors at most (or LEAF rows); blocks of a file of them at most; sieved blocks that a task remembers.
BYTES, FILE, KEPT = 4 << 20, 16, 32
#: More than what single precision can take from a sum of SIEVE + 1 products.
LOSS = 1e-4


def units(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The rows' vectors as unit vectors."""
    return unit(batch.column("e").flatten().to_numpy().reshape(-1, dims))


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # first, so that squares do not overflow
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def principal_axes(vectors: DataFrame, dims: int, k: int) -> np.ndarray:
    """The k leading axes (dims x k) from sums of products over all rows."""
    def sums(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            u = units(batch, dims)
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = vectors.select("e").mapInArrow(sums, "i int, row array<double>")
    rows = parts.select("i", F.posexplode("row").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # dims * dims
    m = np.zeros((dims, dims))
    for r in rows:
        m[r["i"], r["j"]] = r["s"]
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1][:, :k].copy()


def apart(lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
    """Least squared distance of two boxes."""
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return (gap * gap).sum(-1)


class Block:
    """A block's classes (ids, how many vectors each, vectors), their leading coordinates, and these with the length of the rest."""

    def __init__(self, ids: np.ndarray, ms: np.ndarray, e: np.ndarray, axes: np.ndarray, sieved: tuple | None = None):
        self.ids, self.ms, self.e = ids, ms, e
        self.sieved = sieved or self.sieve(axes)
        self.p, self.q = self.sieved
        self.boxes: dict[tuple[int, int], tuple] = {}

    def box(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the leading coordinates of an interval."""
        if (start, end) not in self.boxes:
            p = self.p[start:end]
            self.boxes[start, end] = p.min(0), p.max(0)
        return self.boxes[start, end]

    def sieve(self, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = unit(self.e) @ axes
        rest = np.sqrt(np.maximum(0, 1 - (p * p).sum(1, keepdims=True)))
        return p[:, :BOUNDS].copy(), np.hstack([p, rest]).astype(np.float32)


class Blocks:
    """Links between the rows of two blocks (or of one with itself) by recursion over intervals."""

    def __init__(self, a: Block, b: Block, same: bool, cosine: float):
        self.a, self.b, self.same, self.cosine, self.far = a, b, same, cosine, far(cosine)
        self.na, self.nb = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
        self.ids, self.shift = (a.ids, 0) if same else (np.concatenate([a.ids, b.ids]), len(a.ids))
        self.label = np.arange(len(self.ids))
        self.forest: list[tuple[np.ndarray, np.ndarray]] = []

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        """Join the components of rows x and y; only links between different ones are kept, ends of each component for its rows."""
        x, y = self.label[x], self.label[y]
        if (open_ := x != y).any():
            ends, roots = forest(x[open_], y[open_])
            self.forest.append((self.ids[ends], self.ids[roots]))
            to = np.arange(len(self.label))
            to[ends] = roots
            self.label = to[self.label]

    def run(self, a0: int, a1: int, b0: int, b1: int) -> None:
        if self.same and b1 <= a0:
            return
        if apart(*self.a.box(a0, a1), *self.b.box(b0, b1)) > self.far:
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            most = self.a.q[a0:a1] @ self.b.q[b0:b1].T
            if most.max() >= self.cosine - LOSS:
                may = most >= self.cosine - LOSS
                i, j = a0 + np.flatnonzero(may.any(1)), b0 + np.flatnonzero(may.any(0))
                near = unit(self.a.e[i]) @ unit(self.b.e[j]).T >= self.cosine
                if self.same:
                    near &= i[:, None] < j
                self.na[i] += near @ self.b.ms[j]
                self.nb[j] += self.a.ms[i] @ near
                x, y = np.nonzero(near)
                self.link(i[x], self.shift + j[y])
            return
        am, bm = ((a0 + a1) // 2, (b0 + b1) // 2) if a1 - a0 > LEAF and b1 - b0 > LEAF else ((a0 + a1) // 2, b1) if a1 - a0 > LEAF else (a1, (b0 + b1) // 2)
        for x in ((a0, am), (am, a1)):
            for y in ((b0, bm), (bm, b1)):
                if x[1] > x[0] and y[1] > y[0]:
                    self.run(*x, *y)


def far(cosine: float) -> float:
    """Squared distance beyond which no two unit vectors have the cosine, and a little more."""
    return (2 - 2 * cosine) * (1 + 1e-6) + 1e-9


def join(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    common.small_batches(vectors.sparkSession)
    kind = vectors.schema["embedding"].dataType.elementType
    kind = "float" if isinstance(kind, T.FloatType) else "double"  # as given, so that vectors travel in as few bytes
    zero = F.lit(0.0).cast(kind)
    rows = vectors.select("vec_id", F.transform(F.col("embedding").cast(f"array<{kind}>"), lambda x: x + zero).alias("e"))  # no negative zero
    good = F.coalesce((F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0), F.lit(False))
    name = F.xxhash64("e").alias("rep")
    given = rows.where(good).select("e", name)
    rows = common.written(rows.select("vec_id", F.when(good, F.size("e")).alias("dims"), name), "vectors")
    classes = rows.where("dims > 0").groupBy("rep").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    links = None
    for dims, total in sorted(map(tuple, rows.where("dims > 0").groupBy("dims").count().collect())):
        own = links_of(given.where(F.size("e") == dims), dims, total, kind, cosine)
        links = own if links is None else links.union(own)
    if links is None:
        links = vectors.sparkSession.createDataFrame([], "a bigint, b bigint, n bigint")
    counts = links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(links.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "root")
    named = common.written(classes.join(counts, "rep", "left").join(roots, "rep", "left").select("rep", "least", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "named")
    least = common.written(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = common.written(named.select("rep", "n_links", "root").join(least, "root").select("rep", "n_links", "component_id"), "named")
    linked = rows.where("dims > 0").join(named, "rep").select("vec_id", "n_links", "component_id")
    alone = rows.where("dims is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def links_of(given: DataFrame, dims: int, total: int, kind: str, cosine: float) -> DataFrame:
    """(a, b, n): counts n of links of class a (b is null), and a forest of links (a, b), among `total` vectors (e, rep) of one length."""
    spark = given.sparkSession
    axes = principal_axes(given, dims, min(SIEVE, dims))
    eps, k = float(np.sqrt(2 - 2 * cosine)), min(BOUNDS, dims)
    number = np.dtype(np.float32 if kind == "float" else np.float64)
    size = max(LEAF, min(max(BLOCK, total // BLOCKS), BYTES // (number.itemsize * dims)))

    def project(batches):
        for batch in batches:
            p = units(batch, dims) @ axes[:, :GRID]
            cells = np.floor(p / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p[:, 0]), pa.array(list(cells), pa.list_(pa.int32()))], names=["rep", "m", "e", "p", "cell"])

    classes = given.groupBy("e").agg(F.count("*").alias("m")).select(F.xxhash64("e").alias("rep"), "m", "e")
    projected = classes.mapInArrow(project, f"rep bigint, m bigint, e array<{kind}>, p double, cell array<int>")
    order = [F.col("cell"), F.col("p"), F.col("rep")]
    # A block to a file as long as shuffles have the partitions for it, then FILE blocks at most.
    parts = max(-(-total // (FILE * size)), min(-(-total // size), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ordered = projected.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("rep", "m", "e", F.spark_partition_id().alias("part"))

    def pack(batches):
        """Blocks of a partition's rows, numbered by partition and place; a last one may be larger, by half."""
        held, n, now = [], 0, 0

        def close(rows: int) -> pa.RecordBatch:
            nonlocal held, n, now
            ids, ms, es = (np.concatenate([h[i] for h in held]) for i in range(3))
            held, n = [(ids[rows:], ms[rows:], es[rows:])], n - rows
            ids, ms, es = ids[:rows], ms[:rows], es[:rows]
            p = unit(es) @ axes[:, :k]
            row = [(part << 32) + now, ids.tobytes(), ms.tobytes(), es.tobytes(), p.min(0), p.max(0)]
            now += 1
            types = [pa.int64(), *[pa.binary()] * 3, *[pa.list_(pa.float64())] * 2]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=["block", "ids", "ms", "es", "lo", "hi"])

        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                held.append((batch.column("rep").to_numpy(), batch.column("m").to_numpy(), batch.column("e").flatten().to_numpy().reshape(-1, dims)))
                n += batch.num_rows
                while n > size * 3 // 2:
                    yield close(size)
        if n:
            yield close(n)

    blocks = common.written(ordered.mapInArrow(pack, "block bigint, ids binary, ms binary, es binary, lo array<double>, hi array<double>"), "blocks")
    side = lambda s: blocks.select(*(F.col(c).alias(f"{c}_{s}") for c in blocks.columns))
    met = side("a").join(side("b").hint("shuffle_replicate_nl"), (F.col("block_a") <= F.col("block_b")) & (gap() <= far(cosine)))

    def compare(batches):
        sieved: dict[int, tuple] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                def block(s: str) -> Block:
                    at = batch.column(f"block_{s}")[r].as_py()
                    ids, ms, e = (np.frombuffer(batch.column(f"{c}_{s}")[r].as_buffer(), t) for c, t in (("ids", np.int64), ("ms", np.int64), ("es", number)))
                    got = Block(ids, ms, e.reshape(-1, dims), axes, sieved.get(at))
                    if len(sieved) >= KEPT and at not in sieved:
                        sieved.clear()
                    sieved[at] = got.sieved
                    return got

                same = batch.column("block_a")[r].as_py() == batch.column("block_b")[r].as_py()
                a = block("a")
                work = Blocks(a, a if same else block("b"), same, cosine)
                work.run(0, len(work.na), 0, len(work.nb))
                ids, n = np.concatenate([work.a.ids, work.b.ids]), np.concatenate([work.na, work.nb])
                x, y = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in work.forest)]) for i in range(2))
                lone = np.arange((n > 0).sum() + len(x)) < (n > 0).sum()
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[n > 0], x])), pa.array(np.concatenate([ids[n > 0], y]), mask=lone), pa.array(np.concatenate([n[n > 0], 0 * x]))], names=["a", "b", "n"])

    return common.written(met.select(*(f"{c}_{s}" for s in "ab" for c in ("block", "ids", "ms", "es"))).mapInArrow(common.releasing(compare), "a bigint, b bigint, n bigint"), "found")


def gap() -> Column:
    """Least squared distance of two blocks' boxes (lo_a, hi_a, lo_b, hi_b)."""
    one = lambda of: F.greatest(F.lit(0.0), of["lo_a"] - of["hi_b"], of["lo_b"] - of["hi_a"])
    return F.aggregate(F.arrays_zip("lo_a", "hi_a", "lo_b", "hi_b"), F.lit(0.0), lambda s, x: s + one(x) * one(x))


def op6_near_vectors(spark, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM links l WHERE l.x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON vec_id = c.x
"""
