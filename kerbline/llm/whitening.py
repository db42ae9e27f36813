"""Whitening of embeddings by shifted CholeskyQR (after Fukaya, Kannan, Nakatsukasa, Yamamoto and Yanagisawa, 2020).

Entries are fixed to whole numbers, so sums over all rows are exact. Each pass over the rows centres them, divides them by the
triangular factors so far (a triangular solve for each) and sums the products of their columns, the Gram matrix, in Spark. Its Cholesky
factor is the next triangular factor: the first pass adds a shift, which makes the factor exist for any rows, and two more make the
columns orthonormal to double precision. The product of the factors is R; its singular vectors are the components. Where columns depend
on each other, plain factors may not exist; passes shift again there, and a last Gram matrix corrects R, so components without variance
are told by it. Only sums of products (dims x dims numbers for each length of vector) come to the driver.

Vectors that are null, or hold null or non-finite entries, go, and so do empty ones, which have no component. Vectors of another length
are a list of their own, fitted and whitened alike. Components without variance (those of a single vector, or of equal ones) cannot be
scaled to variance 1 and are left out. Repeated rows and ids, and null ids, are rows of their own; an empty table gives an empty table;
other columns are not looked at. `deviation` is null where it exceeds a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Entries looked at together.
ENTRIES = 1 << 19
SCALE, OFFSET = 1024, 100_000
EPS = float(np.finfo(float).eps)


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, their vectors as whole numbers), by length; rows that do not count are left out."""
    column = batch.column(batch.schema.get_field_index("embedding"))
    offsets, values = column.offsets.to_numpy(), column.values.cast(pa.float64())
    flat = np.asarray(values.to_numpy(zero_copy_only=False), dtype=float)
    sizes = np.diff(offsets)
    good = np.asarray(column.is_valid()) & (sizes > 0)
    for size in np.unique(sizes[good]):
        rows = np.flatnonzero(good & (sizes == size))
        step = max(1, ENTRIES // int(size))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            x = flat[offsets[some][:, None] + np.arange(size)]
            fine = np.isfinite(x).all(axis=1)
            if fine.any():
                x = np.floor(SCALE * x[fine])
                large = np.abs(x).max() >= 2.0**52
                whole = np.array([[int(v) for v in row] for row in x], dtype=object) if large else x.astype(np.int64)
                yield some[fine], whole + OFFSET


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n x - S exactly, and the same over n as doubles."""
    top = max(abs(int(x.max())), abs(int(x.min())), 1)
    if n * top + max(abs(int(s)) for s in sums) >= 1 << 62:
        far = n * x.astype(object) - sums.astype(object)
    else:
        far = n * x - sums.astype(np.int64)
    return far, far.astype(float) / n


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangular matrix, by substitution."""
    out = np.empty_like(rows)
    for j in range(upper.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def summed(vectors: DataFrame, make: Callable[[int, np.ndarray], tuple[int, np.ndarray]]) -> dict[int, tuple[int, np.ndarray]]:
    """Sums over all rows, by length of vector: make(length, whole numbers) gives a block's rows and its matrix of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for _, x in blocks(batch):
                n, m = make(x.shape[1], x)
                old = total.setdefault(x.shape[1], [0, 0.0])
                old[0] += n
                old[1] = old[1] + m
        for size, (n, m) in total.items():
            for i, row in enumerate(m):
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([i], pa.int32()), pa.array([n], pa.int64()), pa.array([row], pa.list_(pa.float64()))], names=["size", "i", "n", "row"])

    parts = vectors.select("embedding").mapInArrow(run, "size int, i int, n bigint, row array<double>")
    cells = parts.select("size", "i", "n", F.posexplode("row").alias("j", "v")).groupBy("size", "i", "j").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    rows = cells.groupBy("size", "i").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row"))
    found: dict[int, dict[int, tuple]] = {}
    for r in rows.select("size", "i", "n", F.transform("row", lambda c: c["v"]).alias("row")).collect():  # one matrix for each length
        found.setdefault(r["size"], {})[r["i"]] = (r["n"], r["row"])
    return {size: (m[0][0], np.array([m[i][1] for i in sorted(m)])) for size, m in found.items()}


def totals(vectors: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """(n, exact sum of each dimension) by length of vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for _, x in blocks(batch):
                old = total.setdefault(x.shape[1], [0, 0])
                old[0] += len(x)
                old[1] = old[1] + x.astype(object).sum(axis=0) if x.dtype == object else old[1] + x.sum(axis=0).astype(object)
        for size, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(list(map(str, s)))], names=["size", "i", "n", "s"])

    rows = vectors.select("embedding").mapInArrow(run, "size int, i int, n bigint, s string")
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in rows.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # a row for each dimension
        out.setdefault(r["size"], (r["n"], np.zeros(r["size"], dtype=object)))[1][r["i"]] = int(r["s"])
    return out


@dataclass
class Model:
    """Of vectors of one length: their number and sums, and the components (in rows) with their variances, falling."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def whitened(self, away: np.ndarray, most: int) -> np.ndarray:
        return away @ self.components[:most].T / np.sqrt(self.variances[:most])


def fit(vectors: DataFrame) -> dict[int, Model]:
    """A model for each length of vector."""
    base = totals(vectors)
    factors: dict[int, list[np.ndarray]] = {size: [] for size in base}
    if not base:
        return {}

    def grams() -> dict[int, np.ndarray]:
        now = {size: list(f) for size, f in factors.items()}

        def make(size: int, x: np.ndarray) -> tuple[int, np.ndarray]:
            q = centred(x, *base[size])[1]
            for upper in now[size]:
                q = solved(q, upper)
            return len(x), q.T @ q

        return {size: m for size, (_, m) in summed(vectors, make).items()}

    certain = dict.fromkeys(base, True)
    for step in range(3):
        for size, gram in grams().items():
            n, norm = base[size][0], float(np.linalg.norm(gram, 2))
            shift = 11 * (n * size + size * (size + 1)) * EPS / 2 * norm
            upper = None
            if step > 0:
                try:
                    upper = np.linalg.cholesky(gram).T
                except np.linalg.LinAlgError:
                    certain[size] = False
            if upper is None:
                upper = np.linalg.cholesky(gram + (shift or 1.0) * np.eye(size)).T
            # After two passes the columns are orthonormal, unless they depend on each other.
            certain[size] &= step < 2 or float(np.abs(gram - np.eye(size)).max()) < 1e-6
            factors[size].append(upper)
    last = {} if all(certain.values()) else grams()
    out = {}
    for size, (n, sums) in base.items():
        r = factors[size][0]
        for upper in factors[size][1:]:
            r = upper @ r
        if not certain[size]:
            values, vectors_ = np.linalg.eigh(last[size])
            r = (np.sqrt(np.clip(values, 0, None)) * vectors_).T @ r
        _, sigma, components = np.linalg.svd(r)
        kept = sigma > sigma[0] * 8 * size * EPS
        at = np.abs(components).argmax(axis=1)
        components = components * np.where(components[np.arange(size), at] < 0, -1.0, 1.0)[:, None]
        out[size] = Model(n, sums, components[kept], sigma[kept] ** 2 / n, float((sigma**2).sum() / n))
    return out


def identity_errors(vectors: DataFrame, models: dict[int, Model], most: int) -> dict[int, float]:
    """Largest absolute entry of the whitened rows' covariance minus the identity, by length of vector."""

    def make(size: int, x: np.ndarray) -> tuple[int, np.ndarray]:
        m = models[size]
        w = m.whitened(centred(x, m.n, m.sums)[1], most)
        return len(x), np.vstack([w.sum(axis=0), w.T @ w])

    usable = {size for size, m in models.items() if len(m.components)}
    if not usable:
        return {}
    out = {}
    for size, (n, m) in summed(vectors.where(F.size("embedding").isin(sorted(usable))), make).items():
        k = min(most, len(models[size].components))
        mean = m[0] / n
        out[size] = float(np.abs(m[1 : k + 1] / n - np.outer(mean, mean) - np.eye(k)).max())
    return out


def whiten(vectors: DataFrame, models: dict[int, Model], most: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every vector that counts and component up to `most`."""
    errors = identity_errors(vectors, models, most)

    def squares(far: np.ndarray) -> list[int | None]:
        top = max(abs(int(far.max())), abs(int(far.min())))
        if far.dtype != object and top * top * far.shape[1] < 1 << 62:
            return (far * far).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in far]
        return [v if v < 1 << 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            for rows, x in blocks(batch):
                m = models[x.shape[1]]
                k = min(most, len(m.components))
                if not k:
                    continue
                far, away = centred(x, m.n, m.sums)
                count = len(rows) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(rows, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(count, m.n)),
                        pa.array([v for v in squares(far) for _ in range(k)], pa.int64()),
                        pa.array(m.whitened(away, most).ravel()),
                        pa.array(np.tile(m.variances[:k] / m.trace, len(rows))),
                        pa.array(np.full(count, errors[x.shape[1]])),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = dict(vectors.dtypes)["vec_id"]
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return whiten(vectors, fit(vectors))
