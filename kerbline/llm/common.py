"""Helpers that the operators of this subpackage share: tables, scratch folders and Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Recent(dict):
    """Remembers what `make` gave for the last keys asked for: two generations of at most `most` each, so frequent keys stay."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def room(self, n: int = 1) -> None:
        if len(self) + n > self.most:
            self.older = dict(self)
            self.clear()

    def __missing__(self, key):
        self.room()
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of this session.
TABLES: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, on one machine, under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    TABLES.append(path)
    return path


def drop_tables(spark: SparkSession) -> int:
    """Remove the tables made so far, once no result that reads them is wanted any more; how many were there."""
    found = 0
    while TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(TABLES.pop())
        found += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_few(df: DataFrame, name: str, files: int) -> DataFrame:
    """As written(), with so many files at most, if any number.

    Hadoop's local file system starts a process of its own for each file that an executor opens, which shares all memory of the executor for a
    moment and counts once more."""
    return written(df.coalesce(files) if files else df, name)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def parts(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part): parts of a string column of not much more than `limit` bytes (a single long text stays whole)."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield a, column.slice(a, b - a)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch as parts() cuts one of its string columns."""
    for at, part in parts(batch.column(batch.schema.get_field_index(column)), limit):
        yield batch.slice(at, len(part))


def release() -> None:
    """Give memory that Python, numpy and Arrow have freed back to the system: workers live on after their tasks, beside later ones."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: What this process keeps from task to task, by operator and key.
_lasting: dict[tuple, object] = {}


def serves(operator: str) -> None:
    """Drop what other operators have left in this Python worker: it lives on and serves tasks of them all."""
    for key in [k for k in _lasting if k[0] != operator]:
        del _lasting[key]


def lasting(operator: str, make: Callable, *key):
    """make(*key), once in each Python worker until it serves another operator."""
    serves(operator)
    own = (operator, make, *key)
    if own not in _lasting:
        _lasting[own] = make(*key)
    return _lasting[own]


#: Bytes of an Arrow batch that travels to a Python worker, or one row.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold BATCH bytes at most: each task keeps some in the executor's JVM and in its worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size, unit = re.match(r"(\d+)([kmgtp]?)", spark.conf.get(name).strip().lower()).groups()
    if int(size) * 1024 ** " kmgtp".index(unit or " ") > BATCH:
        spark.conf.set(name, str(BATCH))


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], operator: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, for mapInArrow, after what other operators keep in the worker was dropped, and what it has freed given back when a task ends."""
    operator = operator or run.__module__

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serves(operator)
        yield from run(batches)
        release()

    return whole


def map_batches(df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function made once in each task and fed with parts of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, column):
                yield step(part)

    return df.mapInArrow(releasing(run, make.__module__), schema)


def lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


#: Keys that hold this share of all rows or more are few: so many at most.
HEAVY = 2000


def by_key(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` with the columns of `table` (a row for each key, met `weight` times by rows, `total` in all) beside them.

    Keys met by a 2000th of all rows or more are 2000 at most, so these are broadcast, and their rows stay where they are; rows of
    other keys are joined by a shuffle, in which no key is large. Both parts read `rows`, which should be a table.
    """
    heavy = F.col(weight) * HEAVY >= F.lit(total)
    hot, cold = F.broadcast(table.where(heavy)), table.where(~heavy)
    near = rows.join(hot, key)
    far = rows.join(F.broadcast(table.where(heavy).select(key)), key, "left_anti").join(cold, key, how)
    return near.unionByName(far)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of ASCII alone take the quick way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
