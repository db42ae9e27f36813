"""Exact deduplication as a stateful stream, in DataFrame operations only.

A stream of documents is aggregated by the digest of its normalised text (A-Z lower-cased, nothing else). The state, kept on disk by
RocksDB and in the checkpoint folder, has a row for each digest for ever: how many rows had it, and the stable identifier and the
content's locator (file and row) of the one that stays. Later runs over the same folder only read what came since. A digest met more
than once is a hit, and hits are checked in full: their texts are read again and grouped by all their bytes, beside the stored
content. Texts of equal digest but other bytes form groups of their own.

Of equal texts the row with the largest doc_id stays (of repeated ids the last by file and row; null ids come before all others).
Null and empty texts are equal; long ones are read whole; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition's store takes megabytes before it holds anything
}
#: Bits of the table that says which texts may be hits (8 MB, whatever the input).
BITS = 1 << 26


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def normal(text: str = "text") -> Column:
    return common.lower_ascii(F.coalesce(F.col(text), F.lit("")))


def located(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the file and row that hold them; `docs` reads files, as a batch or as a stream."""
    return docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def absorb(stream: DataFrame, folder: str, digest: Callable[[Column], Column] = sha256) -> None:
    """Take all that the stream (doc_id, text, file, row) has at present into the state under `folder`."""
    spark = stream.sparkSession
    keyed = stream.select(digest(normal()).alias("digest"), F.struct("doc_id", "file", "row").alias("at"))
    held = keyed.groupBy("digest").agg(F.count("*").alias("n"), F.max("at").alias("keep"))
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    try:
        for k, v in ROCKSDB.items():
            spark.conf.set(k, v)
        query = held.writeStream.format("noop").outputMode("update").option("checkpointLocation", folder).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


def state(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, n, keep) for every digest met so far."""
    return spark.read.format("statestore").load(folder).select("key.digest", F.col("value.count").alias("n"), F.col("value.max").alias("keep"))


def bits(keys: DataFrame) -> DataFrame:
    """(bucket, bitmap): a bit for each digest, in at most 2048 bitmaps of 4 KB."""
    spot = F.pmod(F.xxhash64("digest"), F.lit(BITS))
    return keys.groupBy(F.bitmap_bucket_number(spot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bitmap"))


def likely(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose digest may be among `keys`; none that is gets lost."""
    spot = F.pmod(F.xxhash64("digest"), F.lit(BITS))
    at = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substr("bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn("bucket", F.bitmap_bucket_number(spot)).join(F.broadcast(bits(keys)), "bucket")
    return joined.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("bucket", "bitmap")


def verdicts(docs: DataFrame, held: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept for every row of `docs` (doc_id, text, file, row), all of them taken into `held`."""
    held = common.written(held, "state")
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    texts = docs.select("doc_id", "file", "row", normal().alias("text")).withColumn("digest", digest(F.col("text")))
    keys = common.written(texts.drop("text"), "keys")

    def exact(some: DataFrame) -> DataFrame:
        """(digest, text, group_size) of the texts of some digests, told apart by all their bytes; copies meet before they travel."""
        return likely(texts, some).groupBy("digest", "text").agg(F.count("*").alias("group_size")).join(some, "digest", "left_semi")

    hits = held.where("n > 1").select("digest")
    mixed = common.written(exact(hits).groupBy("digest").agg(F.count("*").alias("kinds")).where("kinds > 1").select("digest"), "mixed")
    whole = held.join(mixed, "digest", "left_anti").select("digest", F.col("n").alias("group_size"), "keep")
    out = [common.by_key(keys, whole, "digest", "group_size", total)]
    if not mixed.isEmpty():
        own = likely(texts, mixed).join(mixed, "digest", "left_semi")
        groups = own.groupBy("digest", "text").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))
        out.append(own.join(groups, ["digest", "text"]).drop("text"))
    rows = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    same = F.struct("doc_id", "file", "row").eqNullSafe(F.col("keep"))
    return rows.select("doc_id", "digest", F.col("keep.doc_id").alias("keep_id"), "group_size", same.alias("kept"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str, batch: int = 1 << 34) -> DataFrame:
    docs = located(common.table(spark, sf_dir, "documents"))
    folder = common.scratch(spark, "digests")
    # A pattern, as a stream takes no path of a single file; the documents' files are read in batches of so many bytes.
    files = spark.readStream.schema("doc_id bigint, text string").option("maxBytesPerTrigger", batch).parquet(f"{sf_dir}/documents.[p]arquet")
    absorb(located(files), folder)
    found = verdicts(docs, state(spark, folder))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""
