"""Streams that have read everything equal the batch."""

import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kerbline.streaming import jobs


def run(stream, path, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(path.rsplit("/", 1)[1]).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(path.rsplit("/", 1)[1])


def test_new_cells(spark, tmp_path):
    rows = [(1, 5, 5), (1, 5, 5), (2, 5, 5), (1, 6, 5)]
    for part in range(2):
        spark.createDataFrame(rows, "athlete_id bigint, ci bigint, cj bigint").write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("athlete_id bigint, ci bigint, cj bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, run(jobs.new_cells(source), f"{tmp_path}/cells").collect())) == sorted(set(rows))


def test_upsert(spark, tmp_path):
    rows = [(1, 10, 1, "a"), (1, 12, 1, "b"), (2, 1, 1, "c"), (1, 12, 2, "d")]
    df = spark.createDataFrame(rows, "key bigint, fetched_at bigint, version bigint, payload string")
    for k in range(4):
        df.where(F.lit(k) == F.when(F.col("payload") == "a", 0).when(F.col("payload") == "b", 1).when(F.col("payload") == "c", 2).otherwise(3)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = source.writeStream.foreachBatch(jobs.upsert_into(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = max(int(p.name) for p in (tmp_path / "out").iterdir())
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/{last}").collect())) == sorted(map(tuple, jobs.newest(df).collect()))


RIDES = "athlete_id bigint, start_ts timestamp, distance_m double"
NOON = datetime(2024, 5, 1, 12)
#: One file a batch; the second run begins with the third. The last file but one holds rides of a day that the watermark had passed before the batch began.
FILES = [[(1, NOON, 10.0), (1, NOON, 5.0), (2, NOON, 1.0)], [(1, NOON + timedelta(hours=5), 7.0), (1, NOON + timedelta(days=1), None)], [(2, NOON + timedelta(hours=1), 2.0), (1, NOON + timedelta(days=4), 3.0)], [(1, NOON + timedelta(days=4), 4.0)], [(1, NOON, 100.0), (3, NOON, 50.0)], [(9, NOON + timedelta(days=20), 0.0)]]


def rides_in(spark, path, files):
    for rows in files:
        spark.createDataFrame(rows, RIDES).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken by age


def into(stream, path):
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return stream.sparkSession.read.parquet(f"{path}/out")


def test_ride_totals_with_late_rows_and_a_restart(spark, tmp_path):
    """Days come out once, complete without what was late; the second run goes on from the first one's state."""
    source = lambda: spark.readStream.schema(RIDES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rides_in(spark, f"{tmp_path}/in", FILES[:2])
    into(jobs.ride_totals(source()), tmp_path)
    rides_in(spark, f"{tmp_path}/in", FILES[2:])
    got = sorted(tuple(r) for r in into(jobs.ride_totals(source()), tmp_path).select("athlete_id", "day", "rides", "distance_m").collect())
    day = lambda k: date(2024, 5, 1) + timedelta(days=k)
    assert got == [(1, day(0), 3, 22.0), (1, day(1), 1, None), (1, day(4), 2, 7.0), (2, day(0), 2, 3.0)]


def test_day_totals_from_timers(spark, tmp_path):
    """A state of our own gives the same days, each once, when its timer is up; a restart loses nothing."""
    pytest.importorskip("google.protobuf")
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = lambda: spark.readStream.schema(RIDES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        rides_in(spark, f"{tmp_path}/in", FILES[:2])
        into(jobs.day_totals(source()), tmp_path)
        rides_in(spark, f"{tmp_path}/in", FILES[2:])
        got = sorted(tuple(r) for r in into(jobs.day_totals(source()), tmp_path).select("athlete_id", "day", "rides", "distance_m").collect())
    finally:
        spark.conf.unset(store)
    day = lambda k: date(2024, 5, 1) + timedelta(days=k)
    assert got == [(1, day(0), 3, 22.0), (1, day(1), 1, 0.0), (1, day(4), 2, 7.0), (2, day(0), 2, 3.0)]


def test_cell_visits(spark, tmp_path):
    rows = [(1, 5, 5), (1, 5, 5), (2, 5, 5), (1, 6, 5)]
    for part in range(2):
        spark.createDataFrame(rows, "athlete_id bigint, ci bigint, cj bigint").write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("athlete_id bigint, ci bigint, cj bigint").parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, run(jobs.cell_visits(source), f"{tmp_path}/visits", "update").collect())) == [(1, 5, 5, 4), (1, 6, 5, 2), (2, 5, 5, 2)]
