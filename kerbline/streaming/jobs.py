"""Streaming forms of the batch operators: cells never seen before, daily ride totals, newest row of each key."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

DAY_MS = 24 * 3600 * 1000


def new_cells(cells: DataFrame) -> DataFrame:
    """Only the first arrival of each athlete's cell; the state grows with coverage on purpose."""
    return cells.select("athlete_id", "ci", "cj").dropDuplicates(["athlete_id", "ci", "cj"])


def ride_totals(rides: DataFrame, late: str = "1 day") -> DataFrame:
    """Rides and metres of each athlete and day (start_ts, distance_m), final once the watermark has passed."""
    days = rides.withWatermark("start_ts", late).groupBy(F.window("start_ts", "1 day"), "athlete_id")
    return days.agg(F.count("*").alias("rides"), F.sum("distance_m").alias("distance_m")).select(F.to_date("window.start").alias("day"), "athlete_id", "rides", "distance_m")


def cell_visits(cells: DataFrame) -> DataFrame:
    """Running number of arrivals of each athlete's cell, for update mode: a row for each cell that a batch changed; 1 where it is new."""
    return cells.groupBy("athlete_id", "ci", "cj").agg(F.count("*").alias("visits"))


class DayTotals(StatefulProcessor):
    """Rides and metres of a key (athlete_id, day), kept until the watermark has passed the day."""

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "rides bigint, distance_m double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        end = int(datetime.combine(key[1], datetime.min.time(), UTC).timestamp() * 1000) + DAY_MS
        rides, metres = 0, 0.0
        for row in rows:
            rides, metres = rides + 1, metres + (row.distance_m or 0.0)
        old = self.sums.get() if self.sums.exists() else (0, 0.0)
        if not self.sums.exists():
            self.handle.registerTimer(end)
        self.sums.update((old[0] + rides, old[1] + metres))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rides, metres = self.sums.get()
        self.sums.clear()
        yield Row(athlete_id=key[0], day=key[1], rides=rides, distance_m=metres)

    def close(self) -> None:
        pass


def day_totals(rides: DataFrame, late: str = "1 day") -> DataFrame:
    """athlete_id, day, rides, distance_m: like ride_totals(), from a state of our own with a timer for each day, at which its state goes. Rides
    older than the watermark are late and not counted; unknown distances are 0. Needs the RocksDB state store."""
    days = rides.withWatermark("start_ts", late).withColumn("day", F.to_date("start_ts"))
    schema = "athlete_id bigint, day date, rides bigint, distance_m double"
    return days.groupBy("athlete_id", "day").transformWithState(DayTotals(), schema, "Append", "EventTime")


def newest(rows: DataFrame) -> DataFrame:
    """The newest row of each key (key, fetched_at, version, payload)."""
    return rows.groupBy("key").agg(F.max(F.struct("fetched_at", "version", "payload")).alias("x")).select("key", "x.*")


def upsert_into(base: str):
    """A foreachBatch function that keeps a snapshot table under `base`, one folder a batch, so that a repeated batch changes nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        both = batch if epoch == 0 else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{base}/{epoch - 1}"))
        newest(both).write.mode("overwrite").parquet(f"{base}/{epoch}")

    return merge
