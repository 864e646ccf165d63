"""Keyed state over event streams: job states, silent devices, runs of change.

All need the RocksDB state store (``use_rocksdb``) and keep one small state per key.  Input
streams are those of any source with the named columns; event time is a timestamp column
with a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def submitted_once(jobs: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """The first submission of each job id; repeats within the delay are dropped."""
    return jobs.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, key: str, at: str, gap: str, delay: str) -> DataFrame:
    """Spans of a key's events with no pause longer than gap: start, end, count."""
    found = events.withWatermark(at, delay).groupBy(key, F.session_window(at, gap).alias("span")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("span.start").alias("start"), F.col("span.end").alias("end"), "n")


class _JobFold(StatefulProcessor):
    """queued -> running -> a terminal state; a terminal state stays, whatever comes later."""

    def __init__(self, key: str, state: str, order: list[str], start: tuple[str, ...], final: tuple[str, ...]):
        self.key, self.column, self.order, self.start, self.final = key, state, order, start, final

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", StructType([StructField("state", StringType()), StructField("events", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, count = self.state.get() if self.state.exists() else ("queued", 0)
        for part in rows:
            for now in part.sort_values(self.order)[self.column]:
                count += 1
                if state in self.final:
                    continue
                if now in self.start:
                    state = "running"
                elif now in self.final and state == "running":
                    state = now
        self.state.update((state, count))
        yield pd.DataFrame({self.key: [key[0]], "state": [state], "events": [count]})

    def close(self) -> None:
        pass


def job_states(events: DataFrame, key: str, state: str, order: list[str], start: tuple[str, ...], final: tuple[str, ...]) -> DataFrame:
    """Present state of each job after every batch (update mode); events of one batch apply in order."""
    schema = StructType([events.schema[key], StructField("state", StringType()), StructField("events", LongType())])
    return events.groupBy(key).transformWithStateInPandas(_JobFold(key, state, order, start, final), schema, "Update", "None")


class _Silence(StatefulProcessor):
    """A timer per device, moved by each sign; when it fires, the device is lost."""

    def __init__(self, device: str, at: str, seconds: int):
        self.device, self.at, self.seconds = device, at, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", StructType([StructField("at", TimestampType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = max(part[self.at].max() for part in rows)
        if self.seen.exists():
            last = max(last, pd.Timestamp(self.seen.get()[0]))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
        self.seen.update((last.to_pydatetime(),))
        self.handle.registerTimer(int(last.timestamp() * 1000) + 1000 * self.seconds)
        yield from ()  # a sign itself gives no row

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(self.seen.get()[0])
        self.seen.clear()
        yield pd.DataFrame({self.device: [key[0]], "lost_after": [last]})

    def close(self) -> None:
        pass


def lost_devices(beats: DataFrame, device: str, at: str, seconds: int, delay: str) -> DataFrame:
    """Devices from which no sign came for so many seconds of event time, with the time of the last one."""
    schema = StructType([beats.schema[device], StructField("lost_after", TimestampType())])
    return beats.withWatermark(at, delay).groupBy(device).transformWithStateInPandas(_Silence(device, at, seconds), schema, "Append", "EventTime")


class _Runs(StatefulProcessor):
    """The open run of an entity; a run closes when more than ``bridge`` quiet rows follow its last moving row."""

    def __init__(self, entity: str, order: str, value: str, threshold: float, bridge: int, least: int):
        self.entity, self.order, self.value, self.threshold, self.bridge, self.least = entity, order, value, threshold, bridge, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [("idx", LongType()), ("value", DoubleType()), ("first", LongType()), ("last", LongType()), ("n", LongType()), ("open", BooleanType())]
        self.state = handle.getValueState("run", StructType([StructField(n, t) for n, t in fields]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        idx, before, first, last, n, open_ = self.state.get() if self.state.exists() else (-1, None, 0, 0, 0, False)
        closed = []
        for value in pd.concat(list(rows)).sort_values(self.order)[self.value]:
            idx += 1
            moving = before is not None and abs(value - before) > self.threshold
            before = float(value)
            if open_ and idx - last > self.bridge + 1:
                closed.append((first, last, n))
                open_ = False
            if moving:
                first, n = (first, n + 1) if open_ else (idx, 1)
                last, open_ = idx, True
        self.state.update((idx, before, first, last, n, open_))
        kept = [r for r in closed if r[1] - r[0] + 1 >= self.least]
        yield pd.DataFrame({self.entity: [key[0]] * len(kept), "first": [r[0] for r in kept], "last": [r[1] for r in kept], "n": [r[2] for r in kept]})

    def close(self) -> None:
        pass


def motion_runs(events: DataFrame, entity: str, order: str, value: str, threshold: float, bridge: int = 1, least: int = 2) -> DataFrame:
    """Runs of change as they close; an entity's rows must come in order from batch to batch."""
    schema = StructType([events.schema[entity], *[StructField(n, LongType()) for n in ("first", "last", "n")]])
    return events.groupBy(entity).transformWithStateInPandas(_Runs(entity, order, value, threshold, bridge, least), schema, "Append", "None")
