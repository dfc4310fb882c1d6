"""Resumable ingest as streams, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def resumable(spark: SparkSession, source: str, schema: T.StructType, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, keys: list[str], files_per_trigger: int | None = None) -> StreamingQuery:
    """Process what is new in a Parquet folder, once: files that the checkpoint knows are skipped, and rows whose keys
    the target holds already are dropped, so a repeated batch after a failure adds nothing.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.sparkSession.sparkContext.setJobDescription(f"ingest batch {batch_id}")
        done = process(batch.dropDuplicates(keys))
        try:
            known = spark.read.parquet(target).select(*keys)
        except Exception as e:
            if getattr(e, "getCondition", lambda: "")() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            done = done.join(known, keys, "left_anti")
        done.write.mode("append").parquet(target)

    return reader.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, on disk and checkpointed by changes; the setting is put back behind it."""
    key, name = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    old = spark.conf.get(key, None)
    spark.conf.set(key, name)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def ingest_once(spark: SparkSession, source: str, schema: T.StructType, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, keys: list[str], files_per_trigger: int | None = None) -> StreamingQuery:
    """Process what is new in a Parquet folder, once for each key, into a folder for each batch (`batch=n`).

    A batch that is repeated after a failure replaces its own folder, so it adds nothing; keys taken before are known to the
    stream's state, so no batch reads the target, and its cost does not grow with it. Null keys are keys like others.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def write(batch: DataFrame, batch_id: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    with rocks(spark):
        return reader.parquet(source).dropDuplicates(keys).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, time: str, length: str, by: str, value: str) -> DataFrame:
    """Counts and sums by event-time window, for tables and streams alike."""
    return events.groupBy(F.window(time, length), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def windowed(events: DataFrame, time: str, length: str, late: str, by: str, value: str) -> DataFrame:
    """event_windows of a stream, dropping what is later than `late` (an extension: nothing before it has windows)."""
    return event_windows(events.withWatermark(time, late), time, length, by, value)


def stop(query: StreamingQuery, grace: float = 60.0) -> bool:
    """Stop a stream after what it works on: waits up to `grace` seconds for it to end by itself; whether it did."""
    ended = bool(query.awaitTermination(grace))
    if not ended:
        query.stop()
    return ended


class _Phases(StatefulProcessor):
    """Holds a key's events until the watermark has passed them, then walks them in order of time."""

    def __init__(self, key: str, n: int):
        self._key, self._n = key, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", "phase int, first timestamp, count int")
        self._waiting = handle.getListState("waiting", "at timestamp, tie bigint, phase int")

    def _wake(self, earliest: datetime) -> None:
        self._handle.registerTimer(int(earliest.replace(tzinfo=UTC).timestamp() * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 - names of the interface
        new = [(at.to_pydatetime(), int(tie), int(phase)) for part in rows for at, tie, phase in zip(part["at"], part["tie"], part["phase"], strict=True)]
        if new:
            self._waiting.appendList(new)
            self._wake(min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        until = datetime.fromtimestamp(timerValues.getCurrentWatermarkInMs() / 1000, UTC).replace(tzinfo=None)
        waiting = sorted(tuple(x) for x in self._waiting.get())
        ready = [x for x in waiting if x[0] <= until]
        phase, first, count = self._open.get() if self._open.exists() else (0, datetime(1970, 1, 1), 0)
        out = []
        for at, _, found in ready:
            if found == phase + 1:
                phase, first = found, at if found == 1 else first
                if found == self._n:
                    out.append((key[0], count, first, at))
                    phase, count = 0, count + 1
        if ready:
            self._open.update((phase, first, count))
            if waiting[len(ready) :]:
                self._waiting.put(waiting[len(ready) :])
                self._wake(waiting[len(ready)][0])
            else:
                self._waiting.clear()
        return iter([pd.DataFrame(out, columns=[self._key, "match", "first", "last"])] if out else ())

    def close(self) -> None:
        pass


def ordered_phases(events: DataFrame, key: str, n: int, late: str) -> DataFrame:
    """As operators.sequence.phase_matches over a stream of (key, phase, at, tie) in any order: (key, match, first, last).

    Events wait until the watermark (`late` behind the latest) has passed them and are then walked by time and tie; later ones
    are dropped. A key holds what waits and its open match, so an idle key holds little. Streams of such state need RocksDB (`rocks`).
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, "phase", "at", "tie").withWatermark("at", late)
    return rows.groupBy(key).transformWithStateInPandas(_Phases(key, n), f"{key} {kind}, match int, first timestamp, last timestamp", "append", "EventTime")


def phases_stream(events: DataFrame, key: str, n: int) -> DataFrame:
    """As operators.sequence.phase_matches over a stream of (key, phase, at) that comes in order: (key, match, t1, tn).

    The state of a key is its open phase, when that match began, and how many are complete.
    """
    kind = events.schema[key].dataType.simpleString()

    def walk(group: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        phase, first, count = state.get if state.exists else (0, 0, 0)
        out = []
        for part in parts:
            for found, at in sorted(zip(part["phase"], part["at"], strict=True), key=lambda x: x[1]):
                if found == phase + 1:
                    phase, first = found, at.value if found == 1 else first
                    if found == n:
                        out.append((group[0], count, pd.Timestamp(first), at))
                        phase, count = 0, count + 1
        state.update((int(phase), int(first), int(count)))
        yield pd.DataFrame(out, columns=[key, "match", "first", "last"])

    rows = events.select(key, "phase", "at")
    return rows.groupBy(key).applyInPandasWithState(walk, f"{key} {kind}, match int, first timestamp, last timestamp", "phase int, first bigint, count int", "append", "NoTimeout")
