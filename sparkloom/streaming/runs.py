"""Runs that end in time or get stuck, by event time, with timers and a state that holds open runs only."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: transformWithState keeps its state in RocksDB.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_START, _FINISH = 1, 2


class Runs(StatefulProcessor):
    """State of a key: starts without an end yet, the finishes that a start may still come for (those after the watermark), and its timer.

    Frames are taken one by one, in whatever order their rows are. A start is done once a finish within the limit is known, and stuck
    once the watermark is past its limit: then no such finish can come any more. A key has one timer, for its earliest open start.
    """

    def __init__(self, limit: int):
        self.limit = limit  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("runs", "starts array<long>, finishes array<long>, timer long")

    def _read(self) -> tuple[list[int], list[int], int]:
        found = self.state.get() if self.state.exists() else None
        return (list(found[0] or []), list(found[1] or []), found[2] or 0) if found else ([], [], 0)

    def _write(self, starts: list[int], finishes: list[int], timer: int, watermark: int) -> None:
        """Keeps what may still count; ``timer`` is the one that is set now, 0 for none."""
        finishes = finishes[bisect_left(finishes, min([watermark, *starts[:1]])) :]
        wanted = self._due(starts[0]) if starts else 0
        if timer and timer != wanted:
            self.handle.deleteTimer(timer)
        if wanted and timer != wanted:
            self.handle.registerTimer(wanted)
        if starts or finishes:
            self.state.update((starts, finishes, wanted))
        else:
            self.state.clear()

    def _ended(self, start: int, finishes: list[int]) -> bool:
        at = bisect_left(finishes, start)
        return at < len(finishes) and finishes[at] <= start + self.limit

    def _due(self, start: int) -> int:
        return (start + self.limit) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        starts, finishes, timer = self._read()
        for frame in rows:
            at, what = frame["ts"].astype("datetime64[us]").astype("int64").to_numpy(), frame["what"].to_numpy()
            finishes = np.unique(np.concatenate((finishes, at[what == _FINISH]))).astype(np.int64).tolist()
            starts = np.sort(np.concatenate((starts, at[what == _START]))).astype(np.int64).tolist()
        done, left = [], []
        for s in starts:
            (done if self._ended(s, finishes) else left).append(s)
        self._write(left, finishes, timer, timerValues.getCurrentWatermarkInMs() * 1000)
        yield _rows(key, done, "done")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        starts, finishes, _ = self._read()
        now = timerValues.getCurrentWatermarkInMs()
        at = bisect_left(starts, True, key=lambda s: self._due(s) > now)
        self._write(starts[at:], finishes, 0, now * 1000)
        yield _rows(key, starts[:at], "stuck")


def _rows(key: tuple, starts: list[int], status: str) -> pd.DataFrame:
    same = lambda x: pd.Series([x] * len(starts), dtype=object)  # noqa: E731  columns of pandas' own strings aren't taken
    return pd.DataFrame({"key": same(key[0]), "started": pd.Series(starts, dtype="int64"), "status": same(status)})


def stuck_runs(stream: DataFrame, key: str, ts: str, started: Column, finished: Column, minutes: int = 30, late: str = "2 days") -> DataFrame:
    """key, started (microseconds), status: each start with an event that finishes its key's run within the limit is done, else stuck.

    A run is stuck once the watermark, ``late`` behind the latest event of all, has passed its limit; runs that are neither aren't told.
    Rows later than the watermark are dropped, rows without a time or of neither kind too. Equal starts count each.
    """
    stream.sparkSession.conf.set(*PROVIDER)
    events = stream.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.when(started, _START).when(finished, _FINISH).otherwise(0).alias("what"))
    events = events.withWatermark("ts", late).where("what > 0 and ts is not null")
    schema = f"key {stream.schema[key].dataType.simpleString()}, started long, status string"
    return events.groupBy("key").transformWithStateInPandas(Runs(minutes * 60_000_000), schema, "Append", "EventTime")
