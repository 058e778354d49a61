"""Runs of flagged rows in a stream, with state: the same runs however the stream is cut into micro-batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import timeops

#: keeps the state; the default provider can't hold lists and timers
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = T.StructType([T.StructField("at", T.LongType()), T.StructField("on", T.BooleanType())])
OPEN = T.StructType([T.StructField("start", T.LongType()), T.StructField("last", T.LongType()), T.StructField("n", T.LongType())])


class RunFinder(StatefulProcessor):
    """Rows wait until the watermark has passed them, are then taken in the order of time, and close or go on with the
    open run. Timers take rows and close runs of keys that get no more rows."""

    def __init__(self, keys: Sequence[str], min_periods: int, gap_us: int):
        self.keys, self.min_periods, self.gap_us = list(keys), min_periods, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(at), bool(on)) for p in rows for at, on in zip(p["at"], p["flagged"], strict=True)]
        yield from self._take(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._take(key, [], timerValues)

    def close(self) -> None:
        pass

    def _take(self, key, new: list, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted([*((r[0], r[1]) for r in self.waiting.get()), *new])
        ready = [r for r in held if r[0] <= now]
        late = held[len(ready) :]
        run = tuple(self.open.get()) if self.open.exists() else None
        done = []
        for at, on in ready:
            if run and (not on or at - run[1] > self.gap_us):
                done.append(run)
                run = None
            if on:
                run = (run[0], at, run[2] + 1) if run else (at, at, 1)
        if run and now - run[1] > self.gap_us:
            done.append(run)
            run = None
        if late:
            self.waiting.put(late)
            self.handle.registerTimer(late[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if run:
            self.open.update(run)
            self.handle.registerTimer((run[1] + self.gap_us) // 1000 + 1)
        else:
            self.open.clear()
        found = [r for r in done if r[2] >= self.min_periods]
        if found:
            out = pd.DataFrame({k: [v] * len(found) for k, v in zip(self.keys, key, strict=True)})
            yield out.assign(start=[r[0] for r in found], last=[r[1] for r in found], n=[r[2] for r in found])


def stream_runs(stream: DataFrame, flag: Column, keys: Sequence[str], ts: str = "ts", min_periods: int = 3, gap: str = "1 day", late: str = "2 hours", tail: str = "INTERVAL '11:59:59' HOUR TO SECOND") -> DataFrame:
    """(keys, start, end, n) of at least min_periods flagged rows in a row of each key; a null flag is false.

    A run ends before a row that isn't flagged, or that comes more than `gap` after its last row; it is sent once the
    watermark shows that it has ended. Rows later than `late` are dropped, rows without a time too. The session needs
    spark.sql.streaming.stateStore.providerClass = PROVIDER.
    """
    gap_us = int(pd.Timedelta(gap) / pd.Timedelta(microseconds=1))
    at = F.col(ts).cast("timestamp")
    src = stream.filter(F.col(ts).isNotNull()).select(*keys, at.alias("seen"), timeops.micros(ts).alias("at"), F.coalesce(flag, F.lit(False)).alias("flagged"))
    schema = T.StructType([*(stream.schema[k] for k in keys), *(T.StructField(n, T.LongType()) for n in ("start", "last", "n"))])
    found = src.withWatermark("seen", late).groupBy(*keys).transformWithStateInPandas(RunFinder(keys, min_periods, gap_us), schema, "Append", "EventTime")
    return found.select(*keys, timeops.from_micros("start").alias("start"), (timeops.from_micros("last") + F.expr(tail)).alias("end"), "n")
