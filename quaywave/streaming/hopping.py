"""Overlapping windows over streams: by event time, and by exact sample counts with state, in order of arrival or of time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..ship import ship


def hopping_features(stream: DataFrame, key: str, ts: str, value: str, size: str = "2 seconds", step: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Per key and event-time window: n, mean, deviation, minimum, maximum. Rows later than `late` are dropped by the watermark.

    Windows at a series' ends hold fewer samples; n tells. Works alike on a static table."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    out = rows.groupBy(F.window(ts, size, step).alias("w"), key).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    return out.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "mean", "std", "min", "max")


def counted_windows(stream: DataFrame, key: str, value: str, size: int, step: int) -> DataFrame:
    """key, window_idx, mean, std for every complete window of `size` samples, each `step` samples on, in arrival order.

    State per key: the samples that later windows still need, fewer than size + step, and two counters."""

    def advance(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, skip, index = state.get if state.exists else ([], 0, 0)
        held, out = list(held), []
        for batch in batches:
            fresh = batch[value].tolist()
            drop = min(skip, len(fresh))
            held, skip = held + fresh[drop:], skip - drop
            while len(held) >= size:
                part = pd.Series(held[:size])
                out.append((*name, index, part.mean(), part.std(ddof=0)))
                index += 1
                skip += max(0, step - len(held))
                held = held[step:]
        state.update((held, skip, index))
        yield pd.DataFrame(out, columns=[key, "window_idx", "mean", "std"])

    ship(stream.sparkSession)
    kind = dict(stream.dtypes)[key]
    return stream.select(key, value).groupBy(key).applyInPandasWithState(advance, f"{key} {kind}, window_idx long, mean double, std double", "held array<double>, skip long, idx long", "append", GroupStateTimeout.NoTimeout)


class _InOrder(StatefulProcessor):
    """Holds a key's samples until the watermark has passed them, then cuts them into windows in the order of time."""

    def __init__(self, key: str, size: int, step: int) -> None:
        self.key, self.size, self.step = key, size, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, nth long, value double")
        self.place = handle.getValueState("place", "idx long, skip long, tail array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for frame in rows:
            fresh = list(zip(frame["at"].tolist(), frame["nth"].tolist(), frame["value"].tolist()))
            if fresh:
                self.held.appendList(fresh)
                last = max(fresh[-1][0] if last is None else last, max(x[0] for x in fresh))
        if last is not None:
            self.handle.registerTimer(last // 1000 + 1)
        yield self._cut(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._cut(key, timerValues.getCurrentWatermarkInMs())

    def _cut(self, key, watermark: int) -> pd.DataFrame:
        held = sorted(tuple(x) for x in self.held.get())
        ready = [x for x in held if x[0] <= watermark * 1000]
        out = []
        if ready:
            index, skip, tail = self.place.get() if self.place.exists() else (0, 0, [])
            fresh = [x[2] for x in ready]
            drop = min(skip, len(fresh))
            tail, skip = [*tail, *fresh[drop:]], skip - drop
            while len(tail) >= self.size:
                part = pd.Series(tail[: self.size])
                out.append((*key, index, part.mean(), part.std(ddof=0)))
                index += 1
                skip += max(0, self.step - len(tail))
                tail = tail[self.step :]
            self.place.update((index, skip, tail))
            if len(ready) < len(held):
                self.held.put(held[len(ready) :])
            else:
                self.held.clear()
        return pd.DataFrame(out, columns=[self.key, "window_idx", "mean", "std"])


def ordered_windows(stream: DataFrame, key: str, ts: str, nth: str, value: str, size: int, step: int, late: str = "10 seconds") -> DataFrame:
    """counted_windows in order of (ts, nth) instead of arrival: key, window_idx, mean, std.

    Samples wait until the watermark, `late` behind the newest, has passed them; those that come later still are
    dropped. State per key: what waits, fewer than size + step samples that later windows need, and two counters. The
    session needs the state store of ordered_state(). ts: a timestamp; nth: a long that tells samples of one time apart."""
    ship(stream.sparkSession)
    rows = stream.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).withWatermark(ts, late)
    rows = rows.select(key, ts, F.unix_micros(ts).alias("at"), F.col(nth).cast("long").alias("nth"), F.col(value).cast("double").alias("value"))
    schema = f"{key} {dict(stream.dtypes)[key]}, window_idx long, mean double, std double"
    return rows.groupBy(key).transformWithStateInPandas(_InOrder(key, size, step), schema, "Append", "EventTime")


@contextmanager
def ordered_state(spark: SparkSession) -> Iterator[None]:
    """Within it, streams that start keep their state where ordered_windows can; the session's setting is restored."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
