"""Crawl events as a stream: one row a tagged event, uniqueness, progress, windows, per-host state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = ["started", "page_fetched", "page_error", "page_skipped", "link_discovered", "progress", "message", "paused", "resumed", "cancelled", "finished"]

EVENT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("url", T.StringType()),
        T.StructField("statusCode", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("message", T.StringType()),
    ]
)


def is_event(kind: str | Column) -> Column:
    return (F.col(kind) if isinstance(kind, str) else kind).isin(TAGS)


def unique(stream: DataFrame, keys: list[str], time: str | None = None, late: str = "1 day") -> DataFrame:
    """First row of each key; with an event time, keys are forgotten after `late`."""
    if time:
        return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def counts(stream: DataFrame, kind: str = "type") -> DataFrame:
    """Running counts of each kind (output mode update or complete)."""
    return stream.groupBy(kind).agg(F.count("*").alias("rows"))


def windowed(stream: DataFrame, time: str, size: str, slide: str | None = None, late: str = "10 minutes", by: list[str] = ()) -> DataFrame:
    """Counts by window of event time; rows later than `late` are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("rows")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "rows")


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    w = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("rows")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "rows")


def throttle(stream: DataFrame, host: str, throttled: str, time: str) -> DataFrame:
    """(host, throttle, delay_s) after each batch of a host's rows: the backoff counter as state by host."""
    schema = "host string, throttle int, delay_s double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for b in batches:
            for hit in b.sort_values(time)[throttled]:
                n = n + 1 if hit else max(0, n - 1)
        state.update((n,))
        yield pd.DataFrame({"host": [key[0]], "throttle": [n], "delay_s": [float(min(2 ** (n - 1), 30)) if n else 0.0]})

    return stream.groupBy(host).applyInPandasWithState(step, schema, "n int", "update", "NoTimeout")


def deliver(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """The stream's batches to a callback, with a checkpoint to resume from."""
    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


class Session:
    """Handle on a running stream: snapshot, cancel, join; cancelled stays known."""

    def __init__(self, query):
        self.query, self.cancelled = query, False

    def snapshot(self) -> dict:
        p = self.query.lastProgress
        return {"phase": "cancelled" if self.cancelled else "running" if self.query.isActive else "finished", "rows": (p or {}).get("numInputRows", 0) if isinstance(p, dict) else getattr(p, "numInputRows", 0) or 0}

    def cancel(self) -> None:
        self.cancelled = True
        self.query.stop()

    def join(self, timeout: float | None = None) -> bool:
        return bool(self.query.awaitTermination(timeout)) if timeout else (self.query.awaitTermination() or True)
