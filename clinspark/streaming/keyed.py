"""Keyed state of streams: a rolling buffer of each key's last rows, and a learner that fits again when enough is new or time is up.

Both are stateful processors: the state of a key is a list or a value in the state store, so it is as large as the buffer and
outlives restarts with the checkpoint. Their rows are appended to a table in the shared folder; the last row of a key holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clinspark.sources.store import shared_dir
from clinspark.streaming.ingest import event_stream

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEPT = "ts timestamp, event_id long, value double"
BUFFER = "user_id long, seen long, kept array<struct<ts:timestamp,event_id:long,value:double>>"
FITTED = "event_type string, fits long, n long, mean double, spread double, by string"


class LastRows(StatefulProcessor):
    """Of each key the last ``keep`` rows by time and id, in order; a row for each key and batch that brought any."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", KEPT)
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        n = self.seen.get()[0] if self.seen.exists() else 0
        for part in rows:
            n += len(part)
            held += list(zip(part["ts"], part["event_id"].tolist(), part["value"].tolist(), strict=True))
            held = sorted(held, key=lambda r: (r[0], r[1]))[-self.keep :]  # never more than a batch beyond the buffer
        self.kept.put(held)
        self.seen.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "seen": [n], "kept": [[{"ts": t, "event_id": i, "value": v} for t, i, v in held]]})

    def close(self) -> None:
        pass


class Refit(StatefulProcessor):
    """Number, mean and spread of a key's values, given out when ``every`` rows are new, or ``wait`` ms of event time after the last fit."""

    def __init__(self, every: int, wait: int):
        self.every, self.wait = every, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, total double, squares double, fresh long, fits long, due long")

    def _fit(self, key: Any, n: int, total: float, squares: float, fits: int, by: str) -> pd.DataFrame:
        mean = total / n
        return pd.DataFrame({"event_type": [key[0]], "fits": [fits], "n": [n], "mean": [mean], "spread": [max(squares / n - mean * mean, 0.0) ** 0.5], "by": [by]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, total, squares, fresh, fits, due = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0, 0, 0, 0)
        latest = 0
        for part in rows:
            values = part["value"].dropna()
            n, fresh = n + len(values), fresh + len(values)
            total, squares = total + float(values.sum()), squares + float((values * values).sum())
            latest = max(latest, int(part["ts"].max().timestamp() * 1000))
        if fresh >= self.every:
            fresh, fits = 0, fits + 1
            if due:
                self.handle.deleteTimer(due)
                due = 0
            yield self._fit(key, n, total, squares, fits, "rows")
        elif fresh and not due:
            due = max(latest, timerValues.getCurrentWatermarkInMs()) + self.wait
            self.handle.registerTimer(due)
        self.sums.update((n, total, squares, fresh, fits, due))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        n, total, squares, fresh, fits, _ = self.sums.get()
        self.sums.update((n, total, squares, 0, fits + bool(fresh), 0))
        if fresh:
            yield self._fit(key, n, total, squares, fits + 1, "time")

    def close(self) -> None:
        pass


def _run(spark: SparkSession, out: DataFrame, schema: str, folder: str) -> DataFrame:
    out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def _with_provider(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _folder(spark: SparkSession, folder: str | None, name: str) -> str:
    return folder or f"{shared_dir(spark)}/clinspark-{name}-{uuid.uuid4().hex}"


def last_rows(spark: SparkSession, events: DataFrame, keep: int, folder: str | None = None) -> DataFrame:
    """user_id, seen and kept (the last ``keep`` rows by ts and event_id) of a stream of events (user_id, event_id, ts, value).

    Runs over what is there; with the same ``folder`` a later run goes on where the last one ended. Rows may come in any
    order: a late one takes its place, if that is still in the buffer.
    """
    _with_provider(spark)
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = rows.groupBy("user_id").transformWithStateInPandas(LastRows(keep), BUFFER, "append", "none")
    return _run(spark, out, BUFFER, _folder(spark, folder, "buffer")).groupBy("user_id").agg(F.max("seen").alias("seen"), F.max_by("kept", "seen").alias("kept"))


def refits(spark: SparkSession, events: DataFrame, every: int, wait_ms: int, late: str = "1 day", folder: str | None = None) -> DataFrame:
    """Every fit of a learner by event_type: its number, n, mean and spread of all values so far, and what called for it (rows or time).

    Rows later than ``late`` are dropped, as their time is over.
    """
    _with_provider(spark)
    rows = events.select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value").where("event_type IS NOT NULL").withWatermark("ts", late)
    out = rows.groupBy("event_type").transformWithStateInPandas(Refit(every, wait_ms), FITTED, "append", "eventTime")
    return _run(spark, out, FITTED, _folder(spark, folder, "refits"))


def buffered_events(spark: SparkSession, sf_dir: str, keep: int = 5) -> DataFrame:
    return last_rows(spark, event_stream(spark, sf_dir), keep)
