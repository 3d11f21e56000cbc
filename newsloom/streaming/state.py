"""Keyed state with time: fetch schedules whose state ends by timers, and a cache whose entries expire.

Both are folds over the rows of a key in the order of their event times, one micro-batch after the other, and give what a fold over
all rows would. State is in RocksDB, with changes in the checkpoint folder, so a query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

#: Timers and times to live want RocksDB. A state that expires by the clock asks for one more batch without data for ever, so a
#: query that is to end must not run any.
ENDING = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def gathered(frames: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(list(order), kind="stable", ignore_index=True)


class Schedule(StatefulProcessor):
    """The earliest fetch time of each request where fetches of a domain are at least `delay` seconds apart.

    State is the time at which the domain is free again. Once the watermark has passed it, it says nothing any more: a timer drops it, so only
    domains that are busy have any.
    """

    def __init__(self, delay: float):
        self.delay = round(delay * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.free = handle.getValueState("free", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        batch = gathered(rows, "ts", "seq")
        free = self.free.get()[0] if self.free.exists() else None
        n = pd.Series(range(len(batch)), dtype="int64") * self.delay
        ready = (batch["us"] - n).cummax()
        start = (ready if free is None else ready.clip(lower=free)) + n
        end = int(start.iloc[-1]) + self.delay
        self.free.update((end,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(end // 1000 + 1)
        yield pd.DataFrame({"domain": pd.array([_key(key)] * len(batch), "Int64"), "seq": batch["seq"], "start": start})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.free.clear()
        return iter(())

    def close(self) -> None:
        pass


class Cache(StatefulProcessor):
    """Whether each request for what is known of a host has to fetch it: there is nothing yet, or it is `keep` seconds old.

    Age is told by event time. The state itself has a time to live, by the clock, so that hosts which nobody asks for go.
    """

    def __init__(self, keep: float):
        self.keep = round(keep * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.checked = handle.getValueState("checked", "at long", max(1, self.keep // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        batch = gathered(rows, "ts", "seq")
        at = self.checked.get()[0] if self.checked.exists() else None
        fetched = []
        for us in batch["us"]:
            fetched.append(at is None or us >= at + self.keep)
            if fetched[-1]:
                at = int(us)
        if any(fetched):
            self.checked.update((at,))
        yield pd.DataFrame({"host": pd.array([_key(key)] * len(batch), "Int64"), "seq": batch["seq"], "fetched": fetched})

    def close(self) -> None:
        pass


def _grouped(requests: DataFrame, key: str):
    """requests by a long key; no key is a key too, but a null one would be taken for as many keys as it has rows."""
    rows = requests.withColumns({"us": F.unix_micros("ts"), "none": F.col(key).isNull(), key: F.coalesce(F.col(key), F.lit(0).cast("long"))})
    return rows.groupBy(key, "none")


def _key(key: tuple) -> int | None:
    return None if key[1] else int(key[0])


def schedule(requests: DataFrame, delay: float, late: str = "0 seconds") -> DataFrame:
    """(domain, seq, start): start in microseconds, of a stream of requests(domain, seq, ts) that come in the order of ts, but for `late`."""
    return _grouped(requests.withWatermark("ts", late), "domain").transformWithStateInPandas(Schedule(delay), "domain long, seq long, start long", "append", "EventTime")


def cached(requests: DataFrame, keep: float) -> DataFrame:
    """(host, seq, fetched) of a stream of requests(host, seq, ts) that come in the order of ts; one before the last fetch finds it."""
    return _grouped(requests, "host").transformWithStateInPandas(Cache(keep), "host long, seq long, fetched boolean", "append", "ProcessingTime")


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Queries that start herein run with these settings."""
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def available_now(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over all that is there and end; what it has given, in this and earlier runs of the same path."""
    spark = stream.sparkSession
    with settings(spark, **ENDING):
        query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def in_slices(rows: DataFrame, ts: str, n: int, path: str, first: int = 0, last: int | None = None) -> str:
    """rows as files of consecutive spans of time, written one after the other: what a log would give a stream, file by file.

    A span is one file, so that it is one micro-batch: take as many as keep files small.
    """
    low, high = rows.agg(F.min(ts), F.max(ts)).first()
    part = F.least(F.floor((F.unix_micros(ts) - F.unix_micros(F.lit(low))) / (F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)) + 1) * n), F.lit(n - 1)) if low is not None else F.lit(0)
    dealt = rows.withColumn("part", part)
    for k in range(first, n if last is None else last):
        dealt.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
    return path


def files(spark: SparkSession, schema, path: str, per_batch: int = 1) -> DataFrame:
    """A stream of the files of a folder, in the order of their times, so many in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
