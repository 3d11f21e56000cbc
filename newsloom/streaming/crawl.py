"""Streaming forms: first sight of urls, and the crawl delay of each domain as keyed state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(urls: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Each url once within the watermark; state older than it is dropped."""
    return urls.withWatermark(at, late).dropDuplicatesWithinWatermark(["url"])


def crawl_delays(responses: DataFrame, first_delay: float = 1.0, floor: float = 300.0) -> DataFrame:
    """(domain, n, delay) after each micro-batch: the fold of operators.frontier.crawl_delay with its value kept as state."""

    def step(key, frames, state: GroupState):
        n, delay = state.get if state.exists else (0, first_delay)
        rows = pd.concat(list(frames)).sort_values("seq")
        for status, wish in zip(rows["status"], rows["retry_after"]):
            n += 1
            if status == 200:
                delay /= 2
            elif status in (429, 503):
                delay = max(2 * delay, 0.0 if pd.isna(wish) else float(wish), floor)
        state.update((n, delay))
        yield pd.DataFrame({"domain": [key[0]], "n": [n], "delay": [delay]})

    return responses.groupBy("domain").applyInPandasWithState(step, "domain string, n long, delay double", "n long, delay double", "update", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str, key: str, order: str, buckets: int = 64):
    """A foreachBatch function that keeps the latest row of each key in a snapshot of buckets: a batch rewrites those it touches, and one that
    is given again does nothing. Read it with keyed.Snapshot(spark, path, key, buckets).read(schema)."""
    from pyspark.sql import functions as F

    from newsloom.sources.keyed import Snapshot

    def write(batch: DataFrame, epoch: int) -> None:
        table = Snapshot(batch.sparkSession, path, key, buckets)
        table.merge(batch, epoch, F.col(order), newest=True)
        table.vacuum(keep=2)

    return write
