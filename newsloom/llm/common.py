"""Helpers shared by the training-data operators: shared tables, Arrow text slices, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.sources.shared import cut, reading, release

#: Bytes of text that one numpy pass holds; bounds the memory of a Python worker.
SLICE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def smallest_hashed(df: DataFrame, limit: int, *key: str) -> DataFrame:
    """The rows of the smallest hashes of key, `limit` at most.

    Where there are many more, rows above a hash that twice as many are expected below are left out before tasks
    hand theirs to one task to be sorted; if fewer than `limit` were below it, nothing is left out.
    """
    n, h = df.count(), F.xxhash64(*key)
    if n > 4 * limit:
        low = df.where(h < int(-(2**63) + 2**64 * (2 * limit + 1000) / n)) if n > 2 * limit + 1000 else df
        if low.count() >= limit:
            df = low
    return df.orderBy(h, *key).limit(limit)


def schema_of(kind: T.DataType, rest: str, name: str = "id") -> T.StructType:
    """A schema of one column of any type, then those of a DDL string."""
    return T.StructType([T.StructField(name, kind), *T.StructType.fromDDL(rest).fields])


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def slices(batches, rows: int = 1024):
    """The rows of batches, few at a time: Python objects are made of no more."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def utf8_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, last row, bytes, offsets) for runs of whole rows of about limit bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    blob = column.buffers()[2]
    data = np.frombuffer(blob, dtype=np.uint8) if blob is not None and blob.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Memory(dict):
    """What make() gives for a key, remembered for the keys met last: when `keep` new ones have come, those
    not asked for since the time before are forgotten."""

    def __init__(self, make, keep: int):
        super().__init__()
        self.make, self.keep, self.old = make, keep, {}

    def __missing__(self, key):
        if len(self) >= self.keep:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over edges i-j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(src, dst): label is the smallest node of its component.

    Each round maps every node to the smallest of its neighbourhood, follows that map once more and
    contracts the graph by it; rounds end when no edge is left. All state is in tables of the shared folder.
    """
    spark = edges.sparkSession
    live = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))
    mapped = None
    while not live.isEmpty():
        low = (
            live.select(F.col("dst").alias("node"), F.col("src").alias("to"))
            .union(live.select("src", "src"))
            .groupBy("node").agg(F.min("to").alias("to"))
        )
        low = cut(low)
        hop = low.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = cut(low.join(hop, "to").select("node", F.col("far").alias("to")))
        a, b = step.toDF("src", "a"), step.toDF("dst", "b")
        pairs = live.join(a, "src").join(b, "dst").where("a <> b")
        nxt = cut(pairs.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.lit(1).alias("one")).select("src", "dst"))
        if mapped is None:
            new = step
        else:
            after = step.toDF("to", "far")
            new = cut(mapped.join(after, "to", "left").select("node", F.coalesce("far", "to").alias("to")))
            release(mapped, step)
        release(low, live)
        mapped, live = new, nxt
    if mapped is None:
        return spark.createDataFrame([], "node long, label long")
    # a label is the smallest of its component already: every map goes to a smaller node and the last contraction has no edge
    out = mapped.select("node", F.col("to").alias("label"))
    out._newsloom_path = mapped._newsloom_path
    return out
