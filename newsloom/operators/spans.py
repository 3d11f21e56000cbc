"""Places of rows in the order of their key, told in spans: a hot key is the work of many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.sources.shared import cut


def placed(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with __place, the number of rows of the key before, and __span, a stretch of the key's rows that one task has sorted.

    Rows are sorted by ranges over all tasks; a place is the one in its task, less that of the key's first row there, plus what
    earlier tasks have of the key. Rows that the order does not tell apart keep the one that they are stored in.
    """
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    at = F.monotonically_increasing_id()
    ranged = cut(ranged.withColumn("__span", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    here = Window.partitionBy("__key").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(F.col(key).alias("__key"), "__span").agg(F.min("__at").alias("__low"), F.count(F.lit(1)).alias("__n"))
    starts = starts.select("__key", F.col("__span").alias("__s"), (F.coalesce(F.sum("__n").over(here), F.lit(0)) - F.col("__low")).alias("__shift"))
    out = ranged.join(starts, ranged[key].eqNullSafe(starts["__key"]) & (ranged["__span"] == starts["__s"]))
    return out.withColumn("__place", F.col("__at") + F.col("__shift")).drop("__key", "__s", "__shift", "__at")


def running_max(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows of placed() with the largest value of the key up to each: within spans, and of the spans before, which are a row each."""
    w = Window.partitionBy(key, "__span").orderBy("__place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = Window.partitionBy("__key").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(F.col(key).alias("__key"), F.col("__span").alias("__s")).agg(F.max(value).alias("__top"))
    tops = tops.select("__key", "__s", F.max("__top").over(here).alias("__before"))
    within = rows.withColumn("__within", F.max(value).over(w))
    out = within.join(tops, within[key].eqNullSafe(tops["__key"]) & (within["__span"] == tops["__s"]))
    return out.withColumn(name, F.greatest("__within", "__before")).drop("__key", "__s", "__before", "__within")
