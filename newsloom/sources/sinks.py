"""Sinks: appended and overwritten CSV with named columns, JSON state with defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


def overwrite_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_state(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_state(spark: SparkSession, path: str, schema: str, defaults: dict) -> DataFrame:
    df = spark.read.schema(schema).json(path)
    return df.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else c for c in df.columns])


def postcodes(df: DataFrame) -> DataFrame:
    """(postcode): the first column without blanks; empty ones dropped."""
    return df.select(F.replace(F.col(df.columns[0]), F.lit(" "), F.lit("")).alias("postcode")).where("postcode <> ''")
