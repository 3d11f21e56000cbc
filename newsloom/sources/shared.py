"""Tables in the folder that all executors share, to cut lineage between rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where none is set and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="newsloom_")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/newsloom-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there. Tables that df was made from and that reading()
    has named are deleted."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    release(*getattr(df, "_newsloom_reads", ()))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._newsloom_path = path
    return out


def reading(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, with the tables of cut() that only it reads, for whoever writes it."""
    df._newsloom_reads = tables
    return df


def release(*frames: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_newsloom_path", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
