"""State kept by key in the shared folder: bucketed tables, growing key sets, and snapshots merged bucket by bucket.

What is stored is laid out by a hash of its key once, so that later joins move only the new rows, and merges rewrite only the buckets
that they touch. A version becomes visible by the rename of one small file; until then readers see the one before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.frontier import latest
from newsloom.sources.shared import fresh_path


class Files:
    """A folder by any path that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str = "") -> list[str]:
        where = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The file appears whole or not at all; False of the rename means that another has put it first."""
        half = self._path(f"{name}.{uuid.uuid4().hex}")
        self.fs.mkdirs(half.getParent())
        stream = self.fs.create(half, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(half, self._path(name)):
            self.fs.delete(half, False)


def bucketed(df: DataFrame, *key: str, buckets: int, path: str | None = None) -> DataFrame:
    """df as a table clustered by key: joins and aggregations on key move no row of it."""
    spark, name = df.sparkSession, f"newsloom_{uuid.uuid4().hex}"
    df.repartition(buckets, *key).write.bucketBy(buckets, *key).sortBy(*key).option("path", path or fresh_path(spark)).mode("overwrite").saveAsTable(name)
    out = spark.table(name)
    out._newsloom_table = name
    return out


def attached(spark: SparkSession, path: str, columns: str, key: str, buckets: int) -> DataFrame:
    """A table that bucketed() wrote, perhaps in a session before."""
    name = f"newsloom_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    out = spark.table(name)
    out._newsloom_table = name
    return out


def detach(*tables: DataFrame) -> None:
    """Forget the names of tables; their files stay with whoever owns the folder."""
    for t in tables:
        if name := getattr(t, "_newsloom_table", None):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


class KeySet:
    """A growing set of string keys: a base clustered by key, and what has been added since.

    Additions are folded into a new base when they reach its size, so a key is written again a number of times that is the
    logarithm of the set's growth; a join with the set moves the additions only. Step numbers name what is stored, so a
    step that is done again replaces what it left before.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int):
        self.spark, self.files, self.key, self.buckets, self._base = spark, Files(spark, path), key, buckets, {}

    def _steps(self, kind: str, upto: int) -> list[int]:
        found = [int(n.split("-")[1]) for n in self.files.names() if n.startswith(kind + "-") and self.files.exists(f"{n}/_SUCCESS")]
        return sorted(s for s in found if s <= upto)

    def add(self, keys: DataFrame, step: int) -> None:
        """keys that the set lacks."""
        keys.select(self.key).write.mode("overwrite").parquet(f"{self.files.path}/add-{step}")

    def parts(self, upto: int) -> list[DataFrame]:
        bases = self._steps("base", upto)
        since = bases[-1] if bases else -1
        out = [self.base(since)] if bases else []
        added = [f"{self.files.path}/add-{s}" for s in self._steps("add", upto) if s > since]
        return out + ([self.spark.read.schema(f"{self.key} string").parquet(*added)] if added else [])

    def base(self, step: int) -> DataFrame:
        if step not in self._base:
            detach(*self._base.values())
            self._base = {step: attached(self.spark, f"{self.files.path}/base-{step}", f"{self.key} string", self.key, self.buckets)}
        return self._base[step]

    def absent(self, rows: DataFrame, upto: int) -> DataFrame:
        """Rows whose key was not added in steps up to that one."""
        for part in self.parts(upto):
            rows = rows.join(part, self.key, "left_anti")
        return rows

    def fold(self, upto: int) -> bool:
        """Merge the additions into a new base, if they have its size or more; whether it was done."""
        bases = self._steps("base", upto)
        parts = self.parts(upto)
        if not parts or bases and (len(parts) == 1 or parts[1].count() < parts[0].count()):
            return False
        whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        detach(bucketed(whole, self.key, buckets=self.buckets, path=f"{self.files.path}/base-{upto}"))
        for old in bases[:-1]:  # the last one may still be read by what was asked of it
            self.files.delete(f"base-{old}")
        return True


class Snapshot:
    """The latest row of each key, in buckets by a hash of the key; a merge rewrites only the buckets that it touches.

    data/<version>/bucket=<b> holds what a version wrote; versions/<version> says for every bucket which version holds it. A merge that is
    repeated, with the version it had, does nothing once it has succeeded, and what a failed one left is overwritten.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.files, self.key, self.buckets = spark, Files(spark, path), key, buckets

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.files.names("versions") if n.isdigit())

    def held(self, version: int | None = None) -> dict[str, int]:
        """The version that holds each bucket, as of a version, by default the last."""
        past = self.versions()
        return json.loads(self.files.read(f"versions/{past[-1] if version is None else version}")) if past else {}

    def read(self, schema: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, of all buckets or of some of them."""
        paths = [f"{self.files.path}/data/{v}/bucket={b}" for b, v in self.held(version).items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def merge(self, delta: DataFrame, version: int, *order: Column, newest: bool = False) -> list[int]:
        """Rows of delta replace those of their keys, the last of delta wins; with `newest` only where they come later in the order.
        Returns the buckets that were rewritten, none if version is there."""
        if version in self.versions():
            return []
        held, columns = self.held(), delta.columns
        new = latest(delta, [self.key], *order).withColumn("bucket", self.bucket()).select("bucket", *columns)
        part = f"{self.files.path}/new-{version}"
        new.write.mode("overwrite").parquet(part)  # the delta is read once, then known by its buckets
        new = self.spark.read.schema(new.schema).parquet(part)
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # as many as there are buckets at most
        if touched:
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in delta.schema.fields)
            old = self.read(schema, only=touched).withColumn("bucket", self.bucket())
            if newest:
                rows = latest(old.unionByName(new), [self.key], *order)
            else:
                known = new.select(F.col(self.key).alias("__key"))
                rows = old.join(known, old[self.key].eqNullSafe(known["__key"]), "left_anti").unionByName(new)
            rows.select("bucket", *columns).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.files.path}/data/{version}")
        self.files.put(f"versions/{version}", json.dumps(held | {str(b): version for b in touched}))
        self.files.delete(f"new-{version}")
        return touched

    def vacuum(self, keep: int = 2) -> int:
        """Delete what the last `keep` versions do not read; how many buckets went."""
        past = self.versions()
        live = {(str(v), b) for at in past[-keep:] for b, v in self.held(at).items()}
        gone = 0
        for v in self.files.names("data"):
            for name in self.files.names(f"data/{v}"):
                if name.startswith("bucket=") and (v, name[7:]) not in live and int(v) <= past[-1]:
                    self.files.delete(f"data/{v}/{name}")
                    gone += 1
        for v in past[:-keep]:
            self.files.delete(f"versions/{v}")
        return gone
