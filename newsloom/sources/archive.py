"""Archive index records: index files, what there is to fetch of them, and the queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "url string, digest string, mime string, status int, timestamp string"


def read_index(spark: SparkSession, paths: list[str], mimes: list[str] | None = None, statuses: list[int] | None = None) -> DataFrame:
    """(origin, url, digest, mime, status, timestamp): the records of index files, one JSON object a line, by any path that
    Spark reads; files are split among tasks, broken lines give no record, origin is the file."""
    rows = spark.read.schema(SCHEMA + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(paths)
    rows = rows.select(F.input_file_name().alias("origin"), *[c.split()[0] for c in SCHEMA.split(", ")], "_broken").where("_broken is null").drop("_broken")
    if mimes is not None:
        rows = rows.where(F.col("mime").isin(*mimes))
    return rows if statuses is None else rows.where(F.col("status").isin(*statuses))


def parts(indexes: DataFrame, mimes: list[str]) -> DataFrame:
    """(source, mime, page): what there is to fetch of indexes(source, pages): each page of each index for each type."""
    each = indexes.select("source", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page"))
    return each.select("source", F.explode(F.array(*map(F.lit, mimes))).alias("mime"), "page")


def resume(rest: DataFrame, done: DataFrame, offset: int = 0) -> DataFrame:
    """What is left of rest(page, url, ...) after a stop: pages from offset on, without the urls of done(url)."""
    return rest.where(F.col("page") >= offset).join(done.select("url"), "url", "left_anti")


def captures(index: DataFrame, pattern: str, mimes: list[str], year: str | None = None) -> DataFrame:
    """Successful captures of urls that contain pattern, one a digest: the earliest."""
    rows = index.where((F.col("status") == 200) & F.col("mime").isin(*mimes) & F.contains("url", F.lit(pattern)))
    if year:
        rows = rows.where(F.startswith("timestamp", F.lit(year)))
    return rows.groupBy("digest").agg(F.min_by(F.struct("url", "mime", "timestamp"), F.struct("timestamp", "url")).alias("r")).select("digest", "r.*")


def totals(pages: DataFrame) -> DataFrame:
    """(source, items): pages times page size of each index."""
    return pages.groupBy("source").agg((F.max("pages") * F.max("page_size")).alias("items"))


def page(rows: DataFrame, offset: int, limit: int, *order: str) -> DataFrame:
    """One page of rows in a stated order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def shuffled(rows: DataFrame, seed: int, *key: str) -> DataFrame:
    """Rows with a place drawn by a hash of seed and key: a random order that reruns agree on."""
    return rows.withColumn("draw", F.xxhash64(F.lit(seed), *key)).orderBy("draw", *key)
