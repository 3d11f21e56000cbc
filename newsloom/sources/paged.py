"""A paged endpoint as a Spark data source, batch and stream.

An endpoint is a folder `<endpoint>/index=<i>/type=<t>/page=<n>` of JSON lines, as an index server would give them page by page; several
endpoints may hold the same. A partition is some pages of one index and type. Its task asks for page after page and stops at the
first short one, or where no endpoint has the next; an endpoint that lacks a page or gives what is no JSON is passed over for the
next one. Filters on index, type and page choose what is asked for at all. Paths are any that pyarrow can open on every machine.

Options: endpoints (comma-separated, in order of trial), page_size (records of a full page), per_task (pages of a partition; all pages of an
index and type where it is not given, as only then nothing is asked for behind a short page), most_pages (20 by default, 0: no limit).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

SCHEMA = "index string, type string, page int, record string"
ROWS = 4096


@dataclass
class Pages(InputPartition):
    index: str
    type: str
    pages: tuple[int, ...]


class NoPage(Exception):
    """No endpoint has the page."""


class Endpoint:
    def __init__(self, url: str):
        self.url = url.rstrip("/")
        self.fs, self.base = fs.FileSystem.from_uri(self.url) if ":/" in url else (fs.LocalFileSystem(), self.url)

    def children(self, *parts: str) -> list[str]:
        """What stands behind the = in the names within a folder."""
        found = self.fs.get_file_info(fs.FileSelector("/".join((self.base, *parts)), allow_not_found=True))
        return [f.base_name.split("=", 1)[1] for f in found if "=" in f.base_name and f.type == fs.FileType.Directory]

    def listed(self) -> Iterator[tuple[str, str, list[int]]]:
        for i in self.children():
            for t in self.children(f"index={i}"):
                yield i, t, sorted(map(int, self.children(f"index={i}", f"type={t}")))

    def fetch(self, index: str, kind: str, page: int) -> list[str] | None:
        """The records of a page; None if it is not there or not whole."""
        files = self.fs.get_file_info(fs.FileSelector(f"{self.base}/index={index}/type={kind}/page={page}", allow_not_found=True))
        files = sorted(f.path for f in files if f.is_file and not f.base_name.startswith(("_", ".")))
        if not files:
            return None
        try:
            out = []
            for path in files:
                with self.fs.open_input_stream(path) as stream:
                    lines = stream.read().decode().splitlines()
                for line in filter(None, lines):
                    json.loads(line)
                    out.append(line)
            return out
        except (OSError, ValueError):
            return None


class Client:
    """Pages by way of the first endpoint that gives them."""

    def __init__(self, options: dict):
        self.urls = [u.strip() for u in options["endpoints"].split(",") if u.strip()]
        self.size = int(options.get("page_size", 0))
        self.per_task = int(options.get("per_task", 0))
        self.most = int(options.get("most_pages", 20))

    def endpoints(self) -> list[Endpoint]:
        return [Endpoint(u) for u in self.urls]

    def catalog(self) -> dict[tuple[str, str], list[int]]:
        """The pages that any endpoint lists, by index and type, as far as a search goes."""
        out: dict[tuple[str, str], set[int]] = {}
        for e in self.endpoints():
            for i, t, pages in e.listed():
                out.setdefault((i, t), set()).update(p for p in pages if not self.most or p < self.most)
        return {k: sorted(v) for k, v in sorted(out.items())}

    def read(self, part: Pages | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # what Spark passes where there are no partitions
            return
        endpoints = self.endpoints()
        for page in part.pages:
            rows = next((r for e in endpoints if (r := e.fetch(part.index, part.type, page)) is not None), None)
            if rows is None:
                if any(str(page) in e.children(f"index={part.index}", f"type={part.type}") for e in endpoints):
                    raise NoPage(f"no endpoint gives page {page} of {part.index}, {part.type} whole")
                return
            for k in range(0, len(rows), ROWS):
                some = rows[k : k + ROWS]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([part.index] * n), pa.array([part.type] * n), pa.array([page] * n, pa.int32()), pa.array(some, pa.string())], ["index", "type", "page", "record"])
            if len(rows) < self.size:
                return

    def partitions(self, catalog: dict[tuple[str, str], list[int]]) -> list[Pages]:
        out = []
        for (i, t), pages in catalog.items():
            step = self.per_task or max(1, len(pages))
            out += [Pages(i, t, tuple(pages[k : k + step])) for k in range(0, len(pages), step)]
        return out


TESTS = {
    EqualTo: lambda have, value: have == value, In: lambda have, value: have in value, GreaterThan: lambda have, value: have > value,
    GreaterThanOrEqual: lambda have, value: have >= value, LessThan: lambda have, value: have < value, LessThanOrEqual: lambda have, value: have <= value,
}


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.client, self.tests = Client(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute[0] in ("index", "type", "page"):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def wanted(self, **have) -> bool:
        return all(TESTS[kind](have[name], value) for name, kind, value in self.tests if name in have)

    def partitions(self) -> list[Pages]:
        chosen = {k: [p for p in pages if self.wanted(page=p)] for k, pages in self.client.catalog().items() if self.wanted(index=k[0], type=k[1])}
        return self.client.partitions({k: v for k, v in chosen.items() if v})

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return self.client.read(partition)


class PagedStream(DataSourceStreamReader):
    """Offsets are how many pages of each index and type have been read: pages that come later are the next batch."""

    def __init__(self, options: dict):
        self.client = Client(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {json.dumps(k): len(v) for k, v in self.client.catalog().items()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        new = {k: v[start.get(json.dumps(k), 0) : end.get(json.dumps(k), 0)] for k, v in self.client.catalog().items()}
        return self.client.partitions({k: v for k, v in new.items() if v})

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return self.client.read(partition)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "newsloom_paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def read(spark: SparkSession, endpoints: list[str], **options) -> DataFrame:
    register(spark)
    return spark.read.format("newsloom_paged").options(endpoints=",".join(endpoints), **options).load()


def read_stream(spark: SparkSession, endpoints: list[str], **options) -> DataFrame:
    register(spark)
    return spark.readStream.format("newsloom_paged").options(endpoints=",".join(endpoints), **options).load()


def write(rows: DataFrame, path: str) -> str:
    """rows(index, type, page, ...) as the pages of an endpoint."""
    rows.repartition("index", "type", "page").write.mode("append").partitionBy("index", "type", "page").json(path)
    return path
