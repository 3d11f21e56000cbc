"""The paged data source: what it asks for, where it stops, which endpoint it goes to; and keyed state with time, restarted."""

import os
import random

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

from newsloom.sources import paged, shared
from newsloom.streaming import state


def endpoint(at, pages):
    """pages: {(index, type, page): lines}"""
    for (i, t, p), lines in pages.items():
        folder = f"{at}/index={i}/type={t}/page={p}"
        os.makedirs(folder)
        with open(f"{folder}/part-0.json", "w") as f:
            f.write("".join(line + "\n" for line in lines))
    return str(at)


def lines(i, t, p, n):
    return [f'{{"v":"{i}{t}{p}.{k}"}}' for k in range(n)]


def rows(df):
    return sorted((r["index"], r["type"], r["page"], r["record"]) for r in df.collect())


def whole(*keys, n=3):
    return {k: lines(*k, n) for k in keys}


def test_filters_choose_what_is_asked_for(spark, tmp_path):
    keys = [(i, t, p) for i in ("a", "b") for t in ("html", "feed") for p in range(4)]
    pages = whole(*keys) | {("b", "html", 2): ["{broken"], ("a", "feed", 0): ["{broken"]}
    at = endpoint(tmp_path / "one", pages)
    reader = paged.PagedReader({"endpoints": at, "per_task": "1"})
    left = list(reader.pushFilters([EqualTo(("type",), "html"), In(("index",), ("a", "c")), GreaterThan(("page",), 0), LessThanOrEqual(("page",), 2), StringContains(("record",), "v")]))
    assert [type(f) for f in left] == [StringContains]
    assert [(p.index, p.type, p.pages) for p in reader.partitions()] == [("a", "html", (1,)), ("a", "html", (2,))]
    # pages that no filter wants are broken: they are not opened
    df = paged.read(spark, [at], per_task=1, page_size=3).where("type = 'html' and index = 'a' and record like '%.1%'")
    assert [(p, r) for _, _, p, r in rows(df)] == [(p, f'{{"v":"ahtml{p}.1"}}') for p in range(4)]
    assert df.rdd.getNumPartitions() == 4
    # schemes work as plain paths do
    assert rows(paged.read(spark, [f"file://{at}"]).where("type = 'html' and index = 'a'"))[0][:3] == ("a", "html", 0)


def test_a_short_page_is_the_last(spark, tmp_path):
    pages = whole(("a", "t", 0), ("a", "t", 1)) | {("a", "t", 2): lines("a", "t", 2, 2), ("a", "t", 3): ["{never opened"]}
    at = endpoint(tmp_path / "one", pages)
    assert [x[2] for x in rows(paged.read(spark, [at], page_size=3))] == [0] * 3 + [1] * 3 + [2] * 2
    assert [x[2] for x in rows(paged.read(spark, [at], page_size=3, most_pages=2))] == [0] * 3 + [1] * 3


def test_the_next_endpoint_has_what_one_lacks(spark, tmp_path):
    keys = [("a", "t", p) for p in range(4)]
    one = endpoint(tmp_path / "one", whole(keys[0], keys[3]) | {keys[1]: ["{half a rec"]})
    two = endpoint(tmp_path / "two", whole(keys[1], keys[2]) | {keys[3]: ["{broken"]})
    want = sorted((*k, r) for k in keys for r in lines(*k, 3))
    assert rows(paged.read(spark, [one, two], page_size=3)) == want
    assert rows(paged.read(spark, [str(tmp_path / "nowhere"), two, one], page_size=3, per_task=1)) == want
    assert rows(paged.read(spark, [str(tmp_path / "nowhere")])) == []
    with pytest.raises(PythonException, match="no endpoint gives page 1"):
        paged.read(spark, [one], page_size=3).collect()


def test_a_stream_goes_on_with_new_pages(spark, tmp_path):
    at, out = endpoint(tmp_path / "one", whole(("a", "t", 0), ("a", "t", 1))), str(tmp_path / "out")
    run = lambda: rows(state.available_now(paged.read_stream(spark, [at], page_size=3), out))
    assert len(run()) == 6 and len(run()) == 6
    endpoint(tmp_path / "one", whole(("a", "t", 2), ("b", "t", 0)))
    got = run()
    assert got == sorted((*k, r) for k in [("a", "t", 0), ("a", "t", 1), ("a", "t", 2), ("b", "t", 0)] for r in lines(*k, 3))


@pytest.fixture(scope="module")
def requests(spark):
    rng = random.Random(12)
    made = [(rng.choice([1, 1, 1, 2, 3, None]), k, round(rng.random() * 1e9)) for k in range(240)] + [(4, 900 + k, 5_000_000) for k in range(8)]
    df = spark.createDataFrame(made, "domain long, seq long, us long").withColumn("ts", F.timestamp_micros("us")).drop("us")
    return sorted(made, key=lambda r: (r[2], r[1])), shared.cut(df)


@pytest.mark.parametrize("stops", [[0, 6], [0, 2, 3, 6]])
def test_streams_equal_folds_wherever_they_stop(spark, tmp_path, requests, stops):
    made, df = requests
    free, checked, starts, fetched = {}, {}, {}, {}
    for key, seq, us in made:
        starts[seq] = max(us, free.get(key, us))
        free[key] = starts[seq] + 4_000_000
        fetched[seq] = key not in checked or us >= checked[key] + 90_000_000
        if fetched[seq]:
            checked[key] = us
    log = str(tmp_path / "log")
    for first, last in zip(stops, stops[1:]):
        state.in_slices(df, "ts", 6, log, first, last)
        one = state.available_now(state.schedule(state.files(spark, df.schema, log), 4.0), str(tmp_path / "one"))
        two = state.available_now(state.cached(state.files(spark, df.schema, log).withColumnRenamed("domain", "host"), 90.0), str(tmp_path / "two"))
    assert {r.seq: r.start for r in one.collect()} == starts
    assert {r.seq: r.fetched for r in two.collect()} == fetched
    held = spark.read.format("statestore").option("path", str(tmp_path / "one" / "checkpoint")).option("stateVarName", "free").load()
    # domains that were free again when the watermark last rose have no state: a timer has dropped it
    assert 4 not in {r.key.domain for r in held.select("key").collect()}
