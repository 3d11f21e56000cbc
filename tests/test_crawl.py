"""Best-first crawls against a plain loop, and state kept by key: snapshots merged by bucket, key sets."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import crawl
from newsloom.plans import catalog
from newsloom.sources import keyed, shared


def loop(start, links, pages, domain, per_domain, batch, retries, rounds):
    """{url: (url_score, page_score, status, retries, met, popped)}, a url at a time."""
    rows = {u: [0.0, None, "unseen", 0, 0, None] for u in start}
    for k in range(1, rounds + 1):
        by_domain = {}
        for u, r in rows.items():
            if r[2] == "unseen":
                by_domain.setdefault(domain(u), []).append((-r[0], u))
        taken = [(n, *x) for some in by_domain.values() for n, x in enumerate(sorted(some)[:per_domain])]
        taken = [u for _, _, u in sorted(taken)[:batch]]
        if not taken:
            break
        found = {}
        for u in taken:
            r = rows[u]
            r[5] = k
            if u in pages:
                r[1], r[2] = float(pages[u]), "seen"
                for dst in links.get(u, ()):
                    found[dst] = max(found.get(dst, r[1]), r[1])
            elif r[3] < retries:
                r[3] += 1
            else:
                r[2] = "error"
        for dst, score in found.items():
            rows.setdefault(dst, [score, None, "unseen", 0, k, None])
    return {u: tuple(r) for u, r in rows.items()}


def as_rows(walk):
    return {r.url: (r.url_score, r.page_score, r.status, r.retries, r.met, r.popped) for r in walk.result().collect()}


@pytest.fixture(scope="module")
def web(spark):
    rng = random.Random(8)
    urls = [f"{rng.choice('abc')}{k}" for k in range(120)]
    links = {u: {rng.choice(urls) for _ in range(rng.randint(1, 5))} for u in urls}
    pages = {u: rng.randint(0, 4) for u in urls if rng.random() < 0.8}
    frames = (
        spark.createDataFrame([(u,) for u in urls[:6] + urls[:1] + [None]], "url string"),
        spark.createDataFrame([(s, d) for s, some in links.items() for d in some] + [(urls[0], None), (None, urls[3])], "src string, dst string"),
        spark.createDataFrame(list(pages.items()), "url string, score int"),
    )
    return urls[:6], links, pages, [shared.cut(f) for f in frames]


@pytest.mark.parametrize(("per_domain", "batch", "retries"), [(3, None, 2), (2, 4, 0)])
def test_best_first_equals_a_loop(spark, web, per_domain, batch, retries):
    start, links, pages, frames = web
    walk = crawl.BestFirst(*frames, lambda u: F.substring(u, 1, 1), per_domain, batch, retries, buckets=2)
    n = walk.run(rounds=14)
    assert as_rows(walk) == loop(start, links, pages, lambda u: u[0], per_domain, batch, retries, 14) and n <= 14


def test_a_crawl_goes_on_where_it_stopped(spark, web):
    start, links, pages, frames = web
    path = shared.fresh_path(spark)
    make = lambda: crawl.BestFirst(*frames, lambda u: F.substring(u, 1, 1), 3, None, 1, path, buckets=2)
    assert make().run(rounds=3) == 3
    # a round that broke off: its tables are there, but not the queue, which is written last
    keyed.Files(spark, path).delete("queue-3")
    again = make()
    assert again.rounds() == 2
    assert again.run(rounds=4) == 6
    assert as_rows(again) == loop(start, links, pages, lambda u: u[0], 3, None, 1, 6)


def test_the_query_equals_a_loop(spark):
    sf = "/root/testdata/sf0.001"
    links, pages, start = catalog.site_graph(spark, sf)
    out = {}
    for r in links.distinct().collect():
        out.setdefault(r.src, set()).add(r.dst)
    want = loop([start.first().url], out, {r.url: r.score for r in pages.collect()}, lambda u: u[:5] if u.startswith("w:") else u, 20, None, 1, 12)
    got = {r.url: (r.url_score, r.page_score, r.status, r.retries, r.met, r.popped) for r in catalog.QUERIES["crawl_best_first"](spark, sf).collect()}
    assert got == want and {"seen", "error"} <= {r[2] for r in got.values()}


def test_known_urls_stay_where_they_are(spark):
    state = keyed.KeySet(spark, shared.fresh_path(spark), "url", 4)
    urls = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("url"))
    state.add(urls(0, 50), 0)
    assert state.fold(0)
    state.add(urls(50, 60), 1)
    assert not state.fold(1)
    assert sorted(int(r.url) for r in state.absent(urls(40, 80), 1).collect()) == list(range(60, 80))
    assert sorted(int(r.url) for r in state.absent(urls(40, 80), 0).collect()) == list(range(50, 80))
    state.add(urls(60, 120), 2)
    assert state.fold(2) and not state.fold(2)
    assert state.absent(urls(0, 130), 2).count() == 10
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = state.absent(urls(0, 130), 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


SCHEMA = "k string, v long, seq long"


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_a_merge_rewrites_the_buckets_it_touches(spark):
    table = keyed.Snapshot(spark, shared.fresh_path(spark), "k", buckets=8)
    order = F.col("seq")
    assert table.read(SCHEMA).collect() == [] and table.versions() == []
    first = table.merge(spark.range(100).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"), F.lit(0).cast("long").alias("seq")), 1, order)
    assert first == list(range(8))
    want = {str(k): k for k in range(100)}
    touched = table.merge(rows_of(spark, ("5", -1, 2), ("5", -2, 1), ("new", 7, 0)), 2, order)
    assert 1 <= len(touched) <= 2
    want |= {"5": -1, "new": 7}
    held = table.held()
    assert sorted(int(b) for b, v in held.items() if v == 2) == touched and set(held.values()) == {1, 2}
    assert {r.k: r.v for r in table.read(SCHEMA).collect()} == want
    # the same merge again changes nothing, whatever it is given; a version before can still be read
    assert table.merge(rows_of(spark, ("5", 0, 9)), 2, order) == []
    assert {r.k: r.v for r in table.read(SCHEMA).collect()} == want
    assert {r.k: r.v for r in table.read(SCHEMA, version=1).collect()} == {str(k): k for k in range(100)}
    assert table.merge(rows_of(spark), 3, order) == [] and table.versions() == [1, 2, 3]
    # null is a key
    for version in (4, 5):
        assert len(table.merge(rows_of(spark, (None, version, 1)), version, order)) == 1
        assert [r.v for r in table.read(SCHEMA).where("k is null").collect()] == [version]


def test_a_stream_keeps_the_latest_row_of_each_key(spark, tmp_path):
    from newsloom.streaming.crawl import upsert_sink

    path, log = shared.fresh_path(spark), str(tmp_path / "log")
    sink = upsert_sink(path, "k", "seq", buckets=4)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(log)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return {r.k: r.v for r in keyed.Snapshot(spark, path, "k", 4).read(SCHEMA).collect()}

    rows_of(spark, ("a", 1, 5), ("b", 2, 1)).coalesce(1).write.parquet(log)
    assert run() == {"a": 1, "b": 2}
    rows_of(spark, ("a", 7, 4), ("b", 8, 2), ("c", 9, 1)).coalesce(1).write.mode("append").parquet(log)
    assert run() == {"a": 1, "b": 8, "c": 9}
    sink(rows_of(spark, ("c", 0, 99)), 1)  # a batch that is given again
    assert run() == {"a": 1, "b": 8, "c": 9}


def test_a_merge_that_broke_off_is_not_seen(spark):
    path = shared.fresh_path(spark)
    table = keyed.Snapshot(spark, path, "k", buckets=4)
    table.merge(rows_of(spark, ("a", 1, 0), ("b", 2, 0)), 1, F.col("seq"))
    table.merge(rows_of(spark, ("a", 9, 1)), 2, F.col("seq"))
    table.files.delete("versions/2")  # as if it had ended before the switch
    assert {r.k: r.v for r in table.read(SCHEMA).collect()} == {"a": 1, "b": 2}
    table.merge(rows_of(spark, ("a", 5, 1)), 2, F.col("seq"))
    assert {r.k: r.v for r in table.read(SCHEMA).collect()} == {"a": 5, "b": 2}
    assert table.vacuum(keep=1) == 1
    assert {r.k: r.v for r in table.read(SCHEMA).collect()} == {"a": 5, "b": 2}
