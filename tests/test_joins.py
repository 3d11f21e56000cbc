"""Similarity joins, growing allow-lists and folds in spans against plain loops."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import frontier, graph, match
from newsloom.plans import catalog, hooks


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j], row[j + 1], last + (x == y)) if x == y else max(row[j], row[j + 1])
    return row[-1]


def indel(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b))


def edited(rng, text, n):
    for _ in range(n):
        k = rng.randrange(len(text) + 1)
        text = rng.choice([text[:k] + rng.choice("abz ") + text[k:], text[:k] + text[k + 1 :]])
    return text


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = ["".join(rng.choice("aaab cdé") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    near = [edited(rng, t, rng.randint(0, 6)) for t in base]
    odd = [None, "", "a", "b", "ab", "ba", "aaaa", "aaaaa", "aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaa"]
    return list(enumerate(base + base[:3] + odd)), list(enumerate(near + near[:3] + odd))


@pytest.mark.parametrize(("least", "q", "ratio", "slow"), [
    (0.8, 2, match.indel_ratio, indel), (0.9, 2, match.indel_ratio, indel), (0.9, 3, match.indel_ratio, indel), (0.6, 1, match.indel_ratio, indel),
    (0.8, 2, match.sequence_ratio, lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()),
])
def test_similar_pairs_equal_all_pairs(spark, texts, least, q, ratio, slow):
    left, right = (spark.createDataFrame(t, "id int, text string") for t in texts)
    got = {(r.l, r.r): round(r.ratio, 9) for r in match.similar(left, right, least, q, ratio).collect()}
    want = {(i, j): round(slow(a, b), 9) for i, a in texts[0] for j, b in texts[1] if a and b and slow(a, b) > least}
    assert got == want
    best = {r.l: (r.r, round(r.ratio, 9)) for r in match.best_similar(left, right, least, q, ratio).collect()}
    assert best == {i: min(((j, s) for (k, j), s in want.items() if k == i), key=lambda x: (-x[1], x[0])) for i in {i for i, _ in want}}


def test_grams_of_many_rows_are_dealt_to_several_tasks(spark, texts, monkeypatch):
    monkeypatch.setattr(match, "HEAVY", 3)
    left, right = (spark.createDataFrame(t, "id int, text string") for t in texts)
    got = {(r.l, r.r) for r in match.similar(left, right, 0.8).collect()}
    assert got == {(i, j) for i, a in texts[0] for j, b in texts[1] if a and b and indel(a, b) > 0.8}


def test_few_pairs_are_verified(spark):
    sf = "/root/testdata/sf0.001"
    turns = catalog.read(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    items = catalog.read(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("id"), "text")
    others = turns.unionByName(items.select((F.col("id") - 1_000_000).alias("id"), F.substring("text", 3, 1_000_000).alias("text")))
    pairs = items.count() * others.count()
    tried, verified = match.candidates(items, others, 0.9, 3).count(), match.likely(items, others, 0.9, 3).count()
    assert verified <= tried < 0.2 * pairs and verified < 0.03 * pairs, (tried, verified, pairs)
    mine, yours = ([(r.id, r.text) for r in t.collect()] for t in (items, others))
    got = {r.l: (r.r, round(r.ratio, 9)) for r in catalog.QUERIES["benchmark_similar"](spark, sf).collect()}
    want = {}
    for i, a in mine:
        some = [(-round(2 * match.common_length(a, b) / (len(a) + len(b)), 9), j) for j, b in yours if b]
        if min(some)[0] < -0.9:
            want[i] = (min(some)[1], -min(some)[0])
    assert got == want and got


def test_grams_that_tell_nothing_are_refused(spark, texts):
    df = spark.createDataFrame(texts[0], "id int, text string")
    with pytest.raises(ValueError, match="tell nothing"):
        match.candidates(df, df, 0.6, 2)


def grown(rows, allowed, find_new_site):
    """The list as it grows, a row at a time."""
    allowed, out = set(allowed), {}
    for seq, url, domain, add in sorted(rows):
        bare = domain.lower().replace("www.", "")
        if not allowed:
            out[seq] = True
            continue
        out[seq] = False
        if not add and not any(a in url for a in allowed):
            continue
        if not any(bare in a.replace("www.", "") for a in allowed):
            if not add or not find_new_site:
                continue
            allowed.add(domain.lower())
        out[seq] = True
    return out


@pytest.mark.parametrize("few", [1000, 0])
@pytest.mark.parametrize(("allowed", "new"), [(["a.org"], True), (["a.org"], False), ([], True), (["www.news.a.org/x", "b"], True)])
def test_an_allow_list_grows_in_order(spark, monkeypatch, allowed, new, few):
    monkeypatch.setattr(frontier, "BROADCAST_PATTERNS", few)
    rng = random.Random(len(allowed) + new)
    domains = ["a.org", "www.a.org", "news.a.org", "org", "b.net", "www.b.net", "x.b.net", "c.com", "sub.c.com", "d.io"]
    rows = []
    for k in range(300):
        d = rng.choice(domains)
        rows.append((k * 3, f"https://{d}/{rng.choice(['x', 'y/www.a.org', ''])}", d, rng.random() < 0.1))
    df = spark.createDataFrame([(*r, 1) for r in rows], "seq long, url string, domain string, add_domain boolean, more int")
    out = frontier.growing_allowed(df, spark.createDataFrame([(a,) for a in allowed], "pattern string"), new)
    assert out.columns == [*df.columns, "accepted"]
    assert {r.seq: r.accepted for r in out.collect()} == grown(rows, allowed, new)


def test_fetch_times_of_a_hot_key_in_spans(spark):
    rng = random.Random(9)
    rows = [("hot" if k % 4 else rng.choice(["a", "b", None]), round(rng.random() * 9000, 2), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "domain string, arrival double, seq int").repartition(3)
    free, want = {}, {}
    for d, at, k in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want[k] = max(at, free.get(d, at))
        free[d] = want[k] + 3.5
    for most in (10**6, 100):
        got = frontier.fetch_times(df, 3.5, window_rows=most)
        assert sorted(got.columns) == ["arrival", "domain", "seq", "start"]
        assert {r.seq: round(r.start, 4) for r in got.collect()} == {k: round(v, 4) for k, v in want.items()}
    plan = frontier.fetch_times(df, 3.5, window_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(domain#" in plan and "__span" in plan.split("windowspecdefinition(domain#")[1][:40]


P, Q = graph.Step("p"), graph.Step("q")
PATHS = [P, graph.Back("p"), graph.Seq(P, Q), graph.Alt(P, graph.Back("q")), graph.Star(P), graph.Seq(P, graph.Star(graph.Alt(P, graph.Seq(Q, Q)))), graph.Star(graph.Star(P)), graph.Seq(graph.Star(graph.Seq(P, graph.Back("p"))), Q)]


def ends(path, edges, node):
    """The nodes that a path leads to, by search."""
    if isinstance(path, graph.Step):
        return {o for s, p, o in edges if p == path.predicate and s == node}
    if isinstance(path, graph.Back):
        return {s for s, p, o in edges if p == path.predicate and o == node}
    if isinstance(path, graph.Seq):
        return {b for a in ends(path.first, edges, node) for b in ends(path.then, edges, a)}
    if isinstance(path, graph.Alt):
        return ends(path.one, edges, node) | ends(path.other, edges, node)
    seen, todo = {node}, [node]
    while todo:
        for b in ends(path.inner, edges, todo.pop()) - seen:
            seen.add(b)
            todo.append(b)
    return seen


@pytest.mark.parametrize("path", PATHS, ids=range(len(PATHS)))
def test_paths_from_a_start_set(spark, path):
    rng = random.Random(2)
    edges = [(rng.randrange(14), rng.choice("ppq"), rng.randrange(14)) for _ in range(22)] + [(3, "p", None), (None, "p", 4)]
    starts = [0, 5, 9, 99, None]
    got = graph.reach(spark.createDataFrame([(s,) for s in starts], "node int"), spark.createDataFrame(edges, "subject int, predicate string, object int"), path).collect()
    real = [e for e in edges if None not in e]
    assert sorted((r.start, r.node) for r in got) == sorted((s, n) for s in starts if s is not None for n in ends(path, real, s))


def test_pages_of_different_documents_do_not_meet(spark):
    box = [0.0, 0.0, 2.0, 2.0]
    cells = spark.createDataFrame([(d, 1, r, 0, *box) for d in ("x", "y") for r in (1, 2)], "doc string, page int, row_id int, col int, x1 double, y1 double, x2 double, y2 double")
    links = spark.createDataFrame([("x", 1, 1, "u", *box), ("x", 1, 2, "v", *box), ("y", 1, 1, "u", *box)], "doc string, page int, pos int, uri string, x1 double, y1 double, x2 double, y2 double")
    key = ("doc", "page")
    taken = match.claimed_links(cells, links, key=key)
    assert sorted(map(tuple, taken.collect())) == [("x", 1, 1, "u"), ("x", 1, 2, "v"), ("y", 1, 1, "u")]
    assert sorted(map(tuple, match.first_link(cells, links, key=key).collect())) == [(d, 1, r, "u") for d in ("x", "y") for r in (1, 2)]
    assert match.last_cell_links(cells, links, key=key).count() == 4 and match.loose_link(cells, links, key=key).count() == 0
    assert [tuple(r) for r in match.unmatched(links, taken.where("doc = 'x'"), key=key).collect()] == [("y", 1, "u")]


def test_plug_ins_are_joined_to_the_rows_they_look_at(spark):
    class Letters:
        def eval(self, text):
            for k, c in enumerate(text or ""):
                yield k, c

    df = spark.createDataFrame([(1, "ab", 5), (2, "", 6), (3, None, 7)], "id int, text string, c int")
    plugs = hooks.Hooks()
    plugs.plug("after_fetch", Letters, "k int, letter string", "text")
    plugs.add("after_fetch", lambda d: d.withColumn("more", F.col("c") + 1))
    assert sorted(map(tuple, plugs.run("after_fetch", df).collect()), key=str) == [(1, "ab", 5, 0, "a", 6), (1, "ab", 5, 1, "b", 6), (2, "", 6, None, None, 7), (3, None, 7, None, None, 8)]
    plugs.plug("before_fetch", Letters, "k int, letter string", "text", keep=False)
    assert plugs.run("before_fetch", df).count() == 2 and plugs.run("on_finish", df) is df
    assert "Exchange" not in plugs.run("before_fetch", df)._jdf.queryExecution().executedPlan().toString()
    plugs.plug("on_start", Letters, "id int, letter string", "text")
    with pytest.raises(ValueError, match="already: id"):
        plugs.run("on_start", df)
    with pytest.raises(ValueError, match="no such stage"):
        plugs.plug("nowhere", Letters, "k int", "text")
