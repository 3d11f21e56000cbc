import json
import random
import re

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions import urls as U
from newsloom.operators import bandit, frontier, graph, keywords, match, records
from newsloom.plans.fixtures import table
from newsloom.plans.hooks import Hooks
from newsloom.sources import archive, sinks


def find_by_scanning(norm, phrases):
    """Every occurrence with no letter or digit next to it: a character scan."""
    out = []
    for p in phrases:
        k = norm.find(p)
        while k >= 0:
            before, after = norm[k - 1 : k], norm[k + len(p) : k + len(p) + 1]
            if not before.isalnum() and not after.isalnum():
                out.append(p)
            k = norm.find(p, k + 1)
    return sorted(out)


def test_normalize_text_equals_the_model(spark):
    rng = random.Random(3)
    texts = ["", " a ", "Ünïcödé ﬁne ½ ①", "x-ray_FOX; é", None] + ["".join(rng.choice("aé ßÇ_-.\n\tｆ１½") for _ in range(30)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_text(F.col("t")).alias("n")).collect()
    assert all(r.n == (None if r.t is None else T.normalize_py(r.t)) for r in rows)


def test_matches_equal_a_character_scan(spark):
    phrases = ["red fox", "fox", "x-ray", "red", "fox red fox"]
    rng = random.Random(5)
    texts = ["Red fox, FOX_den; foxes. X-ray", ""] + ["".join(rng.choice(["red", "fox", "x-ray", " ", "_", ",", "es"]) for _ in range(12)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = keywords.matches(docs, keywords.vocabulary(spark, phrases)).collect()
    for k, t in enumerate(texts):
        assert sorted(r.phrase for r in found if r.id == k) == find_by_scanning(T.normalize_py(t), phrases), t


def by_characters(text, phrases):
    """All occurrences, a place at a time."""
    return [(p, k, k + len(p) - 1) for k in range(len(text)) for p in phrases if text.startswith(p, k) and not text[k - 1 : k].isalnum() and not text[k + len(p) : k + len(p) + 1].isalnum()]


def test_occurrences_have_places(spark):
    phrases = ["red fox", "fox", "x-ray", "red", "fox red fox", "fox_red", "é", ""]
    rng = random.Random(6)
    texts = [None, "", "fox", "Red fox, FOX_den; foxes. X-ray", "Fox red fox red fox"] + ["".join(rng.choice(["red", "fox", "x-ray", " ", "_", ",", "es", "É", "½", "1"]) for _ in range(14)) for _ in range(300)]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id int, text string, start int")
    want = {k: sorted(by_characters(T.normalize_py(t or ""), [p for p in phrases if p])) for k, t in enumerate(texts)}
    table_of = spark.createDataFrame([(p,) for p in phrases + ["RED", "Fox"]], "phrase string")
    for given, most in ((phrases, 100), (phrases, 2), (table_of, 100), (table_of, 3)):
        got = {k: [] for k in want}
        for r in keywords.occurrences(docs, given, most=most).collect():
            got[r.id].append((r.phrase, r.start, r.end))
        assert {k: sorted(v) for k, v in got.items()} == want
        rows = {r.id: (r.unique_count, r.total_count, r.keywords) for r in keywords.scores(docs, given, most=most).collect()}
        assert rows == {k: (len({o[0] for o in v}), len(v), ", ".join(sorted({o[0] for o in v}))) for k, v in want.items() if v}
    assert keywords.occurrences(docs, []).collect() == keywords.scores(docs, []).collect() == []


def test_a_score_needs_no_shuffle(spark):
    plan = keywords.scores(spark.createDataFrame([(1, "a b")], "doc_id int, text string"), ["a", "a b"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_first_match_ends_first(spark):
    phrases = ["fox", "a fox", "ox", "den", "Hen"]
    texts = ["", None, "a fox den", "foxden", "oxen", "none hen", "HEN", "a den fox"]
    got = {r.id: (r.phrase, r.end) for r in keywords.first_match(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), phrases).collect()}
    want = {}
    for k, t in enumerate(texts):
        hits = [(t.index(p.lower()) + len(p), -len(p), p.lower()) for p in phrases if t and p.lower() in t]
        if hits:
            want[k] = (min(hits)[2], min(hits)[0])
    assert got == want


def test_matches_join_and_not_nested_loop(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    plan = keywords.matches(docs, keywords.vocabulary(spark, ["a", "a b"]))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pop_limits_each_group_before_the_exchange(spark):
    plan = frontier.pop(table(spark, "frontier"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def context_by_places(text, keywords, irrelevant, anti, irrelevant_anti, window):
    """Sets of places and a word at a time, for words of letters."""
    word = lambda c: c.isalnum() or c == "_"

    def hits(phrase, s):
        k, low, p = 0, s.lower(), phrase.lower()
        while k + len(p) <= len(s):
            edges = (k == 0 or not word(low[k - 1])) and (k + len(p) == len(s) or not word(low[k + len(p)]))
            if low[k : k + len(p)] == p and edges:
                yield k, k + len(p)
                k += len(p)
            else:
                k += 1

    def kept(phrases, bad):
        return [(p, a, b) for p in phrases for a, b in hits(p, text) if not any(True for x in bad for _ in hits(x, text[max(0, a - window) : b + window]))]

    places, total, one, two = set(), 0, [], []
    for p, a, b in kept(keywords, irrelevant):
        one += [p] if p not in one else []
        if places.isdisjoint(range(a, b)):
            total += len(p.split())
            places |= set(range(a, b))
    for p, a, b in kept(anti, irrelevant_anti):
        two += [p] if p not in two else []
        total -= places.isdisjoint(range(a, b))
    return total, one, two


def test_context_score_model(spark):
    assert keywords.Context(["red fox", "fox"])("big red fox") == (2, ["red fox", "fox"], [])
    assert keywords.Context(["red fox"], ["trap"])("red fox near a trap")[0] == 0
    assert keywords.Context(["red fox"], ["trap"])("red fox near a trapdoor")[0] == 2
    assert keywords.Context(["fox"], anti=["hen"])("fox and hen") == (0, ["fox"], ["hen"])
    assert keywords.Context(["fox"], anti=["hen"], irrelevant_anti=["coop"])("fox and hen in coop") == (1, ["fox"], [])
    rng, lists = random.Random(8), (["red fox", "fox", "hen"], ["trap", "red hen"], ["hen", "cat"], ["coop"])
    texts = [" ".join(rng.choice(["red", "fox", "Hen", "trap", "coop", "cat", "foxes", "x"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    score = keywords.Context(*lists, window=12)
    assert [score(t) for t in texts] == [context_by_places(t, *lists, 12) for t in texts]
    rows = keywords.context_score(spark.createDataFrame([(1, "fox and hen"), (2, None)], "doc_id int, text string"), ["fox"], anti=["hen"]).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, "fox", "hen"), (2, 0, "", "")]


def test_token_set_ratio_model():
    def common(a, b):
        last = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for k, y in enumerate(b):
                row.append(last[k] + 1 if x == y else max(last[k + 1], row[-1]))
            last = row
        return last[-1]

    def alike(a, b):
        return 100.0 * 2 * common(a, b) / (len(a) + len(b))

    def model(a, b):
        one, two = set(a.split()), set(b.split())
        if not one or not two:
            return 0.0
        both = " ".join(sorted(one & two))
        left, right = (" ".join(filter(None, [both, " ".join(sorted(x))])) for x in (one - two, two - one))
        if both and (left == both or right == both):
            return 100.0
        best = [100.0 * (1 - (len(left) + len(right) - 2 * len(both) - 2 * bool(both) - 2 * common(" ".join(sorted(one - two)), " ".join(sorted(two - one)))) / (len(left) + len(right)))]
        return max(best + ([alike(both, left), alike(both, right)] if both else []))

    rng = random.Random(4)
    for _ in range(500):
        a, b = (" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(5))) for _ in range(2))
        assert abs(match.token_set_ratio_py(a, b) - model(a, b)) < 1e-9, (a, b)
        assert match.common_length(a, b) == common(a, b)
    assert match.token_set_ratio_py(None, "a") == 0.0


def test_rows_and_slots_equal_a_loop(spark):
    import difflib

    rng = random.Random(12)
    words = ["morning", "evening", "show", "news", "quiz", "may", "june"]
    phrase = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
    urls = [(k % 3, k, f"{phrase()}-{k}", phrase()) for k in range(40)]
    rows = [(k % 3, k, phrase(), "taken" if k % 7 == 0 else None) for k in range(25)]
    u = spark.createDataFrame(urls, "block int, pos int, url string, text string")
    r = spark.createDataFrame(rows, "block int, row_id int, text string, url string")
    for best, like, least in (
        (match.best_rows(u, r), lambda url, text, row: difflib.SequenceMatcher(None, url.lower(), row.lower()).ratio(), 0.5),
        (match.best_token_rows(u, r), lambda url, text, row: match.token_set_ratio_py(text.lower(), row.lower()), 70),
    ):
        slots = {(b, k): url for b, k, _, url in rows}
        for block, _, url, text in urls:
            top, at = 0, None
            for b, k, row, _ in rows:
                if b == block and like(url, text, row) > max(top, least):
                    top, at = like(url, text, row), k
            if at is not None and slots[block, at] is None:
                slots[block, at] = url
        assert {(x.block, x.row_id): x.url for x in match.claim_slots(best, u, r).collect()} == slots


def test_holding_by_broadcast_and_by_pieces(spark, monkeypatch):
    rng = random.Random(2)
    values = ["".join(rng.choice("ab.") for _ in range(rng.randrange(12))) for _ in range(200)] + [None]
    patterns = ["a.b", "bb", ".", "", "abababababababab"]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, v string")
    p = spark.createDataFrame([(x,) for x in patterns[:3]], "p string")
    for bound in (1000, 1):
        monkeypatch.setattr(frontier, "BROADCAST_PATTERNS", bound)
        for at_start, test in ((False, lambda v, x: x in v), (True, lambda v, x: v.startswith(x))):
            hit = {k for k, v in enumerate(values) if v is not None and any(test(v, x) for x in patterns[:3])}
            assert {r.id for r in frontier.holding(rows, "v", p, "left_semi", at_start).collect()} == hit
            assert {r.id for r in frontier.holding(rows, "v", p, "left_anti", at_start).collect()} == set(range(len(values))) - hit


def test_pop_broadcasts_the_delayed_domains(spark):
    delayed = spark.createDataFrame([("slow.",)], "domain string")
    plan = frontier.pop(table(spark, "frontier"), 2, delayed)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_crawl_delay_equals_the_fold(spark, monkeypatch):
    monkeypatch.setattr(frontier, "FOLD_ROWS", 7)
    rng, rows, want = random.Random(1), [], {}
    for d in "abc":
        delay = 1.0
        for k in range(100):
            status, wish = rng.choice([200, 200, 200, 404, 429, 503]), rng.choice([None, 10, 900])
            rows.append((d, k, status, wish))
            delay = delay / 2 if status == 200 else max(delay * 2, wish or 0, 300.0) if status in (429, 503) else delay
        want[d] = delay
    rng.shuffle(rows)
    got = frontier.crawl_delay(spark.createDataFrame(rows, "domain string, seq int, status int, retry_after int"))
    assert {r.domain: r.delay for r in got.collect()} == want


def test_closure_of_long_paths_and_cycles(spark):
    edges = [(f"n{k}", f"n{k + 1}") for k in range(40)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = graph.closure(spark.createDataFrame([(a, "p", b) for a, b in edges] + [("n0", "q", "x")], "subject string, predicate string, object string"), "p")
    want = {(f"n{a}", f"n{b}") for a in range(41) for b in range(a, 41)} | {(a, b) for a in "xy" for b in "xy"} | {("z", "z")}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_segments_equal_a_loop(spark):
    lines = ["Show, BBC One, 3 May 2020", "Show, 3 May 2020", "BBC Two, Show, 3 May 2020", "The Pilot (Working title)", "BBC Red Button", "Page, bbc.co.uk", "Show, BBC One,", "A, B", "BBC One, 3 May 2020", "Show, Other, 3 May 2020", ", x, 3 May 2020", "A, B, 12 x", "Long", "", "  title  ", "Alpha  Beta  1/2/2020", "x (Working title)"]
    rng = random.Random(6)
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(8))) for _ in range(80)]
    pages = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "doc_id int, page int, text string")
    got = {}
    for r in records.segments(pages).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.programme, r.station, r.date))
    for k, t in enumerate(texts):
        want, held = [], ""
        for line in filter(None, map(str.strip, t.split("\n"))):
            held = f"{held} {line}".strip()
            for pattern, groups in records.HEADERS:
                if m := re.match(pattern, held):
                    want.append(tuple((m[g] or "").strip() if g else "" for g in groups))
                    held = ""
                    break
        assert got.get(k, []) == want


def test_segments_name_their_kinds_and_end_lines_at_newlines_only(spark):
    lines = ["Show, BBC One, 3 May 2020", "Show, 3 août 2020", "The Pilot (Working title)", "BBC Red Button", "Page, bbc.co.uk", "Show, BBC One,", "A, B, 12 x", ", x", "A\x85very", "\u2028long", "\xa0\u3000", "q\x1c,\x1cRadio 4,\u20033 May 2020", "Alpha  Beta  1/2/2020", "Long"]
    rng = random.Random(8)
    texts = [rng.choice(["\n", "\r\n"]).join(rng.choice(lines) for _ in range(rng.randrange(9))) for _ in range(200)]
    texts += ["Morning Show, BBC One, 3 April 2020\r\nA very\r\nlong title, BBC Two, 4 May 2021\r\nBBC Red Button\r\n", None]
    pages = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "doc_id int, page int, text string")
    got = {}
    for r in records.segments(pages).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.programme, r.station, r.date))
    assert got[200] == [("prog_station_date", "Morning Show", "BBC One", "3 April 2020"), ("prog_station_date", "A very long title", "BBC Two", "4 May 2021"), ("red_button", "", "BBC Red Button", "")]
    for k, t in enumerate(texts):
        want, held = [], ""
        for line in filter(None, map(str.strip, (t or "").split("\n"))):
            held = f"{held} {line}".lstrip(" ")
            for name, (pattern, groups) in records.SEGMENTS.items():
                if m := re.match(pattern, held):
                    want.append((name, *[(m[g] or "").strip() if g else "" for g in groups]))
                    held = ""
                    break
        assert got.get(k, []) == want


def test_values_by_spans_equal_the_fold(spark):
    steps = spark.range(0, 400).select((F.col("id") % 2).cast("string").alias("param"), F.col("id").alias("step"), F.lit(1).alias("action"), (F.col("id") % 3).cast("double").alias("reward"))
    want = {}
    for k in range(400):
        want[str(k % 2)] = want.get(str(k % 2), 0.0) * 0.9 + 0.1 * (k % 3)
    for span in (7, 100, 10**6):
        rows = bandit.values(steps, 0.1, span).collect()
        assert {r.n for r in rows} == {200} and all(abs(r.q - want[r.param]) < 1e-12 for r in rows)


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://www.Example.ORG:80/a/;x?q=1#t", "http://example.org/a?q=1"),
        ("https://example.org", "https://example.org/"),
        ("https://web.archive.org/web/2020/http://old.org/x", "http://old.org/x"),
        ("https://example.org/100%zz", "https://example.org/100%25zz"),
    ],
)
def test_normalize_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(U.normalize_url(F.col("u"))).first()[0] == want


def test_fetch_times_are_apart(spark):
    rows = spark.createDataFrame([("d", k, float(a)) for k, a in enumerate([0, 1, 2, 100, 101])], "domain string, seq int, arrival double")
    got = [r.start for r in frontier.fetch_times(rows, 10.0).orderBy("seq").collect()]
    want, free = [], 0.0
    for a in (0, 1, 2, 100, 101):
        want.append(max(a, free))
        free = want[-1] + 10
    assert got == want


def test_bandit_values_equal_the_fold(spark):
    rewards = [1.0, 0.0, 0.5, 1.0]
    steps = spark.createDataFrame([("p", k, 1, r) for k, r in enumerate(rewards)], "param string, step int, action int, reward double")
    q = 0.0
    for r in rewards:
        q += 0.1 * (r - q)
    assert abs(bandit.values(steps).first().q - q) < 1e-12


def test_claimed_links_take_each_uri_once(spark):
    rows = match.claimed_links(table(spark, "cells"), table(spark, "boxes")).collect()
    assert len({(r.page, r.uri) for r in rows}) == len(rows)


def test_hooks():
    hooks = Hooks()
    hooks.add("after_fetch", lambda df: df + 1)
    with pytest.raises(ValueError):
        hooks.add("nope", None)

    class Frame(int):
        def transform(self, f):
            return f(self)

    assert hooks.run("after_fetch", Frame(1)) == 2


def test_sinks_and_archive_source(spark, tmp_path):
    df = spark.createDataFrame([("a b", 1)], "code string, n int")
    sinks.append_csv(df, str(tmp_path / "c"))
    sinks.append_csv(df, str(tmp_path / "c"))
    assert [r.postcode for r in sinks.postcodes(spark.read.csv(str(tmp_path / "c"), header=True)).collect()] == ["ab", "ab"]
    sinks.write_state(spark.createDataFrame([(5, None)], "cursor int, done string"), str(tmp_path / "s"))
    assert sinks.read_state(spark, str(tmp_path / "s"), "cursor int, done string", {"done": "no"}).first() == (5, "no")
    (tmp_path / "i.ndjson").write_text("\n".join(json.dumps({"url": f"u{k}", "digest": "d", "mime": m, "status": 200}) for k, m in enumerate(["text/html", "image/png"])))
    (tmp_path / "j.ndjson").write_text('{"url": "u2", "mime": "text/html", "status": 404}\n{broken\n')
    index = archive.read_index(spark, [str(tmp_path / "i.ndjson"), str(tmp_path / "j.ndjson")], ["text/html"])
    assert sorted((r.url, r.origin[-8:]) for r in index.collect()) == [("u0", "i.ndjson"), ("u2", "j.ndjson")]
    assert [r.url for r in archive.read_index(spark, [str(tmp_path)], statuses=[404]).collect()] == ["u2"]


def test_streams(spark, tmp_path):
    from newsloom.streaming import crawl

    spark.createDataFrame([("a", 1, 200, None), ("a", 2, 429, 10), ("b", 1, 503, 900)], "domain string, seq int, status int, retry_after int").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("domain string, seq int, status int, retry_after int").parquet(str(tmp_path / "in"))
    q = crawl.crawl_delays(source).writeStream.format("memory").queryName("delays").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.domain: r.delay for r in spark.table("delays").collect()} == {"a": 300.0, "b": 900.0}


def test_library_does_not_import_llm():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "newsloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"newsloom\.llm|corpus_pipeline", p.read_text()), p
