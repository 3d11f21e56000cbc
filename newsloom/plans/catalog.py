"""All queries by name, each with the SQL that gives the same rows in DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions import urls as U
from newsloom.operators import bandit, crawl, frontier, graph, keywords, match, records, robots
from newsloom.plans import hooks
from newsloom.plans.fixtures import sql as fx
from newsloom.plans.fixtures import table as fixture
from newsloom.sources import archive, keyed, paged, shared, sinks, web
from newsloom.streaming import state

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Phrases for the keyword queries: nested, accented, punctuated and absent ones, none that overlaps itself.
PHRASES = ["the", "of the", "and", "to", "de", "de la", "que", "der die", "erth", "x-ray", "The", "absent phrase"]
STOP = ["the", "of", "and", "de", "la", "to"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


NORM = r"lower(trim(regexp_replace(regexp_replace(strip_accents(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')))"
#: Every phrase occurrence in padded words: blanks doubled, so that neighbours do not share one.
_PHRASES_SQL = ", ".join(f"('{p}')" for p in dict.fromkeys(p.lower() for p in PHRASES))
SCORED = f"""
n AS (SELECT doc_id, lang, ' ' || replace(replace({NORM}, '_', ' '), ' ', '  ') || ' ' AS t FROM documents),
v(p) AS (VALUES {_PHRASES_SQL}),
m AS (SELECT doc_id, lang, p, (length(t) - length(replace(t, ' ' || replace(p, ' ', '  ') || ' ', ''))) // (length(replace(p, ' ', '  ')) + 2) AS k FROM n, v),
s AS (SELECT doc_id, lang, count(*) AS unique_count, CAST(sum(k) AS BIGINT) AS total_count, string_agg(p, ', ' ORDER BY p) AS keywords FROM m WHERE k > 0 GROUP BY doc_id, lang)
"""


def _scored(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.struct("doc_id", "lang").alias("doc"), "text")
    return keywords.scores(docs, PHRASES, "doc").select("id.doc_id", "id.lang", "unique_count", "total_count", "keywords")


@query(
    "keyword_offsets",
    f"""WITH n AS (SELECT doc_id, {NORM} AS t FROM documents), v(p) AS (VALUES {_PHRASES_SQL}),
    s AS (SELECT doc_id, p, string_split(t, p) AS parts FROM n, v WHERE contains(t, p)),
    e AS (SELECT doc_id, p, unnest(parts) AS part, generate_subscripts(parts, 1) AS k, len(parts) AS n FROM s),
    w AS (SELECT *, sum(length(part)) OVER o + (k - 1) * length(p) AS start, lead(part) OVER o AS next FROM e WINDOW o AS (PARTITION BY doc_id, p ORDER BY k))
    SELECT doc_id, p AS phrase, CAST(start AS INTEGER) AS start, CAST(start + length(p) - 1 AS INTEGER) AS "end" FROM w WHERE k < n
    AND CASE WHEN part = '' THEN k = 1 ELSE NOT regexp_matches(right(part, 1), '[\\p{{L}}\\p{{N}}]') END
    AND CASE WHEN next = '' THEN k + 1 = n ELSE NOT regexp_matches(left(next, 1), '[\\p{{L}}\\p{{N}}]') END""",
)
def keyword_offsets(spark, sf_dir):
    return keywords.occurrences(read(spark, sf_dir, "documents"), PHRASES).withColumnRenamed("id", "doc_id")


@query("keyword_score", f"WITH {SCORED} SELECT doc_id, unique_count, total_count, keywords FROM s")
def keyword_score(spark, sf_dir):
    return _scored(spark, sf_dir).drop("lang")


@query("keyword_score_lang", f"WITH {SCORED} SELECT lang, count(*) AS docs, CAST(sum(unique_count) AS BIGINT) AS uniques, CAST(sum(total_count) AS BIGINT) AS total FROM s GROUP BY lang")
def keyword_score_lang(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("unique_count").alias("uniques"), F.sum("total_count").alias("total"))


@query("contains_keywords", f"WITH {SCORED} SELECT doc_id, doc_id IN (SELECT doc_id FROM s) AS relevant FROM documents")
def contains_keywords(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return docs.join(_scored(spark, sf_dir).select("doc_id", F.lit(True).alias("hit")), "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("relevant"))


@query(
    "first_keyword",
    f"""WITH v(p) AS (VALUES {_PHRASES_SQL}), m AS (SELECT doc_id, p, instr(text, p) + length(p) - 1 AS e FROM documents, v WHERE instr(text, p) > 0)
    SELECT doc_id, arg_min(p, (e, -length(p))) AS phrase, CAST(min(e) AS INTEGER) AS "end" FROM m GROUP BY doc_id""",
)
def first_keyword(spark, sf_dir):
    return keywords.first_match(read(spark, sf_dir, "documents"), PHRASES).withColumnRenamed("id", "doc_id")


#: Keywords, phrases that veto them, anti-keywords, phrases that veto those.
CONTEXT = ["of the", "erth", "the", "de la"], ["x-ray", "license"], ["and the", "que"], ["de"]


def _context_sql() -> str:
    """Hits by places, vetoes by the text around them, claims a keyword at a time; neighbours of a word are no letters, digits or underscores."""
    letter, not_word = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
    values = ", ".join(f"('{kind}', {k}, '{p}')" for kind, some in (("k", CONTEXT[0]), ("a", CONTEXT[2])) for k, p in enumerate(some))
    veto = [f"regexp_matches(around, '(^|{not_word})({'|'.join(some)})($|{not_word})')" for some in (CONTEXT[1], CONTEXT[3])]
    free = lambda *claims: " AND ".join(f"NOT EXISTS (SELECT 1 FROM {c} c WHERE c.doc_id = g.doc_id AND c.start < g.stop AND g.start < c.stop)" for c in claims) or "true"
    claims = ", ".join(f"c{k} AS (SELECT * FROM g WHERE kind = 'k' AND ord = {k} AND {free(*(f'c{j}' for j in range(k)))})" for k in range(len(CONTEXT[0])))
    names = [f"c{k}" for k in range(len(CONTEXT[0]))]
    return f"""WITH v(kind, ord, p) AS (VALUES {values}), t AS (SELECT doc_id, lower(text) AS low FROM documents),
    s AS (SELECT doc_id, kind, ord, p, string_split(low, p) AS parts FROM t, v WHERE contains(low, p)),
    e AS (SELECT doc_id, kind, ord, p, unnest(parts) AS part, generate_subscripts(parts, 1) AS k, len(parts) AS n FROM s),
    w AS (SELECT *, sum(length(part)) OVER o + (k - 1) * length(p) AS start, lead(part) OVER o AS next FROM e WINDOW o AS (PARTITION BY doc_id, kind, p ORDER BY k)),
    h AS (SELECT doc_id, kind, ord, p, start, start + length(p) AS stop FROM w WHERE k < n AND CASE WHEN part = '' THEN k = 1 ELSE NOT regexp_matches(right(part, 1), '{letter}') END
        AND CASE WHEN next = '' THEN k + 1 = n ELSE NOT regexp_matches(left(next, 1), '{letter}') END),
    x AS (SELECT h.*, substr(low, CAST(greatest(0, start - 50) AS BIGINT) + 1, CAST(least(start, 50) + stop - start + 50 AS BIGINT)) AS around FROM h JOIN t USING (doc_id)),
    g AS (SELECT doc_id, kind, ord, p, start, stop FROM x WHERE NOT CASE kind WHEN 'k' THEN {veto[0]} ELSE {veto[1]} END), {claims},
    points AS ({" UNION ALL ".join(f"SELECT doc_id, len(string_split(p, ' ')) AS n FROM {c}" for c in names)} UNION ALL SELECT doc_id, -1 FROM g WHERE kind = 'a' AND {free(*names)}),
    total AS (SELECT doc_id, CAST(sum(n) AS INTEGER) AS score FROM points GROUP BY doc_id),
    named AS (SELECT doc_id, string_agg(p, ', ' ORDER BY ord) FILTER (kind = 'k') AS k, string_agg(p, ', ' ORDER BY ord) FILTER (kind = 'a') AS a FROM (SELECT DISTINCT doc_id, kind, ord, p FROM g) GROUP BY doc_id)
    SELECT doc_id, coalesce(score, 0) AS score, coalesce(k, '') AS keywords, coalesce(a, '') AS anti_keywords FROM documents LEFT JOIN total USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("context_score", _context_sql())
def context_score(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return keywords.context_score(docs, *CONTEXT).withColumnRenamed("id", "doc_id")


@query("title_priority", """WITH t AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&amp;', '&', 'g') AS text FROM pages)
SELECT page_id, least(CAST(count(p) AS INTEGER), 1) AS priority FROM t LEFT JOIN (VALUES ('the'), ('de')) v(p) ON contains(' ' || """ + NORM + """ || ' ', ' ' || p || ' ') GROUP BY page_id""")
def title_priority(spark, sf_dir):
    titles = read(spark, sf_dir, "pages").select("page_id", web.title(F.col("html")).alias("text"))
    found = keywords.scores(titles, ["the", "de"], "page_id")
    return titles.join(found.withColumnRenamed("id", "page_id"), "page_id", "left").select("page_id", F.least(F.coalesce("unique_count", F.lit(0)), F.lit(1)).cast("int").alias("priority"))


@query("normalize_text", f"SELECT doc_id, {NORM} AS norm FROM documents")
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


@query(
    "token_filter",
    r"""SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '),
    lambda w: regexp_matches(w, '^[\p{L}\p{N}]+$') AND NOT list_contains(['the','of','and','de','la','to'], lower(w))), ' ') AS kept FROM documents""",
)
def token_filter(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.keep_tokens(F.col("text"), STOP), " ").alias("kept"))


@query("clean_newlines", "SELECT conv_id, turn, replace(coalesce(text, ''), chr(10), ' ') AS line FROM conversations")
def clean_newlines(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_newlines(T.sanitize(F.col("text"), "string")).alias("line"))


_URL_SQL = r"""
u AS (SELECT id, url, regexp_replace(regexp_replace(url, '[ ;\n\t]+$', ''), '^https?://web\.archive\.org/web/[0-9a-z_*]+/(.+)$', '\1') AS x FROM src),
p AS (SELECT *, CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN lower(regexp_extract(x, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) ELSE 'https' END AS scheme,
        regexp_replace(x, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//', '') AS rest FROM u),
h AS (SELECT *, replace(lower(regexp_replace(regexp_extract(rest, '^([^/?#]*)', 1), '^.*@', '')), 'www.', '') AS h0,
        regexp_replace(regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/+$', ''), ';+$', '') AS p0,
        regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS q FROM p),
e AS (SELECT *, CASE WHEN scheme = 'http' THEN regexp_replace(h0, ':(80)?$', '') WHEN scheme = 'https' THEN regexp_replace(h0, ':(443)?$', '') ELSE h0 END AS host,
        replace(url_encode(url_decode(replace(regexp_replace(regexp_replace(p0, '%([^0-9A-Fa-f])', '%25\1', 'g'), '%$', '%25'), '+', '%2B'))), '%2F', '/') AS path FROM h),
done AS (SELECT id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS normal FROM e)
SELECT id, normal FROM done"""


@query("normalize_url", "WITH src AS (SELECT page_id AS id, url FROM pages)," + _URL_SQL)
def normalize_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), U.normalize_url(F.col("url")).alias("normal"))


@query("normalize_url_edges", f"WITH src AS ({fx('raw_urls')})," + _URL_SQL)
def normalize_url_edges(spark, sf_dir):
    return fixture(spark, "raw_urls").select("id", U.normalize_url(F.col("url")).alias("normal"))


@query(
    "url_parts",
    r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS domain, regexp_matches(url, '(?i)^https?://[^/?#]+') AS valid,
    CASE WHEN starts_with(url, 'https') THEN 'https://' ELSE 'http://' END || lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) || '/robots.txt' AS robots_url,
    ends_with(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), 'example.com') AS own, regexp_extract(url, '([^/]*)$', 1) AS file FROM pages""",
)
def url_parts(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", U.domain(u).alias("domain"), U.is_valid(u).alias("valid"), U.robots_url(u).alias("robots_url"), U.domain(u).endswith("example.com").alias("own"), U.file_name(u).alias("file"))


@query("full_url", f"""SELECT href, base, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(base, '^[a-z]+:') || href WHEN starts_with(href, '/') THEN regexp_extract(base, '^[a-z]+://[^/?#]*') || href
WHEN starts_with(href, '#') THEN regexp_extract(base, '^[^#]*') || href ELSE regexp_extract(base, '^[a-z]+://[^/]*/(?:[^/?#]*/)*') || href END AS url FROM ({fx('links_in')})""")
def full_url(spark, sf_dir):
    return fixture(spark, "links_in").withColumn("url", U.full_url(F.col("href"), F.col("base")))


@query(
    "allow_exclude",
    """SELECT page_id, url, contains(url, 'blog.') AS archived FROM pages WHERE (contains(url, 'example.com') OR contains(url, 'example.org')) AND NOT starts_with(url, 'http://m.') AND NOT starts_with(url, 'https://m.')""",
)
def allow_exclude(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    allowed = spark.createDataFrame([("example.com",), ("example.org",)], "pattern string")
    prefixes = spark.createDataFrame([("http://m.",), ("https://m.",)], "prefix string")
    return frontier.excluded(frontier.allowed(pages, allowed), prefixes).withColumn("archived", F.contains("url", F.lit("blog.")))


@query("mime_route", f"""SELECT mime, page_type, CASE WHEN contains(lower(coalesce(mime, '')), 'html') THEN 'page' WHEN contains(lower(coalesce(mime, '')), 'rss') OR page_type = 'feed' THEN 'feed'
WHEN contains(lower(coalesce(mime, '')), 'xml') OR page_type = 'sitemap' THEN 'sitemap' ELSE 'drop' END AS route FROM ({fx('mimes')})""")
def mime_route(spark, sf_dir):
    return fixture(spark, "mimes").withColumn("route", web.route(F.col("mime"), F.col("page_type")))


@query("path_route", f"""SELECT url, CASE WHEN regexp_matches(url, '/iplayer/episode/[^/]+') THEN 'video:' || regexp_extract(url, '/iplayer/episode/([^/]+)', 1)
WHEN regexp_matches(url, '/sounds/play/[^/]+') THEN 'audio:' || regexp_extract(url, '/sounds/play/([^/]+)', 1) ELSE 'none' END AS route FROM ({fx('media_urls')})""")
def path_route(spark, sf_dir):
    return fixture(spark, "media_urls").withColumn("route", web.path_route(F.col("url")))


@query("policy_canonical", f"""WITH j AS (SELECT u.url, u.query, p.* FROM ({fx('policy_urls')}) u LEFT JOIN ({fx('policies')}) p ON u.domain = p.domain AND u.path = p.path),
k AS (SELECT url, unnest(string_split(query, '&')) AS part, generate_subscripts(string_split(query, '&'), 1) AS pos, params, except_names, drop_names, coalesce(key_order, false) AS key_order FROM j),
f AS (SELECT *, split_part(part, '=', 1) AS name FROM k)
SELECT url, string_agg(part, '&' ORDER BY CASE WHEN key_order THEN name ELSE '' END, pos) AS canonical FROM f
WHERE (NOT coalesce(params, false) OR list_contains(string_split(except_names, ','), name)) AND (drop_names IS NULL OR NOT list_contains(string_split(drop_names, ','), name)) GROUP BY url""")
def policy_canonical(spark, sf_dir):
    urls, rules = fixture(spark, "policy_urls"), fixture(spark, "policies")
    out = urls.join(rules, ["domain", "path"], "left")
    only = F.when(F.col("params"), F.split("except_names", ","))
    return out.select("url", U.canonical_query(F.col("query"), only, F.split("drop_names", ","), F.coalesce("key_order", F.lit(False))).alias("canonical"))


def _doc_frontier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("https://"), "source", F.lit(".org/"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("domain"), (F.col("n_chars") % 1000 / 10.0).alias("url_score"), F.lit("unseen").alias("status"))


@query(
    "frontier_pop",
    """WITH f AS (SELECT 'https://' || source || '.org/' || doc_id AS url, source AS domain, (n_chars % 1000) / 10.0 AS url_score FROM documents WHERE NOT contains(lower(source), 'src1')),
    r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY url_score DESC, url) AS rn FROM f)
    SELECT url, domain, CAST(url_score AS DOUBLE) AS url_score, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 5""",
)
def frontier_pop(spark, sf_dir):
    delayed = spark.createDataFrame([("SRC1",)], "domain string")
    return frontier.pop(_doc_frontier(spark, sf_dir), 5, delayed).select("url", "domain", "url_score", "rn")


@query(
    "frontier_batch",
    """WITH f AS (SELECT 'https://' || source || '.org/' || doc_id AS url, source AS domain, (n_chars % 1000) / 10.0 AS url_score FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY url_score DESC, url) AS rn FROM f)
    SELECT url, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 50 ORDER BY rn, url_score DESC, url LIMIT 50""",
)
def frontier_batch(spark, sf_dir):
    return frontier.pop(_doc_frontier(spark, sf_dir), 50, batch=50).select("url", "rn")


@query("frontier_states", f"""SELECT url, CAST(row_number() OVER (PARTITION BY domain ORDER BY url_score DESC NULLS LAST, url) AS INTEGER) AS rn FROM ({fx('frontier')}) WHERE status = 'unseen' AND domain <> 'slow.net' AND retries < 3""")
def frontier_states(spark, sf_dir):
    rows = fixture(spark, "frontier").where("retries < 3")
    return frontier.pop(rows, 10, spark.createDataFrame([("slow.",)], "domain string")).select("url", "rn")


_LINKS = """links AS (SELECT DISTINCT page_id, url AS src, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
r AS (SELECT page_id, src, href, CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '/') THEN regexp_extract(src, '^([a-z]+://[^/?#]*)', 1) || href END AS url FROM links)"""


@query("links", f"WITH {_LINKS} SELECT page_id, src, href, url FROM r")
def links(spark, sf_dir):
    return web.links(read(spark, sf_dir, "pages"))


@query("frontier_push", f"WITH {_LINKS} SELECT DISTINCT url FROM r WHERE url NOT IN (SELECT url FROM pages) AND regexp_matches(url, '^https?://[^/?#]+')")
def frontier_push(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    found = web.links(pages).where(U.is_valid(F.col("url"))).select("url")
    return frontier.push(pages.select("url"), found)


@query("link_domain_sets", f"""WITH {_LINKS} SELECT href, CAST(count(DISTINCT d) AS BIGINT) AS n, string_agg(DISTINCT d, ',' ORDER BY d) AS domains FROM (SELECT href, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS d FROM r) GROUP BY href""")
def link_domain_sets(spark, sf_dir):
    rows = web.links(read(spark, sf_dir, "pages")).select("href", U.domain(F.col("url")).alias("d"))
    return rows.groupBy("href").agg(F.countDistinct("d").alias("n"), F.array_join(F.array_sort(F.collect_set("d")), ",").alias("domains"))


@query("crawl_bfs", f"""WITH RECURSIVE {_LINKS}, hosts AS (SELECT url AS u, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS h FROM pages),
e AS (SELECT DISTINCT h AS src, 'w:' || href AS dst FROM r JOIN hosts ON r.src = hosts.u UNION SELECT DISTINCT 'w:' || href, h FROM r JOIN hosts ON r.src = hosts.u),
walk(url, depth) AS (SELECT (SELECT min(src) FROM e WHERE NOT starts_with(src, 'w:')), 0 UNION SELECT e.dst, depth + 1 FROM walk JOIN e ON walk.url = e.src WHERE depth < 4)
SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY url""")
def crawl_bfs(spark, sf_dir):
    out = web.links(read(spark, sf_dir, "pages")).select(U.domain(F.col("src")).alias("host"), F.concat(F.lit("w:"), "href").alias("word"))
    edges = out.select(F.col("host").alias("src"), F.col("word").alias("dst")).union(out.select("word", "host")).distinct()
    return frontier.crawl(edges, out.agg(F.min("host").alias("url")), 4)


def site_graph(spark, sf_dir):
    """(links, pages, start) of a walk from host to link and from link to host; a link that fewer than three pages hold leads nowhere."""
    pages = read(spark, sf_dir, "pages")
    rows = web.links(pages).select("page_id", U.domain(F.col("src")).alias("host"), F.concat(F.lit("w:"), "href").alias("word"))
    links = rows.select(F.col("host").alias("src"), F.col("word").alias("dst")).union(rows.select("word", "host"))
    words = rows.groupBy(F.col("word").alias("url")).agg(F.count(F.lit(1)).alias("score")).where("score > 2")
    texts = pages.select(U.domain(F.col("url")).alias("url"), web.strip_boilerplate(F.col("html")).alias("text"))
    hosts = keywords.scores(texts, PHRASES, "url").groupBy(F.col("id").alias("url")).agg(F.sum("unique_count").alias("score"))
    known = texts.select("url").distinct().join(hosts, "url", "left").select("url", F.coalesce("score", F.lit(0)).alias("score"))
    return links, known.unionByName(words), rows.agg(F.min("host").alias("url"))


@query("crawl_best_first")
def crawl_best_first(spark, sf_dir):
    links, pages, start = site_graph(spark, sf_dir)
    walk = crawl.BestFirst(start, links, pages, lambda url: F.when(F.startswith(url, F.lit("w:")), F.substring(url, 1, 5)).otherwise(url), per_domain=20, retries=1)
    walk.run(rounds=12)
    return walk.result()


@query(
    "events_merged",
    """WITH d AS (SELECT user_id, event_id, event_type, value, ts, event_id * 10 // (SELECT max(event_id) + 1 FROM events) AS part FROM events)
    SELECT user_id, r.event_id, r.event_type, r.value FROM (SELECT user_id, arg_max({event_id: event_id, event_type: event_type, value: value}, (part, ts, event_id)) AS r FROM d GROUP BY user_id)""",
)
def events_merged(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    n = events.agg(F.max("event_id") + 1).first()[0]
    table = keyed.Snapshot(spark, shared.fresh_path(spark), "user_id", buckets=16)
    for part in range(10):
        table.merge(events.where(F.expr(f"event_id * 10 div {n} = {part}")), part, F.col("ts"), F.col("event_id"))
    return table.read("user_id long, event_id long, event_type string, value double")


@query("upsert_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def upsert_latest(spark, sf_dir):
    return frontier.latest(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type")


@query("upsert_records", f"""WITH o AS ({fx('crawled')}), d AS (SELECT * FROM ({fx('recrawled')}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1)
SELECT coalesce(o.url, d.url) AS url, coalesce(o.root_domain, d.root_domain) AS root_domain, coalesce(d.score, o.score) AS score, coalesce(d.headline, o.headline) AS headline FROM o FULL JOIN d ON o.url = d.url""")
def upsert_records(spark, sf_dir):
    return frontier.upsert(fixture(spark, "crawled"), fixture(spark, "recrawled"), "url", F.col("seq"), keep=("root_domain",)).drop("seq")


@query("queue_updates", f"""SELECT f.url, coalesce(c.url_score, f.url_score) AS url_score, coalesce(c.status, f.status) AS status FROM ({fx('frontier')}) f LEFT JOIN ({fx('changes')}) c ON f.url = c.url""")
def queue_updates(spark, sf_dir):
    return frontier.update(fixture(spark, "frontier"), fixture(spark, "changes"), "url", ["status", "url_score"]).select("url", "url_score", "status")


@query("queue_counts", f"SELECT status, count(*) AS n FROM ({fx('frontier')}) GROUP BY status")
def queue_counts(spark, sf_dir):
    return fixture(spark, "frontier").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("queue_seed", "SELECT DISTINCT url, 'webpage' AS page_type, CAST(0 AS DOUBLE) AS url_score, 'unseen' AS status FROM pages UNION ALL SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*') || '/feed', 'feed', CAST(0 AS DOUBLE), 'unseen' FROM pages")
def queue_seed(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    feeds = pages.select(F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0), F.lit("/feed")).alias("url"))
    return frontier.seed(pages.select("url").distinct(), feeds.distinct())


@query("dedup_first", "SELECT lang, source, arg_min(text, doc_id) AS text, min(doc_id) AS doc_id FROM documents GROUP BY lang, source")
def dedup_first(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("lang", "source", "text", "doc_id")
    return frontier.first(rows, ["lang", "source"], F.col("doc_id"))


_VISIBLE = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"')


@query(
    "plugged_pages",
    r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h1[^>]*>.*?</h1>|<h2[^>]*>.*?</h2>|<h3[^>]*>.*?</h3>')) AS x FROM pages),
    t AS (SELECT page_id, CAST(substr(x, 3, 1) AS INTEGER) AS level, trim(regexp_replace(x, '(?s)<[^>]*>', '', 'g')) AS heading FROM h),
    n AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)
    SELECT page_id, level, heading, len(list_filter(l, lambda x: starts_with(x, '/'))) AS own, len(list_filter(l, lambda x: NOT starts_with(x, '/'))) AS elsewhere FROM n LEFT JOIN t USING (page_id)""",
)
def plugged_pages(spark, sf_dir):
    """The stages of a crawl at which content has been read, with two plug-ins."""
    plugs = hooks.Hooks()
    plugs.plug("on_metadata_extracted", hooks.Headings, "level int, heading string", "html")
    plugs.plug("on_content_analyzed", hooks.LinkCounts, "own long, elsewhere long", "html")
    pages = read(spark, sf_dir, "pages").select("page_id", "html")
    for stage in ("on_metadata_extracted", "on_content_analyzed"):
        pages = plugs.run(stage, pages)
    return pages.drop("html")


@query("page_title", "SELECT page_id, trim(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&amp;', '&')) AS title FROM pages")
def page_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", web.title(F.col("html")).alias("title"))


@query("page_paragraphs", "SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1), lambda x: " + _VISIBLE.format(x="x") + "), lambda t: t <> ''), ' ') AS body FROM pages")
def page_paragraphs(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", web.paragraphs(F.col("html")).alias("body"))


def _strip_sql(x: str) -> str:
    for tag in web.STRIPPED.split("|"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b.*?</{tag}>', ' ', 'g')"
    return _VISIBLE.format(x=f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')")


@query("page_stripped", f"SELECT page_id, {_strip_sql('html')} AS body FROM pages")
def page_stripped(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", web.strip_boilerplate(F.col("html")).alias("body"))


@query("page_readable", f"SELECT page_id, coalesce(nullif({_strip_sql('regexp_extract(html, ' + chr(39) + '(?is)<article' + chr(92) + 'b[^>]*>(.*?)</article>' + chr(39) + ', 1)')}, ''), {_strip_sql('html')}) AS body FROM pages")
def page_readable(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", web.readable(F.col("html")).alias("body"))


@query("canonical_link", f"""WITH src AS (SELECT page_id AS id, nullif(regexp_extract(html, 'rel="canonical" href="([^"]*)"', 1), '') AS url FROM ({fx('links_html')})),{_URL_SQL.replace('SELECT id, normal FROM done', 'SELECT id AS page_id, normal AS canonical FROM done')}""")
def canonical_link(spark, sf_dir):
    return fixture(spark, "links_html").select("page_id", U.normalize_url(web.canonical(F.col("html"))).alias("canonical"))


_LD_FIELDS = {"headline": "headline", "date_published": "datePublished", "date_modified": "dateModified", "author": "author", "keywords": "keywords", "publisher": "publisher.name", "url": "url"}


@query("json_ld", f"""WITH s AS (SELECT page_id, regexp_extract_all(html, '(?is)<script[^>]*type="application/ld\\+json"[^>]*>(.*?)</script>', 1) AS all_scripts FROM ({fx('jsonld')})),
o AS (SELECT page_id, list_filter(list_transform(all_scripts, lambda x: CASE WHEN json_valid(x) THEN CASE WHEN starts_with(ltrim(x), '[') THEN CAST(json_extract(x, '$[0]') AS VARCHAR) ELSE x END END), lambda x: x IS NOT NULL AND starts_with(x, '{{'))[1] AS j FROM s)
SELECT page_id, """ + ", ".join(f"json_extract_string(j, '$.{f}') AS {n}" for n, f in _LD_FIELDS.items()) + ", CASE WHEN j IS NOT NULL THEN coalesce(json_extract_string(j, '$.\"@type\"'), 'WebPage') END AS type FROM o")
def json_ld(spark, sf_dir):
    rows = fixture(spark, "jsonld").withColumn("j", web.json_ld(F.col("html")))
    m = web.metadata(F.col("j"))
    return rows.select("page_id", *[m[k].alias(k) for k in (*_LD_FIELDS, "type")])


SITEMAP = "<urlset><url><loc>https://a.org/1</loc><lastmod>2020-01-01</lastmod><priority>0.5</priority></url><url><lastmod>x</lastmod></url><url><loc>https://a.org/2</loc><changefreq>daily</changefreq></url></urlset>"
RSS = "<rss><channel><item><title>One</title><link>https://a.org/1</link></item><item><title>Two</title><link>https://a.org/2</link></item></channel></rss>"
ATOM = '<feed><entry><title>Three</title><link href="https://a.org/3"/></entry></feed>'


@query("sitemap", f"""WITH u AS (SELECT unnest(regexp_extract_all('{SITEMAP}', '(?s)<url>(.*?)</url>', 1)) AS x), f AS (SELECT """ + ", ".join(f"nullif(regexp_extract(x, '<{t}>(.*?)</{t}>', 1), '') AS {t}" for t in ("loc", "lastmod", "changefreq", "priority")) + " FROM u) SELECT loc, lastmod, changefreq, CAST(priority AS DOUBLE) AS priority FROM f WHERE loc IS NOT NULL")
def sitemap(spark, sf_dir):
    return web.sitemap(spark.createDataFrame([(SITEMAP,)], "xml string"))


@query("feed", f"""WITH i AS (SELECT unnest(regexp_extract_all('{RSS}', '(?s)<item>(.*?)</item>', 1)) AS x), e AS (SELECT unnest(regexp_extract_all('{ATOM}', '(?s)<entry>(.*?)</entry>', 1)) AS x)
SELECT regexp_extract(x, '<link>(.*?)</link>', 1) AS link, regexp_extract(x, '<title>(.*?)</title>', 1) AS title FROM i UNION ALL SELECT regexp_extract(x, '<link href="([^"]*)"', 1), regexp_extract(x, '<title>(.*?)</title>', 1) FROM e""")
def feed(spark, sf_dir):
    return web.feed(spark.createDataFrame([(RSS,), (ATOM,)], "xml string"))


def _groups_sql(source: str, pattern: str, names, keys=("doc_id", "page"), column="text", first: int = 0) -> str:
    """Every match of a pattern with its groups by name: one list a group, unnested side by side."""
    quoted = pattern.replace("'", "''")
    lists = ", ".join(f"regexp_extract_all({column}, '{quoted}', {k + 1}) AS g{k}" for k in range(len(names)))
    picked = ", ".join(f'g{k}[place] AS "{n}"' for k, n in enumerate(names))
    head = ", ".join(keys)
    return f"SELECT {head}, CAST(place - 1 + {first} AS INTEGER) AS pos, {picked} FROM (SELECT *, unnest(range(1, len(g0) + 1)) AS place FROM (SELECT {head}, {lists} FROM ({source})))"


_COMPLAINT = ("programme", "service", "date", "issue", "outcome")


@query("complaint_rows", _groups_sql(fx("reports"), records.ROW, _COMPLAINT))
def complaint_rows(spark, sf_dir):
    return records.rows(fixture(spark, "reports"))


@query("complaint_stage1", _groups_sql(fx("stage1"), records.STAGE1, (*_COMPLAINT[:4], "complaints")).replace('g0[place] AS', 'trim(regexp_replace(g0[place], \'^\\s+\', \'\')) AS'))
def complaint_stage1(spark, sf_dir):
    out = records.rows(fixture(spark, "stage1"), records.STAGE1, ("programme", "service", "date", "issue", "complaints"))
    return out.withColumn("programme", F.trim(F.regexp_replace("programme", r"^\s+", "")))


@query("complaint_summaries", f"""WITH whole AS (SELECT doc_id, string_agg(text, '' ORDER BY page) AS t FROM ({fx('summaries')}) GROUP BY doc_id),
p AS (SELECT doc_id, unnest(string_split(t, chr(10) || chr(10))) AS s, unnest(range(len(string_split(t, chr(10) || chr(10))))) AS pos FROM whole)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, """ + ", ".join(f"regexp_extract(s, '{records.TITLE}', {k}) AS {n}" for k, n in ((1, "title"), (2, "service"), (3, "date")))
+ "".join(f", CASE WHEN regexp_matches(s, '{x}') THEN trim(regexp_extract(s, '{x}', 1)) ELSE 'N/A' END AS {n}" for x, n in ((records.COMPLAINT, "complaint"), (records.OUTCOME, "outcome"), (records.FURTHER, "further")))
+ f" FROM p WHERE regexp_matches(s, '{records.TITLE}')")
def complaint_summaries(spark, sf_dir):
    return records.summaries(fixture(spark, "summaries"))


@query("programme_segments", """SELECT * FROM (VALUES (1, 1, 0, 'prog_station_date', 'Morning Show', 'BBC One', '3 April 2020'), (1, 1, 1, 'prog_station_date', 'A very long title', 'BBC Two', '4 May 2021'),
(2, 1, 0, 'prog_wip', 'The Pilot', '', ''), (2, 1, 1, 'red_button', '', 'BBC Red Button', '')) t(doc_id, page, pos, kind, programme, station, date)""")
def programme_segments(spark, sf_dir):
    return records.segments(fixture(spark, "segments"))


@query("master_rows", "SELECT Programme, coalesce(Issue, 'N/A') AS Issue, " + ", ".join(f"'N/A' AS \"{c}\"" for c in records.COLUMNS if c not in ("Programme", "Issue")) + f" FROM ({fx('master')})")
def master_rows(spark, sf_dir):
    return records.align(fixture(spark, "master"))


PAGE_FIELDS = [(1, '<h1 id="block-contact-page-title">Show, One, 3 May</h1>'), (2, '<h1 id="block-contact-page-title">Show</h1><p class="service">Two</p><time datetime="x">4 May</time>'), (3, "<p></p>")]


@query("page_fields", "SELECT * FROM (VALUES (1, 'Show', 'One', '3 May'), (2, 'Show', 'Two', '4 May'), (3, 'N/A', 'N/A', 'N/A')) t(page_id, programme, service, date)")
def page_fields(spark, sf_dir):
    return records.page_fields(spark.createDataFrame(PAGE_FIELDS, "page_id int, html string"))


CORRECTIONS = [(1, "<h2>First</h2><p>One.</p><p>Two.</p><p><em>3 May</em></p><h2>Second</h2><p>Only.</p>")]


@query("corrections", "SELECT * FROM (VALUES (1, 0, 'First', '3 May', 'One. Two.'), (1, 1, 'Second', 'No date found', 'Only.')) t(page_id, pos, title, date, correction_text)")
def corrections(spark, sf_dir):
    return records.corrections(spark.createDataFrame(CORRECTIONS, "page_id int, html string"))


TILE = '<div class="tile {}"><time datetime="{}"></time><a href="{}">x</a><a href="{}">y</a></div>'
TILES = [(1, "https://www.own.org/list", "".join(TILE.format(*t) for t in (("white-bg", "d1", "/a", "/a.pdf"), ("white-bg", "d2", "/b", "/c"), ("dark", "d3", "/d", "/e"), ("white-bg", "d4", "/a", "https://other.org/f.pdf")))), (2, "https://www.own.org/list", TILE.format("white-bg", "d", "/z", "/y"))]


@query("listing_tiles", "SELECT * FROM (VALUES (1, 0, 'd1', 'https://www.own.org/a', 'https://www.own.org/a.pdf'), (1, 1, 'd2', 'https://www.own.org/c', NULL)) t(page_id, pos, time, link, pdf_link)")
def listing_tiles(spark, sf_dir):
    return records.tiles(spark.createDataFrame(TILES, "page_id int, url string, html string"), "own.org")


_CUES = (
    r"""SELECT doc_id, pos AS n, "begin", "end", trim(regexp_replace(regexp_replace(t, '<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')) AS text FROM ("""
    + _groups_sql(fx("ttml"), r'(?s)<p[^>]*begin="([^"]*)"[^>]*end="([^"]*)"[^>]*>(.*?)</p>', ("begin", "end", "t"), ("doc_id",), "ttml", 1)
    + ")"
)


@query("ttml_cues", _CUES)
def ttml_cues(spark, sf_dir):
    return web.cues(fixture(spark, "ttml"))


@query("subtitle_text", f"""SELECT doc_id, string_agg(n || chr(10) || replace("begin", '.', ',') || ' --> ' || replace("end", '.', ',') || chr(10) || text || chr(10), chr(10) ORDER BY n) AS srt FROM ({_CUES}) GROUP BY doc_id""")
def subtitle_text(spark, sf_dir):
    return web.subtitles(web.cues(fixture(spark, "ttml")))


@query("robots_join", "SELECT * FROM (VALUES ('https://a.org/private/x', false), ('https://a.org/private/open/1', true), ('https://a.org/', true), ('https://b.org/x', false), ('https://c.org/x', true), ('https://d.org/private', true), ('https://e.org/z', true), ('https://f.org/z', true)) t(url, can_fetch)")
def robots_join(spark, sf_dir):
    return robots.verdicts(fixture(spark, "robot_urls"), fixture(spark, "robots"), now=1_000_500).select("url", "can_fetch")


_BOX = f"SELECT c.page, c.row_id, l.pos, l.uri FROM ({fx('cells')}) c JOIN ({fx('boxes')}) l ON c.page = l.page AND "
_STRICT = "c.x2 > c.x1 AND c.y2 > c.y1 AND l.x2 > l.x1 AND l.y2 > l.y1 AND c.x1 < l.x2 AND l.x1 < c.x2 AND c.y1 < l.y2 AND l.y1 < c.y2"
_TOUCH = "c.x1 <= l.x2 AND l.x1 <= c.x2 AND c.y1 <= l.y2 AND l.y1 <= c.y2"


@query("bbox_first", f"SELECT page, row_id, arg_min(uri, pos) AS uri FROM ({_BOX}{_STRICT}) GROUP BY page, row_id")
def bbox_first(spark, sf_dir):
    return match.first_link(fixture(spark, "cells"), fixture(spark, "boxes"))


@query("bbox_touching", f"SELECT page, row_id, pos, uri FROM ({_BOX}{_TOUCH})")
def bbox_touching(spark, sf_dir):
    return match.box_pairs(fixture(spark, "cells"), fixture(spark, "boxes"), strict=False)


@query("bbox_claimed", "SELECT * FROM (VALUES (1, 1, 'u1'), (1, 2, 'u2'), (2, 1, 'u5')) t(page, row_id, uri)")
def bbox_claimed(spark, sf_dir):
    return match.claimed_links(fixture(spark, "cells"), fixture(spark, "boxes"))


@query("bbox_unmatched", "SELECT * FROM (VALUES (1, 'u3'), (2, 'u4')) t(page, uri)")
def bbox_unmatched(spark, sf_dir):
    links_ = fixture(spark, "boxes")
    return match.unmatched(links_, match.claimed_links(fixture(spark, "cells"), links_))


@query("fuzzy_best", "SELECT * FROM (VALUES (1, 'reports/morning-show-may', 1), (1, 'reports/evening-news', 2)) t(block, url, row_id)")
def fuzzy_best(spark, sf_dir):
    return match.best_rows(fixture(spark, "fuzzy_urls"), fixture(spark, "fuzzy_rows")).select("block", "url", "row_id")


#: The token set ratio of pairs(id, a, b) as relation ratios(id, ratio): a table of common subsequences, a row a step.
_RATIO = r"""
w AS (SELECT id, list_distinct(list_filter(string_split_regex(lower(a), '\s+'), lambda x: x <> '')) AS aw, list_distinct(list_filter(string_split_regex(lower(b), '\s+'), lambda x: x <> '')) AS bw FROM pairs),
d AS (SELECT *, array_to_string(list_sort(list_filter(aw, lambda x: NOT list_contains(bw, x))), ' ') AS x, array_to_string(list_sort(list_filter(bw, lambda x: NOT list_contains(aw, x))), ' ') AS y,
    length(array_to_string(list_filter(aw, lambda x: list_contains(bw, x)), ' ')) AS n FROM w),
lcs AS (SELECT id, x, y, 0 AS i, list_transform(range(length(y)), lambda j: 0) AS r FROM d UNION ALL
    SELECT id, x, y, i + 1, list_transform(range(1, length(y) + 1), lambda j: list_max(list_slice(t, 1, j))) FROM
    (SELECT *, list_transform(range(1, length(y) + 1), lambda j: greatest(r[j], CASE WHEN j > 1 THEN r[j - 1] ELSE 0 END + CASE WHEN substr(x, i + 1, 1) = substr(y, j, 1) THEN 1 ELSE 0 END)) AS t FROM lcs WHERE i < length(x))),
c AS (SELECT id, coalesce(arg_max(r[-1], i), 0) AS common FROM lcs GROUP BY id),
g AS (SELECT d.*, common, CASE WHEN n > 0 THEN 1 ELSE 0 END AS gap FROM d JOIN c ON d.id = c.id),
ratios AS (SELECT id, CASE WHEN len(aw) = 0 OR len(bw) = 0 THEN 0.0 WHEN n > 0 AND (x = '' OR y = '') THEN 100.0 ELSE 100.0 * greatest(
    1 - (length(x) + length(y) - 2 * common)::DOUBLE / (2 * n + 2 * gap + length(x) + length(y)),
    CASE WHEN n > 0 THEN 1 - (gap + length(x))::DOUBLE / (2 * n + gap + length(x)) ELSE 0 END,
    CASE WHEN n > 0 THEN 1 - (gap + length(y))::DOUBLE / (2 * n + gap + length(y)) ELSE 0 END) END AS ratio FROM g)"""


@query("token_set_ratio", f"WITH RECURSIVE pairs AS ({fx('name_pairs')}),{_RATIO} SELECT id, round(ratio, 6) AS ratio FROM ratios")
def token_set_ratio(spark, sf_dir):
    return fixture(spark, "name_pairs").select("id", F.round(match.token_set_ratio(F.lower("a"), F.lower("b")), 6).alias("ratio"))


_TOKEN_BEST = f"""u AS ({fx('slot_urls')}), s AS ({fx('slots')}), pairs AS (SELECT u.block * 10000 + u.pos * 100 + s.row_id AS id, u.text AS a, s.text AS b FROM u JOIN s ON u.block = s.block),{_RATIO},
best AS (SELECT u.block, u.url, u.pos, arg_max(s.row_id, (ratio, -s.row_id)) AS row_id, max(ratio) AS ratio FROM u JOIN s ON u.block = s.block JOIN ratios ON id = u.block * 10000 + u.pos * 100 + s.row_id GROUP BY ALL)"""


@query("token_best", f"WITH RECURSIVE {_TOKEN_BEST} SELECT block, url, row_id, round(ratio, 6) AS ratio FROM best WHERE ratio > 70")
def token_best(spark, sf_dir):
    return match.best_token_rows(fixture(spark, "slot_urls"), fixture(spark, "slots")).withColumn("ratio", F.round("ratio", 6))


@query("token_claimed", f"WITH RECURSIVE {_TOKEN_BEST}, f AS (SELECT block, row_id, arg_min(url, pos) AS new FROM best WHERE ratio > 70 GROUP BY ALL) SELECT s.block, s.row_id, coalesce(s.url, f.new) AS url FROM s LEFT JOIN f ON s.block = f.block AND s.row_id = f.row_id")
def token_claimed(spark, sf_dir):
    urls, rows = fixture(spark, "slot_urls"), fixture(spark, "slots")
    return match.claim_slots(match.best_token_rows(urls, rows), urls, rows)


@query("fuzzy_claimed", "SELECT * FROM (VALUES (1, 1, 'reports/morning-show-may'), (1, 2, 'reports/evening-news'), (1, 3, 'taken'), (1, 4, NULL), (2, 1, NULL)) t(block, row_id, url)")
def fuzzy_claimed(spark, sf_dir):
    urls, rows = fixture(spark, "slot_urls"), fixture(spark, "slots")
    return match.claim_slots(match.best_rows(urls, rows), urls, rows)


_GRID = f"h AS (SELECT c.page, c.row_id, c.col, arg_min(l.uri, l.pos) AS uri FROM ({fx('grid')}) c JOIN ({fx('boxes')}) l ON c.page = l.page AND {_TOUCH} GROUP BY ALL)"


@query("bbox_last_cell", f"WITH {_GRID} SELECT page, row_id, arg_max(uri, col) AS uri FROM h GROUP BY page, row_id")
def bbox_last_cell(spark, sf_dir):
    return match.last_cell_links(fixture(spark, "grid"), fixture(spark, "boxes"))


@query("bbox_loose", f"WITH {_GRID}, c AS (SELECT DISTINCT page FROM ({fx('grid')}) c WHERE NOT EXISTS (FROM h WHERE h.page = c.page AND h.row_id = c.row_id AND h.col = c.col)) SELECT page, arg_max(uri, pos) AS uri FROM ({fx('boxes')}) JOIN c USING (page) GROUP BY page")
def bbox_loose(spark, sf_dir):
    return match.loose_link(fixture(spark, "grid"), fixture(spark, "boxes"))


@query("benchmark_similar")
def benchmark_similar(spark, sf_dir):
    """For each benchmark item the most similar text among the turns of users and the items less two letters, by a common subsequence of nine tenths."""
    turns = read(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    items = read(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("id"), "text")
    return match.best_similar(items, turns.unionByName(items.select((F.col("id") - 1_000_000).alias("id"), F.substring("text", 3, 1_000_000).alias("text"))), 0.9, q=3)


@query("benchmark_best")
def benchmark_best(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select(F.substring_index(F.lower("text"), " ", 1).alias("block"), "item_id", "text")
    return match.best_rows(items.select("block", F.col("text").alias("url")), items.select("block", F.col("item_id").cast("int").alias("row_id"), "text"))


@query("entity_closure", f"""WITH RECURSIVE s AS (SELECT subject, object FROM ({fx('triples')}) WHERE predicate = 'part_of'), walk(subject, object) AS (SELECT subject, subject FROM s UNION SELECT object, object FROM s UNION SELECT walk.subject, s.object FROM walk JOIN s ON walk.object = s.subject)
SELECT DISTINCT subject, object FROM walk""")
def entity_closure(spark, sf_dir):
    return graph.closure(fixture(spark, "triples"), "part_of")


@query("link_paths", f"""WITH RECURSIVE {_LINKS}, e AS (SELECT DISTINCT lower(regexp_extract(src, '^[a-z]+://([^/?#:]*)', 1)) AS host, href FROM r),
h AS (SELECT DISTINCT a.host AS one, b.host AS two FROM e a JOIN e b ON a.href = b.href),
walk(start, node) AS (SELECT DISTINCT host, host FROM e WHERE starts_with(host, 'm.') UNION SELECT walk.start, h.two FROM walk JOIN h ON walk.node = h.one)
SELECT DISTINCT start, href AS node FROM walk JOIN e ON walk.node = e.host""")
def link_paths(spark, sf_dir):
    """From hosts of the mobile kind by links that hosts share, any number of times, to the links of what is found."""
    rows = web.links(read(spark, sf_dir, "pages")).select(U.domain(F.col("src")).alias("subject"), F.lit("links").alias("predicate"), F.col("href").alias("object")).distinct()
    start = rows.select(F.col("subject").alias("node")).where(F.startswith("node", F.lit("m.")))
    links = graph.Step("links")
    return graph.reach(start, rows, graph.Seq(graph.Star(graph.Seq(links, graph.Back("links"))), links))


@query("entity_sets", f"""WITH f AS ({fx('facts')}) SELECT entity, string_agg(DISTINCT value, ',' ORDER BY value) FILTER (attr = 'site') AS site, string_agg(DISTINCT value, ',' ORDER BY value) FILTER (attr = 'country') AS country FROM f GROUP BY entity""")
def entity_sets(spark, sf_dir):
    facts = fixture(spark, "facts")
    return graph.optional(facts.select("entity").distinct(), facts, ["site", "country"])


@query("entity_union", f"SELECT website, arg_max(label, branch) AS label FROM ({fx('sites')}) WHERE NOT contains(website, 'wikidata.org') GROUP BY website")
def entity_union(spark, sf_dir):
    rows = fixture(spark, "sites")
    return graph.last_writer(*[rows.where(F.col("branch") == k).select("website", "label") for k in range(3)], without="wikidata.org")


@query("nation_path", "SELECT n_name AS nation, r_name AS region, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def nation_path(spark, sf_dir):
    n, r, c = (read(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    per = c.groupBy("c_nationkey").agg(F.count("c_custkey").alias("customers"))
    out = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).join(per, n.n_nationkey == per.c_nationkey, "left")
    return out.select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.coalesce("customers", F.lit(0)).alias("customers"))


_STEPS = "SELECT event_type AS param, user_id % 4 AS action, event_id AS step, value / 100.0 AS reward FROM events"
_Q = f"""s AS ({_STEPS}), b AS (SELECT *, row_number() OVER (PARTITION BY param, action ORDER BY step DESC) - 1 AS k FROM s),
q AS (SELECT param, action, sum(0.1::DOUBLE * pow(0.9::DOUBLE, k) * reward) AS q, count(*) AS n FROM b GROUP BY param, action)"""


def _steps(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("param"), (F.col("user_id") % 4).alias("action"), F.col("event_id").alias("step"), (F.col("value") / 100.0).alias("reward"))


@query("bandit_q", f"WITH {_Q} SELECT param, action, round(q, 6) AS q, n FROM q")
def bandit_q(spark, sf_dir):
    return bandit.values(_steps(spark, sf_dir)).withColumn("q", F.round("q", 6))


@query("bandit_ucb", f"WITH {_Q} SELECT param, action, round(q + 2 * sqrt(ln(sum(n) OVER (PARTITION BY param) + 1) / (n + 1)), 6) AS ucb FROM q")
def bandit_ucb(spark, sf_dir):
    return bandit.upper_bounds(bandit.values(_steps(spark, sf_dir))).select("param", "action", F.round("ucb", 6).alias("ucb"))


@query("bandit_softmax", f"WITH {_Q}, e AS (SELECT *, exp(q - max(q) OVER (PARTITION BY param)) AS x FROM q) SELECT param, action, round(x / sum(x) OVER (PARTITION BY param), 6) AS p FROM e")
def bandit_softmax(spark, sf_dir):
    return bandit.softmax(bandit.values(_steps(spark, sf_dir))).select("param", "action", F.round("p", 6).alias("p"))


@query("bandit_greedy", f"WITH {_Q} SELECT param, arg_max(action, (q, -action)) AS action FROM q GROUP BY param")
def bandit_greedy(spark, sf_dir):
    return bandit.greedy(bandit.values(_steps(spark, sf_dir)))


@query("bandit_epsilon", f"SELECT param, round(greatest(pow(0.99::DOUBLE, count(*)), 0.1), 6) AS epsilon FROM ({_STEPS}) GROUP BY param")
def bandit_epsilon(spark, sf_dir):
    return bandit.epsilon(_steps(spark, sf_dir)).withColumn("epsilon", F.round("epsilon", 6))


@query("bandit_converge", f"WITH {_Q} SELECT param, count(*) >= 2 AND var_pop(q) < 0.001 AS converged FROM q GROUP BY param")
def bandit_converge(spark, sf_dir):
    return bandit.converged(bandit.values(_steps(spark, sf_dir)))


@query("bandit_policies", f"SELECT policy, score / sum(score) OVER () AS weight FROM ({fx('policy_scores')})")
def bandit_policies(spark, sf_dir):
    scores = fixture(spark, "policy_scores").select("policy", F.col("score").cast("double").alias("score"))
    return bandit.policy_weights(scores)


@query("bandit_thompson")
def bandit_thompson(spark, sf_dir):
    return bandit.thompson(bandit.values(_steps(spark, sf_dir)), seed=7)


@query("bandit_random")
def bandit_random(spark, sf_dir):
    return bandit.random_action(bandit.values(_steps(spark, sf_dir)), seed=7)


@query("bandit_epsilon_greedy")
def bandit_epsilon_greedy(spark, sf_dir):
    steps = _steps(spark, sf_dir)
    return bandit.epsilon_greedy(bandit.values(steps), bandit.epsilon(steps), seed=7)


@query("fetch_schedule", """WITH a AS (SELECT event_id, user_id % 50 AS domain, epoch(ts) AS arrival FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY arrival, event_id) - 1 AS k FROM a)
SELECT event_id, domain, CAST(round(max(arrival - k * 30.0) OVER (PARTITION BY domain ORDER BY arrival, event_id) + k * 30.0) AS BIGINT) AS start FROM n""")
def fetch_schedule(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("domain"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us")).withColumn("arrival", F.col("us") / 1e6)
    return frontier.fetch_times(rows, 30.0, "domain", "arrival", "event_id").select("event_id", "domain", F.round("start").cast("long").alias("start"))


def _requests(spark, sf_dir, key):
    """A stream of events in six files, one a micro-batch; timestamps without a zone are read as UTC."""
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 50).alias(key), F.col("event_id").alias("seq"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp"))).alias("ts"))
    at = state.in_slices(rows, "ts", 6, shared.fresh_path(spark))
    return state.files(spark, rows.schema, at)


@query("fetch_schedule_stream", ORACLE_SQL["fetch_schedule"])
def fetch_schedule_stream(spark, sf_dir):
    out = state.available_now(state.schedule(_requests(spark, sf_dir, "domain"), 30.0), shared.fresh_path(spark))
    return out.select(F.col("seq").alias("event_id"), "domain", F.round(F.col("start") / 1e6).cast("long").alias("start"))


@query(
    "robots_cache_stream",
    """WITH RECURSIVE e AS (SELECT event_id, user_id % 50 AS host, epoch_us(ts) AS us FROM events),
    f AS (SELECT host, min(us) AS us FROM e GROUP BY host UNION ALL
        SELECT f.host, (SELECT min(us) FROM e WHERE e.host = f.host AND e.us >= f.us + 86400000000) AS us FROM f WHERE f.us IS NOT NULL)
    SELECT e.host, count(*) AS asked, count(*) FILTER (EXISTS (SELECT 1 FROM f WHERE f.host = e.host AND f.us = e.us)) AS fetched FROM e GROUP BY e.host""",
)
def robots_cache_stream(spark, sf_dir):
    out = state.available_now(state.cached(_requests(spark, sf_dir, "host"), 86_400), shared.fresh_path(spark))
    return out.groupBy("host").agg(F.count(F.lit(1)).alias("asked"), F.count_if("fetched").alias("fetched"))


@query("crawl_delay", f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seq) AS k FROM ({fx('responses')})),
f(domain, k, d) AS (SELECT DISTINCT domain, 0::BIGINT, 1.0::DOUBLE FROM r UNION ALL SELECT f.domain, r.k,
    CASE WHEN status = 200 THEN d / 2 WHEN status IN (429, 503) THEN greatest(d * 2, coalesce(retry_after, 0), 300) ELSE d END FROM f JOIN r ON r.domain = f.domain AND r.k = f.k + 1)
SELECT domain, arg_max(d, k) AS delay FROM f GROUP BY domain""")
def crawl_delay(spark, sf_dir):
    return frontier.crawl_delay(fixture(spark, "responses"))


@query("search_json", f"""WITH r AS (SELECT keyword, engine, unnest(CAST(json_extract(body, '$.results[*]') AS JSON[])) AS x FROM ({fx('search_json')}))
SELECT json_extract_string(x, '$.url') AS link, coalesce(json_extract_string(x, '$.title'), json_extract_string(x, '$.url')) AS link_text, json_extract_string(x, '$.content') AS snippet, keyword, engine FROM r""")
def search_json(spark, sf_dir):
    return web.search_json(fixture(spark, "search_json"))


@query("search_links", f"""WITH r AS (SELECT keyword, engine, unnest(regexp_extract_all(html, '(?s)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS link, unnest(regexp_extract_all(html, '(?s)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS t FROM ({fx('search_html')}))
SELECT link, coalesce(nullif(trim(t), ''), link) AS link_text, keyword, engine FROM r WHERE regexp_matches(link, '^(http|www)') AND contains(link, 'site.org') AND NOT contains(link, 'bad.com') AND NOT contains(lower(t), 'cached')""")
def search_links(spark, sf_dir):
    return web.search_links(fixture(spark, "search_html"), "site.org", ["bad.com"], ["cached"])


@query("search_pages", f"""WITH h AS ({fx('hits')}), n AS (SELECT engine, keyword, page, count(*) AS n FROM h GROUP BY ALL)
SELECT h.* FROM h WHERE page <= 20 AND NOT EXISTS (FROM n WHERE n.engine = h.engine AND n.keyword = h.keyword AND n.page < h.page AND n.n < 2)""")
def search_pages(spark, sf_dir):
    return web.paged(fixture(spark, "hits"), per_page=2, most_pages=20).select("engine", "keyword", "page", "link")


@query("search_until_dry", f"WITH h AS ({fx('hits')}), w AS ({fx('hit_words')}) SELECT engine, h.keyword, page, link FROM h JOIN w ON h.keyword = w.keyword WHERE w.ord < (SELECT min(ord) FROM w WHERE keyword NOT IN (SELECT keyword FROM h))")
def search_until_dry(spark, sf_dir):
    return web.until_dry(fixture(spark, "hits"), fixture(spark, "hit_words")).select("engine", "keyword", "page", "link")


@query("search_distinct", f"SELECT link, min(page) AS page FROM ({fx('hits')}) GROUP BY link")
def search_distinct(spark, sf_dir):
    return frontier.first(fixture(spark, "hits").select("link", "page"), ["link"], F.col("page"))


@query("local_feeds", f"""WITH r AS ({fx('local')}), p AS (SELECT postcode, lower(json_extract_string(unnest(CAST(json_extract(body, '$.parms.props.locations[*]') AS JSON[])), '$.name')) AS location FROM r WHERE kind = 'locations'),
a AS (SELECT postcode, lower(location) AS location, unnest(CAST(json_extract(body, '$.parms.asyncProps.feed[*]') AS JSON[])) AS f FROM r WHERE kind = 'feed'),
u AS (SELECT location, json_extract_string(f, '$.item.url') AS url FROM a SEMI JOIN p USING (postcode, location) WHERE json_extract_string(f, '$.type') = 'articles' AND json_extract_string(f, '$.item.url') IS NOT NULL)
SELECT regexp_extract(url, '://([^/]*)', 1) AS domain, string_agg(DISTINCT location, ',' ORDER BY location) AS locations FROM u GROUP BY ALL""")
def local_feeds(spark, sf_dir):
    rows = web.local_feeds(fixture(spark, "local")).withColumn("domain", U.domain(F.col("url")))
    return rows.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set("location")), ",").alias("locations"))


@query("archive_captures", f"""SELECT digest, arg_min(url, timestamp) AS url FROM ({fx('captures')}) WHERE status = 200 AND contains(url, 'a.org') AND mime IN ('text/html', 'application/pdf') AND starts_with(timestamp, '2020') GROUP BY digest""")
def archive_captures(spark, sf_dir):
    return archive.captures(fixture(spark, "captures"), "a.org", ["text/html", "application/pdf"], "2020").select("digest", "url")


@query("backoff", f"SELECT attempt, least(wait * pow(2, attempt), 300)::DOUBLE AS wait FROM ({fx('retries')})")
def backoff(spark, sf_dir):
    return fixture(spark, "retries").select("attempt", T.backoff(F.col("wait").cast("double"), F.col("attempt")).alias("wait"))


@query("domain_posts", f"""WITH a AS (SELECT unnest(regexp_extract_all(html, '(?s)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS url, unnest(regexp_extract_all(html, '(?s)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS title, url AS page FROM ({fx('listing')}))
SELECT url, arg_min(title, page) AS title FROM a WHERE regexp_matches(url, '^https?://([^/]*\\.)?site\\.org') GROUP BY url""")
def domain_posts(spark, sf_dir):
    return web.domain_posts(fixture(spark, "listing"), "site.org")


@query("reports_listed", f"""WITH r AS (SELECT page, list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda h: contains(h, '.pdf')) AS h FROM ({fx('report_pages')})) SELECT DISTINCT page, unnest(h) AS href FROM r WHERE page < (SELECT min(page) FROM r WHERE len(h) = 0)""")
def reports_listed(spark, sf_dir):
    return web.reports_listed(fixture(spark, "report_pages"))


@query("skip_list", "SELECT DISTINCT source FROM documents WHERE source NOT IN ('src1', 'src3', 'src5')")
def skip_list(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("source").distinct().where(~F.col("source").isin("src1", "src3", "src5"))


@query("archive_totals", f"SELECT source, pages * page_size AS items FROM ({fx('index_pages')})")
def archive_totals(spark, sf_dir):
    return archive.totals(fixture(spark, "index_pages"))


@query("archive_page", f"SELECT url, digest FROM ({fx('captures')}) ORDER BY url, digest LIMIT 2 OFFSET 1")
def archive_page(spark, sf_dir):
    return archive.page(fixture(spark, "captures").select("url", "digest"), 1, 2, "url", "digest")


@query("archive_union", f"SELECT url, 'index' AS origin FROM ({fx('captures')}) UNION ALL SELECT url, 'pages' FROM pages")
def archive_union(spark, sf_dir):
    one = fixture(spark, "captures").select("url", F.lit("index").alias("origin"))
    return one.unionByName(read(spark, sf_dir, "pages").select("url", F.lit("pages").alias("origin")))


@query("endpoint_order", f"SELECT source FROM ({fx('index_pages')})")
def endpoint_order(spark, sf_dir):
    return archive.shuffled(fixture(spark, "index_pages"), 7, "source").select("source")


@query("complaint_stage2", _groups_sql(fx("stage1"), records.STAGE2, _COMPLAINT))
def complaint_stage2(spark, sf_dir):
    return records.rows(fixture(spark, "stage1"), records.STAGE2, ("programme", "service", "date", "issue", "outcome"))


@query("bandit_registry", f"""SELECT p.param, kind, coalesce(CASE kind WHEN 'int' THEN CAST(TRY_CAST(s.value AS INTEGER) AS VARCHAR) WHEN 'float' THEN CAST(TRY_CAST(s.value AS DOUBLE) AS VARCHAR) ELSE s.value END, p.value) AS value
FROM ({fx('params')}) p LEFT JOIN ({fx('settings')}) s ON p.param = s.param""")
def bandit_registry(spark, sf_dir):
    return bandit.registry(fixture(spark, "params"), fixture(spark, "settings"))


@query("robots_upsert", f"""SELECT coalesce(n.url, o.url) AS url, coalesce(n.last_checked, o.last_checked) AS last_checked, CASE WHEN n.url IS NOT NULL THEN n.robots_text ELSE o.robots_text END AS robots_text FROM ({fx('robots')}) o FULL JOIN ({fx('robots_new')}) n ON o.url = n.url""")
def robots_upsert(spark, sf_dir):
    old = fixture(spark, "robots").select("url", "last_checked", "robots_text")
    return frontier.upsert(old, fixture(spark, "robots_new"), "url", F.col("last_checked"))


@query("seen_urls", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS seen FROM documents")
def seen_urls(spark, sf_dir):
    docs, seen = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id").distinct()
    return docs.join(seen, "doc_id", "left_semi").withColumn("seen", F.lit(True)).unionByName(docs.join(seen, "doc_id", "left_anti").withColumn("seen", F.lit(False)))


_EXCLUDED = ("http://m.", "https://blog.")


def _offers(spark, sf_dir):
    """Pages in their order, every third one of which may add its domain, each followed by its links."""
    pages = read(spark, sf_dir, "pages")
    links = web.links(pages).select("page_id", "url", F.row_number().over(Window.partitionBy("page_id").orderBy("href")).alias("k"), F.lit(False).alias("add_domain"))
    rows = pages.select("page_id", "url", F.lit(0).alias("k"), (F.col("page_id") % 3 == 0).alias("add_domain")).unionByName(links)
    return rows.select((F.col("page_id") * 100_000 + F.col("k")).alias("seq"), "url", U.domain(F.col("url")).alias("domain"), "add_domain")


@query("allow_grow", f"""WITH {_LINKS},
o AS (SELECT page_id * 100000 AS seq, url, page_id % 3 = 0 AS add FROM pages UNION ALL SELECT page_id * 100000 + row_number() OVER (PARTITION BY page_id ORDER BY href), url, false FROM r),
b AS (SELECT *, replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), 'www.', '') AS bare, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS domain FROM o),
f AS (SELECT bare, min(seq) AS seq, arg_min(domain, seq) AS domain FROM b WHERE add GROUP BY bare),
j AS (SELECT * FROM f WHERE NOT contains('blog.', bare) AND NOT EXISTS (SELECT 1 FROM f g WHERE g.seq < f.seq AND contains(g.bare, f.bare))),
e AS (SELECT 'blog.' AS pattern, 'blog.' AS bare, -1 AS seq UNION ALL SELECT domain, bare, seq FROM j)
SELECT seq, url, add OR EXISTS (SELECT 1 FROM e WHERE e.seq < b.seq AND contains(b.url, e.pattern)) AND EXISTS (SELECT 1 FROM e WHERE e.seq < b.seq AND contains(e.bare, b.bare)) AS accepted FROM b""")
def allow_grow(spark, sf_dir):
    start = spark.createDataFrame([("blog.",)], "pattern string")
    return frontier.growing_allowed(_offers(spark, sf_dir), start, find_new_site=True).select("seq", "url", "accepted")


@query("scrape_exclude", "SELECT page_id, CASE WHEN starts_with(url, 'http://m.') OR starts_with(url, 'https://blog.') THEN 'seen' ELSE 'unseen' END AS status FROM pages")
def scrape_exclude(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", "url", F.lit("unseen").alias("status"))
    prefixes = spark.createDataFrame([(p,) for p in _EXCLUDED], "prefix string")
    return frontier.settle_excluded(rows, prefixes).select("page_id", "status")


@query("requeue", f"""SELECT url, CASE WHEN x AND retries < 3 THEN 'unseen' WHEN x THEN 'error' ELSE status END AS status, retries + CASE WHEN x AND retries < 3 THEN 1 ELSE 0 END AS retries
FROM (SELECT *, url IN (SELECT url FROM ({fx('failed')})) AS x FROM ({fx('frontier')}))""")
def requeue(spark, sf_dir):
    return frontier.requeue(fixture(spark, "frontier"), fixture(spark, "failed")).select("url", "status", "retries")


@query("queue_probe", f"SELECT count(*) > 0 AS has_unseen FROM (SELECT 1 FROM ({fx('frontier')}) WHERE status = 'unseen' LIMIT 1)")
def queue_probe(spark, sf_dir):
    return frontier.has_unseen(fixture(spark, "frontier"))


@query("link_totals", f"WITH {_LINKS} SELECT count(DISTINCT url) AS urls, count(DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))) FILTER (url IS NOT NULL) AS domains FROM r")
def link_totals(spark, sf_dir):
    rows = web.links(read(spark, sf_dir, "pages")).select("url", U.domain(F.col("url")).alias("domain"))
    return rows.agg(F.countDistinct("url").alias("urls"), F.countDistinct("domain").alias("domains"))


_POSTS = f"i AS (SELECT * FROM ({fx('posts')}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch, pos) = 1)"


@query("posts_by_id", f"WITH {_POSTS} SELECT id, url, title FROM i")
def posts_by_id(spark, sf_dir):
    return frontier.posts(fixture(spark, "posts"))[0].select("id", "url", "title")


@query("posts_by_url", f"WITH {_POSTS} SELECT url, arg_max(title, (batch, pos)) AS title FROM i GROUP BY url")
def posts_by_url(spark, sf_dir):
    return frontier.posts(fixture(spark, "posts"))[1].select("url", "title")


@query("moments", f"SELECT id, strftime(moment, '%Y-%m-%d %H:%M:%S') AS crawled_at, CAST(epoch(moment) AS BIGINT) AS epoch, CAST(year(moment) AS INTEGER) AS year, CAST(len(range(1996, year(moment) + 1)) AS INTEGER) AS n_years FROM ({fx('moments')})")
def moments(spark, sf_dir):
    at = F.col("moment").cast("timestamp")
    return fixture(spark, "moments").select("id", *[c.alias(n) for n, c in T.moments(at).items()], F.when(at.isNotNull(), F.size(T.years(1996, at))).alias("n_years"))


@query("sanitized", """SELECT * FROM (VALUES (1, '["a",null]', '{"x":1,"y":"b"}', '1'), (2, '', '', '2')) t(id, words, pair, plain)""")
def sanitized(spark, sf_dir):
    rows = fixture(spark, "nested")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("id", *[T.sanitize(F.col(c), kinds[c]).alias(c) for c in ("words", "pair")], T.sanitize(F.col("id"), "int").alias("plain"))


_CARD = {"card": "card", "link": "card-link", "date": "card-date", "section": "card-section", "text": "card-text"}


@query("search_cards", """SELECT * FROM (VALUES ('https://root.org/x/1', 'First', '3 May', 'No section', 'About it', 'k1', 'cards'), ('https://o.org/2', 'Second', 'No date', 'World', 'No summary', 'k1', 'cards'),
('No URL', 'No title', 'No date', 'No section', 'No summary', 'k1', 'cards')) t(link, link_text, date_published, section, summary, keyword, engine)""")
def search_cards(spark, sf_dir):
    return web.search_cards(fixture(spark, "search_cards").where("engine = 'cards'"), "https://root.org", _CARD)


@query("search_blocks", f"""WITH b AS (SELECT keyword, engine, unnest(regexp_extract_all(html, '(?s)<div class="links_main"[^>]*>(.*?)</div>', 1)) AS x FROM ({fx('search_cards')}) WHERE engine = 'blocks'),
a AS (SELECT keyword, engine, unnest(regexp_extract_all(x, '(?s)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS link, unnest(regexp_extract_all(x, '(?s)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS t FROM b)
SELECT link, coalesce(nullif(t, ''), link) AS link_text, keyword, engine FROM a WHERE contains(link, 'site.org')""")
def search_blocks(spark, sf_dir):
    return web.search_blocks(fixture(spark, "search_cards").where("engine = 'blocks'"), "site.org")


@query("search_any", "SELECT * FROM (VALUES ('https://site.org/p', 'P', 'k3', 'other'), ('https://site.org/r', 'https://site.org/r', 'k3', 'other')) t(link, link_text, keyword, engine)")
def search_any(spark, sf_dir):
    return web.search_any(fixture(spark, "search_cards").where("engine = 'other'"), "https://site.org/find?q=1", "site.org")


_NATIONS = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation"


def _nations(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name")


@query("csv_appended", f"{_NATIONS} UNION ALL {_NATIONS} WHERE n_regionkey = 1")
def csv_appended(spark, sf_dir):
    path = shared.fresh_path(spark)
    sinks.append_csv(_nations(spark, sf_dir), path)
    sinks.append_csv(read(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name"), path)
    return spark.read.schema("n_nationkey string, n_name string").csv(path, header=True)


@query("csv_overwritten", f"{_NATIONS}")
def csv_overwritten(spark, sf_dir):
    path = shared.fresh_path(spark)
    sinks.overwrite_csv(_nations(spark, sf_dir).limit(3), path)
    sinks.overwrite_csv(_nations(spark, sf_dir), path)
    return spark.read.schema("n_nationkey string, n_name string").csv(path, header=True)


@query("state_resumed", "SELECT 'one' AS source, 4 AS \"offset\", 0 AS cdx_index")
def state_resumed(spark, sf_dir):
    path = shared.fresh_path(spark)
    sinks.write_state(spark.createDataFrame([("one", 4)], "source string, offset int"), path)
    return sinks.read_state(spark, path, "source string, offset int, cdx_index int", {"offset": 0, "cdx_index": 0})


@query("archive_parts", f"SELECT source, mime, CAST(unnest(range(pages)) AS INTEGER) AS page FROM ({fx('index_pages')}), (VALUES ('text/html'), ('application/pdf')) m(mime)")
def archive_parts(spark, sf_dir):
    return archive.parts(fixture(spark, "index_pages"), ["text/html", "application/pdf"])


@query("archive_read", f"SELECT url, digest FROM ({fx('captures')}) WHERE mime = 'text/html' AND status = 200")
def archive_read(spark, sf_dir):
    path = shared.fresh_path(spark)
    fixture(spark, "captures").write.json(path)
    return archive.read_index(spark, [path], ["text/html"], [200]).select("url", "digest")


@query("archive_resume", f"SELECT link AS url, page FROM ({fx('hits')}) WHERE page >= 2 AND link NOT IN ('c', 'h')")
def archive_resume(spark, sf_dir):
    done = spark.createDataFrame([("c",), ("h",)], "url string")
    return archive.resume(fixture(spark, "hits").select(F.col("link").alias("url"), "page"), done, 2)


@query("search_results", """SELECT * FROM (VALUES ('https://site.org/1', 'One', 'k', 'searx'), ('https://root.org/x/1', 'First', 'k', 'bbc'), ('https://site.org/4', 'Four', 'k', 'DuckDuckGo'),
('https://site.org/p', 'P', 'k', 'other')) t(link, link_text, keyword, engine)""")
def search_results(spark, sf_dir):
    return web.search_results(fixture(spark, "result_pages"), "site.org", {"bbc": "https://root.org", "other": "https://site.org/find"}, _CARD)


def paged_rows(pages: DataFrame, size: int = 20) -> DataFrame:
    """pages dealt to the pages of an archive: four indexes, two types."""
    index, kind = F.concat(F.lit("i"), (F.col("page_id") % 4).cast("string")), F.when(F.col("page_id") % 5 == 0, "feed").otherwise("html")
    rows = pages.select(index.alias("index"), kind.alias("type"), "page_id", "url")
    return rows.withColumn("page", ((F.row_number().over(Window.partitionBy("index", "type").orderBy("page_id")) - 1) / size).cast("int"))


@query(
    "paged_captures",
    """WITH p AS (SELECT page_id, url, 'i' || page_id % 4 AS i, page_id % 5 = 0 AS feed, row_number() OVER (PARTITION BY page_id % 4, page_id % 5 = 0 ORDER BY page_id) - 1 AS k FROM pages)
    SELECT i AS "index", CAST(k // 20 AS INTEGER) AS page, page_id, url FROM p WHERE NOT feed AND k // 20 BETWEEN 1 AND 40""",
)
def paged_captures(spark, sf_dir):
    """The first endpoint lacks half of the indexes and the odd pages of the others: the second is asked for those."""
    rows = paged_rows(read(spark, sf_dir, "pages"))
    part = paged.write(rows.where("index in ('i0', 'i1') and page % 2 = 0"), shared.fresh_path(spark))
    whole = paged.write(rows, shared.fresh_path(spark))
    out = paged.read(spark, [part, whole], page_size=20, most_pages=0, per_task=8).where("type = 'html' and page >= 1 and page <= 40")
    return out.select("index", "page", F.from_json("record", "page_id long, url string").alias("r")).select("index", "page", "r.*")


@query("paged_stream", "SELECT 'i' || page_id % 4 AS \"index\", count(*) AS n, sum(page_id)::BIGINT AS total FROM pages GROUP BY ALL")
def paged_stream(spark, sf_dir):
    """Two batches: the pages of three indexes, and after a stop those that have come since."""
    rows, at, out = paged_rows(read(spark, sf_dir, "pages")), shared.fresh_path(spark), shared.fresh_path(spark)
    for some in ("index <> 'i3'", "index = 'i3'"):
        paged.write(rows.where(some), at)
        got = state.available_now(paged.read_stream(spark, [at], page_size=20, most_pages=0), out)
    got = got.select("index", F.get_json_object("record", "$.page_id").cast("long").alias("page_id"))
    return got.groupBy("index").agg(F.count(F.lit(1)).alias("n"), F.sum("page_id").alias("total"))
