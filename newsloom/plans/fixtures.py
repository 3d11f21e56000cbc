"""Inline relations for shapes that the test tables lack: VALUES text that Spark and DuckDB read alike."""

VALUES = {
    "frontier": (
        "url, url_score, page_type, status, domain, retries",
        """('https://a.org/1', 3.0e0, 'webpage', 'unseen', 'a.org', 0), ('https://a.org/2', 5.0e0, 'webpage', 'unseen', 'a.org', 0),
           ('https://a.org/3', NULL, 'webpage', 'unseen', 'a.org', 1), ('https://a.org/4', 5.0e0, 'webpage', 'seen', 'a.org', 0),
           ('https://b.org/1', 1.0e0, 'feed', 'unseen', 'b.org', 0), ('https://b.org/2', 1.0e0, 'webpage', 'processing', 'b.org', 0),
           ('https://b.org/3', 1.0e0, 'webpage', 'unseen', 'B.org', 2), ('https://c.org/1', 9.0e0, 'webpage', 'error', 'c.org', 3),
           ('https://slow.net/1', 9.5e0, 'webpage', 'unseen', 'slow.net', 0)""",
    ),
    "changes": (
        "url, status, url_score",
        """('https://a.org/1', 'seen', CAST(NULL AS DOUBLE)), ('https://b.org/1', 'error', 2.5e0), ('https://none.org/', 'seen', 1.0e0)""",
    ),
    "crawled": (
        "url, root_domain, score, headline, seq",
        """('https://a.org/1', 'a.org', 2.0e0, 'old', 1), ('https://b.org/1', 'b.org', 1.0e0, 'kept', 1)""",
    ),
    "recrawled": (
        "url, root_domain, score, headline, seq",
        """('https://a.org/1', 'www.a.org', 4.0e0, 'new', 2), ('https://a.org/1', 'x.a.org', 3.0e0, 'newest', 3), ('https://c.org/1', 'c.org', 7.0e0, 'first', 2)""",
    ),
    "raw_urls": (
        "id, url",
        """(1, 'HTTP://www.Example.ORG:80/a/b/;x=1?q=1#top'), (2, 'https://user:pw@example.org:443'), (3, 'https://example.org/a%20b/c+d/%7Ee/'),
           (4, 'https://web.archive.org/web/20200101000000/http://www.old.org/x/'), (5, 'https://example.org/100%zz'), (6, 'https://example.org/p;v=1; '),
           (7, '//cdn.example.org/x'), (8, 'https://www.www.org/?b=2&a=1'), (9, 'https://example.org/%C3%A9t%C3%A9')""",
    ),
    "policies": (
        "domain, path, params, except_names, drop_names, key_order",
        """('a.org', '/list', true, 'page,q', CAST(NULL AS VARCHAR(9)), false), ('a.org', '/item', false, NULL, 'utm,ref', true), ('b.org', '/', false, NULL, NULL, true)""",
    ),
    "policy_urls": (
        "url, domain, path, query",
        """('https://a.org/list?z=1&page=2&q=x', 'a.org', '/list', 'z=1&page=2&q=x'), ('https://a.org/item?utm=1&b=2&a=1&ref=3', 'a.org', '/item', 'utm=1&b=2&a=1&ref=3'),
           ('https://b.org/?c=1&b=2&b=1', 'b.org', '/', 'c=1&b=2&b=1'), ('https://c.org/x?b=1&a=2', 'c.org', '/x', 'b=1&a=2')""",
    ),
    "robots": (
        "url, last_checked, disallow_all, allow_all, robots_text",
        """('https://a.org/robots.txt', 1000000, false, false, 'User-agent: *\nAllow: /private/open\nDisallow: /private\n'), ('https://b.org/robots.txt', 1000000, true, false, ''),
           ('https://c.org/robots.txt', 1000, true, false, ''), ('https://d.org/robots.txt', 1000000, false, true, ''),
           ('https://e.org/robots.txt', 1000000, false, false, 'User-agent: other\nDisallow: /\n')""",
    ),
    "robot_urls": (
        "url",
        """('https://a.org/private/x'), ('https://a.org/private/open/1'), ('https://a.org/'), ('https://b.org/x'), ('https://c.org/x'), ('https://d.org/private'), ('https://e.org/z'), ('https://f.org/z')""",
    ),
    "mimes": (
        "mime, page_type",
        """('text/html; charset=utf-8', 'feed'), ('application/rss+xml', 'webpage'), ('application/xml', 'feed'), ('text/xml', 'sitemap'), ('application/xml', 'webpage'), ('image/png', 'webpage'), (NULL, 'sitemap'), ('application/json', 'feed')""",
    ),
    "media_urls": (
        "url",
        """('https://tv.org/iplayer/episode/p01/x'), ('https://tv.org/sounds/play/m99'), ('https://tv.org/iplayer/episode'), ('https://tv.org/news/1')""",
    ),
    "cells": (
        "page, row_id, x1, y1, x2, y2",
        """(1, 1, 0.0e0, 0.0e0, 10.0e0, 10.0e0), (1, 2, 0.0e0, 10.0e0, 10.0e0, 20.0e0), (1, 3, 0.0e0, 20.0e0, 10.0e0, 20.0e0), (2, 1, 0.0e0, 0.0e0, 5.0e0, 5.0e0), (2, 2, 5.0e0, 0.0e0, 9.0e0, 5.0e0)""",
    ),
    "boxes": (
        "page, pos, uri, x1, y1, x2, y2",
        """(1, 1, 'u1', 2.0e0, 2.0e0, 4.0e0, 14.0e0), (1, 2, 'u2', 2.0e0, 12.0e0, 4.0e0, 14.0e0), (1, 3, 'u3', 50.0e0, 50.0e0, 60.0e0, 60.0e0), (2, 1, 'u4', 5.0e0, 5.0e0, 6.0e0, 6.0e0), (2, 2, 'u5', 4.0e0, 1.0e0, 6.0e0, 2.0e0), (2, 3, 'u5', 6.0e0, 1.0e0, 7.0e0, 2.0e0)""",
    ),
    "fuzzy_urls": ("block, url", """(1, 'reports/morning-show-may'), (1, 'reports/evening-news'), (2, 'zzz')"""),
    "fuzzy_rows": ("block, row_id, text", """(1, 1, 'morning show may'), (1, 2, 'evening news'), (1, 3, 'quiz night'), (2, 1, 'weather')"""),
    "name_pairs": ("id, a, b", """(1, 'The Morning Show', 'morning show'), (2, 'red fox', 'blue fox'), (3, '', ''), (4, 'alpha beta', 'gamma')"""),
    "facts": (
        "entity, attr, value",
        """('e1', 'site', 'https://e1.org'), ('e1', 'site', 'https://e1.net'), ('e1', 'country', 'X'), ('e1', 'country', 'X'), ('e2', 'country', 'Y'), ('e3', 'lang', 'en')""",
    ),
    "triples": (
        "subject, predicate, object",
        """('a', 'part_of', 'b'), ('b', 'part_of', 'c'), ('c', 'part_of', 'd'), ('d', 'part_of', 'e'), ('e', 'part_of', 'a'), ('x', 'part_of', 'c'), ('a', 'named', 'z'), """
        + ", ".join(f"('n{k}', 'part_of', 'n{k + 1}')" for k in range(45)),
    ),
    "sites": ("website, label, branch", """('s1', 'first', 0), ('s2', 'two', 0), ('s1', 'second', 1), ('s3', 'three', 1), ('s1', 'third', 2), ('https://www.wikidata.org/e', 'own', 0)"""),
    "responses": (
        "domain, seq, status, retry_after",
        """('a', 1, 200, NULL), ('a', 2, 429, 10), ('a', 3, 200, NULL), ('b', 1, 503, 900), ('b', 2, 503, NULL), ('c', 1, 404, NULL), ('c', 2, 200, NULL)""",
    ),
    "policy_scores": ("policy, score", """('greedy', 3.0e0), ('random', 1.0e0), ('ucb', 0.0e0)"""),
    "reports": (
        "doc_id, page, text",
        """(1, 1, 'Morning Show, BBC One, 3/4/2020, Tone of host Upheld\nQuiz Night, BBC Radio 4, 12/11/2021, Wrong answer Not upheld\nno row here'),
           (1, 2, 'Evening, BBC Two, 01/02/2019, Late start Resolved'), (2, 1, 'nothing')""",
    ),
    "segments": ("doc_id, page, text", """(1, 1, 'Morning Show, BBC One, 3 April 2020\nA very\nlong title, BBC Two, 4 May 2021\nPlain text'), (2, 1, 'The Pilot (Working title)\nBBC Red Button')"""),
    "stage1": ("doc_id, page, text", """(1, 1, 'Morning Show BBC One 03/04/2020 tone of host 12\nQuiz BBC Two 01/02/2021 wrong answer 3')"""),
    "summaries": (
        "doc_id, page, text",
        """(1, 1, 'Show, BBC One, 3 May 2020\nComplaint\nToo loud\nOutcome\nAgreed\nUpheld\nFurther action\nReminder sent\n\nno title here\n\nQuiz, BBC Two, 4 May 2020\nComplaint\nWrong')""",
    ),
    "ttml": ("doc_id, ttml", """(1, '<tt><p begin="00:00:01.000" end="00:00:02.500">Hello <span>there</span></p><p begin="00:00:03.000" end="00:00:04.000">Two<br/>lines</p></tt>'), (2, '<tt></tt>')"""),
    "jsonld": (
        "page_id, html",
        """(1, '<script type="application/ld+json">{"@type":"NewsArticle","headline":"H1","datePublished":"2020-01-01","publisher":{"name":"P"},"author":"A"}</script>'),
           (2, '<script type="application/ld+json">[{"headline":"H2","publisher":"text"}]</script>'), (3, '<script type="application/ld+json">{broken</script><script type="application/ld+json">{"headline":"H3"}</script>'), (4, '<p>none</p>')""",
    ),
    "links_html": ("page_id, html", """(1, '<link rel="canonical" href="https://a.org/x">'), (2, '<p></p>')"""),
    "search_json": ("keyword, engine, body", """('k1', 'e1', '{"results":[{"url":"https://x.org/1","title":"T","content":"S"},{"url":"https://x.org/2"}]}'), ('k2', 'e1', '{"results":[]}')"""),
    "search_html": (
        "keyword, engine, html",
        """('k1', 'searx', '<a href="https://site.org/1">One</a><a href="https://bad.com/?site.org">x</a><a href="/rel">y</a><a href="https://site.org/2"></a><a href="https://site.org/3">Cached copy</a>')""",
    ),
    "hits": (
        "engine, keyword, page, link",
        """('e', 'k', 1, 'a'), ('e', 'k', 1, 'b'), ('e', 'k', 2, 'c'), ('e', 'k', 3, 'd'), ('e', 'k', 3, 'e'), ('e', 'm', 1, 'f'), ('e', 'm', 1, 'g'), ('e', 'm', 2, 'a'), ('e', 'm', 2, 'h'), ('e', 'k2', 1, 'z')""",
    ),
    "hit_words": ("ord, keyword", """(1, 'k'), (2, 'm'), (3, 'dry'), (4, 'k2')"""),
    "local": (
        "postcode, kind, location, body",
        """('P1', 'locations', NULL, '{"parms":{"props":{"locations":[{"name":"North"},{"id":2},{"name":"South"}]}}}'),
           ('P1', 'feed', 'North', '{"parms":{"asyncProps":{"feed":[{"type":"articles","item":{"url":"https://n.org/1"}},{"type":"advert","item":{"url":"https://ad.org"}},{"type":"articles","item":{}}]}}}'),
           ('P1', 'feed', 'South', '{"parms":{"asyncProps":{"feed":[{"type":"articles","item":{"url":"https://n.org/1"}},{"type":"articles","item":{"url":"https://s.org/2"}}]}}}')""",
    ),
    "captures": (
        "url, digest, mime, status, timestamp",
        """('https://a.org/1', 'd1', 'text/html', 200, '20200101'), ('https://a.org/1?x', 'd1', 'text/html', 200, '20200301'), ('https://a.org/2', 'd2', 'application/pdf', 200, '20200101'), ('https://a.org/3', 'd3', 'text/html', 404, '20200101'), ('https://b.org/1', 'd4', 'text/html', 200, '20200101')""",
    ),
    "retries": ("attempt, wait", """(0, 3.0e0), (1, 3.0e0), (5, 3.0e0), (9, 3.0e0)"""),
    "grid": (
        "page, row_id, col, x1, y1, x2, y2",
        """(1, 1, 1, 0.0e0, 0.0e0, 3.0e0, 3.0e0), (1, 1, 2, 0.0e0, 12.0e0, 10.0e0, 20.0e0), (1, 1, 3, 60.0e0, 60.0e0, 70.0e0, 70.0e0), (1, 2, 1, 90.0e0, 90.0e0, 95.0e0, 95.0e0), (1, 3, 1, 2.0e0, 13.0e0, 3.0e0, 13.0e0), (2, 1, 1, 6.0e0, 6.0e0, 9.0e0, 9.0e0)""",
    ),
    "slot_urls": (
        "block, pos, url, text",
        """(1, 1, 'reports/morning-show-may', 'the morning show of may'), (1, 2, 'reports/morning-show-may-2', 'may morning show again'), (1, 3, 'reports/evening-news', 'news in the evening'),
           (1, 4, 'reports/quiz-night', 'quiz night'), (2, 1, 'zzz', 'nothing alike')""",
    ),
    "slots": (
        "block, row_id, text, url",
        """(1, 1, 'Morning Show may', CAST(NULL AS VARCHAR(40))), (1, 2, 'Evening News', NULL), (1, 3, 'Quiz Night', 'taken'), (1, 4, 'unlike all else', NULL), (2, 1, 'weather', NULL)""",
    ),
    "failed": ("url", """('https://a.org/1'), ('https://a.org/3'), ('https://c.org/1'), ('https://c.org/1'), ('https://none.org/')"""),
    "posts": (
        "batch, pos, id, url, title",
        """(1, 1, 'p1', 'https://s.org/1', 'One'), (1, 2, 'p2', 'https://s.org/2', 'Two'), (2, 1, 'p2', 'https://s.org/2', 'Two again'), (2, 2, 'p3', 'https://s.org/1', 'One by another')""",
    ),
    "moments": ("id, moment", """(1, TIMESTAMP '2024-02-29 23:59:59'), (2, TIMESTAMP '1999-12-31 00:00:00'), (3, CAST(NULL AS TIMESTAMP))"""),
    "search_cards": (
        "keyword, engine, html",
        """('k1', 'cards', '<div class="card"><a class="card-link" href="/x/1">First</a><span class="card-date">3 May</span><p class="card-text">About it</p></div><div class="card"><a class="card-link" href="https://o.org/2">Second</a><span class="card-section">World</span></div><div class="card"></div>'),
           ('k2', 'blocks', '<div class="links_main"><a href="https://site.org/1">One</a><a href="https://o.org/2">Two</a></div><a href="https://site.org/3">Three</a>'), ('k3', 'other', '<a href="/p">P</a><a href="https://o.org/q">Q</a><a href="https://site.org/r"></a>')""",
    ),
    "result_pages": (
        "keyword, engine, html",
        """('k', 'searx', '<a href="https://site.org/1">One</a><a href="https://github.com/site.org">x</a><a href="https://site.org/2">Privacy Policy</a><a href="https://site.org/3">cached</a><a href="/site.org">rel</a>'),
           ('k', 'bbc', '<div class="card"><a class="card-link" href="/x/1">First</a></div>'), ('k', 'DuckDuckGo', '<div class="links_main"><a href="https://site.org/4">Four</a></div>'),
           ('k', 'other', '<a href="/p">P</a><a href="https://o.org/q">Q</a>'), ('k', 'unknown', '<a href="https://site.org/5">Five</a>')""",
    ),
    "nested": ("id, words, pair", """(1, array('a', NULL), named_struct('x', 1, 'y', 'b')), (2, NULL, NULL)"""),
    "links_in": ("href, base", """('/x', 'https://a.org/p/q'), ('y', 'https://a.org/p/q'), ('https://b.org/z', 'https://a.org/'), ('#t', 'https://a.org/p#s'), ('//c.org/w', 'http://a.org')"""),
    "listing": (
        "url, html",
        """('https://forum.org/r/news', '<a href="https://site.org/1">One</a><a href="https://other.org/2">x</a><a href="https://m.site.org/3">Three</a>'), ('https://forum.org/r/old', '<a href="https://site.org/1">Again</a><a href="/local">y</a>')""",
    ),
    "report_pages": ("page, html", """(1, '<a href="/a.pdf">a</a><a href="/a.pdf">a</a><a href="/x">x</a>'), (2, '<a href="/b.pdf">b</a>'), (3, '<a href="/y">y</a>'), (4, '<a href="/c.pdf">c</a>')"""),
    "index_pages": ("source, pages, page_size", """('one', 12, 500), ('two', 3, 15000)"""),
    "params": ("param, kind, value", """('rate', 'float', '0.1'), ('depth', 'int', '3'), ('name', 'str', 'base'), ('cap', 'int', '9')"""),
    "settings": ("param, value", """('rate', '0.25'), ('depth', 'many'), ('name', 'other'), ('unknown', '1')"""),
    "robots_new": ("url, last_checked, robots_text", """('https://a.org/robots.txt', 2000000, 'User-agent: *'), ('https://z.org/robots.txt', 2000000, '')"""),
    "master": ("Programme, Issue", """('Show', 'Tone'), ('Quiz', NULL)"""),
}


def sql(name: str) -> str:
    columns, values = VALUES[name]
    return f"SELECT * FROM (VALUES {values}) AS t({columns})"


def table(spark, name: str):
    columns, values = VALUES[name]
    # Spark reads backslash escapes in string literals as DuckDB does not: the text holds real line breaks already
    return spark.sql(f"SELECT * FROM (VALUES {values}) AS t({columns})")
