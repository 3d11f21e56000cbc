"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_path(path: Column) -> Column:
    """Percent-decoded, then encoded again with the slash kept; malformed escapes stand for themselves."""
    safe = F.regexp_replace(path, "%(?![0-9A-Fa-f]{2})", "%25")
    out = F.url_encode(F.coalesce(F.try_url_decode(F.replace(safe, F.lit("+"), F.lit("%2B"))), path))
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalize_url(url: Column) -> Column:
    """Archive prefix, www., parameters, fragment, user and default port dropped; scheme and host in lower case."""
    u = F.regexp_replace(url, r"[ ;\n\t]+$", "")
    u = F.regexp_replace(u, r"^https?://web\.archive\.org/web/[0-9a-z_*]+/(.+)$", "$1")
    has = u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    scheme = F.when(has, F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))).otherwise("https")
    rest = F.regexp_replace(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", ""))
    host = F.replace(host, F.lit("www."), F.lit(""))
    host = F.when(scheme == "http", F.regexp_replace(host, r":(80)?$", "")).when(scheme == "https", F.regexp_replace(host, r":(443)?$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), r";[^/]*$", "")
    path = encode_path(F.regexp_replace(F.regexp_replace(path, "/+$", ""), ";+$", ""))
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def domain(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def is_valid(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def robots_url(url: Column) -> Column:
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    return F.concat(F.when(scheme.isin("https", ""), "https").otherwise("http"), F.lit("://"), domain(url), F.lit("/robots.txt"))


def full_url(href: Column, base: Column, suffix: str | None = None) -> Column:
    """An absolute link as it is, a relative one joined to the base; null where the host does not end in suffix."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"[^/]*$", "")
    joined = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#") | (href == ""), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), href))
    )
    return joined if suffix is None else F.when(domain(joined).endswith(suffix), joined)


def canonical_query(query: Column, drop_all_but: Column, keep_only: Column, ignore_order: Column) -> Column:
    """A query string under a No-Vary-Search policy: parameters dropped or kept by name, sorted where order is free.

    drop_all_but: names that matter where all others are dropped (null: no such rule); keep_only: names to drop
    (null: none); ignore_order: whether order is free. Parameters sort by name and then by place.
    """
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    name = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(parts, lambda p: (drop_all_but.isNull() | F.array_contains(drop_all_but, name(p))) & (keep_only.isNull() | ~F.array_contains(keep_only, name(p))))
    tagged = F.transform(kept, lambda p, k: F.struct(name(p).alias("name"), k.alias("at"), p.alias("part")))
    ordered = F.transform(F.array_sort(tagged), lambda t: t["part"])
    return F.array_join(F.when(ignore_order, ordered).otherwise(kept), "&")


def file_name(url: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(F.substring_index(url, "/", -1), F.lit("+"), F.lit("%2B"))), F.substring_index(url, "/", -1))
