"""The URL frontier: keyed state as snapshots, ranked pops, pushes, crawl rounds and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.spans import placed, running_max
from newsloom.sources.shared import cut

STATUSES = ("unseen", "processing", "seen", "error")
#: Patterns that a broadcast may hold, as each row is tried against each of them.
BROADCAST_PATTERNS = 1000
#: Rows of a key that one task may sort.
WINDOW_ROWS = 1_000_000
#: Responses that one fold of a crawl delay takes at a time.
FOLD_ROWS = 10_000


def holding(rows: DataFrame, col: str, patterns: DataFrame, how: str, at_start: bool = False) -> DataFrame:
    """Rows of which col contains (or starts with) one of patterns(one column), or none, as how is left_semi or left_anti.

    Few patterns are broadcast. More are joined by equality with the pieces of the distinct values that are as long
    as some pattern; patterns have at most as many lengths as the longest value has characters.
    """
    p = patterns.select(F.col(patterns.columns[0]).alias("__p")).where("__p is not null").distinct()
    if p.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS:
        return rows.join(F.broadcast(p), (F.startswith if at_start else F.contains)(F.col(col), F.col("__p")), how)
    value = rows.select(F.col(col).alias("__v")).where("__v is not null").distinct()
    sizes = p.select(F.length("__p").alias("n")).distinct()
    sizes = F.broadcast(sizes.join(value.agg(F.max(F.length("__v")).alias("most")), F.col("n") <= F.col("most"), "left_semi"))
    pieces = value.join(sizes, F.length("__v") >= F.col("n"))
    starts = F.lit(1) if at_start else F.explode(F.sequence(F.lit(1), F.length("__v") - F.col("n") + 1))
    pieces = pieces.select("__v", "n", starts.alias("k")).select("__v", F.substring("__v", F.col("k"), F.col("n")).alias("__p"))
    hit = pieces.join(p, "__p", "left_semi").select("__v").distinct()
    return rows.join(hit, rows[col] == hit["__v"], how)


def seed(start: DataFrame, feeds: DataFrame) -> DataFrame:
    """(url, page_type, url_score, status): first rows of a frontier."""
    kinds = start.select("url", F.lit("webpage").alias("page_type")).unionByName(feeds.select("url", F.lit("feed").alias("page_type")))
    return kinds.withColumns({"url_score": F.lit(0.0), "status": F.lit("unseen")})


def pop(frontier: DataFrame, per_domain: int, delayed: DataFrame | None = None, batch: int | None = None) -> DataFrame:
    """The best unseen rows of each domain, dealt in turn over domains; delayed(domain) leaves domains out.

    Ties fall to the url. The rank is a window with a limit, so each task sends on at most per_domain rows a domain.
    """
    rows = frontier.where("status = 'unseen'")
    if delayed is not None:
        rows = holding(rows.withColumn("__low", F.lower("domain")), "__low", delayed.select(F.lower("domain")), "left_anti").drop("__low")
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("url_score"), "url"))
    rows = rows.withColumn("rn", rank).where(F.col("rn") <= per_domain)
    if batch is not None:
        rows = rows.orderBy("rn", F.desc("url_score"), "url").limit(batch)
    return rows


def push(frontier: DataFrame, found: DataFrame, key: str = "url") -> DataFrame:
    """Insert if absent: rows of found whose key the frontier lacks, one a key."""
    return found.dropDuplicates([key]).join(frontier.select(key), key, "left_anti")


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The last row of each key: one aggregation with partial results, no sort."""
    rest = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*key).agg(best.alias("row")).select(*key, "row.*")


def first(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*key, "row.*")


def posts(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of batches(batch, pos, id, url, ...), as cursor paging gives them: (one row an id, the first; of these one row a url, the last)."""
    ids = first(batches, ["id"], F.col("batch"), F.col("pos"))
    return ids, latest(ids, ["url"], F.col("batch"), F.col("pos"))


def upsert(snapshot: DataFrame, delta: DataFrame, key: str, order: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of delta replace those of snapshot by key, except for the columns in keep; the last of delta wins."""
    new = latest(delta, [key], order)
    both = snapshot.select(key, F.struct(*snapshot.columns).alias("old")).join(new.select(key, F.struct(*new.columns).alias("new")), key, "full_outer")
    pick = [F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")) if c in keep else F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) for c in snapshot.columns if c != key]
    return both.select(key, *[p.alias(c) for p, c in zip(pick, [c for c in snapshot.columns if c != key])])


def update(snapshot: DataFrame, delta: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of the rows that delta names; unknown keys do nothing, null values leave the old ones."""
    new = delta.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = snapshot.join(new, key, "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else c for c in snapshot.columns])


def allowed(urls: DataFrame, patterns: DataFrame, url_col="url") -> DataFrame:
    """Rows whose url contains one of patterns(pattern)."""
    return holding(urls, url_col, patterns.select("pattern"), "left_semi")


def excluded(urls: DataFrame, prefixes: DataFrame, url_col="url") -> DataFrame:
    """Rows whose url starts with none of prefixes(prefix)."""
    return holding(urls, url_col, prefixes.select("prefix"), "left_anti", at_start=True)


def settle_excluded(frontier: DataFrame, prefixes: DataFrame, url_col="url") -> DataFrame:
    """The frontier with status seen, and nothing else done to them, for rows whose url starts with one of prefixes(prefix)."""
    p = prefixes.select("prefix")
    out = holding(frontier, url_col, p, "left_semi", at_start=True).withColumn("status", F.lit("seen"))
    return out.unionByName(holding(frontier, url_col, p, "left_anti", at_start=True))


def requeue(frontier: DataFrame, failed: DataFrame, most: int = 3, key: str = "url") -> DataFrame:
    """The frontier after failed(key) fetches: unseen again with one more retry, or in error after `most` retries."""
    rows = frontier.join(failed.select(F.col(key).alias("__key")).distinct(), F.col(key) == F.col("__key"), "left")
    hit, again = F.col("__key").isNotNull(), F.col("retries") < most
    status = F.when(hit & again, "unseen").when(hit, "error").otherwise(F.col("status"))
    return rows.withColumns({"status": status, "retries": F.when(hit & again, F.col("retries") + 1).otherwise(F.col("retries"))}).drop("__key")


def has_unseen(frontier: DataFrame) -> DataFrame:
    """(has_unseen): one row; a probe that stops at the first unseen row."""
    return frontier.where("status = 'unseen'").limit(1).agg((F.count(F.lit(1)) > 0).alias("has_unseen"))


def crawl(edges: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """(url, depth): urls reached from start over edges(src, dst), with the round that first met each.

    The graph is closed, so rounds are a recursion over distinct urls; it ends when no url is new. Each round is
    written to the shared folder: plans stay short and a lost executor costs one round.
    """
    edges = edges.select("src", "dst")
    seen = wave = cut(start.select("url").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, rounds + 1):
        new = wave.join(edges, wave["url"] == edges["src"]).select(F.col("dst").alias("url")).distinct()
        wave = cut(new.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if wave.isEmpty():
            break
        seen = seen.unionByName(wave)
    return seen


def fetch_times(arrivals: DataFrame, delay: float, key="domain", at="arrival", order="seq", window_rows: int = WINDOW_ROWS) -> DataFrame:
    """start: the earliest fetch time where fetches of a key are at least delay apart: a running maximum.

    A key with more than window_rows rows is not sorted by one task: the maximum is taken within spans first, then over them.
    """
    if arrivals.groupBy(key).count().where(F.col("count") > window_rows).isEmpty():
        w = Window.partitionBy(key).orderBy(at, order)
        rows = arrivals.withColumn("__place", F.row_number().over(w) - 1).withColumn("__free", F.col(at) - F.col("__place") * delay)
        rows = rows.withColumn("__top", F.max("__free").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        rows = placed(arrivals, key, at, order).withColumn("__free", F.col(at) - F.col("__place") * delay)
        rows = running_max(rows, key, "__free", "__top").drop("__span")
    return rows.withColumn("start", F.col("__top") + F.col("__place") * delay).drop("__place", "__free", "__top")


def earliest(values: DataFrame, patterns: DataFrame) -> DataFrame:
    """(value, seq): for each of values(value) that contains one of patterns(pattern, seq) the smallest seq of these.

    Few patterns are broadcast; more are joined by equality with the pieces of the values that are as long as some pattern.
    """
    v, p = values.select("value").where("value is not null").distinct(), patterns.where("pattern is not null").groupBy("pattern").agg(F.min("seq").alias("seq"))
    if p.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS:
        hits = v.join(F.broadcast(p), F.contains(F.col("value"), F.col("pattern")))
    else:
        sizes = p.select(F.length("pattern").alias("n")).distinct()
        sizes = sizes.join(v.agg(F.max(F.length("value")).alias("most")), F.col("n") <= F.col("most"), "left_semi")
        pieces = v.join(F.broadcast(sizes), F.length("value") >= F.col("n")).select("value", "n", F.explode(F.sequence(F.lit(1), F.length("value") - F.col("n") + 1)).alias("k"))
        hits = pieces.select("value", F.substring("value", F.col("k"), F.col("n")).alias("pattern")).join(p, "pattern")
    return hits.groupBy("value").agg(F.min("seq").alias("seq"))


def within(values: DataFrame, patterns: DataFrame) -> DataFrame:
    """(value, seq): for each of values(value) that one of patterns(pattern, seq) contains the smallest seq of these: the pieces of the
    distinct patterns, which are short, joined by equality."""
    v = values.select("value").where("value is not null").distinct()
    p = patterns.where("pattern is not null").groupBy("pattern").agg(F.min("seq").alias("seq"))
    n = F.length("pattern")
    pieces = p.select("seq", "pattern", F.explode(F.sequence(F.lit(0), n)).alias("size")).where("size <= length(pattern)")
    pieces = pieces.select("seq", F.explode(F.transform(F.sequence(F.lit(1), n - F.col("size") + 1), lambda k: F.substring("pattern", k, F.col("size")))).alias("value"))
    return v.join(pieces.groupBy("value").agg(F.min("seq").alias("seq")), "value")


def growing_allowed(rows: DataFrame, allowed: DataFrame, find_new_site: bool) -> DataFrame:
    """rows(seq, url, domain, add_domain, ...) with `accepted`, as an allow-list takes them that grows on its way, in the order of seq.

    allowed(pattern) is the list to begin with; where it is empty, all is accepted. A row passes if the list holds a part of its url, unless
    it may add its domain, and if its domain is part of an entry, `www.` aside. The domain of a row that may add it joins the list if
    it is part of no entry yet, where new sites are wanted.

    There is no loop: whether a domain joins depends on the first row that may add it and on longer domains that came before, for what is
    part of a domain that did not join is part of the one that kept it out. So entries have the place that they joined at, and
    a row is compared with the entries of places before its own.
    """
    if allowed.isEmpty():
        return rows.withColumn("accepted", F.lit(True))
    bare = lambda c: F.replace(F.lower(c), F.lit("www."), F.lit(""))
    given = allowed.select(F.col("pattern"), F.lit(-1).cast("long").alias("seq"))
    entries = given
    known_by = given.select(F.replace("pattern", F.lit("www."), F.lit("")).alias("pattern"), "seq")
    if find_new_site:
        offered = rows.where("add_domain").groupBy(bare(F.col("domain")).alias("value")).agg(F.min(F.struct("seq", F.lower("domain").alias("domain"))).alias("r"))
        offered = cut(offered.select("value", F.col("r.seq").cast("long").alias("seq"), "r.domain"))
        # a domain is part of itself: of all that hold it, the first to come must be itself
        kept_out = within(offered, known_by.unionByName(offered.select(F.col("value").alias("pattern"), "seq"))).withColumnRenamed("seq", "first")
        joined = cut(offered.join(kept_out, "value").where(F.col("first") == F.col("seq")))
        entries = given.unionByName(joined.select(F.col("domain").alias("pattern"), "seq"))
        known_by = known_by.unionByName(joined.select(F.col("value").alias("pattern"), "seq"))
    by_url = earliest(rows.select(F.col("url").alias("value")), entries).toDF("url", "__listed")
    by_domain = within(rows.select(bare(F.col("domain")).alias("value")), known_by).toDF("__bare", "__known")
    out = rows.withColumn("__bare", bare(F.col("domain"))).join(by_url, "url", "left").join(by_domain, "__bare", "left")
    known = F.coalesce(F.col("__known") < F.col("seq"), F.lit(False))
    listed = F.coalesce(F.col("__listed") < F.col("seq"), F.lit(False))
    accepted = F.when(F.col("add_domain"), known | F.lit(find_new_site)).otherwise(listed & known)
    return out.withColumn("accepted", accepted).select(*rows.columns, "accepted")


def crawl_delay(responses: DataFrame, first_delay: float = 1.0, floor: float = 300.0) -> DataFrame:
    """(domain, delay): a fold over responses(domain, seq, status, retry_after) in order.

    200 halves the delay; 429 and 503 make it the largest of twice itself, the server's wish and floor. Every step is
    d -> max(a * d, b), and so is what any run of steps does, so runs of FOLD_ROWS numbers are folded to an (a, b)
    each before a domain's runs meet.
    """
    wish = F.greatest(F.coalesce(F.col("retry_after").cast("double"), F.lit(0.0)), F.lit(floor))
    late = F.col("status").isin(429, 503)
    step = F.struct("seq", F.when(F.col("status") == 200, 0.5).when(late, 2.0).otherwise(1.0).alias("a"), F.when(late, wish).otherwise(0.0).alias("b"))
    same = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))

    def fold(items):
        return F.aggregate(items, same, lambda x, y: F.struct((x["a"] * y["a"]).alias("a"), F.greatest(y["a"] * x["b"], y["b"]).alias("b")))

    part = F.floor(F.col("seq") / FOLD_ROWS).alias("part")
    runs = responses.groupBy("domain", part).agg(fold(F.sort_array(F.collect_list(step))).alias("f"))
    whole = runs.groupBy("domain").agg(fold(F.transform(F.sort_array(F.collect_list(F.struct("part", "f"))), lambda x: x["f"])).alias("f"))
    return whole.select("domain", F.greatest(F.col("f.a") * first_delay, F.col("f.b")).alias("delay"))
