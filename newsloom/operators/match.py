"""Spatial and fuzzy joins."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.sources.shared import cut, release


def overlaps(strict: bool = True) -> Column:
    """Whether boxes c and l overlap; strictly, touching edges and empty boxes do not count."""
    if strict:
        full = (F.col("c.x2") > F.col("c.x1")) & (F.col("c.y2") > F.col("c.y1")) & (F.col("l.x2") > F.col("l.x1")) & (F.col("l.y2") > F.col("l.y1"))
        return full & (F.col("c.x1") < F.col("l.x2")) & (F.col("l.x1") < F.col("c.x2")) & (F.col("c.y1") < F.col("l.y2")) & (F.col("l.y1") < F.col("c.y2"))
    return (F.col("c.x1") <= F.col("l.x2")) & (F.col("l.x1") <= F.col("c.x2")) & (F.col("c.y1") <= F.col("l.y2")) & (F.col("l.y1") <= F.col("c.y2"))


#: What tells a page from all others; with more than one document in a table, ("doc", "page").
PAGE = ("page",)


def _on(key: tuple[str, ...], strict: bool) -> Column:
    return reduce(Column.__and__, [F.col(f"c.{k}") == F.col(f"l.{k}") for k in key], overlaps(strict))


def box_pairs(cells: DataFrame, links: DataFrame, strict: bool = True, key: tuple[str, ...] = PAGE) -> DataFrame:
    """(page, row_id, pos, uri): overlapping boxes of a page; an equi-join on the page with the box test on top."""
    return cells.alias("c").join(links.alias("l"), _on(key, strict)).select(*(f"c.{k}" for k in key), "c.row_id", F.col("l.pos").alias("pos"), "l.uri")


def first_link(cells: DataFrame, links: DataFrame, strict: bool = True, key: tuple[str, ...] = PAGE) -> DataFrame:
    """(page, row_id, uri): the first overlapping link of each cell."""
    return box_pairs(cells, links, strict, key).groupBy(*key, "row_id").agg(F.min_by("uri", "pos").alias("uri"))


def claimed_links(cells: DataFrame, links: DataFrame, strict: bool = True, key: tuple[str, ...] = PAGE) -> DataFrame:
    """(page, row_id, uri): cells in order take the first overlapping link whose uri no earlier cell has taken.

    Greedy, hence a fold over the pairs of one page, which are as many as its boxes allow.
    """
    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, rows = set(), []
        for row, part in pdf.sort_values(["row_id", "pos"]).groupby("row_id", sort=True):
            uri = next((u for u in part["uri"] if u not in taken), None)
            if uri is not None:
                taken.add(uri)
                rows.append((row, uri))
        out = pd.DataFrame(rows, columns=["row_id", "uri"])
        return out.assign(**{k: pdf[k].iloc[0] for k in key})[[*key, "row_id", "uri"]]

    kinds = T.StructType([cells.schema[k] for k in (*key, "row_id")] + [links.schema["uri"]])
    return box_pairs(cells, links, strict, key).groupBy(*key).applyInPandas(claim, kinds)


def last_cell_links(cells: DataFrame, links: DataFrame, key: tuple[str, ...] = PAGE) -> DataFrame:
    """(page, row_id, uri): each cell(page, row_id, col, box) takes the first link that overlaps or touches it, as often
    as it comes; of the cells of a row the last that has one names the row's uri."""
    c = cells.alias("c").join(links.alias("l"), _on(key, strict=False))
    per = c.groupBy(*(F.col(f"c.{k}") for k in key), "c.row_id", "c.col").agg(F.min_by("l.uri", "l.pos").alias("uri"))
    return per.groupBy(*key, "row_id").agg(F.max_by("uri", "col").alias("uri"))


def loose_link(cells: DataFrame, links: DataFrame, key: tuple[str, ...] = PAGE) -> DataFrame:
    """(page, uri): the last link of each page that has a cell which no link overlaps or touches."""
    hit = cells.alias("c").join(links.alias("l"), _on(key, strict=False), "left_anti")
    last = links.groupBy(*key).agg(F.max_by("uri", "pos").alias("uri"))
    return last.join(hit.select(*key).distinct(), list(key), "left_semi")


def unmatched(links: DataFrame, matched: DataFrame, key: tuple[str, ...] = PAGE) -> DataFrame:
    return links.select(*key, "uri").distinct().join(matched.select(*key, "uri"), [*key, "uri"], "left_anti")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Share of matching blocks, twice their length over both lengths."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

    return run(a, b)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; a row of the usual table is the bits of one number."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        both = row & places.get(c, 0)
        row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def token_set_ratio_py(a: str | None, b: str | None) -> float:
    """0 to 100: the best of the common words against either side and of both sides, by insertions and deletions over
    both lengths; words are split at white space; a side without words gives 0."""
    one, two = set((a or "").split()), set((b or "").split())
    if not one or not two:
        return 0.0
    both = one & two
    if both and (one <= two or two <= one):
        return 100.0
    mine, yours = " ".join(sorted(one - two)), " ".join(sorted(two - one))
    n = len(" ".join(sorted(both)))
    gap = 1 if n else 0
    left, right = n + gap + len(mine), n + gap + len(yours)
    best = 1 - (len(mine) + len(yours) - 2 * common_length(mine, yours)) / (left + right)
    if n:
        best = max(best, 1 - (gap + len(mine)) / (n + left), 1 - (gap + len(yours)) / (n + right))
    return 100 * best


def token_set_ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio_py(x, y) for x, y in zip(a, b)], dtype="float64")

    return run(a, b)


#: Buckets of code points that letters are counted in before strings are compared.
BUCKETS = 32


def letter_counts(c: Column) -> Column:
    letters = F.transform(F.split(c, ""), lambda x: F.ascii(x) % BUCKETS)
    return F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.size(F.filter(letters, lambda x: x == k)))


def ratio_bound() -> Column:
    """No ratio of a and b is above twice their common letters over both lengths; bucketed counts a_n, b_n only raise it."""
    common = F.aggregate(F.zip_with("a_n", "b_n", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return 2 * common / F.greatest(F.length("a") + F.length("b"), F.lit(1))


def best_rows(urls: DataFrame, rows: DataFrame, least: float = 0.5) -> DataFrame:
    """(block, url, row_id, ratio): for each url of a block the row whose text is most like it, above least; first of equals.

    Pairs that lengths or letters rule out are dropped in the JVM; only the others are compared in Python.
    """
    one = urls.select("block", "url", F.lower("url").alias("a"), letter_counts(F.lower("url")).alias("a_n"))
    two = rows.select("block", "row_id", F.lower("text").alias("b"), letter_counts(F.lower("text")).alias("b_n"))
    short = 2 * F.least(F.length("a"), F.length("b")) > least * (F.length("a") + F.length("b"))
    pairs = one.join(two, "block").where(short).where(ratio_bound() > least).select("block", "url", "row_id", "a", "b")
    pairs = pairs.withColumn("ratio", sequence_ratio(F.col("a"), F.col("b"))).where(F.col("ratio") > least)
    return pairs.groupBy("block", "url").agg(F.max_by(F.struct("row_id", "ratio"), F.struct("ratio", -F.col("row_id"))).alias("best")).select("block", "url", "best.*")


def best_token_rows(pages: DataFrame, rows: DataFrame, least: float = 70.0) -> DataFrame:
    """(block, url, row_id, ratio): for each page(block, url, text) the row of its block with the highest token set ratio,
    if that is above least; first of equals."""
    pairs = pages.select("block", "url", F.lower("text").alias("a")).join(rows.select("block", "row_id", F.lower("text").alias("b")), "block")
    pairs = pairs.withColumn("ratio", token_set_ratio(F.col("a"), F.col("b")))
    best = F.max_by(F.struct("row_id", "ratio"), F.struct("ratio", -F.col("row_id"))).alias("best")
    return pairs.groupBy("block", "url").agg(best).select("block", "url", "best.*").where(F.col("ratio") > least)


#: Rows of a gram that one task of a join takes.
HEAVY = 10_000


def _items(texts: DataFrame, q: int) -> DataFrame:
    """(id, size, item): the grams of q letters of texts(id, text), each with how many of its kind came before; size is the text's length."""
    starts = F.sequence(F.lit(1), F.length("text") - (q - 1))
    each = texts.where(F.length("text") >= q).select("id", F.length("text").alias("size"), F.explode(F.transform(starts, lambda k: F.substring("text", k, F.lit(q)))).alias("gram"))
    nth = F.row_number().over(Window.partitionBy("id", "gram").orderBy("gram"))
    return each.select("id", "size", F.concat_ws("#", nth, "gram").alias("item"))


def _prefixes(items: DataFrame, ranks: DataFrame, q: int, least: float) -> DataFrame:
    """(id, size, item, pos, n): the rarest items of each text, as many as any text that is alike must have one of."""
    order = Window.partitionBy("id").orderBy("n", "item")
    placed = items.join(ranks, "item").select("id", "size", "item", "n", (F.row_number().over(order) - 1).alias("pos"))
    smallest = F.col("size") + F.ceil(F.round(F.col("size") * least / (2 - least), 6))
    keep = F.col("size") - q + 1 - F.greatest(F.lit(1), _shared(smallest, q, least)) + 1
    return placed.where(F.col("pos") < keep)


def _shared(both: Column, q: int, least: float) -> Column:
    """Grams that two texts of so many letters together share at least, if twice their common subsequence over both is at least that.

    A letter that only one of them has takes q grams of its own text away and q - 1 of the other's.
    """
    return F.ceil(F.round(both * ((2 * q - 1) * least / 2 - (q - 1)) - (q - 1), 6))


def candidates(left: DataFrame, right: DataFrame, least: float, q: int = 2) -> DataFrame:
    """(l, r): pairs of left(id, text) and right(id, text) that may have a ratio of `least` or more: all that do, and few others.

    An inverted index of grams, rare ones first: alike texts share one of their rarest grams (prefix filter), have lengths near each
    other, and hold enough grams behind the first one that they share (position filter). A gram of many rows is dealt to several tasks.
    Texts too short for grams to tell are compared by letters, the same way.
    """
    if (2 * q - 1) * least / 2 <= q - 1:
        raise ValueError(f"grams of {q} letters tell nothing at a ratio of {least}")
    mine, yours = cut(_items(left, q)), cut(_items(right, q))
    ranks = mine.select("item").unionByName(yours.select("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    a, b = _prefixes(mine, ranks, q, least), _prefixes(yours, ranks, q, least)
    parts = F.ceil(F.col("n") / HEAVY).cast("int")
    a = a.select(F.col("id").alias("l"), F.col("size").alias("l_size"), "item", F.col("pos").alias("l_pos"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    b = b.select(F.col("id").alias("r"), F.col("size").alias("r_size"), "item", F.col("pos").alias("r_pos"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    both = F.col("l_size") + F.col("r_size")
    pairs = a.join(b, ["item", "part"]).where(2 * F.least("l_size", "r_size") >= least * both)
    first = pairs.groupBy("l", "r", "l_size", "r_size").agg(F.min("l_pos").alias("l_pos"), F.min("r_pos").alias("r_pos"))
    behind = F.least(F.col("l_size") - q + 1 - F.col("l_pos"), F.col("r_size") - q + 1 - F.col("r_pos"))
    out = cut(first.where(behind >= _shared(both, q, least)).select("l", "r"))
    release(mine, yours)
    if q > 1:
        most = int((q - 1) / ((2 * q - 1) * least / 2 - (q - 1))) + 1  # letters of both together up to which no gram need be shared
        short = lambda t: t.where(F.length("text").between(1, most))
        out = out.unionByName(candidates(short(left), short(right), least, 1)).distinct()
    return out


def indel_ratio(a: Column, b: Column) -> Column:
    """Twice the length of the longest common subsequence over both lengths."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([2 * common_length(x, y) / max(1, len(x) + len(y)) for x, y in zip(a, b)], dtype="float64")

    return run(a, b)


def likely(left: DataFrame, right: DataFrame, least: float, q: int) -> DataFrame:
    """(a, b): the texts of the candidates whose letters allow the ratio: what is left to verify."""
    pairs = candidates(left, right, least, q)
    pairs = pairs.join(left.select(F.col("id").alias("l"), F.col("text").alias("a"), letter_counts(F.col("text")).alias("a_n")), "l")
    pairs = pairs.join(right.select(F.col("id").alias("r"), F.col("text").alias("b"), letter_counts(F.col("text")).alias("b_n")), "r")
    return pairs.where(ratio_bound() >= least).select("a", "b")


def similar(left: DataFrame, right: DataFrame, least: float, q: int = 2, ratio=indel_ratio) -> DataFrame:
    """(l, r, ratio): the pairs of left(id, text) and right(id, text) with a ratio above least; null and empty texts are like none.

    Texts are compared once each, however many rows hold them. sequence_ratio, which is never above indel_ratio, may be asked for as well.
    """
    of = lambda t: t.where("text is not null and text <> ''").groupBy("text").agg(F.min("id").alias("id"))
    mine, yours = cut(of(left)), cut(of(right))
    alike = likely(mine, yours, least, q).withColumn("ratio", ratio(F.col("a"), F.col("b"))).where(F.col("ratio") > least).select("a", "b", "ratio")
    rows = lambda t, name, text: t.select(F.col("id").alias(name), F.col("text").alias(text))
    return rows(left, "l", "a").join(alike, "a").join(rows(right, "r", "b"), "b").select("l", "r", "ratio")


def best_similar(left: DataFrame, right: DataFrame, least: float, q: int = 2, ratio=indel_ratio) -> DataFrame:
    """(l, r, ratio): for each row of left the most similar of right, of equals that of the smallest id."""
    first = right.where("text is not null").groupBy("text").agg(F.min("id").alias("id"))  # of one text the first row will do
    best = F.max_by(F.struct("r", "ratio"), F.struct("ratio", -F.col("r"))).alias("best")
    return similar(left, first, least, q, ratio).groupBy("l").agg(best).select("l", "best.*")


def claim_slots(best: DataFrame, urls: DataFrame, rows: DataFrame) -> DataFrame:
    """(block, row_id, url): rows with their slot filled: an empty one takes the first url, by urls.pos, whose best row it is.

    A url is tried once, against its best row only, so who comes first for each row decides: one aggregation.
    """
    order = urls.groupBy("block", "url").agg(F.min("pos").alias("pos"))
    first = best.join(order, ["block", "url"]).groupBy("block", "row_id").agg(F.min_by("url", "pos").alias("__new"))
    return rows.join(first, ["block", "row_id"], "left").select("block", "row_id", F.coalesce("url", "__new").alias("url"))
