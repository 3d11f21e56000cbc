"""Benchmark decontamination: Wu-Manber multi-pattern search over the words of whole documents.

A pattern is a window of `size` consecutive words of a benchmark item (an item of fewer words is one
pattern). Blocks of two words index a shift table; the cursor of a run of positions skips as far as the
table allows, at shift zero a suffix-hash bucket gives the patterns that may end there, and a comparison of
the words confirms each. Many cursors advance together, one numpy step for all. Patterns of other lengths
(short items) get tables of their own. Patterns beyond `block` windows are searched in further passes, each
with its own tables, so what is broadcast stays bounded however large the benchmark is.

Defined results: a null or empty text has no words, no hits and the hash of the empty string; rows repeat
as they come; an item without words matches nothing; a null item id counts as the empty id; repeated items
count once; an empty benchmark leaves every document clean; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import cut, read, release, schema_of, utf8_slices

SIZE = 10
#: Windows that one pass searches for.
BLOCK_WINDOWS = 500_000
#: Start positions that one cursor runs over.
LANE = 256
#: Word bytes: digits, letters in lower case and all of a non-ASCII character; others are 0.
LOWER = np.zeros(256, np.uint8)
LOWER[48:58] = np.arange(48, 58)
LOWER[97:123] = np.arange(97, 123)
LOWER[65:91] = np.arange(97, 123)
LOWER[128:] = np.arange(128, 256)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
EMPTY = hashlib.sha256(b"").hexdigest()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


class _Powers:
    """BASE**i and its inverse modulo 2**64, as far as they have been asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = np.uint64(pow(int(BASE), -1, 1 << 64))

    def get(self, n: int):
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (BASE, self.inverse))
        return self.up, self.down


POWERS = _Powers()


class Words:
    """Words of a run of texts: bounds in `low` (lower case, 0 between words), doc of each, hashes on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = LOWER[data]
        inside = self.low != 0
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = np.flatnonzero(np.diff(offsets))
        if len(data):
            before[offsets[full]] = False
            after[offsets[full + 1] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        up, self.down = POWERS.get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.low * up[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def hash(self, at: np.ndarray) -> np.ndarray:
        s = self.start[at]
        return _mix((self.sums[self.end[at]] - self.sums[s]) * self.down[s])

    def tuple(self, at: int, m: int) -> tuple:
        return tuple(w for w in self.low[self.start[at] : self.end[at + m - 1]].tobytes().split(b"\0") if w)


def words_of(text: str | None) -> tuple:
    return tuple(w for w in LOWER[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)].tobytes().split(b"\0") if w)


def word_hash(word: bytes) -> int:
    w = np.frombuffer(word, np.uint8)
    up, _ = POWERS.get(len(w) + 1)
    return int(_mix(np.array([(w * up[: len(w)]).sum(dtype=np.uint64)]))[0])


def _block(h1, h2):
    return _mix(h1 * np.uint64(3) + h2)


class Search:
    """Wu-Manber tables for patterns of one length m: {words: [items]}."""

    BITS = 20

    def __init__(self, m: int, patterns: dict[tuple, list[int]]):
        self.m, self.patterns, self.width = m, patterns, min(2, m)
        known = {w: word_hash(w) for p in patterns for w in p}
        hashes = np.array([[known[w] for w in p] for p in patterns], dtype=np.uint64).reshape(len(patterns), m)
        self.most = m - self.width + 1
        self.shift = np.full(1 << self.BITS, self.most, np.uint8 if self.most < 256 else np.int32)
        for j in range(m - self.width + 1):
            keys = self._key([hashes[:, j + k] for k in range(self.width)])
            np.minimum.at(self.shift, keys >> np.uint64(64 - self.BITS), m - self.width - j)
        self.bucket = np.unique(self._whole([hashes[:, k] for k in range(m)]))

    def _key(self, h):
        return _block(h[0], h[1]) if self.width == 2 else _mix(h[0])

    def _whole(self, h):
        out = h[0]
        for x in h[1:]:
            out = _block(out, x)
        return out

    def find(self, words: Words):
        """(position, pattern words) of every occurrence."""
        m, last = self.m, self.m - self.width
        n_starts = np.maximum(0, np.diff(words.first) - m + 1)
        lanes = -(-n_starts // LANE)
        doc = np.repeat(np.arange(len(lanes)), lanes)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = words.first[doc] + k * LANE
        stop = np.minimum(at + LANE, words.first[doc] + n_starts[doc])
        while len(at):
            key = self._key([words.hash(at + last + j) for j in range(self.width)])
            step = self.shift[key >> np.uint64(64 - self.BITS)].astype(np.int64)
            hit = at[step == 0]
            if len(hit):
                whole = self._whole([words.hash(hit + j) for j in range(m)])
                where = np.minimum(np.searchsorted(self.bucket, whole), len(self.bucket) - 1)
                for p in hit[self.bucket[where] == whole].tolist():
                    w = words.tuple(p, m)
                    if w in self.patterns:
                        yield p, w
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]


def windows_of(words: tuple, size: int):
    if words and len(words) < size:
        yield words
    for k in range(len(words) - size + 1):
        yield words[k : k + size]


def _scan(searches: list[Search], schema, items_known):
    """Adds this pass's hit words and items to (id, text, spans, items) rows."""

    def run(batches):
        for b in batches:
            spans, items = b.column("spans").to_pylist(), b.column("items").to_pylist()
            n_words = np.zeros(len(spans), np.int64)
            for lo, hi, data, offsets in utf8_slices(b.column("text")):
                words = Words(data, offsets)
                n_words[lo:hi] = np.diff(words.first)
                found, hits = defaultdict(set), defaultdict(list)
                for s in searches:
                    for p, w in s.find(words):
                        d = int(np.searchsorted(words.first, p, side="right")) - 1
                        hits[d].append((p - int(words.first[d]), p - int(words.first[d]) + s.m))
                        found[d].update(s.patterns[w])
                for d, new in hits.items():
                    spans[lo + d] = merge([*zip((spans[lo + d] or [])[::2], (spans[lo + d] or [])[1::2]), *new])
                    items[lo + d] = sorted({*(items[lo + d] or []), *(items_known[k] for k in found[d])})
            cols = [b.column("id"), b.column("text"), pa.array(n_words), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "text", "n_words", "spans", "items"])

    return run


def merge(spans: list[tuple[int, int]]) -> list[int]:
    """Flat start, end list of the union of half-open spans."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def occurrences(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", size=SIZE, block=BLOCK_WINDOWS, keep_text=False) -> DataFrame:
    """(id, n_words, n_hit, items): items are the ids, as sorted strings, of items with occurring windows."""
    kind = docs.schema[id_col].dataType
    schema = schema_of(kind, "text string, n_words long, spans array<bigint>, items array<string>")
    empty = [F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<bigint>").alias("spans"), F.lit(None).cast("array<string>").alias("items")]
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *empty)
    source = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    held = []
    passes, known, patterns, n, done = 0, [], defaultdict(lambda: defaultdict(list)), 0, object()
    stream = iter(source.toLocalIterator(prefetchPartitions=False))
    while True:
        row = next(stream, done)
        if row is not done:
            known.append(row.item or "")
            for w in set(windows_of(words_of(row.text), size)):
                patterns[len(w)][w].append(len(known) - 1)
                n += 1
        if n >= block or row is done and (n or not passes):
            searches = [Search(m, {**p}) for m, p in sorted(patterns.items())]
            if passes:  # a pass reads what the one before has written; that before it is not read again
                df = cut(df)
                release(*held)
                held = [df]
            df = df.mapInArrow(_scan(searches, schema, known), schema)
            passes, known, patterns, n = passes + 1, [], defaultdict(lambda: defaultdict(list)), 0
        if row is done:
            break
    pairs = F.coalesce(F.col("spans"), F.array().cast("array<bigint>"))
    n_hit = F.aggregate(F.transform(pairs, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    cols = ["id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")]
    return df.select(*cols, "spans")


def clean(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """Rows of docs in which no window of the benchmark occurs."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*names).alias("__nl_id"), F.col(text_col).alias("__nl_text"))
    found = occurrences(packed, items, "__nl_id", "__nl_text", **options)
    return found.where("n_hit = 0").select("id.*")


def op9(spark, sf_dir: str) -> DataFrame:
    found = occurrences(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = """
WITH lowered AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
pats AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM pats),
wins AS (
  SELECT r, m, k, array_to_string(w[k:k + m - 1], ' ') AS p
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM lowered, sizes WHERE len(w) >= m)),
hits AS (SELECT r, k, wins.m, item_id FROM wins JOIN pats ON wins.p = pats.p AND wins.m = pats.m),
words AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS i FROM hits) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
"""
