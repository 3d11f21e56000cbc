"""SimHash near-duplicates: 64-bit fingerprints linked by vantage-point trees.

fingerprints() makes a fingerprint of each text; near_duplicates() links fingerprints that differ in at
most `radius` bits. Distinct fingerprints are dealt to shards, the leaves of vantage-point trees, and a shard is
searched by a vantage-point tree of its own until its blocks are small enough to compare directly. In a tree a point
lives in one leaf and, where the triangle bound |d(q,v) - d(x,v)| <= d(q,x) says a partner may lie across the cut, it is
also sent there as a guest. A pair is found once: only points of the near side cross over.

One tree over all 64 bits would send every point over more boundaries the deeper it grows. So there is a tree for each of
four runs of bits, with the Hamming distance of these bits: of two points within `radius` one run differs in at most
radius // 4 bits, so a smaller ball, of no bits at all for three, is all that may cross a boundary there. A fingerprint goes
to four shards however many there are. The trees are grown over the counts of all values of 16 bits (at most 2^18
numbers, exact). A shard of one value that more than `SPLIT` fingerprints share is dealt once more by runs of the other
bits, four for each of its points.

Defined results: null and empty texts have no words and get fingerprint zero; texts of fewer words than a
shingle hash the whole sequence; repeated rows give a row each; a null id never becomes a component id
unless all ids of the group are null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import components, cut, local_components, reading, release, schema_of, texts_of

SEED = 42
WORDS = 3
RADIUS = 3
#: Distinct fingerprints per shard that the trees aim at, and above which a shard is dealt again.
LEAF_ROWS, SPLIT = 4096, 65_536
#: Runs of bits that have a tree of their own, and bits of each that it looks at.
TREES, BITS = 4, 16
BLOCK = 1024
#: Pairs that a shard holds before it merges them.
PAIRS = 1 << 20


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(parts), seed)]
    else:
        joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
        ends = list(accumulate(len(p) + 1 for p in parts))
        starts = [0, *ends]
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :])]
    h = np.array(hashes, dtype=np.uint64)
    count = np.zeros(64, np.int64)
    for k in range(0, len(h), 65_536):
        bits = np.unpackbits(h[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(count * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id, tag, fp): tag is a hash of the text, fp the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words, seed) for t in texts_of(b.column(2))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["id", "tag", "fp"])

    src = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, schema_of(src.schema["id"].dataType, "tag long, fp long"))


class Tree:
    """A vantage-point tree over points of up to 64 bits, each with a weight; leaves are numbered from 0."""

    def __init__(self, points: np.ndarray, leaf: int, weights: np.ndarray | None = None, seed: int = 7):
        rng, self.nodes, self.leaves = np.random.default_rng(seed), [], 0
        points, at = np.unique(points, return_inverse=True)
        self.root = self._grow(points, np.bincount(at, weights, len(points)), max(1, leaf), rng)

    def _grow(self, pts: np.ndarray, weights: np.ndarray, leaf: int, rng) -> int:
        if len(pts) < 2 or weights.sum() <= leaf:
            self.leaves += 1
            return -self.leaves
        probe = rng.choice(pts, min(256, len(pts)), replace=False)
        v = max(rng.choice(pts, min(16, len(pts)), replace=False), key=lambda v: np.bitwise_count(probe ^ v).std())
        d = np.bitwise_count(pts ^ v).astype(np.int64)
        # the cut that halves the weight best; the vantage point itself is always near, the farthest never
        below = np.cumsum(np.bincount(d, weights))[: int(d.max())]
        mu = int(np.abs(below - weights.sum() / 2).argmin())
        near, k = d <= mu, len(self.nodes)
        self.nodes.append(None)
        self.nodes[k] = (v, mu, self._grow(pts[near], weights[near], leaf, rng), self._grow(pts[~near], weights[~near], leaf, rng))
        return k

    def deal(self, pts: np.ndarray, radius: int):
        """(leaf, index, is guest) arrays."""
        out, todo = [], [(self.root, np.arange(len(pts)), np.zeros(len(pts), bool))]
        while todo:
            k, idx, guest = todo.pop()
            if not len(idx):
                continue
            if k < 0:
                out.append((np.full(len(idx), -k - 1), idx, guest))
                continue
            v, mu, left, right = self.nodes[k]
            d = np.bitwise_count(pts[idx] ^ v).astype(np.int64)
            go = np.where(guest, d - radius <= mu, d <= mu)
            todo.append((left, idx[go], guest[go]))
            own = ~guest & (d > mu)
            go = own | (d + radius > mu)
            todo.append((right, idx[go], ~own[go]))
        if not out:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        return tuple(np.concatenate(x) for x in zip(*out))


def link_runs(home: np.ndarray, guests: np.ndarray, radius: int):
    """Runs of index pairs within radius: home to home and guest to home (guests are numbered after home)."""
    pts = np.concatenate([home, guests])
    tree_leaf, idx, guest = (
        (np.zeros(len(pts), int), np.arange(len(pts)), np.arange(len(pts)) >= len(home))
        if len(home) <= BLOCK
        else _deal_block(home, guests, radius)
    )
    order = np.argsort(tree_leaf, kind="stable")
    tree_leaf, idx, guest = tree_leaf[order], idx[order], guest[order]
    bounds = np.flatnonzero(np.diff(tree_leaf)) + 1
    for part, g in zip(np.split(idx, bounds), np.split(guest, bounds)):
        own = part[~g]
        if not len(own):
            continue
        for k in range(0, len(part), 512):
            rows = part[k : k + 512]
            r, c = np.nonzero(np.bitwise_count(pts[rows][:, None] ^ pts[own][None, :]) <= radius)
            r, c = rows[r], own[c]
            keep = r != c
            yield r[keep], c[keep]


def links(home: np.ndarray, guests: np.ndarray, radius: int):
    """All pairs of link_runs()."""
    none = np.zeros(0, int)
    return tuple(np.concatenate(x) for x in zip((none, none), *link_runs(home, guests, radius)))


def forest(home: np.ndarray, guests: np.ndarray, radius: int) -> np.ndarray:
    """Smallest index linked to each of home and guests, directly or not; holds a bounded number of pairs at a time."""
    n = len(home) + len(guests)
    label, held, size = np.arange(n), [], 0

    def merged():
        i, j = (label[np.concatenate(x)] for x in zip(*held))
        return local_components(n, i, j)[label]

    for r, c in link_runs(home, guests, radius):
        held.append((r, c))
        size += len(r)
        if size >= PAIRS:
            label, held, size = merged(), [], 0
    return merged() if held else label


def _deal_block(home, guests, radius):
    tree = Tree(home, BLOCK)
    leaf, idx, guest = tree.deal(home, radius)
    if len(guests):
        # a guest stays a guest in every leaf that its ball meets
        out, todo = [], [(tree.root, np.arange(len(guests)))]
        while todo:
            k, at = todo.pop()
            if not len(at):
                continue
            if k < 0:
                out.append((np.full(len(at), -k - 1), at + len(home), np.ones(len(at), bool)))
                continue
            v, mu, left, right = tree.nodes[k]
            d = np.bitwise_count(guests[at] ^ v).astype(np.int64)
            todo += [(left, at[d - radius <= mu]), (right, at[d + radius > mu])]
        if out:
            leaf, idx, guest = (np.concatenate([a, b]) for a, b in zip((leaf, idx, guest), (np.concatenate(x) for x in zip(*out))))
    return leaf, idx, guest


class Shards:
    """Where a fingerprint is sent: to a leaf of each tree, and to those whose boundary its ball overlaps."""

    def __init__(self, counts, radius: int, leaf_rows: int, split: int):
        """counts: (run, value, n) arrays for all values of all runs."""
        self.radius, self.ball, self.width = radius, radius // runs_of(radius)[0], runs_of(radius)[1]
        self.tables, base = [], 0
        run, value, n = counts
        for k in range(runs_of(radius)[0]):
            mine = np.flatnonzero(run == k)
            if not len(mine):
                continue
            mine = mine[np.argsort(value[mine])]
            values, weight = value[mine].astype(np.uint64), n[mine]
            tree = Tree(values, leaf_rows, weight)
            leaf, at, guest = tree.deal(values, self.ball)
            order = np.argsort(at, kind="stable")
            leaf, at, guest = leaf[order] + base, values[at[order]].astype(np.int64), guest[order]
            total = np.zeros(tree.leaves, np.int64)
            np.add.at(total, leaf[~guest] - base, weight)
            # a leaf is above the bound only if it is one value; what meets there has all bits of the run in common
            again = (total > split)[leaf - base] & (self.ball == 0)
            first = np.searchsorted(at, np.arange((1 << min(BITS, self.width)) + 1))
            self.tables.append((k * self.width, first, leaf.astype(np.int64), guest, again))
            base += tree.leaves

    def deal(self, fp: np.ndarray):
        """(shard, index, is guest) arrays for unsigned fingerprints."""
        shard, idx, guests = [], [], []
        for low, first, leaf, guest, again in self.tables:
            value = (run_bits(fp, low, min(BITS, self.width))).astype(np.int64)
            size = first[value + 1] - first[value]
            at = np.repeat(first[value] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            who = np.repeat(np.arange(len(fp)), size)
            hot = again[at]
            shard.append(leaf[at[~hot]] << 20)
            idx.append(who[~hot])
            guests.append(guest[at[~hot]])
            at, who = at[hot], who[hot]
            if not len(who):
                continue
            # the other bits, as one number of 64 - width bits
            left = np.uint64(0) if low + self.width >= 64 else fp[who] >> np.uint64(low + self.width) << np.uint64(low)
            rest = left | run_bits(fp[who], 0, low)
            wide = max(1, (64 - self.width) // (self.radius + 1))
            for j in range(self.radius + 1):
                shard.append((leaf[at] << 20) + ((j + 1) << 16) + run_bits(rest, j * wide, min(wide, BITS)).astype(np.int64))
                idx.append(who)
                guests.append(guest[at])
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none.astype(kind), *x]) for x, kind in ((shard, np.int64), (idx, np.int64), (guests, bool)))


def run_bits(fp: np.ndarray, low: int, width: int) -> np.ndarray:
    return fp >> np.uint64(low) & np.uint64((1 << width) - 1)


def runs_of(radius: int) -> tuple[int, int]:
    """(number of runs, their width): one run more than the radius has bits, TREES at most."""
    n = min(radius + 1, TREES)
    return n, 64 // n


def run_counts(fps: DataFrame, radius: int):
    """(run, value, n) arrays of all distinct values of each run of bits: at most TREES * 2^BITS numbers at any size."""
    n, width = runs_of(radius)
    mask = (1 << min(BITS, width)) - 1
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("run"), F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit(mask)).cast("int").alias("value")) for k in range(n))))
    got = fps.select(each.alias("x")).groupBy("x.run", "x.value").agg(F.count(F.lit(1)).alias("n")).toArrow()
    return tuple(got.column(k).to_numpy() for k in range(3))


def dealt(fps: DataFrame, radius: int = RADIUS, leaf_rows: int = LEAF_ROWS, split: int = SPLIT) -> DataFrame:
    """(shard, fp, guest) for distinct fingerprints fps(fp)."""
    shards = Shards(run_counts(fps, radius), radius, leaf_rows, split)

    def deal(batches):
        for b in batches:
            fp = b.column(0).to_numpy()
            shard, idx, guest = shards.deal(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[idx]), pa.array(guest)], ["shard", "fp", "guest"])

    return fps.mapInArrow(deal, "shard long, fp long, guest boolean")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, leaf_rows: int = LEAF_ROWS, split: int = SPLIT) -> DataFrame:
    """(src, dst): a spanning forest of the links of each shard, for distinct fingerprints fps(fp)."""

    def join(table: pa.Table) -> pa.Table:
        fp, guest = table.column("fp").to_numpy(), table.column("guest").to_numpy()
        pts = np.concatenate([fp[~guest], fp[guest]])
        label = forest(fp[~guest].view(np.uint64), fp[guest].view(np.uint64), radius)
        linked = np.flatnonzero(label != np.arange(len(pts)))
        return pa.table({"src": pts[linked], "dst": pts[label[linked]]}, schema=pa.schema([("src", pa.int64()), ("dst", pa.int64())]))

    return dealt(fps, radius, leaf_rows, split).groupBy("shard").applyInArrow(join, "src long, dst long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id, tag, fp, label, component): component is the smallest id reachable over links, the row's own
    included; label is the same for all rows of a group and is one of their fingerprints."""
    rows = cut(fingerprints(df, id_col, text_col, words, seed))
    single = cut(rows.groupBy("fp").agg(F.min("id").alias("low")))
    label = components(fingerprint_links(single.select("fp"), radius))
    classes = cut(single.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    release(single, label)
    low = classes.groupBy("label").agg(F.min("low").alias("component"))
    named = classes.select("fp", "label").join(low, "label").select("fp", "label", "component")
    return reading(rows.join(named, "fp").select("id", "tag", "fp", "label", "component"), rows, classes)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group: that of the smallest id (null last; of rows with equal id and text any)."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    found = cut(near_duplicates(docs, id_col, text_col))
    first = found.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("first"), F.count(F.lit(1)).alias("n"))
    kept = cut(first.select(F.col("first.id").alias("__nl_id"), F.col("first.tag").alias("__nl_tag")))
    tagged = docs.withColumn("__nl_hash", F.xxhash64(text_col))
    out = tagged.join(kept, F.col(id_col).eqNullSafe(F.col("__nl_id")) & (F.col("__nl_hash") == F.col("__nl_tag")), "left_semi")
    pairs = found.groupBy("id", "tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not pairs.isEmpty():
        out = out.dropDuplicates([id_col, "__nl_hash"])
    return reading(out.select(*names), found, kept)


def op5(spark, sf_dir: str) -> DataFrame:
    from newsloom.llm.common import read

    out = near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
