"""Repeated byte strings across documents: every byte under a `size`-byte string that starts anywhere else.

Suffixes are sorted by external induction (induction.py), and a suffix that has `size` bytes in common with a neighbour
starts a repeated string. Equal stretches are merged before they are sorted, with a count, and a stretch that can have no
partner is not sorted at all:

1. Each window (string of `size` bytes) has an anchor, the smallest-hashed `GRAM`-byte string in its middle, so equal windows
   have equal anchors with equal surroundings. Windows next to each other share an anchor; their union is the anchor's
   reach. A reach whose surroundings occur once holds no repeated window. Equal reaches are one stretch from here on; if
   there are several, all their windows repeat.
2. The stretches whose surroundings another one has too are dealt to shards by the name of their surroundings. There the
   suffixes at the anchors are sorted and all those to their left induced, with common-prefix values.
3. A shard of more than `HOT` stretches is split by place: into cells of `CELL` neighbouring windows with the same
   distance to the anchor and the same bytes in common. Cells are merged, left out and sorted like reaches. The shard
   of a cell that is still larger is split into single windows, which are equal or not, so that merging them, by
   plain aggregations of 128-bit names, is all there is to do. No key is one task's burden at any skew.

From pass to pass travel Bloom filters of one place for each stretch that is to be sorted, sized by their number
up to `BLOOM_MOST` bits; a wrong yes costs work, never a result. Where even that is too small, sets are joined.

passages() finds what has fewer bytes than that but is a passage: strings of `PASSAGE` words that another document holds too. It
takes these steps with words, as 64-bit hashes, in the place of bytes, and merges instead of sorting: reaches that two documents hold,
then cells and single windows of those whose surroundings two documents hold.

Defined results: null is the empty text; texts shorter than `size` lose nothing; matches never cross rows; rows with
equal texts repeat each other; repeated rows give a row each; texts may be of any length; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import cut, read, release, schema_of, utf8_slices
from newsloom.llm.induction import MEMORY, Stretches, repeated

SIZE, PASSAGE = 400, 51


class Scale(NamedTuple):
    """What a window is: size symbols of unit bytes each, anchored by a gram with side symbols of it on either side; windows
    of a cell; whether only what different documents hold counts as repeated."""

    size: int = SIZE
    unit: int = 1
    gram: int = 16
    side: int = 48
    cell: int = 16
    across: bool = False


BYTES, WORDS = Scale(), Scale(PASSAGE, 8, 4, 4, 8, True)
#: Distinct stretches of a shard, above which it is split; bytes of stretches of whole keys sorted at a time.
HOT, BATCH_BYTES = 20_000, 16 << 20
#: Bits of a Bloom filter for each of its keys, and in all.
BLOOM_EACH, BLOOM_MOST = 12, 1 << 28
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Bytes of texts that anchors are sought in at a time: so few that a processor's cache holds what is made of them.
SLICE = 128 << 10
#: Places in a slice of texts; a text has less than 2**31 bytes.
POSITION = np.uint64((1 << 31) - 1)


#: Bytes that separate words, bytes in lower case, and weights of the places in a word.
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64) + np.uint64(1)
PLACES = np.cumprod(np.full(256, BASE, np.uint64), dtype=np.uint64)


def symbols(data: np.ndarray, offsets: np.ndarray, unit: int):
    """(symbols, their offsets by text): the bytes themselves, or hashes of the words in lower case."""
    if unit == 1:
        return data, offsets
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    first[edge] = ~space[edge]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(len(data)) - at[np.maximum(np.cumsum(first) - 1, 0)]
    value = LOWER[data] * PLACES[place & 255]
    value[space] = 0
    h = np.add.reduceat(value, at) * MIX
    return h ^ (h >> np.uint64(31)), np.searchsorted(at, offsets)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram symbols from each position, by doubling; gram is a power of two."""
    h = (data.astype(np.uint64) + np.uint64(1)) * MIX
    h ^= h >> np.uint64(29)
    width = 1
    while width < gram:
        h = h[:-width] * BASE + h[width:]
        h ^= h >> np.uint64(31)
        width *= 2
    return h * MIX


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, from prefix and suffix minima of blocks."""
    n = len(v)
    if n < width:
        return np.zeros(0, v.dtype)
    pad = -n % width
    full = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]) if pad else v
    grid = full.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, scale: Scale):
    """(row, anchor, first window, last window): bounds in data of the runs of windows that share an anchor."""
    none, size = np.zeros(0, np.int64), scale.size
    long = np.flatnonzero(np.diff(offsets) >= size)
    if not len(long) or len(data) < size:
        return none, none, none, none
    v = gram_hashes(data, scale.gram)
    v = (v & ~POSITION) | np.arange(len(v), dtype=np.uint64)
    width = size - 2 * scale.side - scale.gram + 1
    best = (sliding_min(v[scale.side :], width) & POSITION).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, offsets[long + 1] - size + 1, -1)
    ok = np.flatnonzero(np.cumsum(inside[:-1]))
    ok = ok[ok < len(best)]
    b = best[ok]
    first = np.concatenate([[True], (np.diff(b) != 0) | (np.diff(ok) != 1)])
    first |= np.isin(ok, offsets[long])
    at = np.flatnonzero(first)
    lo, hi = ok[at], ok[np.concatenate([at[1:] - 1, [len(ok) - 1]])]
    return np.searchsorted(offsets, lo, side="right") - 1, b[at], lo, hi


class Bloom:
    """Set of 64-bit keys in a fixed number of bits."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def places(keys: np.ndarray, bits: int):
        k = keys.astype(np.int64).view(np.uint64)
        for m in (MIX, BASE, np.uint64(0x94D049BB133111EB)):
            h = k * m
            h = (h ^ (h >> np.uint64(32))) * BASE
            yield (h >> np.uint64(33)) % np.uint64(bits)

    @classmethod
    def of(cls, keys: DataFrame, most: int = BLOOM_MOST) -> Bloom:
        """keys: one column of longs, counted and then read."""
        bits = 1 << 16
        n = keys.count()
        while bits < min(most, n * BLOOM_EACH):
            bits *= 2

        def run(batches):
            for b in batches:
                at = np.concatenate(list(cls.places(b.column(0).to_numpy(), bits)) or [np.zeros(0, np.uint64)])
                word, start = np.unique(at >> np.uint64(6), return_index=True) if len(at) else (at, at)
                order = np.argsort(at >> np.uint64(6), kind="stable")
                one = np.uint64(1) << (at[order] & np.uint64(63))
                cuts = np.flatnonzero(np.diff((at >> np.uint64(6))[order], prepend=np.uint64(2**63))) if len(at) else []
                value = np.bitwise_or.reduceat(one, cuts) if len(at) else one
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], ["word", "value"])

        got = keys.mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()  # bounded by bits
        words = np.zeros(bits // 64, np.uint64)
        words[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
        return cls(words, bits)

    @staticmethod
    def fits(n: int, most: int = BLOOM_MOST) -> bool:
        """Whether a filter of n keys still keeps most other keys out."""
        return n * 4 <= most

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.places(keys, self.bits):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return out


LEVEL = "key long, f1 long, f2 long, rid long, who long, th binary, lo int, hi int"


def scan(level: int, scale: Scale, blooms, where=None):
    """mapInArrow function over (th, who, text, tk): the names of one level, for what the levels before have left, in the texts
    that where holds."""
    size, unit = scale.size, scale.unit

    def run(batches):
        for b in batches:
            b = only_texts(b, where)
            text_id = text_ids(b.column(0))
            for r0, _, data, offsets in utf8_slices(b.column(2), SLICE):
                data, offsets = symbols(data, offsets, unit)
                row, at, lo, hi = anchors(data, offsets, scale)
                raw = data.tobytes()

                def ids():
                    return place_ids(text_id[row + r0], lo - offsets[row])

                core = at
                for k, bloom in enumerate(blooms):
                    left = bloom.value.holds(ids())
                    row, at, lo, hi, core = row[left], at[left], lo[left], hi[left], core[left]
                    if k == 0:
                        row, lo, hi, core = grid(row, at, lo, hi, scale.cell)
                        at = core
                if level > 2:
                    n = hi - lo + 1
                    row = np.repeat(row, n)
                    lo = hi = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                full = [xxhash.xxh3_128_digest(raw[unit * a : unit * c]) for a, c in zip(lo.tolist(), (hi + size).tolist())]
                f = np.frombuffer(b"".join(full), ">i8").reshape(-1, 2).astype(np.int64)
                key = f[:, 0] if level > 2 else names(raw, core, scale, level)
                base, at_rows = offsets[row], pa.array(row + r0)
                cols = [pa.array(key), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(ids()), b.column(1).take(at_rows), b.column(0).take(at_rows), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32))]
                for c in range(0, len(key), 65_536):
                    yield pa.RecordBatch.from_arrays([x.slice(c, 65_536) for x in cols], ["key", "f1", "f2", "rid", "who", "th", "lo", "hi"])

    return run


def only_texts(batch, where):
    return batch if where is None else batch.filter(pa.array(where.value.holds(batch.column(3).to_numpy())))


def names(raw: bytes, at: np.ndarray, scale: Scale, level: int) -> np.ndarray:
    """64-bit names of what all windows have in common: the surroundings of an anchor, or the core of a cell."""
    before, after = (scale.side, scale.gram + scale.side) if level == 1 else (0, scale.size - scale.cell + 1)
    u = scale.unit
    return np.array([xxhash.xxh3_64_intdigest(raw[u * (a - before) : u * (a + after)]) for a in at.tolist()], np.uint64).view(np.int64)


def grid(row, at, lo, hi, cell):
    """Cells of `cell` windows, cut where the distance from window to anchor is a multiple of it, so that equal windows
    lie in equal places of their cells; core is the start of the last window of the whole cell."""
    first, last = (at - hi) // cell, (at - lo) // cell
    n = last - first + 1
    run = np.repeat(np.arange(len(lo)), n)
    core = at[run] - cell * (first[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n))
    return row[run], np.maximum(lo[run], core - cell + 1), np.minimum(hi[run], core), core


STRETCH = "key long, rid long, th binary, lo int, back int, keep int, raw binary"
SPAN = "th binary, lo int, end int"


def stretches(level: int, scale: Scale, blooms, where):
    """mapInArrow function over (th, who, text, tk): the stretches of a level that are to be sorted, with the place of the anchor and
    of the last window. A cell's anchor is the byte after its core, which all of its windows start before."""
    size = scale.size

    def run(batches):
        for b in batches:
            b = only_texts(b, where)
            text_id = text_ids(b.column(0))
            for r0, _, data, offsets in utf8_slices(b.column(2), SLICE):
                row, at, lo, hi = anchors(data, offsets, scale)
                raw = data.tobytes()
                for bloom in blooms:
                    left = bloom.value.holds(place_ids(text_id[row + r0], lo - offsets[row]))
                    row, at, lo, hi = row[left], at[left], lo[left], hi[left]
                    if level == 2 and bloom is not blooms[-1]:
                        row, lo, hi, at = grid(row, at, lo, hi, scale.cell)
                key = names(raw, at, scale, level)
                at = at + (level == 2)
                rid = place_ids(text_id[row + r0], lo - offsets[row])
                kind = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                nums = [pa.array(x, t) for x, t in zip((key, rid, lo - offsets[row], at - lo, hi - lo), kind)]
                cols = [*nums[:2], b.column(0).take(pa.array(row + r0)), *nums[2:], pa.array([raw[a : c + size] for a, c in zip(lo.tolist(), hi.tolist())], pa.binary())]
                for c in range(0, len(key), 4096):
                    yield pa.RecordBatch.from_arrays([x.slice(c, 4096) for x in cols], ["key", "rid", "th", "lo", "back", "keep", "raw"])

    return run


class Shard:
    """Stretches of whole keys, in order of key, as they arrive."""

    def __init__(self, memory: int):
        self.memory, self.raw, self.parts = memory, Stretches(memory), []

    def add(self, batch) -> None:
        column = batch.column("raw").combine_chunks() if isinstance(batch.column("raw"), pa.ChunkedArray) else batch.column("raw")
        length = np.array([len(x.as_buffer()) for x in column], np.int64)
        for x in column:
            self.raw.add(x.as_buffer().to_pybytes())
        self.parts.append((batch.select(["key", "th", "lo", "back", "keep"]), length))

    def spans(self, size: int):
        """Batches of the runs of repeated windows."""
        if not self.parts:
            return
        table = pa.Table.from_batches([p for p, _ in self.parts]).combine_chunks()
        key, th = table.column("key").to_numpy(), table.column("th")
        lo, back, keep = (table.column(c).to_numpy().astype(np.int64) for c in ("lo", "back", "keep"))
        group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        length = np.concatenate([n for _, n in self.parts])
        for block in repeated(group, self.raw.array(), length, back, keep, size, self.memory):
            record, start = block >> 32, block & 0xFFFFFFFF
            new = np.flatnonzero(np.diff(block, prepend=block[:1] - 2) != 1)
            last = np.append(new[1:], len(block)) - 1
            at = record[new]
            some = th.take(pa.array(at)).combine_chunks()
            yield pa.RecordBatch.from_arrays([some, pa.array(lo[at] + start[new], pa.int32()), pa.array(lo[at] + start[last] + size, pa.int32())], ["th", "lo", "end"])


def induce(size: int, batch_bytes: int = BATCH_BYTES, memory: int = MEMORY):
    """mapInArrow function over stretches in order of key: spans of repeated windows; whole keys, about batch_bytes at a time."""

    def run(batches):
        shard, last = Shard(memory), None
        for b in batches:
            while b.num_rows:
                key = b.column("key").to_numpy()
                if shard.raw.size >= batch_bytes and key[0] != last:
                    yield from shard.spans(size)
                    shard = Shard(memory)
                # once there is enough, only what still belongs to the last key
                n = b.num_rows if shard.raw.size < batch_bytes else int(np.searchsorted(key, last, side="right"))
                step = max(1, min(n, 1024))
                shard.add(b.slice(0, step))
                last, b = key[step - 1], b.slice(step)
        yield from shard.spans(size)

    return run


def text_ids(th) -> np.ndarray:
    return np.frombuffer(b"".join(th.to_pylist()), "<u8")[::2]


def place_ids(text_id: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """64-bit names of (text, first window)."""
    h = (text_id + lo.astype(np.uint64)) * MIX
    return ((h ^ (h >> np.uint64(32))) * BASE).view(np.int64)


def _settle(texts: DataFrame, level: int, scale: Scale, blooms: list, where=None):
    """Names of one level: (spans of what occurs again, distinct stretches (key, f1, f2, n, rid, tk)); n above 1 is repeated."""
    # what several rows hold, or several documents
    n = F.when(F.min("who") < F.max("who"), 2).otherwise(1).cast("long") if scale.across else F.count(F.lit(1))
    some = named = cut(texts.mapInArrow(scan(level, scale, list(blooms), where), LEVEL))
    if level < 3:  # a window's key is its name
        some = _again(named, n)
        release(named)
    # a stretch that occurs once is its own representative; of others one goes on, as a partner for the rest
    tk, text = F.xxhash64("th"), lambda c, tk: F.struct(F.col(c).alias("rid"), F.col(tk).alias("tk"))
    some_of = [F.min("rid").alias("rid"), F.min_by(tk, "rid").alias("tk")]
    if scale.across:
        some_of = [f(x, "who").alias(name) for f, *names_ in ((F.min_by, "rid", "tk"), (F.max_by, "other", "other_tk")) for x, name in zip(("rid", tk), names_)]
    unions = cut(some.groupBy("key", "f1", "f2").agg(n.alias("n"), *some_of))
    twice = unions.where("n > 1").select("key", "f1", "f2")
    spans = cut(some.join(twice, ["key", "f1", "f2"], "left_semi").select("th", "lo", (F.col("hi") + scale.size).alias("end")))
    if scale.across and level < 3:
        # what is open, at all its places; as partners two places, in different documents, of what several documents hold
        alone = unions.where("n = 1")
        open_ = some.join(alone.select("key", "f1", "f2"), ["key", "f1", "f2"], "left_semi").select("rid", tk.alias("tk"))
        held_ = unions.where("n > 1").join(alone.select("key").distinct(), "key", "left_semi").select(F.explode(F.array(text("rid", "tk"), text("other", "other_tk"))).alias("x")).select("x.*")
        places = cut(open_.unionByName(held_).distinct())
        release(unions)
        unions = places
    release(some)
    return spans, unions


def _again(named: DataFrame, n) -> DataFrame:
    """The rows of named whose key occurs again."""
    spark = named.sparkSession
    again = cut(named.groupBy("key").agg(n.alias("n")).where("n > 1").select("key"))
    if Bloom.fits(again.count()):
        held = spark.sparkContext.broadcast(Bloom.of(again))

        def only(batches):
            for b in batches:
                yield b.filter(pa.array(held.value.holds(b.column(0).to_numpy())))

        some = cut(named.mapInArrow(only, LEVEL))
    else:
        some = cut(named.join(again, "key", "left_semi"))
    release(again)
    return some


def _filters(places: DataFrame) -> list:
    """Broadcast filters of the places and of the texts of places(rid, tk)."""
    spark = places.sparkSession
    return [spark.sparkContext.broadcast(Bloom.of(x)) for x in (places.select("rid"), places.select("tk").distinct())]


def _open(unions: DataFrame) -> DataFrame:
    """(key, k): keys of several distinct stretches, one of which may or may not repeat."""
    return cut(unions.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").drop("least"))


def _sort(texts: DataFrame, level: int, scale: Scale, unions: DataFrame, keys: DataFrame, blooms: list, memory: int) -> DataFrame:
    """Spans found by sorting the stretches of the given keys: a row of each (text, place), however many rows the text has."""
    rids = cut(unions.join(keys.select("key"), "key", "left_semi").select("rid", "tk"))
    place, where = _filters(rids)
    found = texts.mapInArrow(stretches(level, scale, [*blooms, place], where), STRETCH)
    if not Bloom.fits(rids.count()):
        found = found.join(rids, "rid", "left_semi")
    found = found.groupBy("key", "rid", "th", "lo", "back", "keep").agg(F.first("raw").alias("raw"))
    spans = cut(found.repartition("key").sortWithinPartitions("key").mapInArrow(induce(scale.size, memory=memory), SPAN))
    release(rids)
    return spans


def repeated_spans(texts: DataFrame, scale: Scale = BYTES, hot: int = HOT, memory: int = MEMORY) -> DataFrame:
    """(th, spans) for texts(th, who, text, tk): flat start, end lists of the maximal runs of repeated bytes, per distinct text."""
    spans, unions = _settle(texts, 1, scale, [])
    open_keys = _open(unions)
    parts = [spans, _sort(texts, 1, scale, unions, open_keys.where(F.col("k") <= hot), [], memory)]
    many = open_keys.where(F.col("k") > hot)
    if not many.isEmpty():
        place, where = _filters(unions.join(many, "key", "left_semi"))
        spans, cells = _settle(texts, 2, scale, [place], where)
        open_cells = _open(cells)
        parts += [spans, _sort(texts, 2, scale, cells, open_cells.where(F.col("k") <= hot), [place], memory)]
        many = open_cells.where(F.col("k") > hot)
        if not many.isEmpty():
            cell, where = _filters(cells.join(many, "key", "left_semi"))
            spans, windows = _settle(texts, 3, scale, [place, cell], where)
            parts.append(spans)
            release(windows)
        release(cells, open_cells)
    release(unions, open_keys)
    return _merged(parts)


def passages(texts: DataFrame, words: int = PASSAGE) -> DataFrame:
    """(th, spans) for texts(th, who, text, tk): runs of words that lie in strings of `words` words which another who holds too."""
    scale = WORDS._replace(size=words)
    spans, places = _settle(texts, 1, scale, [])
    place, where = _filters(places)
    more, cells = _settle(texts, 2, scale, [place], where)
    cell, where = _filters(cells)
    last, left = _settle(texts, 3, scale, [place, cell], where)
    release(places, cells, left)
    return _merged([spans, more, last])


def _merged(parts: list) -> DataFrame:
    """(th, spans): the spans of each text, those that touch as one."""
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    # copies of a text give the same spans: one of each, then a text's in order
    spans = spans.groupBy("th", "lo").agg(F.max("end").alias("end")).repartition("th").sortWithinPartitions("th", "lo")
    done = cut(spans.mapInArrow(union, "th binary, spans array<int>"))
    release(*parts)
    return done


def union(batches):
    """mapInArrow function over (th, lo, end) in order: the flat spans of each text, once for each."""

    def flat(table):
        th, lo, end = table.column("th"), *(table.column(c).to_numpy().astype(np.int64) for c in ("lo", "end"))
        names = np.frombuffer(b"".join(th.to_pylist()), "<u8").reshape(-1, 2)
        first = np.concatenate([[True], (names[1:] != names[:-1]).any(axis=1)])
        text = np.cumsum(first) - 1
        # the furthest end so far, of this text: texts are numbered upwards, so the running maximum starts anew with each
        far = np.maximum.accumulate((text << 32) | end) & 0xFFFFFFFF
        new = first.copy()
        new[1:] |= lo[1:] > far[:-1]
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(lo)) - 1
        values = np.stack([lo[at], far[last]], axis=1).ravel().astype(np.int32)
        offsets = np.append(np.flatnonzero(first[at]) * 2, len(values)).astype(np.int32)
        who = th.take(pa.array(np.flatnonzero(first)))
        who = who.combine_chunks() if isinstance(who, pa.ChunkedArray) else who
        return pa.RecordBatch.from_arrays([who, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["th", "spans"])

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        # the last text may go on in the next batch
        names = np.frombuffer(b"".join(table.column("th").to_pylist()), "<u8").reshape(-1, 2)
        other = np.flatnonzero((names != names[-1]).any(axis=1))
        k = int(other[-1]) + 1 if len(other) else 0
        if k:
            yield flat(table.slice(0, k).combine_chunks())
        held = table.slice(k)
    if held is not None:
        yield flat(held.combine_chunks())


def deduplicate(docs: DataFrame, id_col="doc_id", text_col="text", size: int = SIZE, hot: int = HOT, memory: int = MEMORY, words: int | None = None) -> DataFrame:
    """(id, n_bytes, spans, kept): the bytes of each text, its removed runs, and the bytes that are left.

    With `words`, also passages: the runs of words in strings of that many words that another document (another id) holds too.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("th"), text.alias("text"))
    texts = rows.select("th", F.xxhash64("id").alias("who"), "text", F.xxhash64("th").alias("tk"))
    spans = repeated_spans(texts, BYTES._replace(size=size), hot, memory)
    found = spans
    if words is not None:
        found = cut(spans.join(passages(texts, words).withColumnRenamed("spans", "passages"), "th", "full_outer"))
    some = docs.sparkSession.sparkContext.broadcast(Bloom.of(spans.select(F.xxhash64("th").alias("key"))))

    def pack(batches):
        for b in batches:
            need = some.value.holds(b.column("key").to_numpy())
            raw = [t.encode() for t in b.column("text").to_pylist()]
            z = [zlib.compress(t, 1) if n else None for t, n in zip(raw, need)]
            sha = [None if n else hashlib.sha256(t).hexdigest() for t, n in zip(raw, need)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array([len(t) for t in raw], pa.int64()), pa.array(z, pa.binary()), pa.array(sha, pa.string())], ["id", "th", "n_bytes", "z", "sha"])

    kind = docs.schema[id_col].dataType
    packed = rows.withColumn("key", F.xxhash64("th")).mapInArrow(pack, schema_of(kind, "th binary, n_bytes long, z binary, sha string"))
    more = [] if words is None else ["passages"]
    return packed.join(found, "th", "left").select("id", "n_bytes", "spans", "z", "sha", *more)


def summary(found: DataFrame) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of what deduplicate() gives, and n_shared if it gives passages."""
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["n_shared"] if "passages" in found.columns else [])]
    covered = lambda spans: sum(spans[1::2]) - sum(spans[::2])

    def run(batches):
        for b in batches:
            removed, n, sha = [], [], []
            for spans, z, s in zip(b.column("spans").to_pylist(), b.column("z").to_pylist(), b.column("sha").to_pylist()):
                spans = spans or []
                if s is None:
                    s = hashlib.sha256(kept_bytes(zlib.decompress(z), spans)).hexdigest()
                removed.append(covered(spans))
                n.append(len(spans) // 2)
                sha.append(s)
            cols = [b.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())]
            if len(names) > 4:
                cols.append(pa.array([covered(p or []) for p in b.column("passages").to_pylist()], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], ["id", *names])

    kinds = ", ".join(f"{c} {'string' if c == 'kept_sha256' else 'long'}" for c in names)
    return found.mapInArrow(run, schema_of(found.schema["id"].dataType, kinds))


def kept_bytes(raw: bytes, spans: list[int]) -> bytes:
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def op8(spark, sf_dir: str) -> DataFrame:
    """The columns of the contract, and n_shared: words of passages of more than 50 words that another document holds too."""
    return summary(deduplicate(read(spark, sf_dir, "documents", "doc_id", "text"), words=PASSAGE)).withColumnRenamed("id", "doc_id")
