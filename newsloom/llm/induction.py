"""External induced sorting of suffixes around anchors, with common-prefix values.

A record is a stretch of bytes with an anchor in it; records of a group hold the same bytes about their anchors. The
suffixes that start at the anchors are the seeds: they are sorted, and the common prefix of neighbours is counted. Then
each suffix induces the one that starts a byte to its left: a tuple of group, byte and rank goes through a priority
queue and comes out in the order of the longer suffixes, and the common prefix of new neighbours is one more than
the least between them in the old order. Round by round all suffixes left of the anchors are sorted without any
byte being compared again. A suffix whose common prefix reaches `size` is a string that starts elsewhere too;
one that can no longer reach it leaves the recursion.

A shard may be far larger than memory. Stretches, ranks and common prefixes lie in arrays that are mapped from disk
once they exceed `memory` bytes and are read and written in blocks; the queues (of tuples, and of what is found) keep
`memory` bytes and write sorted runs beyond; seeds are sorted in runs and merged. In memory stay the 48 bytes of a
record's group, length, places and starts. The files are in the worker's scratch folder, belong to one task and end with it:
a task that is run again writes its own.
"""

from __future__ import annotations

import heapq
import tempfile

import numpy as np

#: Bytes that an array, a queue or a run of seeds holds in memory; tuples that are taken at a time.
MEMORY, BLOCK = 64 << 20, 1 << 18


def array_of(n: int, kind, memory: int) -> np.ndarray:
    """An array of zeros, mapped from a scratch file if it is larger than memory."""
    if n * np.dtype(kind).itemsize <= memory:
        return np.zeros(n, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))


class Stretches:
    """Bytes that are appended and then read as one array."""

    def __init__(self, memory: int):
        self.memory, self.held, self.size, self.file = memory, [], 0, None

    def add(self, raw: bytes) -> None:
        self.size += len(raw)
        if self.file is None and self.size > self.memory:
            self.file = tempfile.TemporaryFile()
            self.file.write(b"".join(self.held))
            self.held = []
        if self.file is None:
            self.held.append(raw)
        else:
            self.file.write(raw)

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.frombuffer(b"".join(self.held), np.uint8)
        self.file.flush()
        return np.memmap(self.file, np.uint8, "r", shape=(self.size,))


class TupleQueue:
    """Distinct 64-bit tuples in, ascending blocks of them out."""

    def __init__(self, memory: int = MEMORY, block: int = BLOCK):
        self.most, self.block, self.held, self.size, self.count, self.runs = max(1, memory // 8), block, [], 0, 0, []

    def push(self, tuples: np.ndarray) -> None:
        for k in range(0, len(tuples), self.most):
            part = tuples[k : k + self.most]
            self.held.append(part)
            self.size += len(part)
            self.count += len(part)
            if self.size > self.most:
                self._spill()

    def _spill(self) -> None:
        f = tempfile.TemporaryFile()
        np.sort(np.concatenate(self.held)).tofile(f)
        f.seek(0)
        self.runs.append(f)
        self.held, self.size = [], 0

    def drain(self):
        if not self.runs:
            if self.held:
                yield np.sort(np.concatenate(self.held))
            self.held, self.size = [], 0
            return
        if self.held:
            self._spill()
        # the runs' blocks together hold no more than the queue may
        step = max(1, min(self.block, self.most // len(self.runs)))
        load = lambda f: np.fromfile(f, np.int64, step)
        heads = [load(f) for f in self.runs]
        while any(len(h) for h in heads):
            # what is not above the least last element of the blocks can be given out: nothing smaller is still to come
            top = min(h[-1] for h in heads if len(h))
            out = []
            for k, h in enumerate(heads):
                n = int(np.searchsorted(h, top, side="right"))
                out.append(h[:n])
                heads[k] = h[n:] if n < len(h) else load(self.runs[k])
            yield np.sort(np.concatenate(out))
        for f in self.runs:
            f.close()
        self.runs = []


def seeds(group: np.ndarray, data: np.ndarray, anchor: np.ndarray, end: np.ndarray, memory: int, block: int):
    """(order, lcp) of the records by group and bytes from the anchor on; lcp is with the record before, 0 across groups."""
    n = len(group)
    order, lcp = array_of(n, np.int64, memory), array_of(n + 1, np.int32, memory)
    key = lambda k: (group[k], data[anchor[k] : end[k]].tobytes())
    sizes, runs, lo = np.cumsum(end - anchor), [], 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + memory, side="right")))
        raw = data[anchor[lo] : end[hi - 1]].tobytes()
        at, to, g = (anchor[lo:hi] - anchor[lo]).tolist(), (end[lo:hi] - anchor[lo]).tolist(), group[lo:hi].tolist()
        held = [(g[k], raw[at[k] : to[k]]) for k in range(hi - lo)]
        run = array_of(hi - lo, np.int64, memory if hi - lo == n else 0)
        run[:] = sorted(range(hi - lo), key=held.__getitem__)
        run += lo
        runs.append(run)
        lo = hi
    if len(runs) == 1:
        order = runs[0]
    elif runs:
        merged = heapq.merge(*(map(int, r) for r in runs), key=key)
        for k, x in enumerate(merged):
            order[k] = x
    for lo in range(1, n, 8192):
        hi = min(lo + 8192, n)
        at = order[lo - 1 : hi]
        some = [data[a:b].tobytes() for a, b in zip(anchor[at].tolist(), end[at].tolist())]
        size = np.array([len(s) for s in some])
        width = int(size.max()) + 1
        grid = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in some), np.uint8).reshape(-1, width)
        differ = grid[1:] != grid[:-1]
        first = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), np.minimum(size[1:], size[:-1]))
        first[group[at[1:]] != group[at[:-1]]] = 0
        lcp[lo:hi] = first
    return order, lcp


def repeated(group: np.ndarray, data: np.ndarray, length: np.ndarray, back: np.ndarray, keep: np.ndarray, size: int, memory: int = MEMORY, block: int = BLOCK):
    """Ascending blocks of record << 32 | place, for the windows that share `size` bytes with another of their group.

    group: ascending numbers; data: the stretches one after the other, of `length` bytes each; back: places of the anchors
    in them; windows start at places 0 to keep of a stretch, left of the anchor.
    """
    if not len(group):
        return
    start = np.cumsum(length) - length
    anchor = start + back
    order, lcp = seeds(group, data, anchor, start + length, memory, block)
    found = TupleQueue(memory, block)
    for distance in range(1, int(back.max()) + 1):
        queue = TupleQueue(memory, block)
        for k in range(0, len(order), block):
            record = order[k : k + block]
            # of a rank that can still get to `size` bytes, by the longer of its two common prefixes
            longest = np.maximum(lcp[k : k + len(record)], lcp[k + 1 : k + 1 + len(record)])
            old = np.flatnonzero((back[record] >= distance) & (longest + back[record] - distance + 1 >= size))
            record = record[old]
            queue.push(((group[record] * 256 + data[anchor[record] - distance]) << 32) | (old + k))
        if not queue.count:
            break
        new_order, new_lcp = array_of(queue.count, np.int64, memory), array_of(queue.count + 1, np.int32, memory)
        at, last = 0, np.zeros(0, np.int64)
        for tuples in queue.drain():
            both = np.concatenate([last, tuples])
            old, bucket = both & 0xFFFFFFFF, both >> 32
            pair = np.flatnonzero(bucket[1:] == bucket[:-1])
            value = np.zeros(len(both), np.int32)
            if len(pair):
                ends = np.stack([old[pair] + 1, old[pair + 1] + 1], axis=1).ravel()
                value[pair + 1] = 1 + np.minimum.reduceat(lcp, ends)[::2]
            new_order[at : at + len(tuples)] = order[tuples & 0xFFFFFFFF]
            new_lcp[at : at + len(tuples)] = value[len(last) :]
            at, last = at + len(tuples), tuples[-1:]
        order, lcp = new_order, new_lcp
        for k in range(0, len(order), block):
            record = order[k : k + block]
            longest = np.maximum(lcp[k : k + len(record)], lcp[k + 1 : k + 1 + len(record)])
            record = record[(longest >= size) & (distance >= back[record] - keep[record])]
            found.push((record << 32) | (back[record] - distance))
    yield from found.drain()
