"""Byte-level BPE by backtracking over longest matches, and decoding by an offset table.

A piece (what the pattern splits off) is encoded left to right: an Aho-Corasick automaton gives the longest token
that starts where the last has ended; a token that is not compatible with the one before it gives way to its
next shorter prefix, and where none is left the encoder backs up, never trying a dead position again.
Two tokens are compatible if merging their joined bytes gives just these two; that is told from the merges that
formed them, and the table of pairs is filled as pairs are met. A sequence whose neighbours are all compatible is the
one that merging gives.

Texts are cut at the added tokens first, as the tokenizers library does. Pieces and pairs met lately come from
bounded caches. Decoding reads token bytes from one blob by an offset table.

Defined results: null is the empty text (no ids); repeated rows give a row each; an empty table gives an
empty result; texts may be of any length; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Memory, read, schema_of, slices, texts_of

# The pattern that byte-level BPE splits texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces and token pairs that a worker remembers at least; it may hold twice as many.
CACHE = 200_000
#: Ids of a pass over the decoding and digit tables.
RUN = 200_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 for itself, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters, model = byte_letters(), spec["model"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        ids = {b: i for i, b in self.bytes_of.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merge, self.parts, formed = {}, {}, {ids[bytes([k])]: ids[bytes([k])] for k in range(256)}
        # a token is formed at the rank of the first merge that makes it, and only if merging its own bytes ends in it
        for rank, (a, b) in enumerate(pairs):
            x, y, xy = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.merge.setdefault((x, y), rank)
            if xy not in self.parts and x in formed and y in formed and self.apart(x, y, rank):
                self.parts[xy], formed[xy] = (x, y, rank), xy
        self.ids = {b: i for b, i in ids.items() if i in formed}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.split = regex.compile(PATTERN).findall
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for b, i in self.ids.items():
            self.auto.add_word(b.decode("latin-1"), i)
        self.auto.make_automaton()
        self.widest = max(map(len, self.ids))
        top = max([*self.bytes_of, *self.added.values()]) + 1
        parts = [self.bytes_of.get(i, b"") for i in range(top)]
        for t, i in self.added.items():
            parts[i] = t.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.diff(self.offsets)
        # decimal digits of each id and a comma, right-aligned in eight bytes
        self.decimal = np.array([f"{i}," for i in range(top)], "S8").view(np.uint8).reshape(-1, 8)
        self.digits = (self.decimal != 0).sum(axis=1)
        self.pieces = Memory(self.packed, CACHE)
        self.pairs = Memory(lambda pair: self.apart(*pair), CACHE)
        self.shorter = Memory(self.prefix, CACHE)

    def apart(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether merging the joined bytes of two tokens leaves just these two, by merges of rank below `before`.

        Merging is run backwards: of the tokens that face each other at the boundary the one formed last is taken apart.
        A merge across the boundary would have come first if its rank is below that of the merge just undone; of
        equal ranks the leftmost comes first, so across the boundary it comes before one to its right.
        """
        merge, parts = self.merge, self.parts
        while True:
            across = merge.get((a, b))
            if across is not None and across < before:
                return False
            left, right = parts.get(a), parts.get(b)
            if left is not None and (right is None or left[2] > right[2]):
                a, before = left[1], left[2]
            elif right is not None:
                b, before = right[0], right[2] + 1
            else:
                return True

    def prefix(self, token: int) -> int:
        """The longest token that is a shorter prefix of a token; -1 if there is none."""
        data = self.bytes_of[token]
        return next((self.ids[data[:k]] for k in range(len(data) - 1, 0, -1) if data[:k] in self.ids), -1)

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        letters = data.decode("latin-1")
        longest = [t for _, t in self.auto.iter_long(letters)]
        if all(map(self.pairs.__getitem__, zip(longest, longest[1:]))):
            return longest
        return self.back_track(letters)

    def longest(self, letters: str, at: int) -> int:
        return next(self.auto.iter_long(letters[at : at + self.widest]))[1]

    def back_track(self, letters: str) -> list[int]:
        n, at, out, dead = len(letters), 0, [], set()
        token = self.longest(letters, 0)
        # a position is dead when no token that starts there leads on
        while True:
            end = at + len(self.bytes_of[token])
            if end not in dead and (not out or self.pairs[out[-1], token]):
                out.append(token)
                if end == n:
                    return out
                at, token = end, self.longest(letters, end)
                continue
            token = self.shorter[token]
            while token < 0:
                dead.add(at)
                token = out.pop()
                at -= len(self.bytes_of[token])
                token = self.shorter[token]

    def packed(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece.encode("utf-8", "replace")), np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), np.int32)

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers."""
        of = self.pieces.__getitem__
        if self.cut is None or not any(t in text for t in self.added):
            return b"".join(map(of, self.split(text)))
        out = []
        for k, part in enumerate(self.cut.split(text)):
            out += [np.array([self.added[part]], np.int32).tobytes()] if k % 2 else map(of, self.split(part))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return self.token_bytes(ids).decode("utf-8", "replace")

    def token_bytes(self, ids: np.ndarray) -> bytes:
        done = bytearray()
        for k in range(0, len(ids), 1 << 20):
            some = ids[k : k + (1 << 20)]
            size = self.size[some]
            shift = self.offsets[some] - (np.cumsum(size) - size)
            done += self.blob[np.arange(int(size.sum())) + np.repeat(shift, size)].tobytes()
        return bytes(done)

    def decimals(self, ids: np.ndarray) -> bytes:
        """Decimal ids, a comma after each."""
        done = bytearray()
        for k in range(0, len(ids), 1 << 20):
            some = self.decimal[ids[k : k + (1 << 20)]].ravel()
            done += some[some != 0].tobytes()
        return bytes(done)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Bpe:
    return Bpe(path)


def runs(bpe: Bpe, texts: list[str]):
    """Lists of the ids of texts that follow each other, of about RUN ids together."""
    held, n = [], 0
    for t in texts:
        held.append(bpe.encode(t))
        n += len(held[-1])
        if n >= RUN:
            yield held
            held, n = [], 0
    if held:
        yield held


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, id_col="doc_id", text_col="text", path: str | None = None) -> DataFrame:
    """(id, ids, decoded): the ids of each text and the text that they decode to."""
    where = path or default_path()

    def run(batches):
        bpe = tokenizer(where)
        for b in slices(batches, 256):
            ids = [bpe.encode(t) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, schema_of(src.schema["id"].dataType, "ids array<int>, decoded string"))


def digests(df: DataFrame, id_col="doc_id", text_col="text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): what encode() gives, hashed where it is made."""
    where = path or default_path()

    def run(batches):
        bpe = tokenizer(where)
        for b in slices(batches):
            n, one, two = [], [], []
            for ids in runs(bpe, texts_of(b.column(1))):
                # one pass of each table over the ids of many texts
                flat = np.concatenate(ids)
                commas, raw = bpe.decimals(flat), bpe.token_bytes(flat)
                ends = np.cumsum([len(x) for x in ids])
                digits = np.concatenate([[0], np.cumsum(bpe.digits[flat])])
                sizes = np.concatenate([[0], np.cumsum(bpe.size[flat])])
                for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
                    n.append(end - start)
                    one.append(hashlib.sha256(commas[digits[start] : max(digits[start], digits[end] - 1)]).hexdigest())
                    part = raw[sizes[start] : sizes[end]]
                    two.append(hashlib.sha256(part if part.isascii() else part.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, schema_of(src.schema["id"].dataType, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op6(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")
