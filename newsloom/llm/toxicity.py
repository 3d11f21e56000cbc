"""Toxicity with noisy-channel deobfuscation.

Writers hide words by look-alike characters (1d10t), spacing (i d i o t, i.d.i.o.t) and repetition (idiooot).
Tokens that show such signs become a lattice of characters: each sign may stand for itself or for the letters
it looks like, a repeated letter may be dropped, separators between single characters are dropped. Viterbi
decoding finds the reading that a character trigram model of the whole corpus likes best, and that reading alone is
scored. Beside the corpus the model knows the words that the scorer was fitted on: a reading that holds one gains
`BONUS`, as hidden words are that much likelier to be of these than the corpus says; a reading that is worse by more
stays behind. Tokens without such signs have a lattice of one path and stay as they are.

The scorer is naive Bayes over chosen words and word beginnings (4 to 6 letters) of the restored text. It is
fitted on at most `sample` distinct labelled texts, taken by a hash of the id, none of them held out; an id gives one
text. Every feature of these texts that could explain a toxic row is a candidate.

Defined results: null and empty texts score like texts without words; a null id is neither held out nor used for
fitting; repeated rows give a row each; with no usable labels (none, or of one class) all scores are the share of
toxic labels (0 if there are none); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Memory, cut, read, release, schema_of, smallest_hashed, texts_of, utf8_slices

#: Labelled texts that the scorer is fitted on, least that a feature must explain.
SAMPLE, LEAST = 12_000, 1.5
THRESHOLD = 0.7
#: Words that a worker remembers at least.
KNOWN = 200_000

# The letters that a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
SIGNS = "".join(LOOKALIKES)
#: Log cost of reading a sign as a letter, of keeping it, of dropping a repeat.
SWAP, KEEP, DROP = -1.0, -4.0, -1.0
#: Log odds that a hidden word is one of the scorer's words, over what the character model says.
BONUS = 4.0
PATHS = 6
#: Characters of a token that are read at a time; all pieces of a longer token are read.
PIECE = 256

LETTER, SIGN = r"[^\W\d_]", f"[{re.escape(SIGNS)}]"
PART = rf"[\w{re.escape(SIGNS)}'’\-]"
CANDIDATE = re.compile(
    rf"(?<!\S)[\"'(\[]*(?:{LETTER}(?:[ ._\-*][^\W_0-9 ]|[ ._\-][0-9@$!|+]){{2,}}(?![^\W_])"  # spaced out
    rf"|(?={PART}*?{LETTER})(?={PART}*?{SIGN}){PART}{{3,}}"  # signs beside letters
    rf"|{LETTER}*({LETTER})\1\1{LETTER}*)"  # repeats
)
#: What a candidate needs at least; texts without are not searched.
HINTS = (
    re.compile(rf"{SIGN}(?:(?<={LETTER}.)|(?<=['’_\-].)|['’_\-]*{LETTER})"),
    re.compile(rf"({LETTER})\1\1"),
    re.compile(r"[ ._\-*](?<=[^\W_].)(?<![^\s\"'(\[]..)(?:[^\W_ ]|[@$!|+])[ ._\-*](?:[^\W_ ]|[@$!|+])(?![^\W_])"),
)
#: Signs that prose has at the ends of words, which cost nothing to keep there.
OPENING, CLOSING = "(<{¡", "!*#%"
WORD = re.compile(r"[^\W\d_]+")
REPEAT = re.compile(rf"({LETTER})\1\1")

#: Symbols of the character model: 0 for what is no letter, 1-26 for a-z, 27 for a byte of another letter.
SYMBOL = np.zeros(256, np.int32)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[128:] = 27
N_SYMBOLS = 28


def trigram_counts(docs: DataFrame, text_col="text") -> np.ndarray:
    """Counts of character trigrams over all texts: an array of 28**3, summed on the executors."""

    def run(batches):
        total = np.zeros(N_SYMBOLS**3, np.int64)
        for b in batches:
            for _, _, data, offsets in utf8_slices(b.column(0)):
                s = np.zeros(len(data) + 2 * len(offsets), np.int32)  # two blanks after each text
                s[np.arange(len(data)) + 2 * np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = SYMBOL[data]
                code = s[:-2] * (N_SYMBOLS * N_SYMBOLS) + s[1:-1] * N_SYMBOLS + s[2:]
                total += np.bincount(code, minlength=N_SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    out = np.zeros(N_SYMBOLS**3, np.int64)
    for r in docs.select(text_col).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), smoothed by the bigram and the flat model."""
    c = counts.reshape(N_SYMBOLS, N_SYMBOLS, N_SYMBOLS).astype(float)
    flat = np.full(N_SYMBOLS, 1 / N_SYMBOLS)
    two = c.sum(axis=0)
    bi = (two + 5 * flat) / (two.sum(axis=1, keepdims=True) + 5)
    tri = (c + 5 * bi[None]) / (c.sum(axis=2, keepdims=True) + 5)
    return np.log(tri)


def symbol(c: str) -> int:
    k = ord(c)
    return k - 96 if 97 <= k <= 122 else 27 if c.isalpha() else 0


class Restorer:
    def __init__(self, model: np.ndarray, liked=None):
        self.lm, self.liked = model.tolist(), liked or (lambda w: False)
        self.seen, self.tails = Memory(self.best, KNOWN // 2), Memory(lambda key: self.ends(*key), KNOWN // 4)

    def readings(self, token: str) -> list[tuple[float, str]]:
        """The best few readings of a token, best first, with their log probability."""
        chars = "".join([c for c in token if c.isalnum() or c in LOOKALIKES])
        at = next((k for k, c in enumerate(chars) if not c.isalpha() or k and chars[k - 1] == c), len(chars))
        head, tail = chars[:at], chars[at:]
        # up to there is one path; what follows depends on its last two letters only, and many words share it
        ends = self.tails[head[-2:], tail]
        return [(p, head + w) for p, w in ends]

    def ends(self, head: str, tail: str) -> list[tuple[float, str]]:
        """The best few readings of a tail after the letters of head."""
        beam = {(symbol(head[0]) if len(head) > 1 else 0, symbol(head[-1]) if head else 0): [(0.0, "")]}
        first, last = 0 if head else len(tail) - len(tail.lstrip(OPENING)), len(tail.rstrip(CLOSING))
        before = head[-1:]
        for k, c in enumerate(tail):
            options = [(c, 0.0)] if c.isalpha() else [(c, KEEP if first <= k < last else 0.0), *((x, SWAP) for x in LOOKALIKES.get(c, ""))]
            if c.isalpha() and before == c:
                options.append(("", DROP / 2))
            before = c
            nxt: dict[tuple[int, int], list] = {}
            for (a, b), paths in beam.items():
                for letter, cost in options:
                    if letter:
                        s = symbol(letter)
                        gain, state = cost + self.lm[a][b][s], (b, s)
                    else:
                        gain, state = cost - 2.0, (a, b)
                    nxt.setdefault(state, []).extend((p + gain, w + letter) for p, w in paths)
            beam = {s: sorted(set(p), reverse=True)[:PATHS] for s, p in nxt.items()}
        ends = sorted({(p + self.lm[a][b][0], w) for (a, b), paths in beam.items() for p, w in paths}, reverse=True)
        return ends[: 4 * PATHS]

    def word(self, token: str) -> str:
        if len(token) > PIECE:
            return "".join(self.word(token[k : k + PIECE]) for k in range(0, len(token), PIECE))
        return self.seen[token]

    def best(self, token: str) -> str:
        options = self.readings(token)
        if options and token.lstrip(OPENING).rstrip(CLOSING).isalpha() and not REPEAT.search(token):
            options.insert(0, (options[0][0], token))  # a word of prose is as likely as its best reading
        most, got = -np.inf, token
        for p, w in options:  # best first: from where the bonus would not do, none can win
            if p + BONUS <= most:
                break
            p += BONUS * self.liked(w)
            if p > most:
                most, got = p, w
        return got

    def text(self, text: str) -> str:
        """Lower case, with every token that shows signs of hiding replaced by its best reading."""
        low = text.lower()
        return CANDIDATE.sub(lambda m: self.word(m.group()), low) if any(h.search(low) for h in HINTS) else low


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) >= n)]


class Scorer:
    """Index sets of chosen features for texts; chosen: feature -> column."""

    def __init__(self, model: np.ndarray, chosen: dict[str, int]):
        self.chosen, self.columns = chosen, Memory(self.columns_of, KNOWN)
        self.restore = Restorer(model, lambda w: any(self.columns[x] for x in WORD.findall(w)))

    def columns_of(self, word: str) -> tuple:
        return tuple(self.chosen[f] for f in features_of(word) if f in self.chosen)

    def active(self, text: str) -> list[int]:
        words = set(WORD.findall(self.restore.text(text)))
        return sorted({c for some in map(self.columns.__getitem__, words) if some for c in some})


class Model:
    """Naive Bayes over the chosen features; weights None: every text scores the prior."""

    def __init__(self, lm, chosen, weights, prior):
        self.lm, self.chosen, self.weights, self.prior = lm, chosen, weights, prior

    def scorer(self):
        s = Scorer(self.lm, self.chosen)
        if self.weights is None:
            return lambda text: self.prior
        w, b = self.weights, float(np.log((self.prior + 1e-6) / (1 - self.prior + 1e-6)))
        return lambda text: float(1 / (1 + np.exp(-np.clip(b + w[s.active(text)].sum(), -40, 40))))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    lm = language_model(trigram_counts(docs, text_col))
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 3 != 1))
    usable = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    counts = {r.y: r["count"] for r in usable.groupBy("y").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return Model(lm, {}, None, float(prior))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    # one text an id and one id a text, so that neither repeated rows nor copies crowd out others
    distinct = texts.select("id", "h").join(usable, "id").groupBy("id", "y").agg(F.min("h").alias("h")).groupBy("y", "h").agg(F.min("id").alias("id"))
    distinct = cut(distinct)
    # half of the bound for each class, so that a rare class is learnt too; chosen by a hash of the id
    picked = [smallest_hashed(distinct.where(F.col("y") == y), sample // 2, "id") for y in (0, 1)]
    picked = cut(picked[0].unionByName(picked[1]))
    texts = texts.join(F.broadcast(picked), ["id", "h"])
    texts = cut(texts.groupBy("id", "y").agg(F.min("text").alias("text")).select("y", "text"))
    release(distinct, picked)

    def count(batches):
        restore = Restorer(lm)
        for b in batches:
            total = (Counter(), Counter())
            for y, t in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                total[y].update({f for w in set(WORD.findall(restore.text(t))) for f in features_of(w)})
            at = list(total[0].keys() | total[1].keys())
            for k in range(0, len(at), 65_536):
                part = at[k : k + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[f] for f in part], pa.int64()) for c in total)], ["f", "n0", "n1"])

    rows = texts.mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    have = texts.groupBy("y").count().collect()
    total = {r.y: r["count"] for r in have}
    if len(total) < 2:
        return Model(lm, {}, None, float(prior))
    gain = F.log(((F.col("n1") + 0.5) / total[1]) / ((F.col("n0") + 0.5) / total[0]))
    # what choose() could never take is left out, and nothing else
    best = rows.where((F.col("n1") >= 3) & (F.col("n1") - 10 * F.col("n0") >= LEAST) & (gain > 2)).select("f", (gain * F.col("n1")).alias("gain")).toArrow()
    best = best.sort_by([("gain", "descending"), ("f", "ascending")])
    chosen = {f: k for k, f in enumerate(best.column("f").to_pylist())}

    def active(batches):
        s = Scorer(lm, chosen)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.active(t) for t in texts_of(b.column(1))], pa.list_(pa.int32()))], ["y", "x"])

    got = texts.mapInArrow(active, "y int, x array<int>").toArrow()  # bounded by sample
    release(texts)
    x = got.column("x").combine_chunks()
    row = np.repeat(np.arange(len(x)), x.value_lengths().to_numpy())
    places, weights = choose(row, x.flatten().to_numpy(), got.column("y").to_numpy() == 1, len(chosen))
    return Model(lm, {f: places[k] for f, k in chosen.items() if k in places}, weights, float(prior))


def choose(row: np.ndarray, column: np.ndarray, toxic: np.ndarray, n: int, least: float = LEAST) -> tuple[dict[int, int], np.ndarray]:
    """Columns that explain toxic rows, and their log odds; column k of n occurs in the rows beside it.

    One after the other, that which occurs in most toxic rows, each counted half for every column that it has already,
    less ten times the rows that are not toxic. Words that only go along with toxic ones, as in copies of a
    document, are not chosen, for their rows are explained. What a column explains never grows, so a heap of
    what each explained when last looked at gives the best without looking at all.
    """
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    bad = toxic[row]
    n0 = np.bincount(column[~bad], minlength=n)
    rows_of = np.split(row[bad], np.searchsorted(column[bad], np.arange(1, n)))
    n1 = np.bincount(column[bad], minlength=n)
    heap = [(-g, k) for k, g in enumerate((n1 - 10.0 * n0).tolist()) if g >= least]
    heapify(heap)
    open_rows, places = np.ones(len(toxic)), {}
    while heap:
        _, k = heappop(heap)
        now = (10.0 * n0[k] - open_rows[rows_of[k]].sum(), k)
        if heap and now > heap[0]:
            if -now[0] >= least:
                heappush(heap, now)
            continue
        if -now[0] < least:
            break
        places[k] = len(places)
        open_rows[rows_of[k]] *= 0.5
    at = np.array(list(places), int)
    odds = (n1[at] + 0.5) / (toxic.sum() + 1) / ((n0[at] + 0.5) / ((~toxic).sum() + 1))
    return places, np.log(odds)


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 28**3 numbers and at most a few weights for each of `sample` texts

    def run(batches):
        f = shared.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f(t) for t in texts_of(b.column(1))], pa.float64())], ["id", "score"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, schema_of(src.schema["id"].dataType, "score double"))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    out = score(docs, fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")))
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
