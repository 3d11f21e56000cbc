"""Quality by co-training: a classifier of text content and one of page metadata teach each other.

Both start from the labelled rows. In each round all unlabelled documents are scored on the executors; those that a
view is sure of (calibrated probability at least `sure`, or at most one minus it) are marked by it and join the
training rows of the other view, which takes a Newton step on their slopes and curvatures, summed over the table: no row of
theirs is collected, and there is no bound on their number. Equal documents count once. A marked row weighs as a labelled
one, but those of a class together no more than the labelled rows do by the true share of the class, so neither a frequent
class nor a large table drowns what is known.
At the end both views are calibrated, and a logistic combination of the calibrated views scores all documents.

Labelled rows are at most `sample`, half of them for each class, taken by a hash of the id and weighted by the true
counts of the classes; of rows that share an id the smallest is taken. Three fifths of a class train the views, one
calibrates them in the rounds, and one, used for nothing else, calibrates and combines them at the end; with fewer than three rows of
a class all rows serve for everything. Sources, languages and sizes fall into as many buckets as there are about distinct values twice,
`MOST_BUCKETS` at most. Defined results: null and empty texts, and nulls in metadata, have features of
their own and are scored like any; repeated rows give a row each; with no usable labels (none, of one class, or with
no document of one class) every document scores the share of good labels (1 if there are none); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import cut, read, release, schema_of, slices, smallest_hashed
from newsloom.llm.logistic import Logistic

SAMPLE, ROUNDS, SURE = 8_000, 3, 0.95
THRESHOLD = 0.5
LEAST_BUCKETS, MOST_BUCKETS = 64, 256

#: Classes of ASCII characters for counting.
CLASSES = {"u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "d": "0123456789", "s": "#$%&*@^~=+<>{}[]\\`_", "p": "|/", "b": "!?", "c": ".,;:", "q": "\"'()-", "w": " \t", "n": "\n"}
TABLE = bytearray(b"l" * 256)
for _k, _chars in CLASSES.items():
    for _c in _chars:
        TABLE[ord(_c)] = ord(_k)
TABLE = bytes(TABLE)
N_TEXT = len(CLASSES) + 11


def text_features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    kinds, n = raw.translate(TABLE), max(1, len(raw))
    share = [kinds.count(k.encode()) / n for k in CLASSES]
    words = (text or "").split()
    lines = [x for x in (text or "").split("\n") if x]
    m = max(1, len(words))
    sizes = list(map(len, words))
    distinct = len(set(words)) / m
    repeated = sum(map(eq, words, words[1:])) / m
    line_share = len(set(lines)) / max(1, len(lines))
    longest = max(sizes, default=0)
    mean = sum(sizes) / m
    return [
        *(math.sqrt(x) for x in share),
        math.log1p(m),
        mean,
        abs(mean - 6),
        min(longest, 60) / 10,
        distinct,
        distinct * math.log1p(m),
        math.sqrt(repeated),
        line_share,
        1 - line_share,
        math.log1p(m / max(1, len(lines))),
        float(not words),
    ]


def meta_parts(source: str | None, lang: str | None, n_chars: int | None, buckets: int) -> list[float]:
    """The buckets of source, language and size, and three numbers: all that meta_features() are made of."""
    keys = (f"s{source}", f"l{lang}", f"n{int(math.log2(max(1, n_chars)))}" if n_chars is not None else "n")
    return [*(xxhash.xxh32_intdigest(k) % buckets for k in keys), math.log1p(max(0, n_chars or 0)), float(n_chars is None), float(source is None)]


def spread(parts: np.ndarray, buckets: int) -> np.ndarray:
    """Rows of features from rows of parts."""
    out, rows = np.zeros((len(parts), buckets + 4)), np.arange(len(parts))
    for k in range(3):
        np.add.at(out, (rows, parts[:, k].astype(np.int64)), 1.0)
    out[:, buckets], out[:, buckets + 1] = parts[:, 3], parts[:, 3] ** 2 / 10
    out[:, buckets + 2 :] = parts[:, 4:]
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None, buckets: int) -> np.ndarray:
    return spread(np.array([meta_parts(source, lang, n_chars, buckets)]), buckets)[0]


def _parts(batch, buckets: int):
    cols = [batch.column(k).to_pylist() for k in range(1, 5)]
    text = np.array([text_features(t) for t in cols[0]], np.float64).reshape(-1, N_TEXT)
    return text, np.array([meta_parts(*r, buckets) for r in zip(*cols[1:])], np.float64).reshape(-1, 6)


def _rows(batch, buckets: int):
    text, parts = _parts(batch, buckets)
    return text, spread(parts, buckets)


class Platt:
    """Logistic calibration of a score."""

    def __init__(self, logit: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None):
        self.fit = Logistic(l2=1e-3).fit(np.clip(logit, -30, 30).reshape(-1, 1), y, weight)

    def logit(self, t):
        return self.fit.logit(np.clip(t, -30, 30).reshape(-1, 1))

    def prob(self, t):
        return self.fit.prob(np.clip(t, -30, 30).reshape(-1, 1))


def _weights(y: np.ndarray, shares: dict | None) -> np.ndarray:
    """Weights of 1 on average that give the classes of y their shares."""
    w = np.ones(len(y))
    for k, share in (shares or {}).items():
        w[y == k] = share * len(y) / max(1, int((y == k).sum()))
    return w


class CoTrained:
    """Two views, their calibration and the combination of both."""

    def __init__(self, train, y, choose, y_choose, shares, buckets):
        self.shares, self.buckets, self.pseudo = shares, buckets, []
        self.train, self.y, self.choose, self.y_choose = train, y, choose, y_choose
        self.weight, self.w_choose = _weights(y, shares), _weights(y_choose, shares)
        self.models = [Logistic().fit(v, y, self.weight) for v in train]
        self.calibrate()

    def calibrate(self):
        self.platt = [Platt(m.logit(v), self.y_choose, self.w_choose) for m, v in zip(self.models, self.choose)]

    def marked(self, views, sure: float):
        """(view, class, rows): what each view is taught, the rows that the other one is sure of."""
        p = [c.prob(m.logit(v)) for c, m, v in zip(self.platt, self.models, views)]
        for k in (0, 1):
            for y in (0, 1):
                yield k, y, np.flatnonzero(p[1 - k] >= sure if y else p[1 - k] <= 1 - sure)

    def teach(self, sums: dict):
        """A round: sums[view, class] = (slope, curvature, rows) of the marked rows."""
        self.pseudo.append({k: n for k, (_, _, n) in sums.items()})
        n = len(self.y)
        for k in (0, 1):
            more = [(min(1.0, self.shares[y] * n / rows), g, h, rows) for y in (0, 1) for g, h, rows in [sums[k, y]] if rows]
            if more:
                self.models[k] = self.models[k].taught(self.train[k], self.y, self.weight, more)
        self.calibrate()

    def finish(self, held, y_held):
        w = _weights(y_held, self.shares)
        self.platt = [Platt(m.logit(h), y_held, w) for m, h in zip(self.models, held)]
        self.top = Logistic(l2=1e-3).fit(self._both(held), y_held, w)
        del self.train, self.choose
        return self

    def _both(self, views):
        return np.stack([np.clip(p.logit(m.logit(v)), -15, 15) for p, m, v in zip(self.platt, self.models, views)], axis=1)

    def prob(self, views):
        return self.top.prob(self._both(views))


def round_sums(features: DataFrame, model: CoTrained, sure: float = SURE) -> dict:
    """{(view, class): (slope, curvature, rows)} over all rows of features(x), added up on the executors."""
    sizes = [N_TEXT + 1, model.buckets + 5]
    each = [d + d * d + 1 for d in sizes for _ in (0, 1)]
    starts = np.concatenate([[0], np.cumsum(each)])

    def run(batches):
        total = np.zeros(starts[-1])
        for b in slices(batches, 2048):
            x = b.column(0).flatten().to_numpy().astype(np.float64).reshape(b.num_rows, -1)
            views = x[:, :N_TEXT], spread(x[:, N_TEXT:], model.buckets)
            for k, y, at in model.marked(views, sure) if len(x) else ():
                if len(at):
                    slope, curve = model.models[k].sums(views[k][at], y)
                    part = total[starts[2 * k + y] : starts[2 * k + y + 1]]
                    part += np.concatenate([slope, curve.ravel(), [len(at)]])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "value"])

    got = features.mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()  # bounded by the slots
    total = np.zeros(starts[-1])
    total[got.column(0).to_numpy()] = got.column(1).to_numpy()
    out = {}
    for k, d in enumerate(sizes):
        for y in (0, 1):
            part = total[starts[2 * k + y] : starts[2 * k + y + 1]]
            out[k, y] = part[:d], part[d:-1].reshape(d, d), int(round(part[-1]))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", label_col="quality", sample: int = SAMPLE, rounds: int = ROUNDS, sure: float = SURE) -> CoTrained | float:
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    counts = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    total = sum(counts.values())
    constant = counts.get(1, 0) / total if total else 1.0
    if len(counts) < 2:
        return constant
    source = _source(docs, id_col)
    # half of the bound for each class, so that a rare class is learnt too; weights put the shares right again
    present = cut(marked.join(source.where("id is not null").select("id").distinct(), "id", "left_semi"))
    picked = [smallest_hashed(present.where(F.col("y") == y), sample // 2, "id") for y in (0, 1)]
    picked = cut(picked[0].unionByName(picked[1]))
    src = source.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("row")).select("id", "row.*", "y")
    values = sum(source.agg(F.approx_count_distinct("source"), F.approx_count_distinct("lang")).first()) + 32
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (2 * values - 1).bit_length()))

    def known_rows(batches):
        for b in batches:
            text, meta = _rows(b, buckets)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(5), pa.array(list(text), pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.float64()))], ["id", "y", "a", "b"])

    kind = docs.schema[id_col].dataType
    got = src.select("id", "text", "source", "lang", "n_chars", "y").mapInArrow(known_rows, schema_of(kind, "y int, a array<double>, b array<double>")).collect()  # bounded by sample
    got.sort(key=lambda r: xxhash.xxh64_intdigest(str(r.id)))
    of = [[r for r in got if r.y == y] for y in (0, 1)]
    if not all(of):
        return constant
    pack = lambda rows: [np.array([r.a for r in rows]).reshape(-1, N_TEXT), np.array([r.b for r in rows]).reshape(-1, buckets + 4)]
    y = lambda rows: np.array([r.y for r in rows], float)
    train = choose = held = got
    if min(map(len, of)) >= 3:
        cuts = [(max(1, len(rows) * 3 // 5), max(2, len(rows) * 4 // 5)) for rows in of]
        train, choose, held = ([r for rows, c in zip(of, cuts) for r in rows[slice(*part(c))]] for part in (lambda c: (0, c[0]), lambda c: c, lambda c: (c[1], None)))
    model = CoTrained(pack(train), y(train), pack(choose), y(choose), {k: n / total for k, n in counts.items()}, buckets)

    def free_rows(batches):
        for b in slices(batches):
            x = np.concatenate(_parts(b, buckets), axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(5), b.column(6), pa.array(list(x), pa.list_(pa.float32()))], ["id", "h", "g", "x"])

    # every unlabelled document, of equal ones one; features are made before anything is shuffled, so no text is
    what = ["text", "source", "lang", "n_chars"]
    free = (source if rounds else source.where("false")).select("id", *what, F.xxhash64(*what).alias("h"), F.xxhash64(F.lit(1), *what).alias("g"))
    free = free.mapInArrow(free_rows, schema_of(kind, "h long, g long, x array<float>")).join(marked.select("id"), "id", "left_anti")
    features = cut(free.groupBy("h", "g").agg(F.first("x").alias("x")).select("x"))
    for _ in range(rounds):
        sums = round_sums(features, model, sure)
        if not any(n for _, _, n in sums.values()):
            break
        model.teach(sums)
    release(present, picked, features)
    return model.finish(pack(held), y(held))


def _source(docs: DataFrame, id_col="doc_id") -> DataFrame:
    col = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    return docs.select(F.col(id_col).alias("id"), col("text", "string"), col("source", "string"), col("lang", "string"), col("n_chars", "long"))


def score(docs: DataFrame, model: CoTrained | float, id_col="doc_id") -> DataFrame:
    """(id, p_text, p_meta, score): probability of good quality by either view and by both."""

    def run(batches):
        for b in slices(batches):
            if isinstance(model, float):
                p = [np.full(b.num_rows, model)] * 3
            elif b.num_rows:
                text, meta = _rows(b, model.buckets)
                p = [c.prob(m.logit(v)) for c, m, v in zip(model.platt, model.models, (text, meta))] + [model.prob((text, meta))]
            else:
                p = [np.zeros(0)] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.float64()) for x in p)], ["id", "p_text", "p_meta", "score"])

    src = _source(docs, id_col)
    return src.mapInArrow(run, schema_of(src.schema["id"].dataType, "p_text double, p_meta double, score double"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col="doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs that score at least the threshold, all columns as they are."""
    model = fit(docs, labels, id_col)
    names = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*names).alias("doc_id"), *[F.col(c) for c in ("text", "source", "lang", "n_chars") if c in docs.columns])
    return score(packed, model, "doc_id").where(F.col("score") >= threshold).select("id.*")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score(docs, fit(docs, read(spark, sf_dir, "labels", "doc_id", "quality")))
    return out.select(F.col("id").alias("doc_id"), "p_text", "p_meta", "score", (F.col("score") >= THRESHOLD).alias("keep"))
