"""Phrases in documents: occurrences with their places, scores, first match, and scores with context.

Phrases are found by one Aho-Corasick automaton in each Python worker, in Arrow batches: only what is found leaves a task, and no
shuffle is needed to score a document, as all of its occurrences are met in one place. A vocabulary that is too large for
one automaton is dealt to several, a pass over the documents each; or, where documents are few, joined by words (matches).
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import normalize_py, normalize_text, tokens

#: Phrases that a broadcast may hold; larger vocabularies are joined by shuffling.
BROADCAST_PHRASES = 200_000
#: Phrases of one automaton, some 300 bytes each in a worker.
PASS_PHRASES = 500_000
#: Rows that are made Python objects at a time.
ROWS = 512

_BUILT: dict[str, ahocorasick.Automaton] = {}


class Phrases:
    """Lower-case phrases; the automaton is built once a worker and never pickled."""

    def __init__(self, phrases: Iterable[str]):
        self.phrases = tuple(dict.fromkeys(p.lower() for p in phrases if p))
        self.key = uuid.uuid4().hex

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if self.key not in _BUILT:
            _BUILT.clear()  # a worker holds one at a time
            auto = ahocorasick.Automaton()
            for p in self.phrases:
                auto.add_word(p, p)
            auto.make_automaton()
            _BUILT[self.key] = auto
        return _BUILT[self.key]

    def whole(self, text: str) -> Iterator[tuple[str, int, int]]:
        """(phrase, start, end) of each occurrence, nested and overlapping ones too, beside which no letter or digit stands; both ends count."""
        if not self.phrases:
            return
        last = len(text) - 1
        for end, phrase in self.automaton.iter(text):
            start = end - len(phrase) + 1
            if (end == last or not text[end + 1].isalnum()) and (start == 0 or not text[start - 1].isalnum()):
                yield phrase, start, end

    def first(self, text: str) -> tuple[str, int] | None:
        """(phrase, end) of the phrase that ends first, the longest of equals."""
        best = None
        for end, phrase in self.automaton.iter(text) if self.phrases else ():
            if best is not None and end > best[1]:
                break
            if best is None or len(phrase) > len(best[0]):
                best = phrase, end
        return best


def passes(phrases: Iterable[str] | DataFrame, most: int = PASS_PHRASES) -> list[Phrases]:
    """Phrases(phrase) or a list of them, as many sets as no automaton gets too large; sets have no phrase in common."""
    if not isinstance(phrases, DataFrame):
        listed = list(dict.fromkeys(p.lower() for p in phrases if p))
        return [Phrases(listed[k : k + most]) for k in range(0, len(listed), most)]
    low = phrases.select(F.lower("phrase").alias("phrase")).where("phrase <> ''").distinct()
    n = -(-low.count() // most)
    part = lambda k: low if n == 1 else low.where(F.pmod(F.xxhash64("phrase"), F.lit(n)) == k)
    return [Phrases(r.phrase for r in part(k).toLocalIterator()) for k in range(n)]


def _scan(docs: DataFrame, id_col: str, text_col: str, make, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """(id, ...): the rows that make() gives for the text of each document; null texts are empty."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rest = T.StructType.fromDDL(schema)
    names = ["id", *rest.names]

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                at, columns = [], [[] for _ in kinds]
                for row, text in enumerate(b.column(1).to_pylist()):
                    for values in make(text or ""):
                        at.append(row)
                        for column, v in zip(columns, values):
                            column.append(v)
                if at:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    return src.mapInArrow(run, T.StructType([T.StructField("id", src.schema["id"].dataType), *rest.fields]))


def occurrences(docs: DataFrame, phrases: Iterable[str] | DataFrame, id_col="doc_id", text_col="text", most: int = PASS_PHRASES) -> DataFrame:
    """(id, phrase, start, end): every occurrence of each phrase in the normalised text, by code points, the end included."""
    out = None
    for some in passes(phrases, most):
        got = _scan(docs, id_col, text_col, lambda t, some=some: some.whole(normalize_py(t)), "phrase string, start int, end int", [pa.string(), pa.int32(), pa.int32()])
        out = got if out is None else out.unionByName(got)
    if out is not None:
        return out
    return docs.select(F.col(id_col).alias("id"), F.lit("").alias("phrase"), F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)


def scores(docs: DataFrame, phrases: Iterable[str] | DataFrame, id_col="doc_id", text_col="text", most: int = PASS_PHRASES) -> DataFrame:
    """(id, unique_count, total_count, keywords) of every row with an occurrence; keywords sorted and joined.

    A row is scored where it is read. Only a vocabulary of several passes needs a shuffle, of one row a document and pass.
    """

    def counted(some: Phrases):
        def make(text):
            n = Counter(p for p, _, _ in some.whole(normalize_py(text)))
            if n:
                yield len(n), sum(n.values()), sorted(n)

        return make

    sets = passes(phrases, most)
    made = [_scan(docs, id_col, text_col, counted(some), "unique_count long, total_count long, phrases array<string>", [pa.int64(), pa.int64(), pa.list_(pa.string())]) for some in sets or [Phrases([])]]
    out = made[0]
    if len(made) > 1:
        for more in made[1:]:
            out = out.unionByName(more)
        out = out.groupBy("id").agg(F.sum("unique_count").alias("unique_count"), F.sum("total_count").alias("total_count"), F.sort_array(F.flatten(F.collect_list("phrases"))).alias("phrases"))
    return out.select("id", "unique_count", "total_count", F.array_join("phrases", ", ").alias("keywords"))


def vocabulary(spark, phrases: list[str], normalize: bool = False) -> DataFrame:
    """(phrase, n_words): lower case, duplicates collapsed; with normalize the phrases lose punctuation as texts do."""
    df = spark.createDataFrame([(p, k) for k, p in enumerate(phrases)], "phrase string, ord int")
    df = df.withColumn("phrase", normalize_text(F.col("phrase")) if normalize else F.lower("phrase"))
    return df.groupBy("phrase").agg(F.min("ord").alias("ord")).withColumn("n_words", F.size(F.split("phrase", " "))).where("phrase <> ''")


def matches(docs: DataFrame, vocab: DataFrame, id_col="doc_id", text_col="text", broadcast: bool | None = None) -> DataFrame:
    """(id, phrase, at): every occurrence, overlapping and nested ones too, at its word position.

    Words are joined to the phrases by the first word, an equi-join, where scanning for each phrase would be a nested
    loop; the words that follow, which each row holds as far as the longest phrase goes, confirm the match.
    """
    stats = vocab.agg(F.max("n_words").alias("longest"), F.count(F.lit(1)).alias("n")).first()
    longest = stats.longest or 1
    small = stats.n <= BROADCAST_PHRASES if broadcast is None else broadcast
    # the generator holds the words in a column: what follows refers to them many times and must not make them again
    words = docs.select(F.col(id_col).alias("id"), F.explode(F.array(tokens(normalize_text(F.col(text_col))))).alias("words"))
    # measured: a filter of the places by the first words of all phrases costs more than the join saves
    shifted = [F.col("words") if k == 0 else F.slice("words", F.lit(k + 1), F.greatest(F.size("words") - k, F.lit(0))) for k in range(longest)]
    rows = words.select("id", F.posexplode(F.arrays_zip(*[x.alias(f"w{k}") for k, x in enumerate(shifted)])).alias("at", "w"))
    rows = rows.select("id", "at", *[F.col(f"w.w{k}").alias(f"w{k}") for k in range(longest)])
    phrases = vocab.select("phrase", "n_words", F.substring_index("phrase", " ", 1).alias("w0"))
    found = rows.join(F.broadcast(phrases) if small else phrases, "w0")
    heads = [F.concat_ws(" ", *[f"w{j}" for j in range(k + 1)]) for k in range(longest)]
    same = F.lit(False)
    for k, head in reversed(list(enumerate(heads))):
        same = F.when(F.col("n_words") == k + 1, head == F.col("phrase")).otherwise(same)
    return found.where(same).select("id", "phrase", "at")


def score(found: DataFrame) -> DataFrame:
    """(id, unique_count, total_count, keywords): documents with a match; keywords sorted and joined."""
    per = found.groupBy("id", "phrase").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("id").agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.sum("n").alias("total_count"),
        F.array_join(F.array_sort(F.collect_list("phrase")), ", ").alias("keywords"),
    )


def first_match(docs: DataFrame, phrases: Iterable[str], id_col="doc_id", text_col="text") -> DataFrame:
    """(id, phrase, end): the phrase that ends first, the longest of equals, without regard to word bounds or to case of the phrases."""
    some = Phrases(phrases)
    first = lambda text: [(got[0], got[1] + 1)] if (got := some.first(text)) else []
    return _scan(docs, id_col, text_col, first, "phrase string, end int", [pa.string(), pa.int32()])


class Context:
    """Words of the keywords found, less the anti-keywords found apart from them.

    A hit with one of its irrelevant phrases as whole words within `window` characters does not count; spans claim their
    characters in the order of the list, and what overlaps a claimed span counts nothing but is still named.
    """

    def __init__(self, keywords, irrelevant=(), anti=(), irrelevant_anti=(), window: int = 50):
        def whole(phrases):
            return [(p, re.compile(rf"\b{re.escape(p)}\b", re.I)) for p in phrases]

        self.keywords, self.anti, self.window = whole(keywords), whole(anti), window
        self.irrelevant, self.irrelevant_anti = whole(irrelevant), whole(irrelevant_anti)

    def hits(self, text: str, phrases, irrelevant):
        low = text.lower() if text.isascii() else None
        for phrase, pattern in phrases:
            if low is not None and phrase.isascii() and phrase.lower() not in low:
                continue
            for m in pattern.finditer(text):
                around = text[max(0, m.start() - self.window) : m.end() + self.window]
                if not any(p.search(around) for _, p in irrelevant):
                    yield phrase, m.start(), m.end()

    def __call__(self, text: str) -> tuple[int, list[str], list[str]]:
        """(score, keywords, anti-keywords), each named once in the order of the list."""
        claimed, total, named, against = bytearray(len(text)), 0, {}, {}
        for phrase, a, b in self.hits(text, self.keywords, self.irrelevant):
            named[phrase] = None
            if not any(claimed[a:b]):
                claimed[a:b] = b"\1" * (b - a)
                total += len(phrase.split())
        for phrase, a, b in self.hits(text, self.anti, self.irrelevant_anti):
            against[phrase] = None
            total -= not any(claimed[a:b])
        return total, list(named), list(against)


def context_score(docs: DataFrame, keywords, irrelevant=(), anti=(), irrelevant_anti=(), id_col="doc_id", text_col="text") -> DataFrame:
    """(id, score, keywords, anti_keywords): greedy by list order, so a row at a time, in Arrow batches."""
    lists = list(keywords), list(irrelevant), list(anti), list(irrelevant_anti)

    @F.pandas_udf("struct<score:int,keywords:string,anti_keywords:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        score = Context(*lists)
        got = [score(t or "") for t in texts]
        return pd.DataFrame({"score": [s for s, _, _ in got], "keywords": [", ".join(k) for _, k, _ in got], "anti_keywords": [", ".join(a) for _, _, a in got]})

    return docs.select(F.col(id_col).alias("id"), run(text_col).alias("r")).select("id", "r.score", "r.keywords", "r.anti_keywords")
