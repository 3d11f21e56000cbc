"""A corpus pipeline of the training-data operators: each stage takes what the one before has kept.

Each stage is called with (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared
folder and reads again as the next stage's docs. All but the last return the columns of documents.

Defined results: a null text counts as empty; further columns, whatever their names, go along up to the last stage; an empty
table stays empty; repeated rows are one group of near-duplicates; a null id is an id like any other, but is neither
fitted on nor named as the smallest of a group that has others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, decontaminate, pii, quality, simhash
from newsloom.llm.common import cut, read, release


#: Rows of an Arrow batch. The default, 10,000, is 34 MB of texts on average, held by the worker and, off the heap, by the executor; more
#: where texts are long.
BATCH_ROWS = 1_024


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches have no more rows than that."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject; without labels none is rejected."""
    small_batches(spark)
    return quality.keep_good(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id; texts without words are one group."""
    small_batches(spark)
    return simhash.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; texts without words stay."""
    small_batches(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked, n_chars set anew; a null text stays null."""
    small_batches(spark)
    return pii.mask(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text."""
    small_batches(spark)
    packed = docs.select(F.struct("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text")).alias("doc"), "text")
    out = bpe.encode(packed, "doc", "text")
    return out.select("id.doc_id", "id.lang", "id.source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("id.text")).alias("round_trip"))


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", no_benchmark),
    ("pii", without_pii),
    ("bpe encoding and decoding", tokens),
]

#: Trained, hashed and tokenised stages are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        release(before)
    return docs
