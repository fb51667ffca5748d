"""Corpus pipeline: quality, near duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again for the next one.
All but the last return the columns of documents. Nulls, ties, repeated rows and empty tables are handled as the operators'
docstrings tell; a document that no stage objects to goes through unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard.llm import bpe, decontaminate, jaccard, quality, secrets
from railyard.llm.frames import fresh, remove, table, write_out

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of the best grade is below quality.KEEP."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.select(docs, model)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates (5 words, similarity 0.8)."""
    return jaccard.dedupe(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; n_chars follows where a text changes."""
    before = fresh("before", docs.columns)
    redacted = secrets.redact(docs.withColumn(before, F.col("text")), models=secrets.train(docs))
    return redacted.withColumn("n_chars", F.when(F.col("text") != F.col(before), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers) and the digest of the decoded text."""
    made = bpe.encode(docs.select("doc_id", "lang", "source", "text"), VOCABULARY, decoded_col="decoded")
    return made.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_class),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("BPE encoding and decoding", tokens),
]

#: SQL can't express the classifier, the join's classes, edit distances and BPE; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = write_out(stage(spark, docs, sf_dir))
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
