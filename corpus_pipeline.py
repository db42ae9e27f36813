"""From documents to token ids in five stages; each works on all that the one before it kept.

All stages but the last keep every column, extra ones and ones whose names clash with a stage's own included. Null texts count as
empty. Every stage reads whole texts, however long, and gives an empty table for an empty one. Ties and repeated rows: the classifier,
the decontamination, the secrets and the tokens treat equal rows alike and each for itself; of near duplicates, repeated rows included,
the row of smallest id stays (then of smallest hash of the row), so that a rerun after a lost executor keeps the same rows. Texts without
words are near duplicates of nothing and stay, equal rows of them once. Rows with a null id take part like others, after all other ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline.llm import byte_bpe, common, decontaminate, ngram_join, quality, secret_scan


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    common.small_batches(spark)
    return quality.keep_good(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    common.small_batches(spark)
    return ngram_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    common.small_batches(spark)
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets struck out."""
    return secret_scan.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and the digest of what they decode to."""
    common.small_batches(spark)
    return byte_bpe.digests(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", token_ids),
]

#: Classifier, similarity join and tokenizer have no form in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.written(docs, name)
    return docs
