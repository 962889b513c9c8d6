"""From raw documents to tokens: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripweave.llm import bpe, decontaminate, jaccard, language, secret_scan
from tripweave.llm.common import table
from tripweave.session import cut_lineage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter or far from every centroid go."""
    return language.keep_known(docs, language.fit(language.learned_from(docs).select("doc_id", "text", "lang")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies; all that have no copy stay."""
    return jaccard.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, decontaminate.question_and_answer(table(spark, sf_dir, "benchmark")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secret_scan.redact(docs, secret_scan.train(secret_scan.labelled_words(docs)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids."""
    return bpe.add_tokens(docs)


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("benchmark", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

#: No stage but the third could be written in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table of documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
