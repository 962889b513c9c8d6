"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.llm import archive, bpe, decontaminate, embedding, jaccard, language, ppm, quality, secret_scan, shard, spelling, sql, suffix, whitening
from tripweave.llm.common import remainder, table
from tripweave.session import shared_folder


def op1_embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors by cosine 0.9."""
    return embedding.join(table(spark, sf_dir, "embeddings"))


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code length of every document under a model of those whose remainder is not 2."""
    held_out = remainder("doc_id", 7) == 2
    docs = table(spark, sf_dir, "documents")
    cols = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return ppm.score(docs, ~held_out).withColumn("held_out", held_out).select(*cols)


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that occur more than once."""
    return suffix.remove(table(spark, sf_dir, "documents"))


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through legacy archives to WARC and back: one row per page with its record's type and digest."""
    at = f"{shared_folder(spark).rstrip('/')}/archives/{uuid.uuid4().hex}"
    archive.write_arc(table(spark, sf_dir, "pages"), f"{at}/arc")
    archive.convert(spark, f"{at}/arc", f"{at}/warc")
    return archive.page_records(spark, f"{at}/warc")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those of remainder 0 and 2."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(language.learned_from(docs).select("doc_id", "text", "lang"))
    return language.identify(docs, model).withColumn("held_out", remainder("doc_id", 3) == 1).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels of those of remainder 0 and 2."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(quality.labelled_texts(docs, table(spark, sf_dir, "labels")))
    return quality.score(docs, model).withColumn("held_out", remainder("doc_id", 3) == 1).select("doc_id", "held_out", "score", "predicted")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all documents by similarity 0.8 on five-word shingles."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by patterns and by models trained on what the patterns label."""
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(secret_scan.labelled_words(docs)))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of every document's tokens and of their decoding."""
    return bpe.digests(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in every document."""
    items = decontaminate.question_and_answer(table(spark, sf_dir, "benchmark"))
    return decontaminate.flagged(table(spark, sf_dir, "documents"), items)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by doc_id in 40 contiguous shards of near equal bytes."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", shard.text_bytes().alias("size"), shard.text_crc32().alias("text_crc32"))
    placed = shard.balanced(sized, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.col("size"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the four leading components of the different ones, at unit variance."""
    grid = whitening.on_grid(table(spark, sf_dir, "embeddings"))
    return whitening.whiten(grid, whitening.fit(grid))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, and the frequent form that each is a variant of."""
    return spelling.group(spelling.corpus_words(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_embedding_copies": op1_embedding_copies,
    "op2_ppm_score": op2_ppm_score,
    "op3_repeated_bytes": op3_repeated_bytes,
    "op4_arc_to_warc": op4_arc_to_warc,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_secrets": op8_secrets,
    "op9_bpe": op9_bpe,
    "op10_decontaminate": op10_decontaminate,
    "op11_sharding": op11_sharding,
    "op12_whitening": op12_whitening,
    "op13_spelling": op13_spelling,
}
ORACLE_SQL = {"op11_sharding": sql.SHARDS, "op13_spelling": sql.SPELLING}
