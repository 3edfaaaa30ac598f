"""Registered queries of the thirteen operators: each applies its operator to the whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm import (chat, decontam, exact_dedup, hard_negatives, html_extract, langid, lm_score, mixing, ngram_join, sharding, suffix_dedup,
                         url_filter, whitening)
from cadence.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 by the weighted hash tree, and into 9 with one more."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.even_tree(8))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page capture against the list entries active on its fetch day."""
    return url_filter.url_decisions(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) leak among all documents."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when sources weigh 5, 2, 1 and share 150% of all words."""
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document (five-word shingles, Jaccard 0.8)."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text by mixture inference; learned outside the held-out fold."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all documents through binary-fuse filters of earlier batches."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a 50-byte string of a document with a smaller id."""
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from the raw transcripts of all conversations, in canonical form."""
    return chat.recovered_turns(table(spark, sf_dir, "conversations"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by structure and nearest-URL differencing."""
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole text under a deleted-interpolation n-gram model learned outside the held-out fold."""
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the four leading whitened components, from the scatter matrix's exact characteristic polynomial."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding's five positives, labels of every seventh moved by one first."""
    t = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    return hard_negatives.mine(t.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), "embedding", F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)).alias("anchor")))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_url_filter, op3_decontamination, op4_mixing, op5_ngram_join, op6_language_id, op7_exact_dedup, op8_suffix_dedup, op9_chat_format, op10_html_extraction,
                                   op11_lm_scoring, op12_embedding_whitening, op13_hard_negatives)}
