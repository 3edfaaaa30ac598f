"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

Each stage takes all rows its predecessor kept and returns the columns of ``documents`` (the last adds the shard).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadence.llm import decontam, langid, mixing, ngram_join, sharding
from cadence.llm.common import prepare, table, written

SHARDS = 8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents without a letter (NULL and empty texts too), or that no learned language explains, go; ``lang`` stays as given.

    Where no row has a language to learn from, all go; repeated rows are judged alike; an empty table stays empty."""
    prepare(spark)
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each class linked by five-word shingles (Jaccard 0.8 or more) the smallest doc_id stays.

    Texts without words (NULL, empty, white space) are in no class and all stay; a NULL doc_id takes part, and stays only if its class
    has no other id; rows that repeat the kept id stay; texts of any length count whole; an empty table stays empty."""
    prepare(spark)
    return ngram_join.keep_one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that leak a benchmark item go.

    NULL and empty texts match nothing and stay; items without words match nothing; repeated rows are judged alike; a benchmark without
    items keeps everything; an empty table stays empty."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: sources at their target weights; documents repeat, are left out, or are cut at the budget's word.

    Texts without words are never taken; a NULL source is one of its own, ranked last; repeated rows are rows of their own, in key order by id and
    size; an empty table stays empty."""
    prepare(spark)
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: every row of the mix with its shard, replacing a column of that name.

    Repeated ids get one shard; NULL ids are the one key ``null``; NULL texts are kept; an empty table stays empty."""
    prepare(spark)
    return sharding.shard_rows(docs, sharding.even_tree(SHARDS))


STAGES = [("language_id", language_id), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontamination),
          ("mixing", mix_sources), ("sharding", shard)]
#: language identification, latent retrieval and MinHash classes have no SQL form; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
