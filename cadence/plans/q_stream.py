"""Driver query for incremental ingestion (R1): F1 delivered as several files (one copy of each file
delivered twice), drained batch by batch; the store must equal a one-shot run."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.functions.text import num_words
from cadence.plans import fixtures as fx
from cadence.plans.common import big
from cadence.plans.oracle_fixtures import with_fixtures
from cadence.session import scratch_path, shuffle_partitions
from cadence.streaming.ingest import ingest_increment, read_store

KEYS = ["split", "filename"]


def _features(df):
    return df.select(*KEYS, "doc_id", num_words("clean_transcript").alias("num_words"))


def r1_incremental_ingest(spark, d):
    f1 = fx.f1_transcripts(spark, d).select(*KEYS, "doc_id", "clean_transcript")
    src = scratch_path(spark, "ingest_src")
    files = max(4, shuffle_partitions(spark))  # a file is written, and read, by one task
    parts = f1.repartition(files, "doc_id")
    parts.write.mode("overwrite").parquet(src)
    parts.where(F.col("split") == "train").write.mode("append").parquet(src)  # a re-delivered slice
    store, ckpt = scratch_path(spark, "ingest_store"), scratch_path(spark, "ingest_ckpt")
    schema = spark.read.parquet(src).schema
    ingest_increment(spark, src, schema, store, ckpt, KEYS, ["doc_id"], _features, files_per_batch=files // 2, buckets=16)
    out = read_store(spark, store)
    return out.select(*KEYS, big("doc_id"), big("num_words"))


QUERIES = {"r1_incremental_ingest": r1_incremental_ingest}

ORACLES = {
    "r1_incremental_ingest": with_fixtures("""SELECT split, filename, CAST(doc_id AS BIGINT) AS doc_id,
        CAST(greatest(len(list_filter(string_split(clean_transcript, ' '), lambda x: x <> '')), 1) AS BIGINT) AS num_words
        FROM f1_transcripts""", "f1_transcripts"),
}
