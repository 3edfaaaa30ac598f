"""Incremental feature ingestion (R1) with Structured Streaming.

New manifest/transcript files arrive in a directory; each micro-batch keeps the first row per key (U1),
drops keys already stored by *earlier* batches (JN2), computes features and overwrites its own
``batch=<id>`` folders of a :class:`~cadence.sources.keyed.KeyedStore`. A replayed batch therefore rewrites the same
folders and never sees its own partial output, so a restart after any failure neither loses nor duplicates a key. The
stream's offsets and commits live in the checkpoint location; ``availableNow`` drains what is there and stops.

What a batch reads of the store does not grow with the store: the filters of the buckets its keys fall in, and the
stored keys of those buckets only in which a filter finds a key that may be stored. Rows with a NULL in a key cannot be
deduplicated; they are kept with the reason under ``errors`` instead of stopping the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.operators.keys import dedupe_first
from cadence.sources.keyed import BUCKETS, KeyedStore


def ingest_batch(store: KeyedStore, batch: DataFrame, batch_id: int, order: Sequence[str],
                 features: Callable[[DataFrame], DataFrame]) -> list[int]:
    """One micro-batch into ``store``; returns the buckets whose stored keys were read."""
    keys = list(store.keys)
    unkeyed = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    (batch.where(unkeyed).withColumn("error", F.lit("NULL in the key " + ", ".join(keys)))
     .write.mode("overwrite").parquet(f"{store.root}/errors/batch={batch_id}"))
    fresh = dedupe_first(batch.where(~unkeyed), keys, order).persist()
    known, read = store.already_stored(fresh.select(*keys), batch_id)
    new = fresh if known is None else fresh.join(known, keys, "left_anti")
    store.write_batch(features(new), batch_id)
    fresh.unpersist()
    return read


def ingest_increment(spark: SparkSession, source: str, schema: T.StructType, store: str, checkpoint: str,
                     keys: Sequence[str], order: Sequence[str], features: Callable[[DataFrame], DataFrame],
                     files_per_batch: int | None = 20, stop_after_batches: int | None = None, buckets: int = BUCKETS) -> int:
    """Drain ``source`` into ``store``; returns the number of batches run. A micro-batch takes at most
    ``files_per_batch`` new files (20, the reference's checkpoint interval). ``features`` keeps the key columns.
    ``stop_after_batches`` stops early (used to test restarts)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(source)
    seen = {"n": 0}

    def process(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(KeyedStore.open(batch.sparkSession, store, keys, buckets), batch, batch_id, order, features)
        seen["n"] += 1

    q = (stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    if stop_after_batches is None:
        q.awaitTermination()
    else:
        while q.isActive and seen["n"] < stop_after_batches:
            q.awaitTermination(0.2)
        q.stop()
    return seen["n"]


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """All ingested rows (the ``bucket`` and ``batch`` partition columns kept)."""
    path = f"{store.rstrip('/')}/data"
    return spark.read.parquet(path)


def read_errors(spark: SparkSession, store: str) -> DataFrame:
    """Rows that could not be keyed, with the ``error`` and their ``batch``."""
    return spark.read.parquet(f"{store.rstrip('/')}/errors")
