"""Stop after one batch, restart, and the store still equals a one-shot run (no loss, no duplicates)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.functions.text import num_words
from cadence.plans import fixtures as fx
from cadence.session import scratch_path
from cadence.sources.keyed import KeyedStore, build_filter, covering, may_hold
from cadence.streaming.ingest import ingest_batch, ingest_increment, read_errors, read_store

KEYS = ["split", "filename"]


def _features(df):
    return df.select(*KEYS, "doc_id", num_words("clean_transcript").alias("num_words"))


def test_restart_is_exactly_once(spark, sf_small):
    f1 = fx.f1_transcripts(spark, sf_small).select(*KEYS, "doc_id", "clean_transcript")
    src = scratch_path(spark, "t_src")
    f1.repartition(6, "doc_id").write.parquet(src)
    schema = spark.read.parquet(src).schema
    store, ckpt = scratch_path(spark, "t_store"), scratch_path(spark, "t_ckpt")
    first = ingest_increment(spark, src, schema, store, ckpt, KEYS, ["doc_id"], _features,
                             files_per_batch=2, stop_after_batches=1)
    assert first >= 1
    ingest_increment(spark, src, schema, store, ckpt, KEYS, ["doc_id"], _features, files_per_batch=2)
    out = read_store(spark, store)
    assert out.count() == f1.count()
    assert out.select(*KEYS).distinct().count() == f1.count()
    assert out.join(f1.select(*KEYS), KEYS, "left_anti").count() == 0


def test_filters_cover_every_batch_once():
    for b in (0, 1, 7, 8, 9, 63, 64, 83, 513):
        held = sorted(x for level, last in covering(b) for x in range(last - 8 ** level + 1, last + 1))
        assert held == list(range(b))
        assert len(covering(b)) <= 7 * 4


def test_key_filter_has_no_false_negative():
    keys = np.random.default_rng(1).integers(-2 ** 62, 2 ** 62, 20_000)
    blob = build_filter(keys[:10_000])
    assert may_hold(blob, keys[:10_000]).all()
    assert may_hold(blob, keys[10_000:]).sum() <= 5


def test_a_batch_reads_only_buckets_that_may_hold_its_keys(spark):
    store = KeyedStore.open(spark, scratch_path(spark, "t_keyed"), ["k"], buckets=32)
    rows = lambda lo, hi: spark.range(lo, hi).select(F.concat(F.lit("k"), F.col("id")).alias("k"), "id")
    same = lambda df: df
    assert ingest_batch(store, rows(0, 400), 0, ["id"], same) == []
    assert ingest_batch(store, rows(1000, 1400), 1, ["id"], same) == []                     # all new: no stored key is read
    again = rows(5, 6).unionByName(rows(5000, 5200))
    own = again.where("id = 5").select(store.bucket().alias("b")).first()["b"]
    assert ingest_batch(store, again, 2, ["id"], same) == [own]
    files = store.stored_keys([own], 2).inputFiles()
    assert files and all(f"/bucket={own}/" in f for f in files)
    assert store.rows().count() == 400 + 400 + 200
    assert store.rows().select("k").distinct().count() == 1000
    assert ingest_batch(store, again, 2, ["id"], same) == [own] and store.rows().count() == 1000   # a replay
    for b in range(3, 10):                                                                   # batch 7 merges the filters of 0 to 7
        ingest_batch(store, rows(0, 400).unionByName(rows(10_000 + b, 10_001 + b)), b, ["id"], same)
    assert store.rows().count() == 1000 + 7
    merged = spark.read.parquet(f"{store.root}/filters/level=1")
    assert merged.agg(F.sum("n")).first()[0] == 1005 and {r["batch"] for r in merged.select("batch").distinct().collect()} == {7}
    with pytest.raises(ValueError, match="keys"):
        KeyedStore.open(spark, store.root, ["other"])


def test_rows_without_a_key_become_error_rows(spark):
    store = KeyedStore.open(spark, scratch_path(spark, "t_errors"), ["split", "filename"], buckets=4)
    batch = spark.createDataFrame([("train", "a", 1), ("train", None, 2), (None, "b", 3), ("train", "a", 4)], "split string, filename string, x int")
    ingest_batch(store, batch, 0, ["x"], lambda df: df)
    assert [r["x"] for r in store.rows().collect()] == [1]
    bad = read_errors(spark, store.root)
    assert sorted(r["x"] for r in bad.collect()) == [2, 3] and "NULL in the key" in bad.first()["error"]
    ingest_batch(store, batch.limit(0), 1, ["x"], lambda df: df)
    assert store.rows().count() == 1


def test_delivered_files_follow_the_shuffle_partitions(spark, sf_small, monkeypatch):
    """R1's source: no file, and so no task, takes a fixed share of the input; the batches stay four."""
    from cadence.plans import q_stream

    seen = {}

    def ingest(spark, source, schema, store, checkpoint, *rest, **named):
        files = len(spark.read.parquet(source).inputFiles())
        seen.update(files=files, batches=ingest_increment(spark, source, schema, store, checkpoint, *rest, **named), per=named["files_per_batch"])
        return seen["batches"]

    monkeypatch.setattr(q_stream, "ingest_increment", ingest)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = q_stream.r1_incremental_ingest(spark, sf_small)
        assert got.count() == got.select("doc_id").distinct().count() == fx.f1_transcripts(spark, sf_small).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen["files"] > 8 and seen["per"] == 6 and 3 <= seen["batches"] <= 4
