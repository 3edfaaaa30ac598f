"""Operator 7: exact deduplication screened by static binary-fuse filters.

Texts are equal when identical after lower-casing A-Z. Documents arrive in batches; each finished batch is an
immutable snapshot. Work, all on digests (text leaves the scan only for the byte check):

1. Every row gets its SHA-256 (normalised UTF-8) and its batch; rows are grouped by (digest, batch), so a text
   that fills a third of the corpus is one row per batch after the partial aggregate. The table is written.
   Duplicates inside a new batch are already grouped here.
2. Each (snapshot, digest bucket) builds a static 3-wise binary-fuse filter with 16-bit fingerprints (buckets by
   hash of the digest, their number chosen from the counted digests, about half a million per bucket).
3. Digests of later batches are screened against the filters of all earlier snapshots in the same bucket. Only
   positives (members, and one in 65,536 of the rest) join the exact digests of that snapshot.
4. Byte check: for every confirmed pair of batches the two texts themselves are compared; a pair whose bytes
   differ (a SHA-256 collision) is not merged.
5. Batches of a digest linked by confirmed pairs form one group; of these the largest doc_id stays.

Edge cases: NULL text is the empty text; NULL doc_id never stays unless the whole group has no id; rows sharing
the kept doc_id all count as kept (they are the same row); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import mix64, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCHES = 4
DIGESTS_PER_BUCKET = 500_000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


# ---- binary-fuse filter --------------------------------------------------------------------------

def _layout(n: int) -> tuple[int, int]:
    """(segment length, number of segments) of a 3-wise filter for ``n`` keys (sizes of the published design)."""
    n = max(n, 2)
    length = min(1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25)), 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
    return length, max(int(np.ceil(n * factor / length)), 3)


def _slots(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots of each key, in three neighbouring segments, and its 16-bit fingerprint."""
    h = mix64(keys ^ np.uint64(seed))
    first = ((h >> np.uint64(32)) * np.uint64(segments - 2)) >> np.uint64(32)
    low = np.uint64(length - 1)
    slots = np.stack([(first + np.uint64(i)) * np.uint64(length) + ((h >> np.uint64(18 * i)) & low) for i in range(3)])
    return slots.astype(np.int64), (mix64(h) & np.uint64(0xFFFF)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(seed, segment length, segments, fingerprints) holding every one of the distinct uint64 ``keys``.

    Peels in rounds: all slots holding one key give up that key at once; fingerprints are set in reverse.
    """
    keys = np.unique(keys)
    length, segments = _layout(len(keys))
    for attempt in range(200):
        seed = int(mix64(np.array([attempt + 1], dtype=np.uint64))[0])
        slots, prints = _slots(keys, seed, length, segments)
        held = np.zeros(length * segments, np.int64)
        which = np.zeros(length * segments, np.int64)  # xor of the key numbers in a slot
        for s in slots:
            np.add.at(held, s, 1)
            np.bitwise_xor.at(which, s, np.arange(len(keys)))
        rounds, left = [], len(keys)
        while left:
            single = np.flatnonzero(held == 1)
            if not len(single):
                break
            taken, at = np.unique(which[single], return_index=True)
            rounds.append((taken, single[at]))
            for s in slots[:, taken]:
                np.subtract.at(held, s, 1)
                np.bitwise_xor.at(which, s, taken)
            left -= len(taken)
        if left:
            if attempt % 20 == 19:
                segments += max(1, segments // 8)
            continue
        table = np.zeros(length * segments, np.uint16)
        for taken, own in reversed(rounds):
            table[own] = 0
            table[own] = prints[taken] ^ table[slots[0, taken]] ^ table[slots[1, taken]] ^ table[slots[2, taken]]
        return seed, length, segments, table
    raise RuntimeError("no binary-fuse layout found; keys must be distinct")


def in_filter(keys: np.ndarray, seed: int, length: int, segments: int, table: np.ndarray) -> np.ndarray:
    slots, prints = _slots(keys, seed, length, segments)
    return (table[slots[0]] ^ table[slots[1]] ^ table[slots[2]]) == prints


FILTER_SCHEMA = "batch int, bucket int, seed decimal(20,0), length long, segments long, table binary"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    from decimal import Decimal

    seed, length, segments, fingerprints = build_filter(pdf["key"].to_numpy(np.int64).view(np.uint64))
    return pd.DataFrame([[pdf["batch"].iloc[0], pdf["bucket"].iloc[0], Decimal(seed), length, segments, fingerprints.tobytes()]],
                        columns=["batch", "bucket", "seed", "length", "segments", "table"])


def _screen(digests: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    out = []
    keys = digests["key"].to_numpy(np.int64).view(np.uint64)
    batch = digests["batch"].to_numpy(np.int64)
    for f in filters.itertuples(index=False):
        later = np.flatnonzero(batch > f.batch)
        hit = later[in_filter(keys[later], int(f.seed), f.length, f.segments, np.frombuffer(f.table, np.uint16))] if len(later) else later
        out.append(pd.DataFrame({"sha": digests["sha"].to_numpy()[hit], "batch": batch[hit], "snapshot": f.batch}))
    return pd.concat(out) if out else pd.DataFrame({"sha": [], "batch": [], "snapshot": []})


def snapshot_filters(digests: DataFrame) -> DataFrame:
    """One filter row per (batch, bucket) of a table (sha, key, bucket, batch)."""
    return digests.select("batch", "bucket", "key").groupBy("batch", "bucket").applyInPandas(_build, FILTER_SCHEMA)


def positives(digests: DataFrame, filters: DataFrame) -> DataFrame:
    """(sha, batch, snapshot): digests that the filter of an earlier snapshot lets through."""
    return (digests.select("sha", "key", "bucket", "batch").groupBy("bucket").cogroup(filters.groupBy("bucket"))
            .applyInPandas(_screen, "sha string, batch int, snapshot int"))


def arrival(doc_id: Column, batches: int = BATCHES) -> Column:
    """Batch of a document when the table has no arrival column: md5 of its id."""
    return F.pmod(F.conv(F.substring(F.md5(F.encode(F.coalesce(doc_id.cast("string"), F.lit("null")), "UTF-8")), 1, 8), 16, 10).cast("long"),
                  F.lit(batches)).cast("int")


UNDATED = -(2 ** 31)      # rows whose batch is NULL are a batch of their own, the first


def exact_groups(docs: DataFrame, batch: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    batch = arrival(F.col("doc_id")) if batch is None else batch
    rows = docs.select("doc_id", F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256).alias("sha"), F.coalesce(batch.cast("int"), F.lit(UNDATED)).alias("batch"))
    rows = written(rows, "op7-rows")
    per_batch = rows.groupBy("sha", "batch").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
    per_batch = written(per_batch.withColumn("key", F.xxhash64("sha")), "op7-digests")
    buckets = 1 << max(4, (-(-per_batch.count() // DIGESTS_PER_BUCKET) - 1).bit_length())
    digests = per_batch.withColumn("bucket", F.pmod(F.hash("key"), F.lit(buckets)).cast("int"))

    maybe = positives(digests, snapshot_filters(digests))
    earlier = per_batch.select("sha", F.col("batch").alias("snapshot"), F.col("top").alias("old_id"))
    pairs = (maybe.join(earlier, ["sha", "snapshot"])
             .join(per_batch.select("sha", "batch", F.col("top").alias("new_id")), ["sha", "batch"]))
    pairs = written(pairs, "op7-pairs")

    # one text per (digest, batch) that is in a pair, by id and digest (an id may have several texts); ids without a
    # row (NULL) are checked by their digest alone; the merge hint keeps one join strategy at every size
    ids = pairs.select(F.col("old_id").alias("doc_id"), "sha").union(pairs.select("new_id", "sha")).distinct()
    bytes_of = docs.select("doc_id", normalised(F.col("text")).alias("bytes"))
    texts = written(bytes_of.withColumn("sha", F.sha2(F.encode("bytes", "UTF-8"), 256)).join(ids.hint("merge"), ["doc_id", "sha"], "left_semi")
                    .dropDuplicates(["doc_id", "sha"]), "op7-texts")
    checked = (pairs.join(texts.select(F.col("doc_id").alias("old_id"), "sha", F.col("bytes").alias("old")), ["old_id", "sha"], "left")
               .join(texts.select(F.col("doc_id").alias("new_id"), "sha", F.col("bytes").alias("new")), ["new_id", "sha"], "left"))
    linked = checked.where(F.col("old").isNull() | F.col("new").isNull() | (F.col("old") == F.col("new")))
    # equality is transitive: a batch's group is the smallest snapshot it equals, or itself
    root = linked.groupBy("sha", "batch").agg(F.min("snapshot").alias("root"))
    member = (per_batch.join(root, ["sha", "batch"], "left")
              .select("sha", "batch", "n", "top", F.coalesce("root", "batch").alias("root")))
    member = written(member, "op7-members")
    group = member.groupBy("sha", "root").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    verdict = member.where("batch is not null").join(group, ["sha", "root"]).select("sha", "batch", "keep_id", "group_size")
    out = rows.join(verdict, ["sha", "batch"])
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
