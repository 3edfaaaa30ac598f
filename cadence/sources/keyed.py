"""A keyed append store: rows in buckets of their key's hash, beside every bucket filters of the keys that it holds.

Layout under ``root``: ``data/bucket=K/batch=B`` the rows of batch B; ``filters/level=L/bucket=K/batch=B`` one Bloom filter
of the keys that batches B - 8^L + 1 to B put into the bucket (level 0: batch B alone); ``errors/batch=B`` rows that cannot be keyed; ``layout`` the number of
buckets and the keys, written once. Batches before b are covered by at most 7 filters a level (the digits of b in base 8), so the filters
read grow with the logarithm of the number of batches; a filter of a higher level is built from the keys of its own eight ranges.

A lookup asks the filters of the buckets that the asked keys fall in, and reads stored keys of those buckets only in which some key may be stored; the
answer is exact, since what the filters let through is compared with the stored keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
FAN_IN = 8
BITS_PER_KEY, PROBES = 24, 12        # about one key in 100,000 passes a filter that does not hold it
LEAST_BITS = 1024
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(keys, PROBES) bit positions of 64-bit key hashes: one well-mixed number per probe."""
    h = hashes.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, PROBES + 1, dtype=np.uint64)[None, :] * _STEP
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) % np.uint64(bits)).astype(np.int64)


def build_filter(hashes: np.ndarray) -> bytes:
    """Bloom filter of the given key hashes."""
    bits = max(LEAST_BITS, 8 * -(-len(hashes) * BITS_PER_KEY // 8))
    field = np.zeros(bits, bool)
    field[_positions(hashes, bits).reshape(-1)] = True
    return np.packbits(field).tobytes()


def may_hold(blob: bytes, hashes: np.ndarray) -> np.ndarray:
    """False for keys that are surely not in the filter."""
    raw = np.frombuffer(blob, np.uint8)
    at = _positions(hashes, 8 * len(raw))
    return ((raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def covering(batch: int) -> list[tuple[int, int]]:
    """(level, last batch) of the filters that cover the batches 0 to ``batch`` - 1, each batch once."""
    out, end, level = [], 0, 0
    while FAN_IN ** (level + 1) <= batch:
        level += 1
    for lv in range(level, -1, -1):
        size = FAN_IN ** lv
        while end + size <= batch:
            end += size
            out.append((lv, end - 1))
    return out


@dataclass(frozen=True)
class KeyedStore:
    spark: SparkSession
    root: str
    keys: tuple[str, ...]
    buckets: int

    # -- layout -------------------------------------------------------------------------------------------
    @classmethod
    def open(cls, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = BUCKETS) -> KeyedStore:
        """The store under ``root``; a stored layout wins over ``buckets`` and must have the same keys."""
        root, keys = root.rstrip("/"), list(keys)
        if not _exists(spark, f"{root}/layout/_SUCCESS"):
            spark.createDataFrame([(buckets, keys)], "buckets int, keys array<string>").coalesce(1).write.mode("overwrite").json(f"{root}/layout")
        row = spark.read.schema("buckets int, keys array<string>").json(f"{root}/layout").first()
        if list(row["keys"]) != keys:
            raise ValueError(f"the store under {root} has the keys {list(row['keys'])}, not {keys}")
        return cls(spark, root, tuple(keys), row["buckets"])

    def hash(self) -> Column:
        return F.xxhash64(*[F.col(k) for k in self.keys])

    def bucket(self) -> Column:
        return F.pmod(self.hash(), F.lit(self.buckets)).cast("int")

    def _under(self, folder: str, buckets: Sequence[int]) -> list[str]:
        """The existing folders of the given buckets: other buckets are not even listed."""
        return [p for p in (f"{folder}/bucket={b}" for b in sorted(buckets)) if _exists(self.spark, p)]

    # -- reading ------------------------------------------------------------------------------------------
    def rows(self) -> DataFrame:
        """All rows with ``bucket`` and ``batch``."""
        return self.spark.read.option("basePath", f"{self.root}/data").parquet(f"{self.root}/data")

    def stored_keys(self, buckets: Sequence[int], before: int, since: int = 0) -> DataFrame | None:
        """Keys of batches ``since`` to ``before`` - 1 in the given buckets; None if no such bucket exists."""
        paths = self._under(f"{self.root}/data", buckets)
        if not paths:
            return None
        reader = self.spark.read.option("basePath", f"{self.root}/data")
        return reader.parquet(*paths).where((F.col("batch") < before) & (F.col("batch") >= since)).select(*self.keys, "bucket")

    def filters(self, buckets: Sequence[int], before: int) -> DataFrame | None:
        """(bucket, blob) of the filters that cover the batches before ``before`` in the given buckets."""
        out = None
        by: dict[int, list[int]] = {}
        for level, last in covering(before):
            by.setdefault(level, []).append(last)
        for level, lasts in by.items():
            base = f"{self.root}/filters/level={level}"
            paths = self._under(base, buckets)
            if paths:
                df = self.spark.read.schema("n long, blob binary, bucket int, batch long").option("basePath", base).parquet(*paths)
                df = df.where(F.col("batch").isin(lasts)).select("bucket", "blob")
                out = df if out is None else out.unionByName(df)
        return out

    def already_stored(self, keyed: DataFrame, before: int) -> tuple[DataFrame | None, list[int]]:
        """(those keys of ``keyed`` that batches before ``before`` hold, buckets whose stored keys were read)."""
        asked = [r[0] for r in keyed.select(self.bucket().alias("b")).distinct().collect()]      # at most ``buckets``
        filters = self.filters(asked, before) if asked else None
        if filters is None:
            return None, []
        probes = keyed.select(*self.keys, self.bucket().alias("bucket"), self.hash().alias("_hash"))
        schema = T.StructType([*[keyed.schema[k] for k in self.keys], T.StructField("bucket", T.IntegerType())])
        names = [*self.keys, "bucket"]

        def test(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if own.empty or held.empty:
                return own[names].iloc[:0]
            hashes = own["_hash"].to_numpy()
            hit = np.zeros(len(own), bool)
            for blob in held["blob"]:
                hit |= may_hold(blob, hashes)
            return own.loc[hit, names]

        maybe = probes.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(test, schema).persist()
        read = sorted(r[0] for r in maybe.select("bucket").distinct().collect())
        stored = self.stored_keys(read, before) if read else None
        if stored is None:
            return None, read
        return maybe.select(*self.keys).join(stored.select(*self.keys), list(self.keys), "left_semi"), read

    # -- writing ------------------------------------------------------------------------------------------
    def write_batch(self, rows: DataFrame, batch: int) -> None:
        """Rows of one batch into their buckets, then their filters; a repeated call rewrites the same folders."""
        placed = rows.withColumn("bucket", self.bucket()).withColumn("batch", F.lit(batch).cast("long"))
        (placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket", "batch").parquet(f"{self.root}/data"))
        level, size = 0, 1
        while (batch + 1) % size == 0:
            self._write_filters(level, batch, batch + 1 - size)
            level, size = level + 1, size * FAN_IN

    def _write_filters(self, level: int, batch: int, since: int) -> None:
        keys = self.stored_keys(range(self.buckets), batch + 1, since)
        if keys is None:
            return
        hashed = keys.select("bucket", self.hash().alias("h"))

        def build(own: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"n": [len(own)], "blob": [build_filter(own["h"].to_numpy())], "bucket": [int(own["bucket"].iloc[0])]})

        filters = hashed.groupBy("bucket").applyInPandas(build, "n long, blob binary, bucket int").withColumn("batch", F.lit(batch).cast("long"))
        (filters.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch")
         .parquet(f"{self.root}/filters/level={level}"))


def _exists(spark: SparkSession, path: str) -> bool:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)
