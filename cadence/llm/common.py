"""Shared helpers of the ``llm`` operators: scratch tables, packed rows, vectorised UTF-8 word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.session import ensure_checkpoint_dir, scratch_path, ship_package


def prepare(spark: SparkSession) -> None:
    """Shared folder for written tables, package on the executors."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``row`` beside the given key columns, so that an operator's own
    column names never clash with the caller's."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *[c.alias(n) for n, c in keys.items()])


def md5_unit(text: Column) -> Column:
    """Uniform double in (0, 1) from the first 52 bits of md5, the same in every engine."""
    bits = F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2 ** 52)


# ---- numpy on Arrow batches -------------------------------------------------------------------------

CHUNK_BYTES = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW: dict[str, np.ndarray] = {}


def utf8_chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) for runs of rows of about ``chunk_bytes``; offsets start at 0.

    NULL texts count as empty. A row longer than the chunk is a chunk of its own.
    """
    arr = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if n == 0:
        return
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + n + 1]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + chunk_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi - lo, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inv = np.uint64(pow(int(_BASE), -1, 2 ** 64))
        p = np.full(size, _BASE, dtype=np.uint64)
        q = np.full(size, inv, dtype=np.uint64)
        p[0] = q[0] = 1
        _POW["p"], _POW["q"] = np.cumprod(p), np.cumprod(q)
    return _POW["p"], _POW["q"]


def is_space(data: np.ndarray) -> np.ndarray:
    """White space of the word rule: 0x20 and 0x09 to 0x0D."""
    return (data == 32) | ((data - np.uint8(9)) <= 4)


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without white space, never crossing rows): 64-bit hashes, byte starts, byte ends, and the
    first word index of each row (length rows + 1)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offs), np.int64)
    solid = ~is_space(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    np.logical_not(solid[:-1], out=before[1:])
    before |= edge[:n]
    start = np.flatnonzero(solid & before)
    after = np.empty(n, dtype=bool)
    after[-1] = True
    np.logical_not(solid[1:], out=after[:-1])
    after |= edge[1:]
    end = np.flatnonzero(solid & after) + 1
    p, q = _powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    h = mix64((total[end] - total[start]) * q[start])
    return h, start, end, np.searchsorted(start, offs)
