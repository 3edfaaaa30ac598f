"""Media inventory (S6): manifest keys joined to files found under a root; content is never read.

Folders are listed by tasks, level by level: the driver only knows the root, a round lists all folders that the last one
found, spread over the executors, and files never pass through the driver as a table of statuses.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.session import scratch_path, shuffle_partitions

# root/<split>/<filename>  (the reference's layout) or root/split=<s>/filename=<f>/<part file>
LAYOUTS = {
    "plain": r"/([^/]+)/([^/]+)$",
    "hive": r"/split=([^/]+)/filename=([^/]+)/[^/]+$",
}
MOST_DEPTH = 64
_FOUND = "path string, length long, folder boolean"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the session's file systems resolve it."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hpath).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def _list(root: str):
    """Paths relative to the file system of ``root`` to their direct children; hidden names (_ or .) are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = [i for i in store.get_file_info(pafs.FileSelector(folder)) if not i.base_name.startswith(("_", "."))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.path for i in found], pa.string()), pa.array([i.size if i.type == pafs.FileType.File else None for i in found], pa.int64()),
                     pa.array([i.type == pafs.FileType.Directory for i in found], pa.bool_())], ["path", "length", "folder"])
    return run


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file under ``root``, however deep; the listing is written once to the scratch folder."""
    root = qualified(spark, root)
    store, top = pafs.FileSystem.from_uri(root)
    if store.get_file_info(top).type != pafs.FileType.Directory:
        raise FileNotFoundError(root)
    scratch = scratch_path(spark, "listing")
    folders = spark.createDataFrame([(top,)], "path string")
    for depth in range(MOST_DEPTH):
        level = f"{scratch}/depth={depth}"
        folders.repartition(max(1, shuffle_partitions(spark)), "path").mapInArrow(_list(root), _FOUND).write.partitionBy("folder").parquet(level)
        found = spark.read.schema(_FOUND).parquet(level)
        if found.where("folder").isEmpty():
            break
        folders = found.where("folder").select("path")
    else:
        raise RuntimeError(f"more than {MOST_DEPTH} levels of folders under {root}")
    return spark.read.schema(f"{_FOUND}, depth int").parquet(scratch).where("NOT folder").select("path", "length")


def list_media(spark: SparkSession, root: str, layout: str = "plain") -> DataFrame:
    """(split, filename, path, length) of every file under ``root``."""
    rx = LAYOUTS[layout]
    return list_files(spark, root).select(
        F.regexp_extract("path", rx, 1).alias("split"), F.regexp_extract("path", rx, 2).alias("filename"),
        "path", "length")


def media_inventory(manifest: DataFrame, media: DataFrame, keys: Sequence[str] = ("split", "filename")) -> DataFrame:
    """Manifest left-joined to files; ``missing`` flags keys with no file, ``bytes`` sums multi-part files."""
    per_key = media.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))
    j = manifest.join(per_key, list(keys), "left")
    return j.withColumn("missing", F.col("n_files").isNull()).fillna({"n_files": 0, "bytes": 0})
