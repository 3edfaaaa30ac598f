"""Feature store (S3, S4, S5): keyed Parquet tables partitioned by split, with key-level checks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.operators.keys import same_keys
from cadence.schemas import KEY_COLUMNS, missing_columns


class FeatureStore:
    """Tables under ``root/<name>``; ``split`` becomes a directory level so split filters prune files.

    A write goes to a folder of its own, ``data/<snapshot>``, and becomes visible when a pointer ``versions/<number>`` that
    names it is renamed into place, which file systems do at once. A reader resolves the highest number when it reads: it sees all of
    the old table or all of the new one, also while a write runs, after one was killed, or if two writers race (one of them fails,
    for its number is taken)."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = KEY_COLUMNS):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)

    # -- file system ---------------------------------------------------------------------------------------
    def _hpath(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._hpath(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read_text(self, path) -> str:
        stream = self._fs().open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def versions(self, name: str) -> list[int]:
        """Committed version numbers, oldest first."""
        fs, folder = self._fs(), self._hpath(f"{self.root}/{name}/versions")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def path(self, name: str, version: int | None = None) -> str:
        """Folder of the current (or given) version."""
        have = self.versions(name)
        if not have or (version is not None and version not in have):
            raise FileNotFoundError(f"{self.root}/{name} has no committed version{'' if version is None else f' {version}'}")
        pointer = self._hpath(f"{self.root}/{name}/versions/{have[-1] if version is None else version:012d}")
        return f"{self.root}/{name}/data/{self._read_text(pointer)}"

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def _commit(self, name: str, snapshot: str, number: int) -> None:
        """Point version ``number`` at ``snapshot``; fails if another writer has committed that number."""
        jvm, fs = self.spark.sparkContext._jvm, self._fs()
        draft, final = (self._hpath(f"{self.root}/{name}/{p}") for p in (f"drafts/{snapshot}", f"versions/{number:012d}"))
        fs.mkdirs(final.getParent())
        stream = fs.create(draft, True)
        stream.write(bytearray(snapshot.encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getUri(),
                                                                      self.spark.sparkContext._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, final, how)
        except Exception as e:
            fs.delete(draft, False)
            raise RuntimeError(f"version {number} of {name} was committed by another writer meanwhile") from e

    # -- tables --------------------------------------------------------------------------------------------
    def write(self, df: DataFrame, name: str, partition_by: str | None = "split") -> int:
        """A new version, partitioned by ``split`` when the table has it; returns its number. ``df`` may read the
        current version. Nothing is visible until the whole write has ended."""
        have = self.versions(name)
        number, snapshot = (have[-1] + 1 if have else 0), uuid.uuid4().hex
        w = df.write.mode("errorifexists")
        if partition_by and partition_by in df.columns:
            w = w.partitionBy(partition_by)
        w.parquet(f"{self.root}/{name}/data/{snapshot}")
        self._commit(name, snapshot, number)
        return number

    def expire(self, name: str, keep: int = 1) -> int:
        """Delete all but the last ``keep`` versions and what unfinished writes left; returns the folders deleted.
        Not while a write runs; readers of an expired version fail."""
        fs, have = self._fs(), self.versions(name)
        wanted = {self.path(name, v).rsplit("/", 1)[1] for v in have[-keep:]} if keep > 0 else set()
        gone = 0
        for v in have[:-keep] if keep > 0 else []:
            fs.delete(self._hpath(f"{self.root}/{name}/versions/{v:012d}"), False)
        folder = self._hpath(f"{self.root}/{name}/data")
        for s in fs.listStatus(folder) if keep > 0 and fs.exists(folder) else []:
            if s.getPath().getName() not in wanted:
                gone += bool(fs.delete(s.getPath(), True))
        return gone

    def read(self, name: str, schema=None, version: int | None = None) -> DataFrame:
        """S3: read back the current (or an older) version (partition column ``split`` restored by discovery); with
        ``schema`` (a StructType) the stored columns are validated by name and type."""
        df = self.spark.read.parquet(self.path(name, version))
        if schema is not None:
            bad = missing_columns(df.schema, schema)
            if bad:
                raise ValueError(f"stored table {name!r} lacks or mistypes columns {bad}")
        return df

    def get_or_build(self, name: str, expected: DataFrame, build, partition_by: str | None = "split") -> DataFrame:
        """Cached feature view: reuse the stored table only if its keys equal ``expected`` exactly (same key
        set, one row per key, checked in one pass, U4); otherwise ``build()`` it, commit a new version, and read back.
        All-or-nothing, as the reference's feature modules (a partial match recomputes everything)."""
        if self.exists(name):
            r = same_keys(self.read(name).select(*self.keys), expected.select(*self.keys).distinct(), self.keys).first()
            if r["same"]:
                return self.read(name)
        self.write(build(), name, partition_by)
        return self.read(name)

    def completeness(self, name: str, expected: DataFrame) -> DataFrame:
        """Stored table against expected keys: counts and key differences in one pass (not just a count)."""
        return same_keys(self.read(name).select(*self.keys), expected.select(*self.keys), self.keys)


def embedding_rows(df: DataFrame, keys: Sequence[str], vector_col: str) -> DataFrame:
    """Embeddings are stored with their key, never aligned by position."""
    return df.select(*keys, F.col(vector_col).cast("array<float>").alias("embedding"))
