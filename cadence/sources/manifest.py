"""Manifests (S1, S2): CSV with a header, explicit schema, file order kept as a dense position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.operators.ordinal import ordinal_within
from cadence.schemas import MANIFEST


def read_manifest(spark: SparkSession, path: str, schema: T.StructType = MANIFEST,
                  with_position: bool = True) -> DataFrame:
    """Header CSV read with a declared schema (no inference pass over the data).

    ``position`` is the row's place in file order (path, byte block, row), dense from 0; it is what the
    prediction sink and the order check (C4) use. Computed with the skew-safe ordinal, not a global window.
    """
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    if not with_position:
        return df
    df = df.select("*", F.col("_metadata.file_path").alias("_fp"), F.col("_metadata.file_block_start").alias("_fb"),
                   F.monotonically_increasing_id().alias("_row"))
    return ordinal_within(df, [], ["_fp", "_fb", "_row"], out="position").drop("_fp", "_fb", "_row")


def union_splits(train: DataFrame, test: DataFrame, split_col: str = "split") -> DataFrame:
    """Tag each manifest with its split; a test manifest without labels gets NULL labels."""
    return (train.withColumn(split_col, F.lit("train"))
            .unionByName(test.withColumn(split_col, F.lit("test")), allowMissingColumns=True))


def write_manifest(df: DataFrame, path: str, order_col: str | None = None) -> None:
    """Write a manifest as header CSV; ``order_col`` keeps a global order across part files."""
    out = df.orderBy(order_col) if order_col else df
    cols = [c for c in out.columns if c != order_col]
    out.select(*cols).write.mode("overwrite").option("header", True).csv(path)
