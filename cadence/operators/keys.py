"""Key and set operators: keep-first dedupe (U1), key unions and checks (U2-U4), pending work (JN2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order`` (explicit; ``dropDuplicates`` picks arbitrarily).

    ``min_by`` is a partial aggregate: a key with a third of the rows is reduced map-side before any
    shuffle, unlike ``row_number() = 1`` over a window, which sorts the whole key in one task.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def expected_keys(train: DataFrame, test: DataFrame, key: str = "filename", split_col: str = "split") -> DataFrame:
    """Union of split-tagged key sets."""
    return (train.select(F.lit("train").alias(split_col), key)
            .union(test.select(F.lit("test").alias(split_col), key)).distinct())


def covers(store: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Does the store hold every expected key? One row: (n_expected, n_missing, covered)."""
    keys = list(keys)
    have = store.select(*keys).distinct().withColumn("_have", F.lit(True))
    j = expected.select(*keys).distinct().join(have, keys, "left")
    out = j.agg(F.count(F.lit(1)).alias("n_expected"), F.count_if(F.col("_have").isNull()).alias("n_missing"))
    return out.withColumn("covered", F.col("n_missing") == 0)


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """U4: exact key-set equality plus equal row counts, from one full outer join of key counts."""
    keys = list(keys)
    ca = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_na"))
    cb = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nb"))
    j = ca.join(cb, keys, "full_outer")
    out = j.agg(
        F.coalesce(F.sum("_na"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("_nb"), F.lit(0)).alias("rows_b"),
        F.count_if(F.col("_nb").isNull()).alias("only_a"), F.count_if(F.col("_na").isNull()).alias("only_b"))
    return out.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.col("rows_a") == F.col("rows_b")))


def pending(manifest: DataFrame, store: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN2: manifest rows whose key is not stored yet."""
    return manifest.join(store.select(*keys).distinct(), list(keys), "left_anti")
