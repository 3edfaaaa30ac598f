"""Repeated stratified folds and in-fold preprocessing statistics.

The fold is a column, never a loop over filtered copies: every (repeat, fold) statistic comes out of
one grouped aggregate, and a fold's training statistic is "all rows minus the fold's own rows" for
additive quantities. The full-data refit (V15) is the extra fold ``(repeat=-1, fold=-1)`` trained on
every row. Medians are not additive, but the counts that select them are (see :mod:`cadence.operators.selection`),
so they too come from passes over the rows as they are, without a copy per fold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions.text import round_even
from cadence.operators.ordinal import ordinal_within
from cadence.operators.selection import radix_medians

FULL = -1  # repeat and fold id of the all-rows refit


def fold_hash(seed: int, key: str) -> F.Column:
    """Shuffle order inside a stratum: md5 of 'seed:repeat:key' (same function in Spark and DuckDB)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("repeat").cast("string"), F.lit(":"), F.col(key).cast("string")))


def assign_folds(df: DataFrame, key: str, label: str, k: int = 5, repeats: int = 2, seed: int = 42) -> DataFrame:
    """V1: (key, repeat, fold). Strata are round-half-even labels; inside each repeat rows are ordered by
    (stratum, hash, key) and dealt round-robin, so every stratum spreads evenly and fold sizes differ by
    at most one. The ordinal is the skew-safe one: a stratum holding most rows spans many tasks."""
    base = df.select(key, round_even(F.col(label)).alias("stratum"),
                     F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    base = base.withColumn("_h", fold_hash(seed, key))
    ranked = ordinal_within(base, ["repeat"], ["stratum", "_h", key], out="_ord")
    return ranked.select(key, F.col("repeat").cast("int").alias("repeat"),
                         (F.col("_ord") % k).cast("int").alias("fold"), "stratum")


def fold_sizes(folds: DataFrame, k: int) -> DataFrame:
    """V2: validation and training row counts per (repeat, fold); training = repeat total - own fold."""
    own = folds.groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("n_val"))
    tot = folds.groupBy("repeat").agg(F.count(F.lit(1)).alias("_n"))
    return own.join(tot, "repeat").select("repeat", "fold", "n_val", (F.col("_n") - F.col("n_val")).alias("n_train"))


def fold_view(df: DataFrame, folds: DataFrame, key: str, repeat: int, fold: int) -> tuple[DataFrame, DataFrame]:
    """V2: (training rows, validation rows) of one fold, as filters on the fold column (no copies)."""
    f = folds.where(F.col("repeat") == repeat).select(key, "fold")
    j = df.join(f, key)
    return j.where(F.col("fold") != fold).drop("fold"), j.where(F.col("fold") == fold).drop("fold")


def train_membership(folds: DataFrame, key: str, k: int, include_full: bool = True) -> DataFrame:
    """(key, repeat, fold) for every fold a row *trains*: the k-1 other folds of each repeat, plus FULL."""
    others = folds.select(key, "repeat", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)),
                                                             lambda f: f != F.col("fold"))).alias("fold"))
    if include_full:
        full = folds.select(key).distinct().select(key, F.lit(FULL).alias("repeat"), F.lit(FULL).alias("fold"))
        others = others.unionByName(full)
    return others


def fold_vectors(folds: DataFrame, key: str, repeats: int) -> DataFrame:
    """(key, folds): the fold of every repeat as one array, so that a row is carried once however many folds it trains."""
    return folds.groupBy(key).agg(F.array(*[F.max(F.when(F.col("repeat") == r, F.col("fold"))) for r in range(repeats)]).alias("folds"))


def fold_medians(df: DataFrame, folds: DataFrame, key: str, features: Sequence[str], k: int,
                 include_full: bool = True, repeats: int | None = None) -> DataFrame:
    """V4 fit: exact median of each feature over each fold's training rows -> (repeat, fold, feature, median).

    A feature with no value in a fold's training rows has no row (the reference drops an all-null column)."""
    repeats = folds.agg(F.max("repeat")).first()[0] + 1 if repeats is None else repeats
    rows = df.select(key, *features).join(fold_vectors(folds, key, repeats), key).drop(key).persist()
    try:
        found = training_medians(rows, features, k, repeats, include_full)
    finally:
        rows.unpersist()
    out = [(r, f, c, v) for (r, f, c), v in sorted(found.items())]       # folds x features values
    return df.sparkSession.createDataFrame(out, "repeat int, fold int, feature string, median double")


def training_medians(rows: DataFrame, features: Sequence[str], k: int, repeats: int, include_full: bool = True) -> dict[tuple[int, int, str], float]:
    """Exact training medians of (folds, features...) rows, each row read once a pass: (repeat, fold, feature) -> median.

    Training ranks are additive: a count over the training rows is the count over all rows minus the fold's own."""
    targets = [(r, f) for r in range(repeats) for f in range(k)] + ([(FULL, FULL)] if include_full else [])

    def of(counts: np.ndarray, target: tuple[int, int]) -> np.ndarray:
        total = counts[:k].sum(axis=0)                                   # the first repeat's folds hold every row once
        return total if target[0] == FULL else total - counts[target[0] * k + target[1]]

    return {(*t, c): v for (t, c), v in radix_medians(rows, features, repeats * k, targets, of,
                                                      [F.col("folds")[r] + r * k for r in range(repeats)]).items()}


def impute(df: DataFrame, features: Sequence[str], medians: dict[str, float]) -> DataFrame:
    """V4 apply: NULL/NaN -> the fold's median."""
    return df.select(*[c for c in df.columns if c not in features],
                     *[F.when(F.col(c).isNull() | F.isnan(F.col(c)), F.lit(medians.get(c))).otherwise(F.col(c).cast("double")).alias(c)
                       for c in features])


def standardize(df: DataFrame, features: Sequence[str], means: dict[str, float], stds: dict[str, float]) -> DataFrame:
    """V5 apply: (x - mean) / std with a zero std replaced by 1."""
    return df.select(*[c for c in df.columns if c not in features],
                     *[((F.col(c) - F.lit(means[c])) / F.lit(stds[c] if stds[c] > 0 else 1.0)).alias(c) for c in features])
