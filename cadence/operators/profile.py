"""Profiling aggregates (E1-E6, K3): the data behind each plot of the reference, computed on executors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.ordinal import exact_quantiles

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles (linear interpolation), max. NULL/NaN skipped."""
    x = df.select(F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    basic = x.agg(F.count(F.lit(1)).alias("count"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"),
                  F.min("_x").alias("min"), F.max("_x").alias("max"), F.lit(0).alias("_k"))
    q = exact_quantiles(x, [], "_x", QUARTILES).withColumn("_k", F.lit(0))
    return basic.join(q, "_k", "left").select("count", "mean", "std", "min", "q25", "q50", "q75", "max")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max]; the top edge belongs to the last bin (numpy semantics).

    One small aggregate gives the range; the binning is a narrow expression plus a partial aggregate.
    """
    x = df.select(F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    lo, hi = x.agg(F.min("_x"), F.max("_x")).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin bigint, lower double, upper double, count bigint")
    if hi == lo:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col("_x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
    counts = x.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
                         (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"), "count")


MOMENTS, BIN_WIDTH, REACH = 14, 0.25, 8.5  # terms, bin width and reach in bandwidths


def kde_error_bound(h: float) -> float:
    """Bound of the density's error from cutting the expansion after ``MOMENTS`` terms and kernels at ``REACH`` bandwidths.

    With |t| <= w / 2 around a bin's centre the k-th term is t^k / k! He_k(u) exp(-u^2 / 2), at most 1.09 |t|^k / sqrt(k!) (Cramer)."""
    half = BIN_WIDTH / 2
    rest = sum(1.09 * half ** k / math.sqrt(math.factorial(k)) for k in range(MOMENTS, MOMENTS + 40))
    return (rest + math.exp(-REACH * REACH / 2)) / (h * math.sqrt(2 * math.pi))


def kde(df: DataFrame, col: str, grid_size: int = 200, cut: float = 3.0, bandwidth: float | None = None) -> DataFrame:
    """Gaussian KDE on a grid (Scott's factor n^(-1/5) times the sample std unless given), by a binned Gauss transform.

    Values are reduced to bins of a quarter bandwidth with their moments around the bin's centre (one partial aggregate of
    native sums); a bin then adds its Hermite expansion to the grid points within ``REACH`` bandwidths. Work is values plus bins
    times the grid points near a bin, and the error is bounded by :func:`kde_error_bound` (below 1e-16 / bandwidth)."""
    x = df.select(F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    n, sd, lo, hi = x.agg(F.count(F.lit(1)), F.stddev_samp("_x"), F.min("_x"), F.max("_x")).first()
    if not n or sd is None or sd == 0:
        return df.sparkSession.createDataFrame([], "grid_i bigint, x double, density double")
    h = bandwidth if bandwidth is not None else sd * n ** (-1.0 / 5.0)
    g0, g1 = lo - cut * h, hi + cut * h
    step = (g1 - g0) / (grid_size - 1)
    w = BIN_WIDTH * h
    binned = x.select("_x", F.floor((F.col("_x") - F.lit(lo)) / F.lit(w)).alias("_b"))
    binned = binned.withColumn("_t", (F.col("_x") - (F.lit(lo) + (F.col("_b") + 0.5) * F.lit(w))) / F.lit(h))
    powers, term = [], F.lit(1.0)
    for k in range(MOMENTS):                                             # t^k / k!
        powers.append(F.sum(term).alias(f"m{k}"))
        term = term * F.col("_t") / (k + 1)
    bins = binned.groupBy("_b").agg(*powers).withColumn("_c", F.lit(lo) + (F.col("_b") + 0.5) * F.lit(w))
    near = lambda side: F.floor((F.col("_c") + side * REACH * h - g0) / step)
    first, last = F.greatest(near(-1) + 1, F.lit(0)), F.least(near(1), F.lit(grid_size - 1))
    at = bins.where(first <= last).withColumn("grid_i", F.explode(F.sequence(first, last)))
    at = at.withColumn("_u", (F.lit(g0) + F.col("grid_i") * F.lit(step) - F.col("_c")) / F.lit(h))
    # He_k(u) by its recurrence He_{k+1} = u He_k - k He_{k-1}, one column a term so that each is computed once
    at = at.withColumn("_h0", F.lit(1.0)).withColumn("_h1", F.col("_u"))
    for k in range(1, MOMENTS - 1):
        at = at.withColumn(f"_h{k + 1}", F.col("_u") * F.col(f"_h{k}") - k * F.col(f"_h{k - 1}"))
    total = F.exp(-0.5 * F.col("_u") * F.col("_u")) * sum((F.col(f"m{k}") * F.col(f"_h{k}") for k in range(1, MOMENTS)), F.col("m0"))
    sums = at.groupBy("grid_i").agg(F.sum(total).alias("_d"))
    grid = df.sparkSession.range(grid_size).select(F.col("id").alias("grid_i"))
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    return grid.join(sums, "grid_i", "left").select(
        "grid_i", (F.lit(g0) + F.col("grid_i") * F.lit(step)).alias("x"), (F.coalesce("_d", F.lit(0.0)) * F.lit(norm)).alias("density"))


def box_summary(df: DataFrame, col: str, whis: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the most extreme values within whis x IQR, outlier count."""
    x = df.select(F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    q = exact_quantiles(x, [], "_x", {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumn("_k", F.lit(0))
    j = x.withColumn("_k", F.lit(0)).join(F.broadcast(q), "_k")
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - whis * iqr, F.col("q3") + whis * iqr
    return j.groupBy("q1", "median", "q3").agg(
        F.min(F.when(F.col("_x") >= lo_f, F.col("_x"))).alias("whisker_lo"),
        F.max(F.when(F.col("_x") <= hi_f, F.col("_x"))).alias("whisker_hi"),
        F.count_if((F.col("_x") < lo_f) | (F.col("_x") > hi_f)).alias("n_outliers")
    ).withColumn("iqr", F.col("q3") - F.col("q1"))


def split_counts(df: DataFrame, split_col: str = "split") -> DataFrame:
    """E5: rows per split and the table's column count (its shape)."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def scatter_pairs(df: DataFrame, key: str, y: str, pred: str, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """Keyed (true, predicted) pairs; sampled only when a fraction is asked for (plotting)."""
    out = df.select(key, F.col(y).alias("y_true"), F.col(pred).alias("y_pred"))
    return out.sample(fraction=fraction, seed=seed) if fraction else out


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """K3: first n rows by an explicit order (top-k per partition, then a small merge)."""
    return df.orderBy(*order).limit(n)
