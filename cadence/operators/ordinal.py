"""Skew-safe ordinals, ranks and exact quantiles.

A window ``PARTITION BY g ORDER BY o`` sends a whole group to one task. Here rows are range-partitioned
on ``(g, o)`` instead, so a group holding a third of the rows spans many tasks; per-task counts then give
each task's offset inside its group. The ranged data is checkpointed once (reliable checkpoint in
``spark.checkpoint.dir``) so that partition ids and row positions are stable for every later read and
survive executor loss.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators.joins import broadcast_if_small, null_safe_join
from cadence.session import ensure_checkpoint_dir, shuffle_partitions


def _ranged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    n = shuffle_partitions(df.sparkSession)
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    return ranged.checkpoint(eager=True)


def ordinal_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], out: str = "ord",
                   carry_first: Sequence[str] = (), keep_pid: bool = False) -> DataFrame:
    """0-based position of each row inside its group, ordered by ``order_cols`` (ascending, NULLs first).

    ``order_cols`` should make rows unique inside a group. ``carry_first`` columns are copied from the
    group's first row onto every row as ``first_<name>`` (the group minimum of the order, for free).
    """
    g, o = list(group_cols), list(order_cols)
    ranged = _ranged(df, g + o)
    aggs = [F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0")]
    aggs += [F.min_by(c, "_mid").alias(f"_f_{c}") for c in carry_first]
    part = ranged.groupBy("_pid", *g).agg(*aggs)
    w = (Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))).orderBy("_pid")
    part = part.withColumn("_before", F.coalesce(
        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    for c in carry_first:
        part = part.withColumn(f"first_{c}", F.first(f"_f_{c}").over(
            w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    part = part.select("_pid", *g, "_before", "_m0", *[f"first_{c}" for c in carry_first])
    joined = null_safe_join(ranged, broadcast_if_small(part), ["_pid", *g])
    joined = joined.withColumn(out, (F.col("_before") + F.col("_mid") - F.col("_m0")).cast("bigint"))
    drop = ["_before", "_m0", "_mid"] + ([] if keep_pid else ["_pid"])
    return joined.drop(*drop)


def value_positions(df: DataFrame, group_cols: Sequence[str], value_col: str) -> DataFrame:
    """(group, value, _c, _start): how often each distinct value occurs in its group and the 0-based position of
    its first occurrence in value order.

    Rows are counted per (group, value) before anything is ordered (a partial aggregate), so a value that holds most of the
    rows is one row. The distinct values are range-partitioned; running sums inside a range partition and the
    partitions' totals (groups x partitions rows) give the positions.
    """
    g = list(group_cols)
    counts = df.groupBy(*g, value_col).agg(F.count(F.lit(1)).alias("_c"))
    ranged = _ranged(counts, [*g, value_col])
    part = ranged.groupBy("_pid", *g).agg(F.sum("_c").alias("_n"))
    before = (Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("_pid", *g, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_pid", *g).orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = null_safe_join(ranged.withColumn("_upto", F.sum("_c").over(inside)), part, ["_pid", *g])
    return rows.select(*g, value_col, "_c", (F.col("_before") + F.col("_upto") - F.col("_c")).alias("_start"))


def average_rank(df: DataFrame, value_col: str, tiebreak_cols: Sequence[str], out: str) -> DataFrame:
    """1-based rank of ``value_col`` over all rows, ties sharing their average rank (NULL values excluded).

    Ranks belong to distinct values and join back to the rows; a value that holds most rows is a hot key against
    a one-row side, which adaptive execution splits. ``tiebreak_cols`` are not needed and kept for callers.
    """
    vals = df.where(F.col(value_col).isNotNull())
    ranks = value_positions(vals, [], value_col).select(value_col, (F.col("_start") + (F.col("_c") + 1) / 2.0).alias(out))
    return vals.join(ranks, value_col)


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                    probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation (the numpy / pandas default), one row per group.

    NULL and NaN values are skipped; a group with no values is absent, so callers left-join onto their spine.
    Every distinct value knows which positions it covers, so the two values around a quantile's position are a
    filter and two conditional aggregates.
    """
    g = list(group_cols)
    if not g:
        return exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value_col, probs).drop("_all")
    vals = df.where(F.col(value_col).isNotNull() & ~F.isnan(F.col(value_col))).select(*g, value_col)
    placed = value_positions(vals, g, value_col)
    sizes = placed.groupBy(*g).agg(F.sum("_c").alias("_n"))
    rows = null_safe_join(placed, sizes, g)
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        covers = lambda at: (F.col("_start") <= at) & (at < F.col("_start") + F.col("_c"))
        lo = F.max(F.when(covers(F.floor(pos)), F.col(value_col)))
        hi = F.max(F.when(covers(F.ceil(pos)), F.col(value_col)))
        share = F.max(pos - F.floor(pos))
        aggs.append((lo + share * (hi - lo)).alias(name))
    return rows.groupBy(*g).agg(*aggs)
