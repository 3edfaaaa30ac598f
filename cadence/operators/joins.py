"""Join building blocks: size-checked broadcast and null-safe keys (JN1-JN4 build on these)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.session import BROADCAST_ROW_LIMIT


def row_count_at_most(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows (a count per task, summed; no rows are gathered)."""
    return df.count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast hint only behind a measured bound; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if row_count_at_most(df, limit) else df


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join treating NULL keys as equal; keeps the left copy of each key column."""
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"__r_{k}")
    cond: Column | None = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys])
