"""Distributed Gram matrices (sum of w w^T) per group, from Arrow batches.

Each task accumulates one d x d matrix per group with numpy, emits it in fixed-size blocks, and blocks
are summed per (group, block). The result's size is groups x d^2 and does not grow with the rows, so it
is the one thing collected to the driver. ``max_tasks`` caps the number of partial matrices shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
SINGLE_LEVEL_TASKS = 64  # up to this many partial arrays per key are summed in one step


def _vector_sum(c):
    return F.aggregate(c, F.array_repeat(F.lit(0.0), F.size(F.element_at(c, 1))),
                       lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))


def tree_sum_arrays(parts: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Element-wise sums of per-task partial arrays per key, in two levels: partials are first summed in
    buckets of the producing task id, then the bucket sums are summed. A reducer holds at most about
    sqrt(tasks) arrays per key instead of one array per task."""
    import math

    keys, values = list(keys), list(values)
    tasks = max(1, parts.rdd.getNumPartitions())
    if tasks <= SINGLE_LEVEL_TASKS:
        return parts.groupBy(*keys).agg(*[F.collect_list(v).alias(v) for v in values]) \
            .select(*keys, *[_vector_sum(F.col(v)).alias(v) for v in values])
    buckets = max(1, int(math.ceil(math.sqrt(tasks))))
    tagged = parts.withColumn("_bucket", F.spark_partition_id() % buckets)
    first = tagged.groupBy(*keys, "_bucket").agg(*[F.collect_list(v).alias(v) for v in values]) \
        .select(*keys, *[_vector_sum(F.col(v)).alias(v) for v in values])
    return first.groupBy(*keys).agg(*[F.collect_list(v).alias(v) for v in values]) \
        .select(*keys, *[_vector_sum(F.col(v)).alias(v) for v in values])


def sum_vectors(parts: DataFrame, group_cols: Sequence[str]) -> dict[tuple, np.ndarray]:
    """Sum per-task partial vectors emitted as (groups..., _block, _v) rows and collect one vector per group."""
    g = list(group_cols)
    out: dict[tuple, dict] = {}
    for r in tree_sum_arrays(parts, [*g, "_block"], ["_v"]).collect():
        out.setdefault(tuple(r[c] for c in g), {})[r["_block"]] = r["_v"]
    return {k: np.array([x for i in sorted(v) for x in v[i]]) for k, v in out.items()}


def grouped_gram(df: DataFrame, group_cols: Sequence[str], w_col: str, dim: int,
                 max_tasks: int | None = None) -> dict[tuple, np.ndarray]:
    """Gram matrix of ``w`` per group of whole-number columns; every row is read and multiplied once."""
    g = list(group_cols)
    src = df.select(*g, F.col(w_col).alias("_w"))
    if max_tasks and src.rdd.getNumPartitions() > max_tasks:
        src = src.coalesce(max_tasks)
    nblocks = (dim * dim + BLOCK - 1) // BLOCK

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple, np.ndarray] = {}
        for b in batches:
            w = b.column("_w").flatten().to_numpy().reshape(-1, dim)
            keys = np.stack([b.column(c).to_numpy() for c in g], axis=1) if g else np.zeros((len(b), 0), np.int64)
            own, which = np.unique(keys, axis=0, return_inverse=True) if g and len(b) else (keys[:1], np.zeros(len(b), np.int64))
            order = np.argsort(which, kind="stable")
            for key, part in zip(own.tolist(), np.split(w[order], np.cumsum(np.bincount(which, minlength=len(own)))[:-1])):
                m = acc.get(tuple(key))
                acc[tuple(key)] = part.T @ part if m is None else m + part.T @ part
        rows = [(*key, i, m.reshape(-1)[i * BLOCK:(i + 1) * BLOCK]) for key, m in acc.items() for i in range(nblocks)]
        yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], pa.int64()) for i in range(len(g))], pa.array([r[-2] for r in rows], pa.int32()),
                                          pa.array([r[-1] for r in rows], pa.list_(pa.float64()))], [*g, "_block", "_v"])

    schema = ", ".join([f"{c} long" for c in g] + ["_block int", "_v array<double>"])
    return {k: v.reshape(dim, dim) for k, v in sum_vectors(src.mapInArrow(partial, schema), g).items()}
