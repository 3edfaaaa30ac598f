"""Exact medians of many columns and many overlapping groups by counting: no row is copied or shuffled by value.

A double is read as a 64-bit number of the same order. Each pass counts, per column, group and interval still in
question, how many values fall into each of the interval's 1,024 parts; the part that holds the wanted rank is the next
interval (ten bits longer). Tasks send sums of fixed-size count arrays, so what is shuffled depends on columns, groups and tasks, not on
the rows. An interval left with few rows is finished by one pass that returns its values with their counts. At most
seven counting passes are ever needed; a value that holds most rows ends as an interval of that one value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.operators.gram import tree_sum_arrays

STEP = 10                       # bits per pass
FEW = 512                       # an interval of at most so many rows is finished from its values
_TOP = np.uint64(1 << 63)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order (-0.0 counts as 0.0)."""
    u = (x + 0.0).view(np.uint64)
    return np.where(u & _TOP, ~u, u | _TOP)


def from_ordered(u: int) -> float:
    v = u ^ (1 << 63) if u >> 63 else u ^ ((1 << 64) - 1)
    return float(np.array([v], np.uint64).view(np.float64)[0])


def _values(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, ordered bits) of a column's values that are neither NULL nor NaN."""
    column = batch.column(i)
    x = column.to_numpy(zero_copy_only=False).astype(np.float64)
    ok = ~np.isnan(x)
    return np.flatnonzero(ok), ordered_bits(x[ok])


def radix_medians(rows: DataFrame, columns: Sequence[str], groups: int, targets: Sequence, of: Callable, memberships: Sequence[Column]) -> dict:
    """(target, column) -> exact median (mean of the two middle values) of the column's values in the target's rows.

    ``memberships`` are the group numbers (0 to ``groups`` - 1) that a row counts in; ``of(counts, target)`` combines
    per-group counts (first axis) into the target's. Targets without a value are absent."""
    columns = list(columns)
    if not columns:
        return {}
    data = rows.select(F.array(*memberships).cast("array<int>").alias("_g"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    # per column: (bits fixed, leading bits) -> {(target, which of the two middle values): rank inside}
    open_: dict[int, dict[tuple[int, int], dict]] = {i: {(0, 0): {}} for i in range(len(columns))}
    small: dict[int, dict[tuple[int, int], dict]] = {i: {} for i in range(len(columns))}
    found: dict = {}
    first = True
    while any(open_.values()):
        counts = _count(data, {i: list(v) for i, v in open_.items() if v}, groups)
        after: dict[int, dict] = {i: {} for i in open_}
        for i, intervals in open_.items():
            for (bits, lead), wanted in intervals.items():
                cell = counts.get((i, bits, lead))
                if cell is None:
                    continue
                width = min(STEP, 64 - bits)
                if first:
                    for t in targets:
                        n = int(of(cell, t).sum())
                        if n:
                            wanted[t, 0], wanted[t, 1] = (n - 1) // 2, n // 2
                own = {t: np.cumsum(of(cell, t)) for t in {t for t, _ in wanted}}
                total = cell.sum(axis=0)
                for (t, side), rank in wanted.items():
                    part = int(np.searchsorted(own[t], rank, side="right"))
                    inside = (bits + width, (lead << width) | part)
                    left = rank - (int(own[t][part - 1]) if part else 0)
                    if inside[0] == 64:
                        found[t, i, side] = from_ordered(inside[1])
                    else:
                        (small if total[part] <= FEW else after)[i].setdefault(inside, {})[t, side] = left
        open_, first = after, False
    if any(small.values()):
        values = _collect(data, {i: list(v) for i, v in small.items() if v}, groups)
        for i, intervals in small.items():
            for at, wanted in intervals.items():
                keys, cell = values[(i, *at)]
                for (t, side), rank in wanted.items():
                    found[t, i, side] = from_ordered(int(keys[np.searchsorted(np.cumsum(of(cell, t)), rank, side="right")]))
    return {(t, columns[i]): found[t, i, 0] + (found[t, i, 1] - found[t, i, 0]) / 2 for t, i, side in found if side == 0}


def _placed(u: np.ndarray, bits: int, leads: np.ndarray) -> np.ndarray:
    """Number of the interval (of sorted leading bits) that each value falls into, -1 for none."""
    p = u >> np.uint64(64 - bits) if bits else np.zeros(len(u), np.uint64)
    at = np.minimum(np.searchsorted(leads, p), len(leads) - 1)
    return np.where(leads[at] == p, at, -1)


def _by_bits(intervals: list[tuple[int, int]]) -> dict[int, np.ndarray]:
    out: dict[int, list[int]] = {}
    for bits, lead in intervals:
        out.setdefault(bits, []).append(lead)
    return {bits: np.array(sorted(leads), np.uint64) for bits, leads in out.items()}


def _count(data: DataFrame, wanted: dict[int, list[tuple[int, int]]], groups: int) -> dict[tuple[int, int, int], np.ndarray]:
    """(column, bits, lead) -> counts (groups x parts)."""
    plan = {i: _by_bits(v) for i, v in wanted.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = {(i, bits): np.zeros((len(leads), groups, 1 << min(STEP, 64 - bits)), np.int64) for i, by in plan.items() for bits, leads in by.items()}
        for batch in batches:
            member = batch.column("_g").flatten().to_numpy().reshape(len(batch), -1)
            for i, by in plan.items():
                row, u = _values(batch, i + 1)
                for bits, leads in by.items():
                    width = min(STEP, 64 - bits)
                    at = _placed(u, bits, leads)
                    hit = at >= 0
                    part = ((u[hit] >> np.uint64(64 - bits - width)) & np.uint64((1 << width) - 1)).astype(np.int64)
                    a = acc[i, bits]
                    for m in member.T:
                        flat = (at[hit] * groups + m[row[hit]]) * (1 << width) + part
                        a += np.bincount(flat, minlength=a.size).reshape(a.shape)
        out = [(i, bits, int(lead) - (1 << 63), g, a[n, g]) for (i, bits), a in acc.items() for n, lead in enumerate(plan[i][bits]) for g in range(groups) if a[n, g].any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int64()),
                                          pa.array([r[3] for r in out], pa.int32()), pa.array([r[4].astype(np.float64) for r in out], pa.list_(pa.float64()))], ["col", "bits", "lead", "g", "n"])

    parts = data.mapInArrow(run, "col int, bits int, lead long, g int, n array<double>")
    out: dict = {}
    for r in tree_sum_arrays(parts, ["col", "bits", "lead", "g"], ["n"]).collect():
        key = (r["col"], r["bits"], r["lead"] + (1 << 63))
        n = np.array(r["n"]).astype(np.int64)                            # sums of whole numbers, exact below 2^53
        out.setdefault(key, np.zeros((groups, len(n)), np.int64))[r["g"]] = n
    return out


def _collect(data: DataFrame, wanted: dict[int, list[tuple[int, int]]], groups: int) -> dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]]:
    """(column, bits, lead) -> (sorted distinct values, counts per group) of intervals of at most ``FEW`` rows."""
    plan = {i: _by_bits(v) for i, v in wanted.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            member = batch.column("_g").flatten().to_numpy().reshape(len(batch), -1)
            for i, by in plan.items():
                row, u = _values(batch, i + 1)
                for bits, leads in by.items():
                    at = _placed(u, bits, leads)
                    hit = np.flatnonzero(at >= 0)
                    for m in member.T:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), i, np.int32)), pa.array(np.full(len(hit), bits, np.int32)), pa.array((leads[at[hit]] ^ _TOP).view(np.int64)),
                                                          pa.array((u[hit] ^ _TOP).view(np.int64)), pa.array(m[row[hit]].astype(np.int32))], ["col", "bits", "lead", "u", "g"])

    rows = data.mapInArrow(run, "col int, bits int, lead long, u long, g int").groupBy("col", "bits", "lead", "u", "g").agg(F.count(F.lit(1)).alias("n")).collect()
    by: dict = {}
    for r in rows:
        by.setdefault((r["col"], r["bits"], r["lead"] + (1 << 63)), []).append((r["u"] + (1 << 63), r["g"], r["n"]))
    out = {}
    for key, own in by.items():
        keys = np.array(sorted({u for u, _, _ in own}), np.uint64)
        cell = np.zeros((groups, len(keys)), np.int64)
        for u, g, n in own:
            cell[g, int(np.searchsorted(keys, np.uint64(u)))] += n
        out[key] = (keys, cell)
    return out
