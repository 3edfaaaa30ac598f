"""Per-clip signal features (G1-G4) as array expressions, and numpy kernels for the spectral part.

A clip's samples live in one row (D10). Values that a lambda needs (the peak, the samples, the loudest frame) are
bound once with :func:`let`, so work is linear in the clip: no Python, no shuffle, rows stay where they are.

Framing follows the usual audio-library defaults: frames of ``frame`` samples every ``hop`` samples;
with ``center`` the signal is padded by frame // 2 on each side (zeros for energy, edge values for zero
crossings).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_THRESHOLD = 1e-10  # |x| at or below counts as zero (positive) for zero crossings
AMIN_POWER = 1e-10      # floor of power before taking decibels


# ---- numpy kernels ----------------------------------------------------------------------------------

def np_peak_normalize(y: np.ndarray) -> np.ndarray:
    """G1: divide by the largest absolute value; an all-zero signal is left alone."""
    peak = np.max(np.abs(y)) if y.size else 0.0
    return y / peak if peak > 0 else y


def _framed(p: np.ndarray, frame: int, hop: int) -> np.ndarray:
    n = 1 + (len(p) - frame) // hop if len(p) >= frame else 0
    if n <= 0:
        return np.zeros((0, frame))
    return np.lib.stride_tricks.as_strided(p, shape=(n, frame), strides=(p.strides[0] * hop, p.strides[0]))


def np_frame_rms(y: np.ndarray, frame: int = 2048, hop: int = 512, center: bool = True) -> np.ndarray:
    """RMS energy per frame (zero padding when centred)."""
    p = np.pad(y, frame // 2) if center else y
    f = _framed(np.ascontiguousarray(p, dtype=np.float64), frame, hop)
    return np.sqrt(np.mean(f * f, axis=1)) if len(f) else np.zeros(0)


def np_frame_zcr(y: np.ndarray, frame: int = 2048, hop: int = 512, center: bool = True) -> np.ndarray:
    """Share of sign changes between neighbours inside each frame (edge padding when centred)."""
    p = np.pad(y, frame // 2, mode="edge") if (center and len(y)) else y
    neg = (np.asarray(p) < -ZERO_THRESHOLD).astype(np.int8)
    f = _framed(np.ascontiguousarray(neg), frame, hop)
    return np.abs(np.diff(f, axis=1)).sum(axis=1) / frame if len(f) else np.zeros(0)


def np_trim_bounds(y: np.ndarray, top_db: float = 30.0, frame: int = 2048, hop: int = 512) -> tuple[int, int]:
    """(start, end) of the part within ``top_db`` of the loudest frame; equal-quiet clips keep all."""
    r = np_frame_rms(y, frame, hop, True)
    if not len(r):
        return 0, 0
    power = np.maximum(r * r, AMIN_POWER)
    loud = np.flatnonzero(power > power.max() * 10.0 ** (-top_db / 10.0))
    if not len(loud):
        return 0, 0
    return int(loud[0] * hop), int(min(len(y), (loud[-1] + 1) * hop))


# ---- Spark column functions (array expressions, no Python) ---------------------------------------------

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` evaluated once per row: inside a lambda a plain expression would be evaluated again for
    every element, a lambda's own variable is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _col(samples: Column | str) -> Column:
    return (F.col(samples) if isinstance(samples, str) else samples).cast("array<double>")


def peak_normalize(samples: Column | str) -> Column:
    """G1 as a column."""
    def scaled(s: Column) -> Column:
        peak = F.array_max(F.transform(s, lambda x: F.abs(x)))
        return let(peak, lambda p: F.when(p > 0, F.transform(s, lambda x: x / p)).otherwise(s))

    return let(_col(samples), scaled)


def _frames(samples: Column, frame: int, hop: int, center: bool, of_frame: Callable[[Column], Column]) -> Column:
    """``of_frame`` of the part of each frame that lies inside the signal; NULL for NULL, empty for none."""
    pad = frame // 2 if center else 0

    def framed(s: Column) -> Column:
        n = F.size(s)
        count = F.floor((n + (2 * pad - frame)) / hop).cast("int") + 1
        begin = lambda t: F.greatest(t * hop - pad, F.lit(0))
        part = lambda t: F.slice(s, F.least(begin(t), n) + 1, F.greatest(F.least(t * hop - pad + frame, n) - begin(t), F.lit(0)))
        none = F.array().cast("array<double>")
        return F.when((n > 0) & (count > 0), F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda t: of_frame(part(t)))).otherwise(none)

    return F.when(samples.isNotNull(), let(samples, framed))


def frame_rms(samples: Column | str, frame: int = 2048, hop: int = 512, center: bool = True) -> Column:
    """G3 as a column: padding is zero, so only the samples inside a frame add energy."""
    energy = lambda part: F.sqrt(F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x * x) / frame)
    return _frames(_col(samples), frame, hop, center, energy)


def frame_zcr(samples: Column | str, frame: int = 2048, hop: int = 512, center: bool = True) -> Column:
    """G4 as a column: edge padding repeats a sign, so only neighbours inside the signal can change it."""
    def changes(part: Column) -> Column:
        sign = F.struct(F.lit(0).alias("n"), F.lit(None).cast("boolean").alias("neg"))
        step = lambda acc, x: F.struct(
            (acc["n"] + F.when(acc["neg"] != (x < -ZERO_THRESHOLD), 1).otherwise(0)).alias("n"), (x < -ZERO_THRESHOLD).alias("neg"))
        return F.aggregate(part, sign, step)["n"] / F.lit(float(frame))

    return _frames(_col(samples), frame, hop, center, changes)


def trim_bounds(samples: Column | str, top_db: float = 30.0, frame: int = 2048, hop: int = 512) -> Column:
    """G2 bounds as struct<start int, end int> (computed on the given, usually normalised, samples)."""
    col = _col(samples)

    def bounds(power: Column) -> Column:
        loud = let(F.array_max(power), lambda top: F.filter(F.transform(power, lambda p, t: F.when(p > top * 10.0 ** (-top_db / 10.0), t)), lambda t: t.isNotNull()))
        return let(loud, lambda at: F.struct(
            (F.coalesce(F.array_min(at), F.lit(0)) * hop).cast("int").alias("start"),
            F.least(F.size(col), (F.coalesce(F.array_max(at), F.lit(-1)) + 1) * hop).cast("int").alias("end")))

    return F.when(col.isNotNull(), let(F.transform(frame_rms(col, frame, hop), lambda r: F.greatest(r * r, F.lit(AMIN_POWER))), bounds))


def mean_std(values: Column) -> Column:
    """struct<mean, std> (population) of an array of doubles; 0.0 for an empty one."""
    def both(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
        return let(total / F.greatest(F.size(v), F.lit(1)), lambda m: F.struct(
            m.alias("mean"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.greatest(F.size(v), F.lit(1))).alias("std")))

    return let(values, both)
