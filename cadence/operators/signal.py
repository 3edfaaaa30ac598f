"""Signal features per clip (G1-G8) over a samples table ``(clip keys, sr, samples)``.

Energy, zero crossings and trimming of clips that fit a row are array expressions (:mod:`cadence.functions.signal`).
Everything else works on a table of sample blocks ``(clip keys, block, samples)``: a block receives half a frame of its
neighbours (the halo), so that every frame lies inside one row, frames are rows, and a clip's means and deviations are sums over its
frames. A clip of any length therefore spans as many tasks as it has blocks; the spectral centroid and MFCCs need FFTs and run
with numpy on the Arrow batches of those blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions import signal as S

N_MFCC = 13
BLOCK_SAMPLES = 1 << 16   # cut to a multiple of the hop
SUMMARY_COLUMNS = (["rms_mean", "rms_std", "zcr_mean", "zcr_std", "centroid_mean", "centroid_std"]
                   + [f"mfcc_mean_{i}" for i in range(N_MFCC)] + [f"mfcc_std_{i}" for i in range(N_MFCC)])


def durations(df: DataFrame, samples: str = "samples", sr: str = "sr", top_db: float = 30.0,
              frame: int = 2048, hop: int = 512) -> DataFrame:
    """Raw and trimmed duration in seconds (bounds found on the peak-normalised signal)."""
    b = S.trim_bounds(S.peak_normalize(samples), top_db, frame, hop)
    return df.select("*", (F.size(samples) / F.col(sr)).alias("raw_dur"),
                     ((b["end"] - b["start"]) / F.col(sr)).alias("trimmed_dur"))


# ---- mel filters and cosine transform ---------------------------------------------------------------

# Slaney's auditory scale: 3 steps per 200 Hz up to 1 kHz (15 steps), above it 27 steps for every factor of 6.4.
LINEAR_TOP_HZ, STEPS_PER_HZ, LOG_STEPS, LOG_FACTOR = 1000.0, 3 / 200.0, 27.0, 6.4


def _scale_of_hz(hz: float) -> float:
    if hz < LINEAR_TOP_HZ:
        return hz * STEPS_PER_HZ
    return LINEAR_TOP_HZ * STEPS_PER_HZ + LOG_STEPS * float(np.log(hz / LINEAR_TOP_HZ) / np.log(LOG_FACTOR))


def _hz_of_scale(steps: np.ndarray) -> np.ndarray:
    above = np.maximum(steps - LINEAR_TOP_HZ * STEPS_PER_HZ, 0.0)
    return np.minimum(steps / STEPS_PER_HZ, LINEAR_TOP_HZ) * LOG_FACTOR ** (above / LOG_STEPS)


@lru_cache(maxsize=32)
def mel_filters(sr: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangular filters between neighbouring corners of the scale, each of unit area (in Hz)."""
    corners = _hz_of_scale(np.linspace(0.0, _scale_of_hz(sr / 2.0), n_mels + 2))
    bins = np.fft.rfftfreq(n_fft, 1.0 / sr)
    return np.stack([np.interp(bins, [a, b, c], [0.0, 2.0 / (c - a), 0.0]) for a, b, c in zip(corners, corners[1:], corners[2:])])


@lru_cache(maxsize=32)
def cosine_basis(n: int, k: int) -> np.ndarray:
    """First ``k`` rows of the orthonormal DCT-II of ``n`` points."""
    rows = np.cos(np.pi * np.outer(np.arange(k), 2 * np.arange(n) + 1) / (2 * n)) * np.sqrt(2.0 / n)
    rows[0] = np.sqrt(1.0 / n)
    return rows


# ---- blocks and frames ------------------------------------------------------------------------------


def sample_blocks(df: DataFrame, keys: Sequence[str], samples: str = "samples", sr: str = "sr", size: int = BLOCK_SAMPLES) -> DataFrame:
    """Clips that fit a row as a block table (keys, sr, block, samples); clips without samples give no row. Narrow."""
    n = F.size(samples)
    cut = df.where(n > 0).select(*keys, F.col(sr).alias("sr"), F.col(samples).cast("array<double>").alias("_s"),
                                 F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("block"))
    return cut.select(*keys, "sr", F.col("block").cast("bigint").alias("block"), F.slice("_s", F.col("block") * size + 1, size).alias("samples"))


def clip_facts(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per clip: samples, blocks, peak, lowest sample rate, whether a sample is missing or not finite. Partial aggregates."""
    bad = F.exists("samples", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return blocks.groupBy(*keys).agg(F.sum(F.size("samples")).cast("bigint").alias("n"), (F.max("block") + 1).alias("n_blocks"), F.max(F.size("samples")).alias("widest"),
                                     F.max(F.array_max(F.transform("samples", lambda x: F.abs(x)))).alias("peak"),
                                     F.max(bad).alias("bad"), F.min("sr").alias("rate"), F.max(F.col("sr").isNull()).alias("no_rate"))


def with_halo(blocks: DataFrame, keys: Sequence[str], half: int) -> DataFrame:
    """(keys, block, before, samples, after): every block with the last ``half`` samples before and the first ``half`` after it.

    A block sends two copies of its edges; a group is a block and at most two edges."""
    edge = lambda at, shift, part: F.struct((F.col("block") + shift).alias("block"), F.lit(at).alias("at"), part.alias("x"))
    s = F.col("samples")
    tail = F.slice(s, F.greatest(F.size(s) - half, F.lit(0)) + 1, F.lit(half))
    pieces = F.array(edge(1, 0, s), edge(0, 1, tail), edge(2, -1, F.slice(s, 1, half)))
    sent = blocks.select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.*").where("block >= 0")
    of = lambda at: F.first(F.when(F.col("at") == at, F.col("x")), ignorenulls=True)
    none = F.array().cast("array<double>")
    met = sent.groupBy(*keys, "block").agg(F.coalesce(of(0), none).alias("before"), of(1).alias("samples"), F.coalesce(of(2), none).alias("after"))
    return met.where(F.col("samples").isNotNull())


def _frames_of(x: np.ndarray, first: int, begin: int, end: int, start: int, stop: int, frame: int, hop: int):
    """Frames whose centre lies in the block [start, stop) of the signal [begin, end), or at its end in its last block:
    (frame numbers from ``begin``, frame matrix with zeros outside the signal, sign changes inside each frame).

    ``x`` are samples from position ``first`` on that cover the frames as far as the signal does."""
    half = frame // 2
    top = stop - 1 if stop < end else end
    centres = np.arange(max(start, begin), top + 1, hop)
    if not len(centres) or begin >= end or start >= end:
        return np.zeros(0, np.int64), np.zeros((0, frame)), np.zeros(0)
    lo, hi = int(centres[0]) - half, int(centres[-1]) - half + frame
    padded = np.zeros(hi - lo)
    a, b = max(lo, begin, first), min(hi, end, first + len(x))
    padded[a - lo:b - lo] = x[a - first:b - first]
    neg = padded < -S.ZERO_THRESHOLD
    change = np.zeros(hi - lo + 1)                                        # sign changes before each position
    if b - a > 1:
        change[a - lo + 2:b - lo + 1] = np.cumsum(neg[a - lo + 1:b - lo] != neg[a - lo:b - lo - 1])
        change[b - lo + 1:] = change[b - lo]
    at = centres - half - lo
    frames = np.lib.stride_tricks.sliding_window_view(padded, frame)[at]
    return (centres - begin) // hop, frames, change[at + frame] - change[at + 1]


FRAME_COLUMNS = ["rms", "zcr", "centroid"] + [f"mfcc_{i}" for i in range(N_MFCC)]


def _kernel(keys: Sequence[str], frame: int, hop: int, n_mels: int, size: int, step: str, spectral: bool, top_db: float = 80.0):
    """Blocks with halo and their clip's facts to rows: ``loudness`` (frame, power), ``ceiling`` (highest decibel) or ``frames``."""
    half = frame // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)   # periodic Hann window

    def spectrum(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
        magnitude = np.abs(np.fft.rfft(x * window, axis=1))
        return magnitude, 10.0 * np.log10(np.maximum(S.AMIN_POWER, (magnitude ** 2) @ mel_filters(rate, frame, n_mels).T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                get = lambda c: batch.column(c)[i].values.to_numpy()
                block, peak = batch.column("block")[i].as_py(), batch.column("peak")[i].as_py()
                before = get("before")
                start = block * size
                own = get("samples")
                x = np.concatenate([before, own, get("after")]) / (peak if peak > 0 else 1.0)
                t, f, changes = _frames_of(x, start - len(before), batch.column("begin")[i].as_py(), batch.column("end")[i].as_py(), start, start + len(own), frame, hop)
                if not len(t):
                    continue
                power = np.mean(f * f, axis=1)
                if step == "loudness":
                    columns = {"t": t, "power": np.maximum(power, S.AMIN_POWER)}
                else:
                    rate = batch.column("rate")[i].as_py() or 0
                    magnitude, db = spectrum(f, rate) if spectral else (None, None)
                    if step == "ceiling":
                        columns = {"ceiling": np.array([db.max()])}
                    else:
                        columns = {"t": t, "rms": np.sqrt(power), "zcr": changes / frame}
                        if spectral:
                            weight = magnitude.sum(axis=1)
                            centre = np.divide(magnitude @ np.fft.rfftfreq(frame, 1.0 / rate), weight, out=np.zeros(len(t)), where=weight > 0)
                            floor = batch.column("ceiling")[i].as_py() - top_db
                            columns |= {"centroid": centre} | {f"mfcc_{k}": v for k, v in enumerate((np.maximum(db, floor) @ cosine_basis(n_mels, N_MFCC).T).T)}
                n = len(next(iter(columns.values())))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array([i] * n)) for k in keys], *map(pa.array, columns.values())], [*keys, *columns])
    return run


def _joined(blocks: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every block with its clip's facts, met by (clip, block): a long clip's blocks stay spread.

    A merge join by hint: Spark's size estimate counts an array as one element, and would broadcast the samples."""
    per = facts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)))
    return blocks.hint("merge").join(per, [*keys, "block"])


def block_frames(blocks: DataFrame, keys: Sequence[str], frame: int = 2048, hop: int = 512, n_mels: int = 128, trim: bool = False,
                 top_db: float = 30.0, spectral: bool = True, size: int = BLOCK_SAMPLES, facts: DataFrame | None = None) -> DataFrame:
    """G1 to G6 of a block table: one row per frame (keys, t, rms, zcr, and with ``spectral`` centroid, mfcc_0 ...).

    All blocks of a clip but its last hold ``size`` samples, a multiple of the hop and at least half a frame. Clips with a sample that is
    missing or not finite, or (with ``spectral``) without a positive sample rate, give no frames."""
    keys = list(keys)
    if size % hop or size < frame // 2 or frame % 2:
        raise ValueError("blocks must be a multiple of the hop and hold half a frame, and the frame be even")
    types = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    schema = lambda *columns: ", ".join([f"`{k}` {types[k]}" for k in keys] + list(columns))
    facts = clip_facts(blocks, keys) if facts is None else facts
    good = ~F.col("bad") & (F.col("n_blocks") > 0)
    if spectral:
        good = good & ~F.col("no_rate") & (F.col("rate") > 0)
    facts = facts.where(good).select(*keys, "n_blocks", "peak", F.col("rate").cast("int").alias("rate"), F.lit(0).cast("bigint").alias("begin"), F.col("n").alias("end"))
    halo = with_halo(blocks, keys, frame // 2).checkpoint(eager=True)   # read once per step
    kernel = lambda step: _kernel(keys, frame, hop, n_mels, size, step, spectral)
    if trim:
        power = _joined(halo, facts, keys).mapInArrow(kernel("loudness"), schema("t bigint", "power double"))
        # a long clip's frames are compared with its loudest one block by block
        top = power.groupBy(*keys).agg(F.max("power").alias("top"))
        part = F.floor(F.col("t") * hop / size).cast("bigint")
        spread = facts.join(top, keys).select(*keys, "top", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks"))).alias("_part"))
        loud = power.withColumn("_part", part).hint("merge").join(spread, [*keys, "_part"]).where(F.col("power") > F.col("top") * 10.0 ** (-top_db / 10.0))
        edges = loud.groupBy(*keys).agg((F.min("t") * hop).alias("begin"), ((F.max("t") + 1) * hop).alias("_end"))
        facts = facts.drop("begin").join(edges, keys).withColumn("end", F.least("end", "_end")).drop("_end")
    if spectral:
        top = _joined(halo, facts, keys).mapInArrow(kernel("ceiling"), schema("ceiling double")).groupBy(*keys).agg(F.max("ceiling").alias("ceiling"))
        facts = facts.join(top, keys)
    names = FRAME_COLUMNS if spectral else FRAME_COLUMNS[:2]
    return _joined(halo, facts, keys).mapInArrow(kernel("frames"), schema("t bigint", *[f"{c} double" for c in names]))


def summarize_frames(frames: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean and population deviation per clip and column (partial aggregates, merged stably)."""
    own = lambda c, what: f"mfcc_{what}_{c.split('_')[1]}" if c.startswith("mfcc") else f"{c}_{what}"
    return frames.groupBy(*keys).agg(*[F.avg(c).alias(own(c, "mean")) for c in names], *[F.stddev_pop(c).alias(own(c, "std")) for c in names])


def signal_error(bad: Column, empty: Column, no_rate: Column | None) -> Column:
    """Why a clip has no features; NULL for a good clip."""
    out = F.when(empty, "no samples").when(bad, "a sample is missing or not finite")
    return out.when(no_rate, "no sample rate") if no_rate is not None else out


def block_features(blocks: DataFrame, clips: DataFrame, keys: Sequence[str], frame: int = 2048, hop: int = 512, n_mels: int = 128, trim: bool = False,
                   top_db: float = 30.0, spectral: bool = True, size: int = BLOCK_SAMPLES) -> DataFrame:
    """G7 + G8 of a block table over the clip spine: the summary columns, 0.0 where a clip has none, and ``error``."""
    keys = list(keys)
    facts = clip_facts(blocks, keys).checkpoint(eager=True)             # one row per clip
    names = FRAME_COLUMNS if spectral else FRAME_COLUMNS[:2]
    summary = summarize_frames(block_frames(blocks, keys, frame, hop, n_mels, trim, top_db, spectral, size, facts), keys, names)
    columns = SUMMARY_COLUMNS if spectral else SUMMARY_COLUMNS[:4]
    why = facts.select(*keys, "bad", (F.col("no_rate") | (F.col("rate") <= 0)).alias("no_rate"), F.lit(True).alias("_some"))
    j = clips.select(*keys).join(why, keys, "left").join(summary, keys, "left")
    error = signal_error(F.col("bad"), F.col("_some").isNull(), F.col("no_rate") if spectral else None)
    return j.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns], error.alias("error"))


# ---- clips that fit a row ---------------------------------------------------------------------------


def _block_size(hop: int, frame: int) -> int:
    return max(BLOCK_SAMPLES // hop, -(-frame // hop)) * hop


def spectral_features(df: DataFrame, keys: Sequence[str], samples: str = "samples", sr: str = "sr",
                      n_fft: int = 2048, hop: int = 512, n_mels: int = 128) -> DataFrame:
    """G5/G6 per clip as columns, of the samples as they are (not normalised), and ``error``. A clip without usable samples or
    sample rate has zeros."""
    keys, size = list(keys), _block_size(hop, n_fft)
    blocks = sample_blocks(df, keys, samples, sr, size)
    facts = clip_facts(blocks, keys).withColumn("peak", F.lit(1.0)).checkpoint(eager=True)
    names = FRAME_COLUMNS[2:]
    summary = summarize_frames(block_frames(blocks, keys, n_fft, hop, n_mels, spectral=True, size=size, facts=facts), keys, names)
    why = facts.select(*keys, "bad", (F.col("no_rate") | (F.col("rate") <= 0)).alias("no_rate"), F.lit(True).alias("_some"))
    j = df.select(*keys).join(why, keys, "left").join(summary, keys, "left")
    return j.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in SUMMARY_COLUMNS[4:]], signal_error(F.col("bad"), F.col("_some").isNull(), F.col("no_rate")).alias("error"))


def signal_features(df: DataFrame, keys: Sequence[str], samples: str = "samples", sr: str = "sr",
                    frame: int = 2048, hop: int = 512, n_mels: int = 128, trim: bool = False,
                    top_db: float = 30.0, spectral: bool = True) -> DataFrame:
    """G7 + G8: the 32 summary columns per clip on the peak-normalised (optionally trimmed) signal, and ``error``. Energy and zero
    crossings alone are array expressions (no join, no shuffle); with the spectral part the clip goes through the block table.
    Missing or bad signals keep their row with every column 0.0 and the reason."""
    if spectral:
        size = _block_size(hop, frame)
        return block_features(sample_blocks(df, keys, samples, sr, size), df, keys, frame, hop, n_mels, trim, top_db, True, size)
    raw = F.col(samples).cast("array<double>")
    empty = F.coalesce(F.size(raw) <= 0, F.lit(True))
    bad = F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    y = S.peak_normalize(raw)
    if trim:
        y = S.let(y, lambda s: S.let(S.trim_bounds(s, top_db, frame, hop), lambda b: F.slice(s, b["start"] + 1, F.greatest(b["end"] - b["start"], F.lit(0)))))
    stats = S.let(y, lambda s: F.struct(S.mean_std(S.frame_rms(s, frame, hop)).alias("r"), S.mean_std(S.frame_zcr(s, frame, hop)).alias("z")))
    error = signal_error(bad, empty, None)
    out = df.select(*keys, error.alias("error"), F.when(error.isNull(), stats).alias("_v"))
    fields = ("r.mean", "r.std", "z.mean", "z.std")
    return out.select(*keys, *[F.coalesce(F.col(f"_v.{f}"), F.lit(0.0)).alias(n) for f, n in zip(fields, SUMMARY_COLUMNS)], "error")
