"""Driver queries for signal features (G1-G8) on F8: 64 Hz test signals, frames of 16 every 8 samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.functions import signal as S
from cadence.operators.signal import SUMMARY_COLUMNS, durations, signal_features
from cadence.plans import fixtures as fx
from cadence.plans.common import big, r6
from cadence.plans.oracle_fixtures import with_fixtures

FRAME, HOP, N_MELS = 16, 8, 8


def g1_peak_normalize(spark, d):
    f8 = fx.f8_signal(spark, d).where(F.col("samples").isNotNull())
    y = S.peak_normalize("samples")
    return f8.select(big("clip_id"), r6(F.array_max(F.transform("samples", lambda x: F.abs(x))), "peak"),
                     r6(F.aggregate(y, F.lit(0.0), lambda a, x: a + x), "sum_normalized"),
                     r6(F.array_max(F.transform(y, lambda x: F.abs(x))), "max_abs_normalized"))


def g2_trim_silence(spark, d):
    f8 = fx.f8_signal(spark, d).where(F.col("samples").isNotNull())
    out = durations(f8, top_db=30.0, frame=FRAME, hop=HOP)
    return out.select(big("clip_id"), r6("raw_dur"), r6("trimmed_dur"))


def g3_frame_rms(spark, d):
    f8 = fx.f8_signal(spark, d).where(F.col("samples").isNotNull())
    r = S.frame_rms(S.peak_normalize("samples"), FRAME, HOP)
    return f8.select("clip_id", F.posexplode(r).alias("t", "rms")).select(big("clip_id"), big("t"), r6("rms"))


def g4_frame_zcr(spark, d):
    f8 = fx.f8_signal(spark, d).where(F.col("samples").isNotNull())
    z = S.frame_zcr(S.peak_normalize("samples"), FRAME, HOP)
    return f8.select("clip_id", F.posexplode(z).alias("t", "zcr")).select(big("clip_id"), big("t"), r6("zcr"))


def g5_g6_spectral(spark, d):
    out = signal_features(fx.f8_signal(spark, d), ["clip_id"], frame=FRAME, hop=HOP, n_mels=N_MELS)
    return out.select(big("clip_id"), *[r6(c) for c in SUMMARY_COLUMNS])


def g5_spectral_centroid(spark, d):
    out = signal_features(fx.f8_signal(spark, d), ["clip_id"], frame=FRAME, hop=HOP, n_mels=N_MELS)
    return out.select(big("clip_id"), r6("centroid_mean"), r6("centroid_std"))


def g6_mfcc_summary(spark, d):
    out = signal_features(fx.f8_signal(spark, d), ["clip_id"], frame=FRAME, hop=HOP, n_mels=N_MELS)
    cols = [f"mfcc_mean_{i}" for i in range(13)] + [f"mfcc_std_{i}" for i in range(13)]
    return out.select(big("clip_id"), *[r6(c) for c in cols])


def g7_g8_signal_summary(spark, d):
    out = signal_features(fx.f8_signal(spark, d), ["clip_id"], frame=FRAME, hop=HOP, spectral=False)
    return out.select(big("clip_id"), r6("rms_mean"), r6("rms_std"), r6("zcr_mean"), r6("zcr_std"))


def g2_notebook_trimmed_features(spark, d):
    """Notebook variant: features on the normalised and trimmed signal."""
    out = signal_features(fx.f8_signal(spark, d), ["clip_id"], frame=FRAME, hop=HOP, trim=True, spectral=False)
    return out.select(big("clip_id"), r6("rms_mean"), r6("rms_std"), r6("zcr_mean"), r6("zcr_std"))


QUERIES = {
    "g1_peak_normalize": g1_peak_normalize,
    "g2_trim_silence": g2_trim_silence,
    "g3_frame_rms": g3_frame_rms,
    "g4_frame_zcr": g4_frame_zcr,
    "g5_g6_spectral": g5_g6_spectral,
    "g5_spectral_centroid": g5_spectral_centroid,
    "g6_mfcc_summary": g6_mfcc_summary,
    "g7_g8_signal_summary": g7_g8_signal_summary,
    "g2_notebook_trimmed_features": g2_notebook_trimmed_features,
}


def _frames(sig_expr: str) -> str:
    """Frame RMS / ZCR of the signals produced by ``sig_expr`` (columns clip_id, sr, y)."""
    return f"""WITH sig AS ({sig_expr}),
pts AS (SELECT clip_id, unnest(y) AS v, unnest(range(len(y))) AS i FROM sig),
fr AS (SELECT clip_id, unnest(range(CAST(floor(len(y) / 8) + 1 AS BIGINT))) AS t FROM sig WHERE len(y) > 0),
rms AS (SELECT fr.clip_id, fr.t, sqrt(coalesce(sum(v * v), 0.0) / 16) AS r FROM fr
        LEFT JOIN pts ON pts.clip_id = fr.clip_id AND pts.i >= fr.t * 8 - 8 AND pts.i < fr.t * 8 + 8 GROUP BY fr.clip_id, fr.t),
pp0 AS (SELECT clip_id, y, unnest(range(len(y) + 16)) AS p FROM sig WHERE len(y) > 0),
pp AS (SELECT clip_id, p, y[least(greatest(p - 8, 0), len(y) - 1) + 1] < -1e-10 AS neg FROM pp0),
cr AS (SELECT b.clip_id, b.p, CASE WHEN a.neg <> b.neg THEN 1 ELSE 0 END AS c FROM pp a JOIN pp b ON a.clip_id = b.clip_id AND b.p = a.p + 1),
zcr AS (SELECT fr.clip_id, fr.t, sum(c) / 16.0 AS z FROM fr JOIN cr ON cr.clip_id = fr.clip_id AND cr.p >= fr.t * 8 + 1 AND cr.p < fr.t * 8 + 16
        GROUP BY fr.clip_id, fr.t)
"""


_NORM = """SELECT clip_id, sr, CASE WHEN peak > 0 THEN list_transform(samples, lambda x: x / peak) ELSE samples END AS y
           FROM (SELECT clip_id, sr, samples, list_max(list_transform(samples, lambda x: abs(x))) AS peak FROM f8_signal WHERE samples IS NOT NULL) s"""

_SUMMARY = """, agg AS (SELECT r.clip_id, avg(r) AS rm, stddev_pop(r) AS rs FROM rms r GROUP BY r.clip_id),
zagg AS (SELECT clip_id, avg(z) AS zm, stddev_pop(z) AS zs FROM zcr GROUP BY clip_id)
SELECT CAST(f.clip_id AS BIGINT) AS clip_id, round(coalesce(rm, 0.0), 6) AS rms_mean, round(coalesce(rs, 0.0), 6) AS rms_std,
       round(coalesce(zm, 0.0), 6) AS zcr_mean, round(coalesce(zs, 0.0), 6) AS zcr_std
FROM f8_signal f LEFT JOIN agg ON f.clip_id = agg.clip_id LEFT JOIN zagg ON f.clip_id = zagg.clip_id"""

ORACLES = {
    "g1_peak_normalize": with_fixtures("""SELECT CAST(clip_id AS BIGINT) AS clip_id, round(peak, 6) AS peak,
        round(list_sum(CASE WHEN peak > 0 THEN list_transform(samples, lambda x: x / peak) ELSE samples END), 6) AS sum_normalized,
        round(CASE WHEN peak > 0 THEN list_max(list_transform(samples, lambda x: abs(x) / peak)) ELSE peak END, 6) AS max_abs_normalized
        FROM (SELECT clip_id, samples, list_max(list_transform(samples, lambda x: abs(x))) AS peak FROM f8_signal WHERE samples IS NOT NULL) s""", "f8_signal"),
    "g3_frame_rms": with_fixtures(_frames(_NORM) + "SELECT CAST(clip_id AS BIGINT) AS clip_id, CAST(t AS BIGINT) AS t, round(r, 6) AS rms FROM rms", "f8_signal"),
    "g4_frame_zcr": with_fixtures(_frames(_NORM) + "SELECT CAST(clip_id AS BIGINT) AS clip_id, CAST(t AS BIGINT) AS t, round(z, 6) AS zcr FROM zcr", "f8_signal"),
    "g2_trim_silence": with_fixtures(_frames(_NORM).rstrip() + """,
        pw AS (SELECT clip_id, t, greatest(r * r, 1e-10) AS pw FROM rms),
        ref AS (SELECT clip_id, max(pw) AS ref FROM pw GROUP BY clip_id),
        loud AS (SELECT pw.clip_id, min(t) AS t0, max(t) AS t1 FROM pw JOIN ref USING (clip_id) WHERE pw > ref * 0.001 GROUP BY pw.clip_id)
        SELECT CAST(s.clip_id AS BIGINT) AS clip_id, round(len(s.y) / s.sr, 6) AS raw_dur,
               round((least(len(s.y), (l.t1 + 1) * 8) - l.t0 * 8) / s.sr, 6) AS trimmed_dur
        FROM sig s JOIN loud l ON s.clip_id = l.clip_id""", "f8_signal"),
}
ORACLES["g7_g8_signal_summary"] = with_fixtures(_frames(_NORM).rstrip() + _SUMMARY, "f8_signal")

# notebook variant: frame features of the normalised signal after trimming (bounds as in G2)
_NRMS = """SELECT fr.clip_id, fr.t, sqrt(coalesce(sum(p.v * p.v), 0.0) / 16) AS rr
    FROM (SELECT clip_id, unnest(range(CAST(floor(len(y) / 8) + 1 AS BIGINT))) AS t FROM (""" + _NORM + """) a WHERE len(y) > 0) fr
    LEFT JOIN (SELECT clip_id, unnest(y) AS v, unnest(range(len(y))) AS i FROM (""" + _NORM + """) b) p
      ON p.clip_id = fr.clip_id AND p.i >= fr.t * 8 - 8 AND p.i < fr.t * 8 + 8
    GROUP BY fr.clip_id, fr.t"""
_TRIMMED = """SELECT s.clip_id, s.sr, s.y[l.t0 * 8 + 1 : least(len(s.y), (l.t1 + 1) * 8)] AS y
    FROM (""" + _NORM + """) s JOIN (
      SELECT clip_id, min(t) AS t0, max(t) AS t1 FROM (
        SELECT clip_id, t, greatest(rr * rr, 1e-10) AS pw, max(greatest(rr * rr, 1e-10)) OVER (PARTITION BY clip_id) AS ref
        FROM (""" + _NRMS + """) q0) q WHERE pw > ref * 0.001 GROUP BY clip_id) l ON s.clip_id = l.clip_id"""
ORACLES["g2_notebook_trimmed_features"] = with_fixtures(_frames(_TRIMMED).rstrip() + _SUMMARY, "f8_signal")

# G5 by a DFT join: 16-sample Hann-windowed frames (zero padding by 8), 9 frequency bins of 4 Hz at sr 64
_DFT = """, win AS (SELECT n, 0.5 - 0.5 * cos(2 * pi() * n / 16) AS h FROM range(16) t(n)),
bins AS (SELECT k FROM range(9) t(k)),
fx AS (SELECT fr.clip_id, fr.t, w.n, coalesce(p.v, 0.0) * w.h AS xw
       FROM fr CROSS JOIN win w LEFT JOIN pts p ON p.clip_id = fr.clip_id AND p.i = fr.t * 8 + w.n - 8),
spec AS (SELECT fx.clip_id, fx.t, b.k, sqrt(power(sum(xw * cos(2 * pi() * b.k * fx.n / 16)), 2)
                                           + power(sum(xw * sin(2 * pi() * b.k * fx.n / 16)), 2)) AS mag
         FROM fx CROSS JOIN bins b GROUP BY fx.clip_id, fx.t, b.k),
cen AS (SELECT clip_id, t, CASE WHEN sum(mag) > 0 THEN sum(k * 4.0 * mag) / sum(mag) ELSE 0.0 END AS c FROM spec GROUP BY clip_id, t),
cs AS (SELECT clip_id, avg(c) AS cm, stddev_pop(c) AS cv FROM cen GROUP BY clip_id)
SELECT CAST(f.clip_id AS BIGINT) AS clip_id, round(coalesce(cm, 0.0), 6) AS centroid_mean, round(coalesce(cv, 0.0), 6) AS centroid_std
FROM f8_signal f LEFT JOIN cs ON f.clip_id = cs.clip_id"""
ORACLES["g5_spectral_centroid"] = with_fixtures(_frames(_NORM).rstrip() + _DFT, "f8_signal")


def _mfcc_sql() -> str:
    """G6 by joins: |DFT|^2 of Hann frames, a mel filterbank table, 10 log10 with a per-clip floor at
    max - 80 dB, and an orthonormal DCT-II basis table. The two weight tables are constants of
    (sr, frame, mel count) and are inlined as VALUES."""
    import numpy as np

    from cadence.operators.signal import mel_filters

    fb = mel_filters(64, FRAME, N_MELS)
    mel_rows = ", ".join(f"({m}, {k}, {repr(float(fb[m, k]))})" for m in range(fb.shape[0]) for k in range(fb.shape[1]) if fb[m, k] != 0)
    n = N_MELS
    dct_rows = ", ".join(
        f"({c}, {m}, {repr(float(np.cos(np.pi / n * (m + 0.5) * c) * np.sqrt(2.0 / n) / (np.sqrt(2.0) if c == 0 else 1.0)))})"
        for c in range(13) for m in range(n))
    means = ", ".join(f"round(coalesce(max(mm) FILTER (WHERE c = {i}), 0.0), 6) AS mfcc_mean_{i}" for i in range(13))
    stds = ", ".join(f"round(coalesce(max(ms) FILTER (WHERE c = {i}), 0.0), 6) AS mfcc_std_{i}" for i in range(13))
    return f""", win AS (SELECT n, 0.5 - 0.5 * cos(2 * pi() * n / 16) AS h FROM range(16) t(n)),
bins AS (SELECT k FROM range(9) t(k)),
fx AS (SELECT fr.clip_id, fr.t, w.n, coalesce(p.v, 0.0) * w.h AS xw
       FROM fr CROSS JOIN win w LEFT JOIN pts p ON p.clip_id = fr.clip_id AND p.i = fr.t * 8 + w.n - 8),
pw AS (SELECT fx.clip_id, fx.t, b.k, power(sum(xw * cos(2 * pi() * b.k * fx.n / 16)), 2)
                                      + power(sum(xw * sin(2 * pi() * b.k * fx.n / 16)), 2) AS p
       FROM fx CROSS JOIN bins b GROUP BY fx.clip_id, fx.t, b.k),
melw AS (SELECT * FROM (VALUES {mel_rows}) v(m, k, wt)),
mel AS (SELECT pw.clip_id, pw.t, melw.m, 10 * log10(greatest(sum(pw.p * melw.wt), 1e-10)) AS db
        FROM pw JOIN melw ON pw.k = melw.k GROUP BY pw.clip_id, pw.t, melw.m),
floor_ AS (SELECT clip_id, max(db) - 80 AS fl FROM mel GROUP BY clip_id),
dctw AS (SELECT * FROM (VALUES {dct_rows}) v(c, m, wt)),
mf AS (SELECT mel.clip_id, mel.t, dctw.c, sum(greatest(mel.db, floor_.fl) * dctw.wt) AS v
       FROM mel JOIN floor_ ON mel.clip_id = floor_.clip_id JOIN dctw ON mel.m = dctw.m GROUP BY mel.clip_id, mel.t, dctw.c),
st AS (SELECT clip_id, c, avg(v) AS mm, stddev_pop(v) AS ms FROM mf GROUP BY clip_id, c)
SELECT CAST(f.clip_id AS BIGINT) AS clip_id, {means}, {stds}
FROM f8_signal f LEFT JOIN st ON f.clip_id = st.clip_id GROUP BY f.clip_id"""


ORACLES["g6_mfcc_summary"] = with_fixtures(_frames(_NORM).rstrip() + _mfcc_sql(), "f8_signal")
# the whole summary is the three parts side by side
ORACLES["g5_g6_spectral"] = f"""SELECT * FROM ({ORACLES["g7_g8_signal_summary"]}) a
JOIN ({ORACLES["g5_spectral_centroid"]}) b USING (clip_id) JOIN ({ORACLES["g6_mfcc_summary"]}) c USING (clip_id)"""
