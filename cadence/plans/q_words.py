"""Driver queries for J1-J3, A1-A4, W1-W7 and P4 over the timed-word views (F2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.operators import words as W
from cadence.plans import fixtures as fx
from cadence.plans.common import big, r6
from cadence.plans.oracle_fixtures import with_fixtures

KEYS = ["clip_id"]


def _timing(spark, d, mode="package"):
    w = fx.f2_words(spark, d)
    return W.timing_features(fx.f2_clips(spark, d), w, KEYS, segments=fx.f2_segments(w), mode=mode)


def j1_flatten_words(spark, d):
    w = fx.f2_words(spark, d)
    nested = W.chunk_segments(w, KEYS, fx.f2_segments(w))
    flat = W.flatten_words(nested, KEYS, "segments", base="base")
    return flat.select("clip_id", "ord", "word", r6("start_s"), r6("end_s"), r6("probability"))


def j2_words_json(spark, d):
    w = fx.f2_words(spark, d)
    nested = W.chunk_segments(w, KEYS, fx.f2_segments(w))
    arr = F.flatten(F.transform("segments", lambda s: s["words"]))
    back = W.words_from_json(W.words_to_json(arr))
    out = nested.select("clip_id", arr.alias("a"), back.alias("b"))
    return out.groupBy("clip_id").agg(
        F.sum(F.size("a")).cast("bigint").alias("n_words"),
        F.sum(F.size("b")).cast("bigint").alias("n_roundtrip"),
        r6(F.sum(F.aggregate("b", F.lit(0.0), lambda acc, x: acc + x["end"] - x["start"])), "sum_len"),
        r6(F.sum(F.aggregate("b", F.lit(0.0), lambda acc, x: acc + x["probability"])), "sum_prob"))


def j3_words_from_json(spark, d):
    """Notebook-style JSON (key ``prob``) parsed back to word structs."""
    w = fx.f2_words(spark, d)
    per_seg = w.groupBy("clip_id", F.floor(F.col("ord") / 10).alias("seg_no")).agg(
        F.to_json(F.sort_array(F.collect_list(F.struct(
            "ord", "word", F.col("start_s").alias("start"), F.col("end_s").alias("end"),
            F.col("probability").alias("prob"))))).alias("js"))
    parsed = per_seg.select("clip_id", F.explode(W.words_from_json(F.col("js"))).alias("w"))
    return parsed.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("n_words"), r6(F.sum("w.probability"), "sum_prob"),
        r6(F.min("w.start"), "min_start"), r6(F.max("w.end"), "max_end"))


def j3_package_words(spark, d):
    """Package-style JSON (key ``probability``, words with the recogniser's leading space) parsed back as written."""
    w = fx.f2_words(spark, d)
    per_seg = w.groupBy("clip_id", F.floor(F.col("ord") / 10).alias("seg_no")).agg(
        F.to_json(F.sort_array(F.collect_list(F.struct(
            "ord", F.concat(F.lit(" "), "word").alias("word"), F.col("start_s").alias("start"), F.col("end_s").alias("end"),
            "probability")))).alias("js"))
    parsed = per_seg.select("clip_id", F.explode(W.words_from_json(F.col("js"), trim=False)).alias("w"))
    return parsed.groupBy("clip_id", F.col("w.word").alias("word")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("w.word")).cast("bigint").alias("n_chars"), r6(F.sum("w.probability"), "sum_prob"))


def a1_word_confidence(spark, d):
    t = _timing(spark, d)
    return t.select("clip_id", r6("whisper_mean_word_prob", "mean_word_prob"), r6("whisper_min_word_prob", "min_word_prob"))


def a2_low_confidence(spark, d):
    return _timing(spark, d).select("clip_id", r6("whisper_low_conf_ratio", "low_conf_ratio"))


def a3_segment_confidence(spark, d):
    return _timing(spark, d).select("clip_id", r6("whisper_avg_logprob", "avg_logprob"),
                                    r6("whisper_no_speech_prob", "no_speech_prob"))


def a3_segment_confidence_notebook(spark, d):
    return _timing(spark, d, mode="notebook").select(
        "clip_id", r6("whisper_avg_logprob", "avg_logprob"), r6("whisper_no_speech_prob", "no_speech_prob"))


def a4_confidence_view(spark, d):
    w = fx.f2_words(spark, d)
    conf = W.word_aggregates(w, KEYS).select("clip_id", "mean_word_prob", "min_word_prob", "low_conf_ratio")
    conf = W.with_prefix(conf, ["mean_word_prob", "min_word_prob", "low_conf_ratio"])
    return conf.select("clip_id", *[r6(c) for c in conf.columns if c != "clip_id"])


def w1_word_gaps(spark, d):
    g = W.word_gaps(fx.f2_words(spark, d), KEYS)
    return g.select("clip_id", "ord", r6("gap"))


def w2_pause_counts(spark, d):
    return _timing(spark, d).select("clip_id", big("pause_count_03"), big("pause_count_05"))


def w3_pause_lengths(spark, d):
    return _timing(spark, d).select("clip_id", r6("mean_pause_len"), r6("max_pause_len"))


def w4_speech_duration(spark, d):
    t = _timing(spark, d)
    return t.select("clip_id", r6("speech_time_ratio"), r6("articulation_rate"))


def w5_speech_rate(spark, d):
    return _timing(spark, d).select("clip_id", r6("wpm"))


def timing_features(spark, d):
    """Flagship: W2-W7 and A1-A3 per clip."""
    t = _timing(spark, d)
    return t.select("clip_id", *[r6(c) if not c.startswith("pause_count") else big(c)
                                 for c in t.columns if c != "clip_id"])


QUERIES = {
    "j1_flatten_words": j1_flatten_words,
    "j2_words_json": j2_words_json,
    "j3_words_from_json": j3_words_from_json,
    "j3_package_words": j3_package_words,
    "a1_word_confidence": a1_word_confidence,
    "a2_low_confidence": a2_low_confidence,
    "a3_segment_confidence": a3_segment_confidence,
    "a3_segment_confidence_notebook": a3_segment_confidence_notebook,
    "a4_confidence_view": a4_confidence_view,
    "w1_word_gaps": w1_word_gaps,
    "w2_pause_counts": w2_pause_counts,
    "w3_pause_lengths": w3_pause_lengths,
    "w4_speech_duration": w4_speech_duration,
    "w5_speech_rate": w5_speech_rate,
    "w6_w7_timing_features": timing_features,
}

_AGG = r"""
g AS (SELECT clip_id, ord, start_s, end_s, probability,
             lead(start_s) OVER (PARTITION BY clip_id ORDER BY ord) - end_s AS gap FROM f2_words),
a AS (SELECT clip_id, count(*) AS n, sum(greatest(end_s - start_s, 0.0)) AS speech_sum,
             count(*) FILTER (WHERE gap > 0.3) AS p03, count(*) FILTER (WHERE gap > 0.5) AS p05,
             avg(gap) FILTER (WHERE gap > 0.3) AS mp, max(gap) FILTER (WHERE gap > 0.3) AS xp,
             avg(probability) AS mw, min(probability) AS nw,
             avg(CASE WHEN probability < 0.5 THEN 1.0 ELSE 0.0 END) AS lc
      FROM g GROUP BY clip_id),
s AS (SELECT clip_id, avg(avg_logprob) AS lp, avg(no_speech_prob) AS ns,
             avg(coalesce(avg_logprob, 0.0)) AS lp_nb, avg(coalesce(no_speech_prob, 0.0)) AS ns_nb
      FROM f2_segments GROUP BY clip_id),
b AS (SELECT c.clip_id, greatest(c.trimmed_dur, 1.0) AS dur, CAST(greatest(c.n_words, 1) AS DOUBLE) AS nwd,
             coalesce(a.n, 0) AS n, a.speech_sum, a.p03, a.p05, a.mp, a.xp, a.mw, a.nw, a.lc, s.lp, s.ns, s.lp_nb, s.ns_nb
      FROM f2_clips c LEFT JOIN a ON c.clip_id = a.clip_id LEFT JOIN s ON c.clip_id = s.clip_id),
t AS (SELECT *, CASE WHEN n <= 1 THEN dur * 0.8 ELSE speech_sum END AS speech FROM b)
"""


def _timing_sql(select: str) -> str:
    return with_fixtures("WITH " + _AGG + select, "f2_words", "f2_clips", "f2_segments")


_FLAT = "SELECT clip_id, ord, word, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, round(probability, 6) AS probability FROM f2_words"

ORACLES = {
    "j1_flatten_words": with_fixtures(_FLAT, "f2_words"),
    "j2_words_json": with_fixtures("""SELECT clip_id, CAST(count(*) AS BIGINT) AS n_words, CAST(count(*) AS BIGINT) AS n_roundtrip,
        round(sum(end_s - start_s), 6) AS sum_len, round(sum(probability), 6) AS sum_prob FROM f2_words GROUP BY clip_id""", "f2_words"),
    "j3_words_from_json": with_fixtures("""SELECT clip_id, CAST(count(*) AS BIGINT) AS n_words, round(sum(probability), 6) AS sum_prob,
        round(min(start_s), 6) AS min_start, round(max(end_s), 6) AS max_end FROM f2_words GROUP BY clip_id""", "f2_words"),
    "j3_package_words": with_fixtures("""SELECT clip_id, ' ' || word AS word, CAST(count(*) AS BIGINT) AS n,
        CAST(sum(length(word) + 1) AS BIGINT) AS n_chars, round(sum(probability), 6) AS sum_prob FROM f2_words GROUP BY clip_id, word""", "f2_words"),
    "a1_word_confidence": _timing_sql("SELECT clip_id, round(coalesce(mw, 0.0), 6) AS mean_word_prob, round(coalesce(nw, 0.0), 6) AS min_word_prob FROM t"),
    "a2_low_confidence": _timing_sql("SELECT clip_id, round(coalesce(lc, 0.0), 6) AS low_conf_ratio FROM t"),
    "a3_segment_confidence": _timing_sql("SELECT clip_id, round(coalesce(lp, 0.0), 6) AS avg_logprob, round(coalesce(ns, 0.0), 6) AS no_speech_prob FROM t"),
    "a3_segment_confidence_notebook": _timing_sql("SELECT clip_id, round(coalesce(lp_nb, -1.0), 6) AS avg_logprob, round(coalesce(ns_nb, 0.0), 6) AS no_speech_prob FROM t"),
    "a4_confidence_view": with_fixtures("""SELECT clip_id, round(avg(probability), 6) AS whisper_mean_word_prob,
        round(min(probability), 6) AS whisper_min_word_prob,
        round(avg(CASE WHEN probability < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS whisper_low_conf_ratio FROM f2_words GROUP BY clip_id""", "f2_words"),
    "w1_word_gaps": with_fixtures("""SELECT clip_id, ord, round(lead(start_s) OVER (PARTITION BY clip_id ORDER BY ord) - end_s, 6) AS gap
        FROM f2_words""", "f2_words"),
    "w2_pause_counts": _timing_sql("SELECT clip_id, CAST(coalesce(p03, 0) AS BIGINT) AS pause_count_03, CAST(coalesce(p05, 0) AS BIGINT) AS pause_count_05 FROM t"),
    "w3_pause_lengths": _timing_sql("SELECT clip_id, round(coalesce(mp, 0.0), 6) AS mean_pause_len, round(coalesce(xp, 0.0), 6) AS max_pause_len FROM t"),
    "w4_speech_duration": _timing_sql("SELECT clip_id, round(speech / dur, 6) AS speech_time_ratio, round(nwd / greatest(speech, 0.1), 6) AS articulation_rate FROM t"),
    "w5_speech_rate": _timing_sql("SELECT clip_id, round(nwd / dur * 60.0, 6) AS wpm FROM t"),
    "w6_w7_timing_features": _timing_sql("""SELECT clip_id, round(nwd / dur * 60.0, 6) AS wpm, round(nwd / greatest(speech, 0.1), 6) AS articulation_rate,
        CAST(coalesce(p03, 0) AS BIGINT) AS pause_count_03, CAST(coalesce(p05, 0) AS BIGINT) AS pause_count_05,
        round(coalesce(mp, 0.0), 6) AS mean_pause_len, round(coalesce(xp, 0.0), 6) AS max_pause_len,
        round(speech / dur, 6) AS speech_time_ratio, round(coalesce(mw, 0.0), 6) AS whisper_mean_word_prob,
        round(coalesce(nw, 0.0), 6) AS whisper_min_word_prob, round(coalesce(lc, 0.0), 6) AS whisper_low_conf_ratio,
        round(coalesce(lp, 0.0), 6) AS whisper_avg_logprob, round(coalesce(ns, 0.0), 6) AS whisper_no_speech_prob FROM t"""),
}
