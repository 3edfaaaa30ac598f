"""Driver queries for text cleaning (P1-P3, P5, P10) and text-pattern features (T1-T6) over F1.

The Spark side runs the reference's regexes (Java, Unicode classes). DuckDB's RE2 has no
backreferences, so each oracle replays the same leftmost, non-overlapping matching on whitespace tokens:
a candidate at token i is counted when it starts after the text consumed by the previous counted match.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.functions import text as T
from cadence.plans import fixtures as fx
from cadence.plans.common import big, r6
from cadence.plans.oracle_fixtures import with_fixtures


def _f1(spark, d):
    return fx.f1_transcripts(spark, d)


def p1_clean_text(spark, d):
    return _f1(spark, d).select("doc_id", T.clean_text("raw_transcript").alias("clean_text"))


def p2_clean_letters(spark, d):
    return _f1(spark, d).select("doc_id", T.clean_text("raw_transcript", letters_only=True).alias("clean_text"))


def p3_word_count(spark, d):
    f = _f1(spark, d)
    return f.select("doc_id", big(F.size(T.words("clean_transcript")), "n_tokens"),
                    big(T.num_words("clean_transcript"), "num_words"))


def p5_split_filter(spark, d):
    return _f1(spark, d).where(F.col("split") == "train").select("filename", r6("label"))


def p10_text_defaults(spark, d):
    f = _f1(spark, d)
    emb_in = F.coalesce(F.col("raw_transcript"), F.lit(""))
    return f.select("doc_id", T.text_or_default("raw_transcript").alias("parse_input"),
                    big(F.length(emb_in), "embed_input_len"))


def _feats(spark, d):
    f = _f1(spark, d)
    feats = T.text_features(F.col("clean_transcript"))
    return f.select("doc_id", *[c.alias(n) for n, c in feats.items()],
                    T.pattern_count("clean_transcript", [T.EXTRA_SV_PATTERN]).alias("sv_extra"),
                    T.pattern_count("clean_transcript", [T.EXTRA_DOUBLE_PATTERN]).alias("double_extra"))


def t1_sv_errors(spark, d):
    return _feats(spark, d).select("doc_id", big("sv_errors"), big("sv_extra"))


def t2_double_negation(spark, d):
    return _feats(spark, d).select("doc_id", big("double_negations"), big("double_extra"))


def t3_adjacent_repeats(spark, d):
    return _feats(spark, d).select("doc_id", big("adjacent_repeats"))


def t4_error_rate(spark, d):
    return _feats(spark, d).select("doc_id", big("lt_total_errors"), r6("lt_errors_per_100"))


def t5_fillers(spark, d):
    return _feats(spark, d).select("doc_id", big("disfluency_filler_count"), r6("disfluency_filler_rate"))


def t6_repetition_rate(spark, d):
    return _feats(spark, d).select("doc_id", r6("disfluency_repetition_rate"))


QUERIES = {
    "p1_clean_text": p1_clean_text,
    "p2_clean_letters": p2_clean_letters,
    "p3_word_count": p3_word_count,
    "p5_split_filter": p5_split_filter,
    "p10_text_defaults": p10_text_defaults,
    "t1_sv_errors": t1_sv_errors,
    "t2_double_negation": t2_double_negation,
    "t3_adjacent_repeats": t3_adjacent_repeats,
    "t4_error_rate": t4_error_rate,
    "t5_fillers": t5_fillers,
    "t6_repetition_rate": t6_repetition_rate,
}

_W = r"[\p{L}\p{Nd}\p{Nl}\p{Mn}\p{Mc}\p{Me}\p{Pc}]"
_NW = r"[^\p{L}\p{Nd}\p{Nl}\p{Mn}\p{Mc}\p{Me}\p{Pc}]"


def _ends(words: str) -> str:
    return f"'(^|{_NW})({words})$'"


def _starts(words: str) -> str:
    return f"'^({words})({_NW}|$)'"


def _greedy(cond: str, reach: str) -> str:
    return (f"coalesce(list_reduce(list({{'p': i, 'r': {reach}, 'n': CAST(0 AS BIGINT)}} ORDER BY i) FILTER (WHERE {cond}), "
            f"lambda a, x: CASE WHEN x.p > a.r THEN {{'p': x.p, 'r': x.r, 'n': a.n + 1}} ELSE a END, "
            f"{{'p': CAST(-10 AS BIGINT), 'r': CAST(-10 AS BIGINT), 'n': CAST(0 AS BIGINT)}}).n, 0)")


_NEG = "don''t|doesn''t|didn''t|never|cannot"
_TOKENS = rf"""
WITH tok0 AS (SELECT doc_id, unnest(string_split(clean_transcript, ' ')) AS t,
                     unnest(range(len(string_split(clean_transcript, ' ')))) AS i FROM f1_transcripts),
tok AS (SELECT doc_id, i, t, lead(t) OVER w AS t1, lead(t, 2) OVER w AS t2,
               regexp_extract(t, '{_W}+$') AS rw
        FROM tok0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *,
        regexp_full_match(coalesce(t1, ''), '{_W}+') AS aw1, regexp_full_match(coalesce(t2, ''), '{_W}+') AS aw2,
        (rw <> '' AND starts_with(t1, rw) AND (length(t1) = length(rw) OR regexp_matches(substr(t1, length(rw) + 1, 1), '^{_NW}'))) AS rep,
        ((regexp_matches(t, {_ends('he|she|it')}) AND regexp_matches(t1, {_starts('go|have|do|were|are')}))
          OR (regexp_matches(t, {_ends('they|we|you')}) AND regexp_matches(t1, {_starts('is|was|has|goes')}))) AS sv,
        (regexp_matches(t, {_ends('the|of|and')}) AND regexp_matches(t1, {_starts('with|by|in|for')})) AS sv_x,
        (regexp_matches(t, {_ends(_NEG)}) AND regexp_full_match(coalesce(t1, ''), '{_W}+') AND regexp_matches(t2, {_starts('no|nothing|nobody|none')})) AS dn,
        (regexp_matches(t, {_ends('the|of|and')}) AND regexp_full_match(coalesce(t1, ''), '{_W}+') AND regexp_matches(t2, {_starts('the|of|and')})) AS dn_x
      FROM tok),
agg AS (SELECT doc_id,
        CAST(count(*) FILTER (WHERE t <> '') AS BIGINT) AS ntok,
        CAST(count(*) FILTER (WHERE sv) AS BIGINT) AS sv,
        CAST(count(*) FILTER (WHERE sv_x) AS BIGINT) AS sv_x,
        CAST({_greedy('dn', 'CASE WHEN aw2 THEN i + 2 ELSE i + 1 END')} AS BIGINT) AS dn,
        CAST({_greedy('dn_x', 'CASE WHEN aw2 THEN i + 2 ELSE i + 1 END')} AS BIGINT) AS dn_x,
        CAST({_greedy('rep', 'CASE WHEN aw1 THEN i + 1 ELSE i END')} AS BIGINT) AS rep,
        CAST(count(*) FILTER (WHERE t IN ('um', 'uh', 'er', 'ah', 'like', 'mean')) AS BIGINT) AS fill
      FROM c GROUP BY doc_id),
x AS (SELECT *, sv + dn + rep AS total, CAST(greatest(ntok, 1) AS DOUBLE) AS nw FROM agg)
"""


def _t(select: str) -> str:
    return with_fixtures(_TOKENS + select, "f1_transcripts")


ORACLES = {
    "p1_clean_text": with_fixtures(r"SELECT doc_id, trim(regexp_replace(lower(raw_transcript), '\s+', ' ', 'g')) AS clean_text FROM f1_transcripts", "f1_transcripts"),
    "p2_clean_letters": with_fixtures(r"""SELECT doc_id, trim(regexp_replace(lower(regexp_replace(raw_transcript, '[^a-zA-Z\s]', '', 'g')), '\s+', ' ', 'g')) AS clean_text
        FROM f1_transcripts""", "f1_transcripts"),
    "p3_word_count": with_fixtures("""SELECT doc_id, CAST(len(list_filter(string_split(clean_transcript, ' '), lambda x: x <> '')) AS BIGINT) AS n_tokens,
        CAST(greatest(len(list_filter(string_split(clean_transcript, ' '), lambda x: x <> '')), 1) AS BIGINT) AS num_words FROM f1_transcripts""", "f1_transcripts"),
    "p5_split_filter": with_fixtures("SELECT filename, round(label, 6) AS label FROM f1_transcripts WHERE split = 'train'", "f1_transcripts"),
    "p10_text_defaults": with_fixtures("""SELECT doc_id, CASE WHEN raw_transcript IS NULL OR length(raw_transcript) = 0 THEN 'N/A' ELSE raw_transcript END AS parse_input,
        CAST(length(coalesce(raw_transcript, '')) AS BIGINT) AS embed_input_len FROM f1_transcripts""", "f1_transcripts"),
    "t1_sv_errors": _t("SELECT doc_id, sv AS sv_errors, sv_x AS sv_extra FROM x"),
    "t2_double_negation": _t("SELECT doc_id, dn AS double_negations, dn_x AS double_extra FROM x"),
    "t3_adjacent_repeats": _t("SELECT doc_id, rep AS adjacent_repeats FROM x"),
    "t4_error_rate": _t("SELECT doc_id, CAST(total AS BIGINT) AS lt_total_errors, round(total / nw * 100.0, 6) AS lt_errors_per_100 FROM x"),
    "t5_fillers": _t("SELECT doc_id, fill AS disfluency_filler_count, round(fill / nw * 100.0, 6) AS disfluency_filler_rate FROM x"),
    "t6_repetition_rate": _t("SELECT doc_id, round(rep / nw * 100.0, 6) AS disfluency_repetition_rate FROM x"),
}
