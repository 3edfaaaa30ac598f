"""Timed-word operators: JSON and nested word lists (J1-J3), ASR confidence (A1-A4), speech timing.

Words are a long table keyed ``(clip keys..., ord)`` with ``ord`` dense from 0. A clip is cut into blocks of
``BLOCK_WORDS`` positions: the next word is a ``lead`` inside the block, so a clip with millions of words spans many tasks
and the word table is shuffled once; only the gap from a block's last word to the next block's first takes a look
at the neighbour, one row per block. Per-clip results are sums of per-block results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions.text import floor_at

WORD_STRUCT = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("start", T.DoubleType()),
    T.StructField("end", T.DoubleType()),
    T.StructField("probability", T.DoubleType()),
])
# JSON word records: the package writes `probability`, the notebook writes `prob` (J3 accepts both).
_WORD_JSON_IN = T.ArrayType(T.StructType(list(WORD_STRUCT.fields) + [T.StructField("prob", T.DoubleType())]))
SEGMENT_STRUCT = T.StructType([
    T.StructField("avg_logprob", T.DoubleType()),
    T.StructField("no_speech_prob", T.DoubleType()),
    T.StructField("words", T.ArrayType(WORD_STRUCT)),
])

# Reference thresholds and defaults (fixed values).
PAUSE_SHORT = 0.3
PAUSE_LONG = 0.5
LOW_CONFIDENCE = 0.5
MIN_CLIP_SECONDS = 1.0
MIN_SPEECH_SECONDS = 0.1
ONE_WORD_SPEECH_SHARE = 0.8

BLOCK_WORDS = 4096


def _default_word(w: Column) -> Column:
    return F.struct(
        F.coalesce(w["word"], F.lit("")).alias("word"),
        F.coalesce(w["start"], F.lit(0.0)).alias("start"),
        F.coalesce(w["end"], F.lit(0.0)).alias("end"),
        F.coalesce(w["probability"], F.lit(0.0)).alias("probability"))


def flatten_words(df: DataFrame, keys: Sequence[str], segments: str = "segments",
                  base: str | None = None) -> DataFrame:
    """Nested segments -> one row per word in order, with per-field defaults.

    ``base`` (optional) is the position of the row's first word inside its clip, for sources that store a
    long clip as several bounded chunks; the word position is then ``base + index``. Narrow: no shuffle.
    """
    flat = F.flatten(F.transform(F.col(segments), lambda s: F.coalesce(s["words"], F.array().cast(T.ArrayType(WORD_STRUCT)))))
    flat = F.transform(flat, _default_word)
    out = df.select(*keys, *( [base] if base else []), F.posexplode(flat).alias("_i", "w"))
    ord_col = (F.col(base) + F.col("_i")) if base else F.col("_i")
    return out.select(*keys, ord_col.cast("bigint").alias("ord"), F.col("w.word").alias("word"),
                      F.col("w.start").alias("start_s"), F.col("w.end").alias("end_s"),
                      F.col("w.probability").alias("probability"))


def words_to_json(words: Column) -> Column:
    """Word array -> JSON text."""
    return F.to_json(words)


def words_from_json(text: Column, trim: bool = True) -> Column:
    """JSON text -> word array; `probability` or `prob` (notebook) both accepted, defaults applied.

    The notebook strips words (``trim``); the package keeps them as the recogniser wrote them, often with a leading space."""
    parsed = F.from_json(text, _WORD_JSON_IN)
    word = lambda w: F.trim(w["word"]) if trim else w["word"]
    return F.transform(parsed, lambda w: F.struct(
        F.coalesce(word(w), F.lit("")).alias("word"),
        F.coalesce(w["start"], F.lit(0.0)).alias("start"),
        F.coalesce(w["end"], F.lit(0.0)).alias("end"),
        F.coalesce(w["probability"], w["prob"], F.lit(0.0)).alias("probability")))


def _in_blocks(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words with their ``_block`` and the start of the next word of the same block (NULL for the block's last)."""
    blocked = words.withColumn("_block", F.floor(F.col("ord") / BLOCK_WORDS).cast("bigint"))
    after = F.lead(F.struct("ord", "start_s")).over(Window.partitionBy(*keys, "_block").orderBy("ord"))
    nxt = F.when(F.col("_after.ord") == F.col("ord") + 1, F.col("_after.start_s"))
    return blocked.withColumn("_after", after).withColumn("_next", nxt).drop("_after")


def word_gaps(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every word with ``gap`` = next word's start - this word's end (NULL for the last word)."""
    blocked = _in_blocks(words, keys)
    # the first word of every later block, under the block before it: one row per block, met where the block already is
    heads = words.where((F.col("ord") > 0) & (F.col("ord") % BLOCK_WORDS == 0)).select(
        *keys, (F.floor(F.col("ord") / BLOCK_WORDS) - 1).cast("bigint").alias("_block"), F.col("start_s").alias("_head"))
    last = F.col("ord") % BLOCK_WORDS == BLOCK_WORDS - 1
    j = blocked.join(heads, [*keys, "_block"], "left")
    return j.withColumn("gap", F.coalesce(F.col("_next"), F.when(last, F.col("_head"))) - F.col("end_s")).select(*words.columns, "gap")


def word_aggregates(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A1, A2 and W2-W4 per clip: partial sums per block, then the gaps between blocks and the clip's sums."""
    gap = F.col("_next") - F.col("end_s")
    pause = F.when(gap > PAUSE_SHORT, gap)
    blocks = _in_blocks(words, keys).groupBy(*keys, "_block").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("start_s", "ord").alias("head"), F.max_by(F.struct("ord", "end_s"), "ord").alias("tail"),
        F.min("ord").alias("first"),
        F.sum(F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.0))).alias("speech"),
        F.count_if(gap > PAUSE_SHORT).alias("n03"), F.count_if(gap > PAUSE_LONG).alias("n05"),
        F.sum(pause).alias("sum_pause"), F.max(pause).alias("max_pause"),
        F.sum("probability").alias("sum_p"), F.count("probability").alias("n_p"), F.min("probability").alias("min_p"),
        F.count_if(F.col("probability") < LOW_CONFIDENCE).alias("n_low"))
    after = F.lead(F.struct("first", "head")).over(Window.partitionBy(*keys).orderBy("_block"))
    edge = F.when(F.col("_after.first") == F.col("tail.ord") + 1, F.col("_after.head")) - F.col("tail.end_s")
    long_edge = F.when(F.col("_edge") > PAUSE_SHORT, F.col("_edge"))
    pauses = F.sum("n03") + F.count_if(F.col("_edge") > PAUSE_SHORT)
    return blocks.withColumn("_after", after).withColumn("_edge", edge).groupBy(*keys).agg(
        F.sum("n").alias("n_word_rows"),
        F.sum("speech").alias("speech_sum"),
        pauses.alias("pause_count_03"),
        (F.sum("n05") + F.count_if(F.col("_edge") > PAUSE_LONG)).alias("pause_count_05"),
        ((F.coalesce(F.sum("sum_pause"), F.lit(0.0)) + F.coalesce(F.sum(long_edge), F.lit(0.0))) / F.nullif(pauses, F.lit(0))).alias("mean_pause_len"),
        F.greatest(F.max("max_pause"), F.max(long_edge)).alias("max_pause_len"),
        (F.sum("sum_p") / F.nullif(F.sum("n_p"), F.lit(0))).alias("mean_word_prob"),
        F.min("min_p").alias("min_word_prob"),
        (F.sum("n_low") / F.nullif(F.sum("n_p"), F.lit(0))).alias("low_conf_ratio"))


def segment_confidence(segments: DataFrame, keys: Sequence[str], mode: str = "package") -> DataFrame:
    """A3: mean segment avg_logprob / no_speech_prob per clip.

    package: segments lacking a field are skipped. notebook: a missing field counts as 0.0.
    Defaults when a clip has no (usable) segments are applied by :func:`timing_features`.
    """
    lp, ns = F.col("avg_logprob"), F.col("no_speech_prob")
    if mode == "notebook":
        lp, ns = F.coalesce(lp, F.lit(0.0)), F.coalesce(ns, F.lit(0.0))
    return segments.groupBy(*keys).agg(F.avg(lp).alias("seg_avg_logprob"), F.avg(ns).alias("seg_no_speech_prob"),
                                       F.count(F.lit(1)).alias("n_segments"))


def timing_features(clips: DataFrame, words: DataFrame, keys: Sequence[str],
                    segments: DataFrame | None = None, n_words_col: str = "n_words",
                    duration_col: str = "trimmed_dur", mode: str = "package") -> DataFrame:
    """W2-W7 + A1-A4 per clip, over the clip spine (clips without words get the reference defaults).

    ``n_words_col`` is the transcript word count (not the word-list length); ``duration_col`` the trimmed
    clip duration in seconds.
    """
    agg = word_aggregates(words, keys)
    spine = clips.select(*keys, F.col(n_words_col).alias("_nw"), F.col(duration_col).alias("_dur"))
    j = spine.join(agg, list(keys), "left")
    if segments is not None:
        j = j.join(segment_confidence(segments, keys, mode), list(keys), "left")
    dur = floor_at(F.col("_dur"), MIN_CLIP_SECONDS)
    nw = F.greatest(F.col("_nw"), F.lit(1)).cast("double")
    n = F.coalesce(F.col("n_word_rows"), F.lit(0))
    speech = F.when(n <= 1, dur * ONE_WORD_SPEECH_SHARE).otherwise(F.col("speech_sum"))
    no_logprob = -1.0 if mode == "notebook" else 0.0
    cols = [
        *[F.col(k) for k in keys],
        (nw / dur * 60.0).alias("wpm"),
        (nw / F.greatest(speech, F.lit(MIN_SPEECH_SECONDS))).alias("articulation_rate"),
        F.coalesce(F.col("pause_count_03"), F.lit(0)).cast("bigint").alias("pause_count_03"),
        F.coalesce(F.col("pause_count_05"), F.lit(0)).cast("bigint").alias("pause_count_05"),
        F.coalesce(F.col("mean_pause_len"), F.lit(0.0)).alias("mean_pause_len"),
        F.coalesce(F.col("max_pause_len"), F.lit(0.0)).alias("max_pause_len"),
        (speech / dur).alias("speech_time_ratio"),
        F.coalesce(F.col("mean_word_prob"), F.lit(0.0)).alias("whisper_mean_word_prob"),
        F.coalesce(F.col("min_word_prob"), F.lit(0.0)).alias("whisper_min_word_prob"),
        F.coalesce(F.col("low_conf_ratio"), F.lit(0.0)).alias("whisper_low_conf_ratio"),
    ]
    if segments is not None:
        cols += [F.coalesce(F.col("seg_avg_logprob"), F.lit(no_logprob)).alias("whisper_avg_logprob"),
                 F.coalesce(F.col("seg_no_speech_prob"), F.lit(0.0)).alias("whisper_no_speech_prob")]
    return j.select(*cols)


def with_prefix(df: DataFrame, names: Sequence[str], prefix: str = "whisper_") -> DataFrame:
    """A4: pass confidence columns into another view under a prefix."""
    return df.withColumnsRenamed({n: prefix + n for n in names if not n.startswith(prefix)})


def chunk_segments(words: DataFrame, keys: Sequence[str], segments: DataFrame,
                   segment_size: int = 10, chunk_segments_n: int = 10) -> DataFrame:
    """Nested form of a long word table: one row per chunk of at most ``chunk_segments_n`` segments.

    Each group collected here holds at most ``segment_size`` words (then ``chunk_segments_n`` segments),
    so no group grows with the data. Used to produce nested inputs for J1-J3.
    """
    seg_no = F.floor(F.col("ord") / segment_size).cast("bigint")
    w = words.withColumn("seg_no", seg_no)
    per_seg = w.groupBy(*keys, "seg_no").agg(F.sort_array(F.collect_list(F.struct(
        "ord", F.col("word"), F.col("start_s").alias("start"), F.col("end_s").alias("end"),
        F.col("probability")))).alias("_w"))
    per_seg = per_seg.join(segments, [*keys, "seg_no"], "left")
    per_seg = per_seg.select(*keys, "seg_no", F.struct(
        F.col("avg_logprob"), F.col("no_speech_prob"),
        F.transform("_w", lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"),
                                              x["end"].alias("end"), x["probability"].alias("probability"))).alias("words")
    ).alias("seg"))
    chunk = F.floor(F.col("seg_no") / chunk_segments_n).cast("bigint")
    per_chunk = per_seg.groupBy(*keys, chunk.alias("chunk_no")).agg(
        F.sort_array(F.collect_list(F.struct("seg_no", "seg"))).alias("_s"))
    return per_chunk.select(
        *keys, "chunk_no",
        (F.col("chunk_no") * (segment_size * chunk_segments_n)).alias("base"),
        F.transform("_s", lambda x: x["seg"]).alias("segments"))
