"""Derived test views F1-F8 (see FIXTURES.md), built from the driver tables as Spark plans.

Every view reads whole tables. Windows keyed by one entity are replaced by the skew-safe ordinal
(F2) or by positions inside a row's own array (F3), so no group is funnelled into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.text import clean_text
from cadence.operators.ordinal import ordinal_within
from cadence.sources.tables import read_table


# clip and id offsets of the rows that the views add for edge cases
ONE_WORD, NO_WORDS = 1_000_000, 2_000_000
MISSING_X2, SILENT, NO_SIGNAL = 1_000_000_000, 1_000_000, 2_000_000


def f1_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as clips: labelled documents are the train split, the rest test."""
    docs = read_table(spark, d, "documents").select("doc_id", "text", "n_chars")
    labels = read_table(spark, d, "labels").select("doc_id", "quality", "toxic")
    j = docs.join(labels.withColumn("_lab", F.lit(True)), "doc_id", "left")
    label = (F.when(F.col("_lab").isNotNull(),
                    (2 * F.col("quality") + (1 - F.col("toxic"))).cast("double")
                    + (F.col("n_chars") % 1000).cast("double") / 500))
    return j.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("filename"),
        "doc_id",
        F.when(F.col("_lab").isNull(), F.lit("test")).otherwise(F.lit("train")).alias("split"),
        label.alias("label"),
        F.col("text").alias("raw_transcript"),
        F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")).alias("clean_transcript"),
    )


def f2_words(spark: SparkSession, d: str) -> DataFrame:
    """Events as timed words, one clip per user; ord is the skew-safe per-clip position. Edge cases are extra rows:
    the first word of every tenth user again, as a clip of its own."""
    ev = read_table(spark, d, "events").select(
        F.col("user_id").alias("clip_id"), "event_id", "ts", F.col("event_type").alias("word"), "value", "props")
    ranked = ordinal_within(ev, ["clip_id"], ["ts", "event_id"], out="ord", carry_first=["ts"])
    # offsets from the clip's first event, on the zone-free timestamps (independent of the session zone)
    start = F.expr("timestampdiff(MICROSECOND, first_ts, ts)") / F.lit(3e10)
    out = ranked.select(
        "clip_id", "ord", "word",
        start.alias("start_s"),
        (start + (F.col("value") - 5) / 97).alias("end_s"),
        (F.get_json_object("props", "$.k").cast("double") / 97).alias("probability"),
    )
    single = out.where((F.col("clip_id") % 10 == 0) & (F.col("ord") == 0))
    return out.union(single.withColumn("clip_id", F.col("clip_id") + ONE_WORD))


def f2_clips(spark: SparkSession, d: str) -> DataFrame:
    """One clip per user, and for every tenth user a clip of one word and one without words."""
    ev = read_table(spark, d, "events")
    g = ev.groupBy(F.col("user_id").alias("clip_id")).agg(F.count(F.lit(1)).alias("_n"))
    tenth = g.where("clip_id % 10 = 0")
    g = g.union(tenth.withColumn("clip_id", F.col("clip_id") + ONE_WORD)).union(tenth.withColumn("clip_id", F.col("clip_id") + NO_WORDS))
    return g.select(
        "clip_id",
        (F.col("_n") + F.col("clip_id") % 3).alias("n_words"),
        (F.col("_n").cast("double") * 0.75
         - F.when(F.col("clip_id") % 7 == 0, F.lit(1000.0)).otherwise(F.lit(0.0))).alias("trimmed_dur"),
    )


def f2_segments(words: DataFrame) -> DataFrame:
    seg = F.floor(F.col("ord") / 10).cast("bigint")
    g = words.groupBy("clip_id", seg.alias("seg_no")).agg(
        F.avg("probability").alias("_p"), F.min("probability").alias("_m"))
    return g.select("clip_id", "seg_no",
                    F.when(F.col("seg_no") % 4 != 3, -F.col("_p")).alias("avg_logprob"),
                    (F.col("_m") / 10).alias("no_speech_prob"))


def f3_sents(f1: DataFrame) -> DataFrame:
    """Sentences split on '.', empty ones dropped; sent_no is the position among kept sentences."""
    kept = F.filter(F.transform(F.split(F.col("clean_transcript"), r"\."), lambda s: F.trim(s)),
                    lambda s: s != "")
    return f1.select("doc_id", F.posexplode(kept).alias("sent_no", "sent")).select(
        "doc_id", "sent", F.col("sent_no").cast("bigint").alias("sent_no"))


def f3_tokens(sents: DataFrame) -> DataFrame:
    """A synthetic but valid parse: binary-heap heads, tags from token length."""
    t = sents.select("doc_id", "sent_no", F.posexplode(F.split("sent", " ")).alias("tok_no", "text"))
    t = t.withColumn("tok_no", F.col("tok_no").cast("bigint"))
    ln = F.length("text")
    pos = (F.when(ln % 7 == 0, "NOUN").when(ln % 7 == 1, "PRON").when(ln % 7 == 2, "AUX")
           .when(ln % 7 == 3, "ADJ").when(ln % 7 == 4, "ADV").when(ln % 7 == 5, "VERB").otherwise("PROPN"))
    k = (ln + F.col("tok_no")) % 8
    dep = (F.when(k == 0, "nsubj").when(k == 1, "nsubjpass").when(k == 2, "auxpass").when(k == 3, "advcl")
           .when(k == 4, "relcl").when(k == 5, "acl").otherwise("obj"))
    return t.select(
        "doc_id", "sent_no", "tok_no", "text",
        F.when(F.col("tok_no") == 0, F.lit(0).cast("bigint"))
        .otherwise(F.floor((F.col("tok_no") - 1) / 2).cast("bigint")).alias("head_tok"),
        pos.alias("pos"), dep.alias("dep"),
        (ln == 1).alias("is_punct"), F.col("text").rlike("^[a-z]+$").alias("is_alpha"))


def f4_scores(sents: DataFrame) -> DataFrame:
    ln = F.length("sent")
    return sents.select(
        "doc_id", "sent_no", "sent",
        ((ln * 37) % 101).cast("double").alias("_s"), (ln % 130).cast("double").alias("_l"),
    ).select("doc_id", "sent_no", "sent", (F.col("_s") / 97).alias("score"), (F.col("_l") * 10 / 97).alias("loss"))


def f6_reg(spark: SparkSession, d: str) -> DataFrame:
    """One row per order from exact sums (cents, percent) with divisors that give no rounding ties; every eleventh
    order again with x2 missing."""
    li = read_table(spark, d, "lineitem")
    whole = lambda c, k: F.sum(F.round(F.col(c) * k).cast("bigint"))
    n = F.count(F.lit(1))
    g = li.groupBy(F.col("l_orderkey").alias("id")).agg(
        whole("l_extendedprice", 100).alias("_p"), whole("l_quantity", 1).alias("_q"), whole("l_discount", 100).alias("_d"),
        whole("l_tax", 100).alias("_t"), n.alias("_n"))
    ratio = lambda c, k: F.col(c).cast("double") / (F.col("_n") * k).cast("double")
    out = g.select(
        "id", F.least(F.lit(5.0), ratio("_p", 1999700)).alias("y"), ratio("_q", 1).alias("x1"), ratio("_d", 100).alias("x2"),
        ratio("_t", 100).alias("x3"), F.col("_n").cast("double").alias("x4"), F.lit(7.0).alias("x_const"))
    missing = out.where("id % 11 = 0").withColumn("id", F.col("id") + MISSING_X2).withColumn("x2", F.lit(None).cast("double"))
    return out.union(missing)


def f7_preds(f6: DataFrame) -> DataFrame:
    y, i = F.col("y"), F.col("id")
    return f6.select(
        "id", "y",
        (y * 0.8 + 0.5 + (i % 7 - 3).cast("double") * 0.05).alias("p1"),
        (y * 0.6 + 0.9 + (i % 5 - 2).cast("double") * 0.1).alias("p2"),
        (F.lit(2.5) + (i % 11 - 5).cast("double") * 0.2).alias("p3"),
        (y + (i % 13 - 6).cast("double") * 0.3).alias("p4"))


def f5_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    return e.select("vec_id", "embedding", (F.col("label") / 2.0).alias("y"))


def f8_signal(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as padded signals; every fiftieth again as silence and as a missing signal."""
    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("clip_id"), "embedding")
    pad = F.array_repeat(F.lit(0.0), 16)
    out = e.select("clip_id", F.lit(64).alias("sr"), F.concat(pad, F.transform("embedding", lambda x: x.cast("double")), pad).alias("samples"))
    some = out.where("clip_id % 50 = 0")
    silent = some.select((F.col("clip_id") + SILENT).alias("clip_id"), "sr", F.transform("samples", lambda x: F.lit(0.0)).alias("samples"))
    absent = some.select((F.col("clip_id") + NO_SIGNAL).alias("clip_id"), "sr", F.lit(None).cast("array<double>").alias("samples"))
    return out.union(silent).union(absent)


def clean_f1(f1: DataFrame) -> DataFrame:
    """F1 with the package's own text cleaning (P1) alongside the fixture's."""
    return f1.withColumn("clean_a", clean_text(F.col("raw_transcript")))
