"""Operator 4: mix sources to target weights by hash-random keys, prefix sums and exact cuts.

1. One row per source: size (words), rank by code point (NULL last), weight, capacity. Water-filling gives the
   targets: sources in the order of capacity / weight, each full one takes its capacity, the rest share what is
   left by weight. This table has one row per source.
2. Each document gets a hash-random key (md5 of its id). Keys are uniform, so equal key ranges (the first three
   hex digits) cut every source into 4096 even buckets: a window sums sizes within (source, bucket), and the
   bucket totals (at most sources x 4096 rows) are summed in front. A source holding a third of the corpus is
   4096 small groups, never one task.
3. The whole epochs of the budget take every document; the rest of it is cut at the exact word on the prefix sum,
   so the document at the cut is taken in part.

Edge cases: NULL text has size 0 and is never taken; a NULL source is a source of its own, ranked last; a NULL
doc_id is the key ``null``; repeated rows are rows of their own (ties in key order by id, then size); a source
of size 0 has target 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import packed

# fixed values: the word rule of the contract
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
BUCKET_DIGITS = 3
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never NULL; sorts by code point with NULL last."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
            most: int = MOST_EPOCHS) -> DataFrame:
    """(src, source_size) to (src, source_size, target): water-filling over the sources, one row each."""
    rank = Window.orderBy("src")
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    all_rows = Window.partitionBy(F.lit(1))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    s = (s.withColumn("total", F.sum("source_size").over(all_rows) * F.lit(float(share)))
         .withColumn("cap_before", F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
         .withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))))
    s = s.withColumn("full", F.col("cap") <= (F.col("total") - F.col("cap_before")) * F.col("weight") / F.col("weight_left"))
    spent = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(all_rows)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(all_rows)
    return s.withColumn("spent", spent).withColumn("open_weight", open_weight).select(
        "src", "source_size",
        F.when(F.col("full"), F.col("cap")).otherwise((F.col("total") - F.col("spent")) * F.col("weight") / F.col("open_weight")).alias("target"))


def _taken(rows: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """rows: id, src, size and what else is carried; adds source_size, target, taken."""
    order = F.md5(F.encode(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), "UTF-8"))
    rows = rows.withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    totals = rows.groupBy("src", "_bucket").agg(F.sum("size").alias("_n"))
    upto = Window.partitionBy("src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    goal = targets(totals.groupBy("src").agg(F.sum("_n").alias("source_size")), weights, share, most)
    first = (totals.withColumn("_first", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
             .join(goal, "src").select("src", "_bucket", "_first", "source_size", "target"))
    within = Window.partitionBy("src", "_bucket").orderBy("_order", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_before", F.sum("size").over(within) - F.col("size")).join(first, ["src", "_bucket"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("_first") - F.col("_before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return rows.withColumn("taken", taken.cast("long")).drop("_order", "_bucket", "_before", "_first")


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                  most: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").alias("id"), source_key(F.col("source")).alias("src"), word_count(F.col("text")).alias("size"))
    return _taken(rows, weights, share, most).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
               most: int = MOST_EPOCHS) -> DataFrame:
    """The mix itself: every taken document with all its columns, once per epoch; the last repeat of the document
    at a source's cut holds only the words taken of it (white space before each word kept)."""
    rows = packed(docs, id=docs["`doc_id`"], src=source_key(docs["`source`"]), size=word_count(docs["`text`"]))
    out = _taken(rows, weights, share, most).where(F.col("taken") > 0)
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(r"([\x20\x09-\x0D]*" + WORD + ")"), F.lit(1)), F.lit(1), words.cast("int")), "")
    text = F.when(words < F.col("size"), head).otherwise(F.col("row.text"))
    kept = {"text": text, **({"n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})}
    return out.select(*[kept.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
