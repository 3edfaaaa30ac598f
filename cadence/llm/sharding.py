"""Operator 1, native: hierarchical weighted hash tree (region, rack, shard).

A key descends the tree. At each level every child of the chosen node draws ``-ln(u) / weight`` with ``u``
from md5 of (key, child path), and the smallest draw wins, so a child is chosen in proportion to its weight
and a draw depends on nothing but the key and the child itself. A node's weight is the sum of its leaves.
When leaf weights change, draws change only for nodes on the path to those leaves: rows move only into a
subtree that grew or out of one that shrank. A shard added as a subtree of its own (``grown``) leaves all
other weights alone, so it takes rows only into itself (law ``key``).

Everything is a column expression (one array transform per level, indexed by the chosen parent), so the
assignment needs no shuffle. Only the gapless slot does: rows are numbered within (shard, md5 bucket) and the
bucket counts (at most shards x 4096 rows) give each bucket's first slot, so a shard never sits in one task.

Edge cases: a NULL key is the key ``null``; a NULL text has no bytes (size 1, crc32 0); repeated keys get the
same shard and different slots (among identical rows the slot order is arbitrary); an empty table gives no
rows. Extra columns are ignored by ``shard_documents`` and carried whole by ``shard_rows``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import md5_unit, packed

BUCKET_DIGITS = 3


@dataclass(frozen=True)
class Leaf:
    """One shard of the tree; ``weight`` is its share of the keys relative to the others."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, shards_per_rack: int = 2, racks_per_region: int = 2) -> list[Leaf]:
    """Shards 0 .. n-1 of weight 1, filled rack by rack and region by region."""
    return [Leaf(f"r{i // (shards_per_rack * racks_per_region)}", f"k{i // shards_per_rack}", i) for i in range(shards)]


def grown(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, alone in a rack and a region of its own."""
    new = max(leaf.shard for leaf in tree) + 1
    return [*tree, Leaf(f"r+{new}", f"k+{new}", new, weight)]


def _draw(key: Column, child: Column) -> Column:
    return -F.log(md5_unit(F.concat(key, F.lit("|"), child["path"]))) / child["weight"]


def _descend(key: Column, children: Column) -> Column:
    """Index carried by the child with the smallest draw; ties go to the smaller index."""
    return F.array_min(F.transform(children, lambda c: F.struct(_draw(key, c).alias("draw"), c["at"].alias("at"))))["at"]


def _literal(children: list[tuple[str, float, int]]) -> Column:
    return F.array(*[F.struct(F.lit(p).alias("path"), F.lit(float(w)).alias("weight"), F.lit(i).alias("at"))
                     for p, w, i in children])


def shard_of(key: Column, tree: Sequence[Leaf]) -> Column:
    """Shard of each key; the literal tree is as large as the number of shards, not of rows."""
    if any(leaf.weight <= 0 for leaf in tree) or len({leaf.shard for leaf in tree}) != len(tree):
        raise ValueError("leaves need positive weights and distinct shard numbers")
    regions = list(dict.fromkeys(leaf.region for leaf in tree))
    racks = list(dict.fromkeys((leaf.region, leaf.rack) for leaf in tree))
    weight = lambda match: sum(leaf.weight for leaf in tree if match(leaf))
    top = _literal([(r, weight(lambda x, r=r: x.region == r), i) for i, r in enumerate(regions)])
    by_region = F.array(*[_literal([(f"{r}/{k}", weight(lambda x, r=r, k=k: (x.region, x.rack) == (r, k)), i)
                                    for i, (q, k) in enumerate(racks) if q == r]) for r in regions])
    by_rack = F.array(*[_literal([(f"{r}/{k}/{x.shard}", x.weight, x.shard) for x in tree if (x.region, x.rack) == (r, k)])
                        for r, k in racks])
    key = F.coalesce(key.cast("string"), F.lit("null"))
    region = _descend(key, top)
    rack = _descend(key, F.element_at(by_region, region + 1))
    return _descend(key, F.element_at(by_rack, rack + 1))


def with_slots(df: DataFrame, shard: str, key: str, slot: str, ties: Sequence[str] = ()) -> DataFrame:
    """Adds a gapless position from 0 within ``shard``, in md5 order of ``key``."""
    order = F.md5(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("null")), "UTF-8"))
    rows = df.withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    counts = rows.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(shard, "_bucket", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_first"))
    within = Window.partitionBy(shard, "_bucket").orderBy("_order", key, *ties)
    rows = rows.withColumn("_at", F.row_number().over(within))
    return (rows.join(F.broadcast(first), [shard, "_bucket"])  # at most shards x 4096 rows
            .withColumn(slot, (F.col("_first") + F.col("_at") - 1).cast("long")).drop("_order", "_bucket", "_at", "_first"))


def shard_documents(docs: DataFrame, tree: Sequence[Leaf]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       shard_of(F.col("doc_id"), tree).alias("shard"), shard_of(F.col("doc_id"), grown(tree)).alias("grown_shard"))
    out = with_slots(rows, "shard", "doc_id", "slot", ["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
                      F.col("grown_shard").cast("int").alias("grown_shard"))


def shard_rows(df: DataFrame, tree: Sequence[Leaf], key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """Every row with all its columns and its shard (replacing a column of that name)."""
    rows = packed(df, chosen=shard_of(df[f"`{key}`"], tree).cast("int"))
    return rows.select(*[F.col("row")[c].alias(c) for c in df.columns if c != shard], F.col("chosen").alias(shard))
