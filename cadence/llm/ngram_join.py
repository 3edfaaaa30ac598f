"""Operator 5: n-gram Jaccard join by MinHash LSH banding with exact verification.

1. Every whole text becomes word hashes and five-word shingles (vectorised over Arrow batches): a 128-bit digest of
   its word sequence and a signature of ``TREES`` x ``DEPTH`` MinHash values.
   Rows with the same words are one representative (a partial aggregate), so exact copies cost nothing further.
2. A pair of similarity s meets in a tree at prefix length d with probability s^d. One prefix length serves all trees:
   the longest for which 1 - (1 - t^d)^trees reaches the target recall at the threshold t (6 at the registered values).
   It is fixed from there: the recall estimated from the verified links, all at t or more, cannot fall short of it.
3. Members of a prefix bucket are linked to the bucket's smallest member: one row each, never all pairs. Connected
   components of these links hold every candidate pair.
4. Each component is verified exactly: its shingle sets go to (block, block) groups of at most ``BLOCK`` members a
   side, chosen by hash, and every pair is counted in numpy there. A group returns only sums per member and a
   spanning forest of its links, so a component of m members gives m x blocks rows, not m^2.
5. Components of the verified links are the classes.

Words are runs without white space, lower-cased; fewer than five words are one shingle. A text without words has no
shingles: it is in no link and a class of its own. NULL text is empty; a NULL doc_id takes part and its class is
named by the smallest id in the class (NULL if there is none); repeated rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import mix64, utf8_chunks, words_of, written
from cadence.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.999
TREES, DEPTH = 24, 6
BLOCK = 1024

_RNG = np.random.default_rng(20240501)
_FLIP = _RNG.integers(0, 2 ** 32, TREES * DEPTH, dtype=np.uint32)
_TURN = _RNG.integers(0, 2 ** 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def found(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """Chance that a pair of this similarity shares a prefix of ``depth`` in some tree."""
    return 1.0 - (1.0 - similarity ** depth) ** TREES


def prefix_length(threshold: float, target: float) -> int:
    """The longest prefix that still reaches the target recall at the threshold."""
    for depth in range(DEPTH, 1, -1):
        if found(threshold, depth) >= target:
            return depth
    return 1


def shingles_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of rows in order, first shingle of each row (rows + 1), word hashes, first words."""
    h, _, _, first = words_of(data, offs)
    words = np.diff(first)
    count = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    start = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(words)), count)
    at = first[:-1][row] + (np.arange(start[-1]) - start[:-1][row])
    stop = first[1:][row]
    out = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE - 1, -1, -1):
        nxt = at + j
        out = np.where(nxt < stop, mix64(h[np.minimum(nxt, len(h) - 1)] + mix64(out)) if len(h) else out, out)
    return out, start, h, first


def _digests(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bytes per row from the sequence of its word hashes; rows without words get zeros."""
    out = np.zeros((len(first) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        for k, salt in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
            out[full, k] = np.add.reduceat(mix64(h ^ mix64(place.astype(np.uint64) + np.uint64(salt))), first[full])
    return out


def _signatures(sh: np.ndarray, start: np.ndarray) -> np.ndarray:
    """rows x (TREES * DEPTH) uint32 minima; every row has a shingle."""
    low = (sh >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(start) - 1, TREES * DEPTH), np.uint32)
    for k in range(TREES * DEPTH):
        out[:, k] = np.minimum.reduceat((low ^ _FLIP[k]) * _TURN[k], start[:-1])
    return out


def _fixed(rows: np.ndarray, width: int) -> pa.Array:
    raw = np.ascontiguousarray(rows)
    offs = np.arange(0, (len(raw) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offs), pa.py_buffer(raw.tobytes())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, n, data, offs in utf8_chunks(batch.column("text")):
            sh, start, h, first = shingles_of(data, offs)
            digest = _digests(h, first)
            full = np.flatnonzero(np.diff(start) > 0)
            sig = _signatures(sh, np.append(start[full], start[-1])) if len(full) else np.zeros((0, TREES * DEPTH), np.uint32)
            blank = np.setdiff1d(np.arange(n), full)
            order = np.concatenate([full, blank])
            sigs = pa.concat_arrays([_fixed(sig, TREES * DEPTH * 4), pa.nulls(len(blank), pa.binary())])
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, n).take(pa.array(order)), _fixed(digest[order], 16), sigs], ["id", "rep", "sig"])


def _buckets(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, TREES, DEPTH)
        key = mix64(np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), (n, TREES)).copy())
        for j in range(depth):
            key = mix64(key + sig[:, :, j])
        rep = batch.column("rep").take(pa.array(np.repeat(np.arange(n), TREES)))
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), rep], ["bucket", "rep"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the rows whose words still give the digest they are asked for under."""
    for batch in batches:
        for lo, n, data, offs in utf8_chunks(batch.column("text")):
            sh, start, h, first = shingles_of(data, offs)
            digest = [d.tobytes() for d in _digests(h, first)]
            want = batch.column("rep").slice(lo, n).to_pylist()
            same = [i for i in range(n) if digest[i] == want[i]]
            blobs = [np.unique(sh[start[i]:start[i + 1]]).tobytes() for i in same]
            rest = batch.slice(lo, n).take(pa.array(same, pa.int64())).select(["rep", "root", "blocks", "copies"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(blobs, pa.binary())], ["rep", "root", "blocks", "copies", "grams"])


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, left x right, exact: only shingles on both sides, in column chunks."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(common):
        return out

    def placed(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.searchsorted(common, flat)
        col[col == len(common)] = 0
        ok = common[col] == flat
        row, col = row[ok], col[ok]
        order = np.argsort(col, kind="stable")
        return row[order], col[order]

    (ra, ca), (rb, cb) = placed(left, a), placed(right, b)
    step = 4096
    for lo in range(0, len(common), step):
        i, j = np.searchsorted(ca, [lo, lo + step]), np.searchsorted(cb, [lo, lo + step])
        x = np.zeros((len(left), min(step, len(common) - lo)), np.float32)
        y = np.zeros((len(right), x.shape[1]), np.float32)
        x[ra[i[0]:i[1]], ca[i[0]:i[1]] - lo] = 1
        y[rb[j[0]:j[1]], cb[j[0]:j[1]] - lo] = 1
        out += x @ y.T
    return out


VERIFIED = "rep binary, other binary, links long, pairs double, weighed double"


def _verify(pdf: pd.DataFrame, threshold: float, depth: int) -> pd.DataFrame:
    """Links of one (component, block, block) group: sums per member, and a spanning forest as (rep, other)."""
    pdf = pdf.drop_duplicates("rep").sort_values("rep", kind="stable")
    left_at = np.flatnonzero(pdf["own"].to_numpy() == pdf["i"].to_numpy())
    right_at = np.flatnonzero(pdf["own"].to_numpy() == pdf["j"].to_numpy())
    empty = pd.DataFrame({"rep": [], "other": [], "links": [], "pairs": [], "weighed": []})
    if not len(left_at) or not len(right_at):
        return empty
    reps, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(np.int64)
    sets = [np.frombuffer(x, np.uint64) for x in pdf["grams"]]
    same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    size = np.array([len(s) for s in sets], np.float64)
    inter = _shared([sets[k] for k in left_at], [sets[k] for k in right_at]).astype(np.float64)
    sim = inter / (size[left_at][:, None] + size[right_at][None, :] - inter)
    linked = sim >= threshold
    if same:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(reps), np.int64)
    links[left_at] += linked @ copies[right_at]
    if not same:
        links[right_at] += copies[left_at] @ linked
    x, y = np.nonzero(linked)
    value = sim[x, y]
    part = 0.5 if same else 1.0
    parent = np.arange(len(reps))
    forest = []
    for p, q in zip(left_at[x].tolist(), right_at[y].tolist()):
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        while parent[q] != q:
            parent[q] = parent[parent[q]]
            q = parent[q]
        if p != q:
            parent[max(p, q)] = min(p, q)
            forest.append((p, q))
    own = np.flatnonzero(links)
    rows = pd.DataFrame({"rep": reps[own], "other": None, "links": links[own], "pairs": 0.0, "weighed": 0.0})
    if len(own):
        rows.iloc[0, 3:] = [part * len(value), part * float(np.sum(1.0 / found(value, depth)))]
    tree = pd.DataFrame({"rep": [reps[p] for p, _ in forest], "other": [reps[q] for _, q in forest], "links": 0, "pairs": 0.0, "weighed": 0.0})
    return pd.concat([rows, tree]) if len(forest) else rows


def _links(docs: DataFrame, reps: DataFrame, threshold: float, depth: int) -> DataFrame:
    """Verified sums and spanning links (``VERIFIED``) of all candidate components at one prefix length."""
    keys = reps.where("sig is not null").select("rep", "sig").mapInArrow(lambda it: _buckets(it, depth), "bucket long, rep binary")
    keys = written(keys, "op5-buckets")
    many = keys.groupBy("bucket").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "b")
    edges = written(keys.join(many, "bucket").where("rep != b").select(F.col("rep").alias("a"), "b").distinct(), "op5-edges")
    groups = components(edges, "op5-candidates")
    sizes = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = groups.join(sizes, "root").select(F.col("node").alias("rep"), "root", "blocks")
    members = written(members.join(reps.select("rep", "rep_id", "copies"), "rep"), "op5-members")

    texts = docs.select(F.col("id"), F.col("text"))
    wanted = texts.join(members.hint("merge"), F.col("id").eqNullSafe(F.col("rep_id"))).select("rep", "root", "blocks", "copies", "text")
    sets = wanted.mapInArrow(_sets, "rep binary, root binary, blocks int, copies long, grams binary")
    own = sets.withColumn("own", F.pmod(F.hash("rep"), F.col("blocks")))
    pairs = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "rep", "root", "copies", "grams", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    return written(pairs.groupBy("root", "i", "j").applyInPandas(lambda p: _verify(p, threshold, depth), VERIFIED), "op5-verified")


def similar_classes(docs: DataFrame, id_col: Column, text_col: Column, threshold: float = THRESHOLD,
                    target: float = TARGET_RECALL) -> tuple[DataFrame, DataFrame]:
    """(rows, reps): rows (id, rep) for every row of ``docs``; reps (rep, rep_id, copies, class_id, n_links)."""
    texts = docs.select(id_col.cast("long").alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("text"))
    signed = written(texts.mapInArrow(_sign, "id long, rep binary, sig binary"), "op5-signed")
    reps = written(signed.groupBy("rep").agg(F.min("id").alias("rep_id"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")), "op5-reps")
    depth = prefix_length(threshold, target)
    while True:
        verified = _links(texts, reps, threshold, depth)
        pairs, weighed = verified.agg(F.sum("pairs"), F.sum("weighed")).first()
        if depth == 1 or not pairs or pairs >= target * weighed:
            break
        depth -= 1
    roots = components(verified.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")), "op5-classes")
    sums = verified.where("links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
    out = (reps.select("rep", "rep_id", "copies", "sig").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
           .join(sums, "rep", "left").withColumn("root", F.coalesce("root", "rep")))
    named = out.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    out = out.join(named, "root").select("rep", "rep_id", "copies", F.col("sig").isNull().alias("blank"), "class_id",
                                         (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("id", "rep"), written(out, "op5-out")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id it is linked to, through any chain), copy_id (smallest
    doc_id with the same words), n_links (documents whose similarity with it is at least the threshold)."""
    rows, reps = similar_classes(docs, docs["`doc_id`"], docs["`text`"], threshold, target)
    blank = F.col("blank")
    return rows.join(reps, "rep").select(
        F.col("id").alias("doc_id"), F.when(blank, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(blank, F.col("id")).otherwise(F.col("rep_id")).alias("copy_id"),
        F.when(blank, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def keep_one_per_class(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """The documents, all columns, without all but the smallest doc_id of each class (texts without words all stay;
    rows that repeat the kept doc_id are the same document and stay)."""
    from cadence.llm.common import packed

    rows, reps = similar_classes(docs, docs["`doc_id`"], docs["`text`"], threshold, target)
    stays = reps.where(F.col("blank") | F.col("rep_id").eqNullSafe(F.col("class_id")))
    kept = rows.join(stays, "rep").where(F.col("blank") | F.col("id").eqNullSafe(F.col("rep_id")))
    kept = kept.groupBy("id").agg(F.max("blank").alias("blank"))
    named = packed(docs, id=docs["`doc_id`"].cast("long"))
    out = named.join(kept.withColumnRenamed("id", "kept_id"), F.col("id").eqNullSafe(F.col("kept_id")))
    return out.select("row.*")
