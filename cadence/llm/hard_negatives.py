"""Operator 13: hard negatives from Hilbert-ordered blocks with zone maps.

Components become integers floor(256 c); a score is the integer inner product with the anchor, so every comparison is exact.
Candidates are ordered by (label, Hilbert index, id), the index taken over the dimensions of largest spread, and written as Parquet blocks of
``BLOCK_ROWS`` rows, each with its label range and the minimum and maximum of every dimension (its zone map). Anchors are cut into packs
in the same order. Three steps, each over (pack, block) pairs chosen by interval arithmetic, never over pairs of rows:

1. an anchor's own block gives a first set of same-label scores, whose last one is a lower bound of its last positive;
2. all blocks that may hold its label and whose upper bound reaches that score are read for the positives;
3. every positive's score p sets a window low * p <= 100 s <= high * p; all blocks that may hold another label and whose bounds meet one
   of the anchor's windows are read, and the best of each window stay.

Bounds of a pack against many zone maps are two matrix products per cell of (``CELL_ZONES`` zones, ``CELL_PACKS`` packs); a chosen pair
carries its anchors' vectors to the block, so blocks are shuffled once a step and never copied. Each pair returns at most the wanted
number per anchor or window, and the best overall are picked by a rank whose limit is pushed below the shuffle.

Edge cases: rows with a NULL id, a NULL label, a NULL or empty vector, or one with a NULL, non-finite or too large entry take no part, nor do
those of another length than the most frequent one (the longer of two equally frequent); repeated rows are rows of their own, also as
anchors (an anchor is never its own positive, its copy is); ties go to the smaller id; a negative positive score has no window (30 p > 90 p); an
anchor without positives, or a window without rows, returns nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import written
from cadence.llm.int_vectors import exact_products, pack_block, pack_rows, unpack_block, unpack_rows, vectors_of

BLOCK_ROWS = 2048
PACK_ANCHORS = 256
CELL_ZONES, CELL_PACKS = 512, 32
TASK_BLOCKS = 64
CURVE_DIMS, CURVE_BITS = 16, 4
NONE = -(2 ** 63 - 1)          # no score; its negative is a long too


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of grid points (rows x dimensions, entries below 2^bits; dimensions x bits at most 64), by the
    published transform of axes to the transposed index (Skilling 2004)."""
    x = [axes[:, i].astype(np.uint64) for i in range(axes.shape[1])]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(len(x)):
            hit = (x[i] & q) != 0
            swap = np.where(hit, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(axes), np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(b)) & one == one, np.uint64((1 << b) - 1), np.uint64(0))
    out = np.zeros(len(axes), np.uint64)
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = (out << one) | (((v ^ flip) >> np.uint64(b)) & one)
    return out


# ---- blocks and packs -------------------------------------------------------------------------------


def _rows(vectors: DataFrame) -> DataFrame:
    """(id, label, anchor, width, x) of the rows that take part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, width, flat = vectors_of(batch.column("embedding"))
            at, w = np.flatnonzero(valid), width[valid]
            begin = np.cumsum(w) - w
            for one in np.unique(w):
                own = np.flatnonzero(w == one)
                x = flat[begin[own][:, None] + np.arange(one)]
                take = pa.array(at[own])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("id", "label", "anchor")), pa.array([int(one)] * len(own), pa.int32()),
                                                  pa.array(pack_rows(x), pa.binary())], ["id", "label", "anchor", "width", "x"])

    known = vectors.where("id IS NOT NULL AND label IS NOT NULL")
    return written(known.mapInArrow(run, "id long, label long, anchor boolean, width int, x binary"), "negatives-rows", "zstd")


def _spread(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, deviation) of every dimension, from per-task sums; they only place rows on the curve."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.zeros((3, width))
        for batch in batches:
            x = unpack_rows(batch.column("x").to_pylist(), width).astype(np.float64)
            t += [np.full(width, float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(3 * width)), pa.array(t.reshape(-1))], ["cell", "v"])

    t = np.zeros(3 * width)
    for r in rows.select("x").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        t[r["cell"]] = r["v"]
    n, s, q = t.reshape(3, width)
    n = np.maximum(n, 1)
    return s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))


def _with_curve(rows: DataFrame, width: int) -> DataFrame:
    """``curve``, the Hilbert index over the dimensions of largest deviation, two deviations either way from the mean."""
    mean, deviation = _spread(rows, width)
    dims = np.sort(np.argsort(-deviation, kind="stable")[:CURVE_DIMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpack_rows(batch.column("x").to_pylist(), width)[:, dims]
            step = np.maximum(deviation[dims], 1e-9) * 4 / (1 << CURVE_BITS)
            grid = np.clip(np.floor((x - mean[dims]) / step) + (1 << (CURVE_BITS - 1)), 0, (1 << CURVE_BITS) - 1)
            index = hilbert_index(grid.astype(np.int64), CURVE_BITS) ^ np.uint64(1 << 63)       # unsigned order as signed longs
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "anchor", "x")), pa.array(index.view(np.int64))], ["id", "label", "anchor", "x", "curve"])

    return rows.mapInArrow(run, "id long, label long, anchor boolean, x binary, curve long")


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """One row per block, written as Parquet with its zone map. Inside a block rows are in id order, so ties need no comparison."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= BLOCK_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                yield block((part << 32) | number, table.slice(0, BLOCK_ROWS))
                number, held = number + 1, table.slice(BLOCK_ROWS).to_batches()
        if sum(map(len, held)):
            yield block((part << 32) | number, pa.Table.from_batches(held))

    def block(number: int, t: pa.Table) -> pa.RecordBatch:
        ids, labels = t.column("id").to_numpy(), t.column("label").to_numpy()
        order = np.argsort(ids, kind="stable")
        x = unpack_rows(t.column("x").to_pylist(), width)[order]
        many = lambda v, kind: pa.array([v.tolist()], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), many(ids[order], pa.int64()), many(labels[order], pa.int64()), many(t.column("anchor").to_numpy(zero_copy_only=False)[order], pa.bool_()), pa.array([pack_block(x)], pa.binary()),
             pa.array([int(labels.min())]), pa.array([int(labels.max())]), many(x.min(axis=0), pa.int64()), many(x.max(axis=0), pa.int64())],
            ["block", "ids", "labels", "anchors", "x", "low_label", "high_label", "low", "high"])

    placed = rows.repartitionByRange("label", "curve", "id").sortWithinPartitions("label", "curve", "id")
    return written(placed.mapInArrow(run, "block long, ids array<long>, labels array<long>, anchors array<boolean>, x binary, low_label long, high_label long, low array<long>, high array<long>"),
                   "negatives-blocks", "zstd")


PACK = "pack long, ids array<long>, labels array<long>, blocks array<long>, places array<int>, x binary, floors array<long>"


def _packs(blocks: DataFrame, width: int, positives: int) -> DataFrame:
    """Anchors in block order, with the score that their own block proves for their last positive (step 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            ids, labels, own, places, x, floors = zip(*rows)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | number], pa.int64()), *(pa.array([list(map(int, v))], pa.list_(k)) for v, k in zip((ids, labels, own, places), kinds)),
                 pa.array([pack_block(np.stack(x))], pa.binary()), pa.array([list(map(int, floors))], pa.list_(pa.int64()))], [f.split()[0] for f in PACK.split(", ")])

        for batch in batches:
            for i in range(len(batch)):
                get = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
                at = np.flatnonzero(get("anchors"))
                if not len(at):
                    continue
                ids, labels, x = get("ids"), get("labels"), unpack_block(batch.column("x")[i].as_py(), width)
                scores = exact_products(x[at], x)
                other = (labels[None, :] == labels[at][:, None]) & (np.arange(len(ids))[None, :] != at[:, None])
                scores = np.where(other, scores, NONE)
                floors = -np.partition(-scores, positives - 1, axis=1)[:, positives - 1] if len(ids) >= positives else np.full(len(at), NONE)
                held += list(zip(ids[at], labels[at], [batch.column("block")[i].as_py()] * len(at), at, x[at], floors))
                while len(held) >= PACK_ANCHORS:
                    yield pack(held[:PACK_ANCHORS])
                    number, held = number + 1, held[PACK_ANCHORS:]
        if held:
            yield pack(held)

    few = blocks.select("block", "ids", "labels", "anchors", "x").coalesce(max(1, -(-blocks.count() // TASK_BLOCKS)))   # full packs
    return written(few.mapInArrow(run, PACK), "negatives-packs", "zstd")


# ---- choosing and reading blocks --------------------------------------------------------------------


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the inner products of every row of ``q`` with any vector of every zone [low, high], rounded outward."""
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    low, high = low.astype(np.float64), high.astype(np.float64)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    slack = (np.abs(up) + np.abs(down)) @ np.maximum(np.abs(low), np.abs(high)).T * 1e-12   # 0 where doubles are exact, below one unit
    slack[slack < 0.5] = 0
    return least - slack, most + slack


REQUEST = "block long, pack long, ids_asked array<long>, places array<int>, labels array<long>, own array<int>, x binary, least array<long>, most array<long>"


def _requests(packs: DataFrame, zones: DataFrame, width: int, windows: int, same: bool) -> DataFrame:
    """(pack, block) pairs that the bounds leave, each with the anchors that need it.

    ``packs`` has ``least`` and ``most``: ``windows`` bounds per anchor, one anchor after the other (an empty window has least > most)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {f.split()[0]: [] for f in REQUEST.split(", ")}
        many = lambda t, c: np.stack([v.values.to_numpy() for v in t.column(c)])
        zone = {c: right.column(c).to_numpy() for c in ("block", "low_label", "high_label")}
        low, high = many(right, "low"), many(right, "high")
        for i in range(left.num_rows):
            get = lambda c: left.column(c)[i].values.to_numpy()
            x, labels = unpack_block(left.column("x")[i].as_py(), width), get("labels")
            least, most = get("least").reshape(-1, windows), get("most").reshape(-1, windows)
            lower, upper = bounds(x, low, high)
            a, b = zone["low_label"][None, :], zone["high_label"][None, :]
            own = labels[:, None]
            fits = (a <= own) & (own <= b) if same else (a != own) | (b != own)
            need = np.zeros(fits.shape, bool)
            for k in range(windows):
                need |= (upper >= least[:, k:k + 1]) & (lower <= most[:, k:k + 1]) & (least[:, k:k + 1] <= most[:, k:k + 1])
            need &= fits
            for z in np.flatnonzero(need.any(axis=0)):
                at = np.flatnonzero(need[:, z])
                block = int(zone["block"][z])
                out["block"].append(block)
                out["pack"].append(left.column("pack")[i].as_py())
                out["ids_asked"].append(get("ids")[at].tolist())
                out["places"].append(at.tolist())
                out["labels"].append(labels[at].tolist())
                out["own"].append(np.where(get("blocks")[at] == block, get("places")[at], -1).tolist())
                out["x"].append(pack_block(x[at]))
                out["least"].append(least[at].reshape(-1).tolist())
                out["most"].append(most[at].reshape(-1).tolist())
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    # cells of bounded size: zones of one group against packs of one group; both counts grow with the rows / BLOCK_ROWS and / PACK_ANCHORS
    groups = max(1, -(-zones.count() // CELL_ZONES))
    sets = max(1, -(-packs.count() // CELL_PACKS))
    cell = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    left = packs.withColumn("_set", cell("pack", sets)).withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    right = zones.withColumn("_group", cell("block", groups)).withColumn("_set", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sets - 1).cast("long"))))
    return left.groupBy("_group", "_set").cogroup(right.groupBy("_group", "_set")).applyInArrow(run, REQUEST)


FOUND = "pack long, place int, win int, anchor long, score long, id long"


def _read(requests: DataFrame, blocks: DataFrame, width: int, windows: int, same: bool, most_rows: int) -> DataFrame:
    """Best ``most_rows`` rows per window of every request: (pack, place, win, score, id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                get = lambda c: batch.column(c)[i].values.to_numpy()
                ids, labels, q_labels, own = get("ids"), get("row_labels"), get("labels"), get("own")
                scores = exact_products(unpack_block(batch.column("x")[i].as_py(), width), unpack_block(batch.column("rows")[i].as_py(), width))
                fits = (labels[None, :] == q_labels[:, None]) == same
                inside = np.flatnonzero(own >= 0)
                fits[inside, own[inside]] = False
                least, most = get("least").reshape(-1, windows), get("most").reshape(-1, windows)
                k = min(most_rows, len(ids))
                for w in range(windows):
                    held = np.where(fits & (scores >= least[:, w:w + 1]) & (scores <= most[:, w:w + 1]), scores, NONE)
                    best = _best(held, k)
                    found = np.take_along_axis(held, best, axis=1)
                    r, c = np.nonzero(found != NONE)
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array([batch.column("pack")[i].as_py()] * len(r), pa.int64()), pa.array(get("places")[r], pa.int32()), pa.array([w] * len(r), pa.int32()),
                                                          pa.array(get("ids_asked")[r]), pa.array(found[r, c]), pa.array(ids[best[r, c]])], [f.split()[0] for f in FOUND.split(", ")])

    rows = blocks.select("block", "ids", F.col("labels").alias("row_labels"), F.col("x").alias("rows"))
    found = requests.join(rows, "block").drop("block").mapInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("pack", "place", "win").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most_rows)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` highest scores of each row, the first column of equals first."""
    n = scores.shape[1]
    some = scores[scores != NONE]
    if len(some) and max(abs(int(some.max())), abs(int(some.min()))) < 2 ** 62 // n:
        key = np.where(scores == NONE, NONE, scores * n + (n - 1 - np.arange(n))[None, :])
        return np.argpartition(key, n - k, axis=1)[:, n - k:]
    return np.argsort(np.where(scores == NONE, np.iinfo(np.int64).max, -scores), axis=1, kind="stable")[:, :k]


PACK_WINDOWS = PACK.replace("floors array<long>", "least array<long>, most array<long>")


def _windows(positives: int, low: int, high: int):
    """A pack and its positives to the pack with one window per positive, in rank order; a missing positive is an empty window."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = len(left.column("ids")[0])
        least, most = np.ones(n * positives, object), np.zeros(n * positives, object)
        at = right.column("place").to_numpy().astype(np.int64) * positives + right.column("rank").to_numpy() - 1
        score = right.column("score").to_numpy().astype(object)
        least[at], most[at] = -(-low * score // 100), high * score // 100
        return left.drop_columns(["floors"]).append_column("least", pa.array([least.tolist()], pa.list_(pa.int64()))).append_column("most", pa.array([most.tolist()], pa.list_(pa.int64())))
    return run


# ---- operator ---------------------------------------------------------------------------------------


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from (id, label, embedding, anchor).

    ``low`` and ``high`` are the window in hundredths of the positive's score."""
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = _rows(vectors)
    widths = rows.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not widths:
        return spark.createDataFrame([], schema)
    width = widths[0]["width"]
    blocks = _blocks(_with_curve(rows.where(F.col("width") == width), width), width)
    zones = blocks.select("block", "low_label", "high_label", "low", "high")
    packs = _packs(blocks, width, positives)
    ceiling = F.lit(2 ** 63 - 1)
    first = packs.withColumn("least", F.col("floors")).withColumn("most", F.transform("floors", lambda _: ceiling))
    found = written(_read(_requests(first, zones, width, 1, True), blocks, width, 1, True, positives).select("pack", "place", "score", "id", "rank"), "negatives-positives", "zstd")

    second = packs.groupBy("pack").cogroup(found.groupBy("pack")).applyInArrow(_windows(positives, low, high), PACK_WINDOWS)
    hard = _read(_requests(second, zones, width, positives, False), blocks, width, positives, False, negatives)
    of = found.select("pack", "place", (F.col("rank") - 1).alias("win"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(of, ["pack", "place", "win"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
