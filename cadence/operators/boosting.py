"""Histogram gradient boosting for all folds at once (V8, V9; split counts for I1).

Rows are read once, one per example: every fold model's design features (``B @ w``) are binned with
fold-train quantile sketches, one byte per feature, for the rows that the fold trains. No tree can tell rows of
equal bins apart, so a fold model keeps groups of them, with their number and the sum of their labels; where
no rows fall together there are as many groups as rows. A fold model whose groups fit one task (``FIT_BYTES``) is
grown there, all rounds in one job, the folds side by side. Groups of larger tables stay in blocks: one pass
over them builds gradient histograms for the pending leaves of every fold's
current tree: each task adds into a numpy array bounded by folds x leaves x features x bins and emits it;
the partials are summed per key and the (small) result picks splits on the driver. Leaf values come from
the same sums, so a tree costs one pass per level, shared by all folds, whether it grows leaf by leaf or
level by level. Squared loss: gradient = residual, hessian = 1.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.folds import FULL
from cadence.operators.gram import tree_sum_arrays
from cadence.session import shuffle_partitions


@dataclass
class BoostParams:
    rounds: int
    learning_rate: float
    max_depth: int
    num_leaves: int
    min_leaf: int
    l2: float
    growth: str  # "leaf" (best leaf first) or "depth" (level by level)
    bins: int = 64


BLOCK_BYTES = 4_000_000  # bin ids of a block of rows
FIT_BYTES = 256_000_000  # groups of a fold model that one task fits, with their gradients and what a pass holds of them
GROUP_BYTES = 48        # of a group besides its bin ids
PASS_GROUPS = 1 << 16   # groups that are added up at a time: they stay in a core's cache
PACKED_BYTES = 8        # bin ids of a group that are compared as one number; longer ones are not compared
SKETCHES = 120          # quantile sketches that a task holds at a time
RUN_ROWS = 100_000      # rows that a task sorts at a time for them
GROUP_COLUMNS = ["slot", "part", "m", "bins", "n", "y"]
GROUP_SCHEMA = "slot int, part int, m int, bins binary, n binary, y binary"   # per group its bin ids, number of rows and sum of labels
TABLE_SCHEMA = f"n long, groups array<struct<{', '.join(c.replace(' ', ': ', 1) for c in GROUP_SCHEMA.split(', '))}>>"

# Profiles of the reference's two boosters (library defaults for the unlisted settings).
PROFILES = {
    "a": BoostParams(rounds=120, learning_rate=0.03, max_depth=3, num_leaves=7, min_leaf=20, l2=0.0, growth="leaf"),
    "b": BoostParams(rounds=100, learning_rate=0.03, max_depth=3, num_leaves=8, min_leaf=1, l2=1.0, growth="depth"),
}


@dataclass
class Tree:
    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])   # split value: left if x <= threshold
    bin: list[int] = field(default_factory=lambda: [0])             # same split on bin ids
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    count: list[float] = field(default_factory=lambda: [0.0])
    grad: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def leaf_of(self, Xb: np.ndarray, use_bins: bool = True) -> np.ndarray:
        return np.broadcast_to(_route(_splits(self, use_bins), Xb.T), Xb.shape[:1])

    def predict(self, X: np.ndarray, use_bins: bool) -> np.ndarray:
        return _route(_splits(self, use_bins), X.T, np.asarray(self.value))

    def split(self, node: int, f: int, b: int, thr: float, gain: float, left_stats, right_stats, lr: float, l2: float):
        ids = []
        for g, n in (left_stats, right_stats):
            ids.append(len(self.feature))
            self.feature.append(-1); self.threshold.append(0.0); self.bin.append(0)
            self.left.append(-1); self.right.append(-1)
            self.value.append(lr * g / (n + l2)); self.count.append(n); self.grad.append(g)
            self.depth.append(self.depth[node] + 1); self.gain.append(0.0)
        self.feature[node], self.bin[node], self.threshold[node], self.gain[node] = f, b, thr, gain
        self.left[node], self.right[node] = ids

    def leaves(self) -> list[int]:
        return [i for i, f in enumerate(self.feature) if f < 0]


@dataclass
class BoostedModel:
    base: float
    trees: list[Tree]
    n_features: int

    def predict(self, X: np.ndarray) -> np.ndarray:
        out = np.full(X.shape[0], self.base)
        X = np.asfortranarray(X)                                         # trees compare whole columns
        for t in self.trees:
            out += t.predict(X, use_bins=False)
        return out

    def split_counts(self) -> np.ndarray:
        c = np.zeros(self.n_features)
        for t in self.trees:
            for f in t.feature:
                if f >= 0:
                    c[f] += 1
        return c

    def gain_importance(self) -> np.ndarray:
        c = np.zeros(self.n_features)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    c[f] += g
        return c

    def node_tables(self) -> list[tuple[float, list[dict]]]:
        """Trees in the node format used by the Shapley attributions (values already scaled)."""
        out = []
        for t in self.trees:
            nodes = [{"f": t.feature[i], "thr": t.threshold[i], "l": t.left[i], "r": t.right[i],
                      "v": t.value[i], "cover": t.count[i]} for i in range(len(t.feature))]
            out.append((1.0, nodes))
        return out


def _splits(t: Tree, use_bins: bool = True, node: int = 0):
    """(feature, cut, left, right) nested; a leaf is its node number."""
    if t.feature[node] < 0:
        return _node_type(len(t.feature))(node)
    return (t.feature[node], (t.bin if use_bins else t.threshold)[node], _splits(t, use_bins, t.left[node]), _splits(t, use_bins, t.right[node]))


def _node_type(n: int) -> type:
    return np.uint8 if n <= 256 else np.int32


MOST_TESTS = 8  # splits of a tree whose outcomes fit one byte


def _tests(tree, out: list | None = None) -> list[tuple]:
    """(feature, cut) of every split, parents first."""
    out = [] if out is None else out
    if isinstance(tree, tuple):
        out.append(tree[:2])
        _tests(tree[2], out)
        _tests(tree[3], out)
    return out


@lru_cache(maxsize=4096)
def _outcomes(tree) -> np.ndarray:
    """The leaf entry for every outcome of the splits (bit i: split i of ``_tests`` goes left)."""
    n = len(_tests(tree))

    def leaf(code: int):
        node, at = tree, 0
        while isinstance(node, tuple):
            if code >> at & 1:
                node, at = node[2], at + 1
            else:
                node, at = node[3], at + 1 + len(_tests(node[2]))
        return node

    return np.array([leaf(code) for code in range(1 << n)])


def _route(tree, X: np.ndarray, values: np.ndarray | None = None):
    """The leaf entry, or its entry of ``values``, that each column of ``X`` (features x rows) reaches; one number if the tree is a leaf."""
    tests = _tests(tree)
    if not tests or len(tests) > MOST_TESTS:
        at = _where(tree, X)
        return at if values is None else values[at]
    code = (X[tests[0][0]] <= tests[0][1]).view(np.uint8)
    for i, (f, cut) in enumerate(tests[1:], 1):
        code |= (X[f] <= cut).view(np.uint8) << np.uint8(i)
    leaves = _outcomes(tree)
    return (leaves if values is None else values[leaves])[code]


def _where(tree, X: np.ndarray):
    if not isinstance(tree, tuple):
        return tree
    f, cut, left, right = tree
    return np.where(X[f] <= cut, _where(left, X), _where(right, X))


def _numbered(tree, marks: list):
    """The tree with the place in ``marks`` at its marked leaves and the number of marks at the others."""
    if isinstance(tree, tuple):
        return (*tree[:2], _numbered(tree[2], marks), _numbered(tree[3], marks))
    return _node_type(len(marks) + 1)(len(marks) if tree is None else marks.index(tree))


def _bin_type(bins: int) -> str:
    return "uint8" if bins < 256 else "int32"


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """folds (rows x repeats), y, w (rows x width) of a batch."""
    return (b.column("folds").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1), b.column("y").to_numpy(zero_copy_only=False),
            b.column("w").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1))


def _joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ``_arrays`` of ``most`` rows at a time; what is left at the end may be fewer."""
    held, n = [], 0
    for b in batches:
        at = 0
        while at < len(b):
            part = _arrays(b.slice(at, most - n))
            held.append(part)
            n, at = n + len(part[1]), at + len(part[1])
            if n == most:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _trains(folds: np.ndarray, rf: tuple) -> np.ndarray:
    return np.ones(len(folds), bool) if rf[0] == FULL else folds[:, rf[0]] != rf[1]


def _unpacked(m: int, bins: bytes, n: bytes, y: bytes, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin ids (features x groups), rows and label sums of a record of groups."""
    X = np.frombuffer(bins, dtype)
    return X.reshape(len(X) // m, m), np.frombuffer(n), np.frombuffer(y)


def _keys(X: np.ndarray) -> np.ndarray | None:
    """The bin ids of every group (a column of ``X``) as one number, or None where they are too long."""
    if X.shape[0] * X.itemsize > PACKED_BYTES:
        return None
    packed = np.zeros((X.shape[1], PACKED_BYTES // X.itemsize), X.dtype)
    packed[:, :X.shape[0]] = X.T
    return packed.view(np.uint64)[:, 0]


def _merged(X: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One group for all with the same bin ids, in their order."""
    keys = _keys(X)
    if keys is None or not len(keys):
        return X, n, y
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return X[:, order[first]], np.add.reduceat(n[order], first), np.add.reduceat(y[order], first)


def _part_of(X: np.ndarray, parts: int) -> np.ndarray:
    """The part that every group belongs to; equal bin ids go to the same one."""
    keys = _keys(X)
    if keys is None:
        return np.zeros(X.shape[1], np.int64)
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % parts


def _records(slot: int, part: int, X: np.ndarray, n: np.ndarray, y: np.ndarray) -> Iterator[tuple]:
    """Records of GROUP_COLUMNS, each of a block's bytes at most."""
    most = max(1024, BLOCK_BYTES // max(1, X.shape[0] * X.itemsize))
    for lo in range(0, len(n), most):
        own = slice(lo, lo + most)
        yield slot, part, len(n[own]), X[:, own].tobytes(), n[own].tobytes(), y[own].tobytes()


_GROUP_TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())


def _merge_parts(dtype: str):
    """For mapInArrow: the groups of a task, of every fold model and part those with the same bin ids as one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for slot, part, *record in zip(*(b.column(c).to_pylist() for c in GROUP_COLUMNS)):
                held.setdefault((slot, part), []).append(record)
        for (slot, part), records in held.items():
            for row in _records(slot, part, *_merged(*_together(records, dtype))):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _GROUP_TYPES)], GROUP_COLUMNS)

    return run


def _together(records: list, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [_unpacked(*r, dtype) for r in records]
    return np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def _sums(tree, nodes: int, X: np.ndarray, n: np.ndarray, g: np.ndarray, nb: int) -> np.ndarray:
    """Sums of gradient and rows per (feature, marked node of the tree and bin); the last part takes the groups of no marked node."""
    width = (nodes + 1) * nb
    out = np.zeros((2, len(X), width))
    for lo in range(0, len(n), PASS_GROUPS):
        own = slice(lo, lo + PASS_GROUPS)
        slot = _route(tree, X[:, own])
        start = slot.astype(np.intp) * nb if isinstance(slot, np.ndarray) else int(slot) * nb
        for j in range(len(X)):
            at = X[j, own].astype(np.intp) + start
            out[0, j] += np.bincount(at, weights=g[own], minlength=width)
            out[1, j] += np.bincount(at, weights=n[own], minlength=width)
    return out


def _best_split(hist_g: np.ndarray, hist_n: np.ndarray, p: BoostParams):
    """Best (feature, bin, gain, left, right) for one leaf from its (features x bins) sums."""
    G, N = hist_g[0].sum(), hist_n[0].sum()
    cg, cn = np.cumsum(hist_g, axis=1), np.cumsum(hist_n, axis=1)
    rg, rn = G - cg, N - cn
    ok = (cn >= p.min_leaf) & (rn >= p.min_leaf) & (cn > 0) & (rn > 0)
    parent = G * G / (N + p.l2)
    left, right = np.where(ok, cn + p.l2, 1.0), np.where(ok, rn + p.l2, 1.0)
    gain = np.where(ok, cg * cg / left + rg * rg / right - parent, -np.inf)
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    if not np.isfinite(gain[f, b]) or gain[f, b] <= 1e-12:
        return None
    return int(f), int(b), float(gain[f, b]), (float(cg[f, b]), float(cn[f, b])), (float(rg[f, b]), float(rn[f, b]))


class TreeGrower:
    """Grows a tree for every model of ``keys`` from the sums that ``_pass`` returns."""

    p: BoostParams
    keys: list[tuple]
    edges: dict

    def _pass(self, asked: dict) -> dict:
        """Sums of gradient and rows per (model, asked node, feature, bin); ``asked`` has a model's routing tree and how many nodes it marks."""
        raise NotImplementedError

    def _histograms(self, trees: dict, pending: dict, candidates: dict, paths: dict, known: dict) -> dict:
        """Sums of gradient and rows per (feature, bin) for the pending leaves of each fold.

        A pass that a pending leaf needs also takes the children that the leaves with a known best split would have, so that a leaf-wise
        tree, too, costs one pass a level; ``known`` keeps them by fold and path from the root."""
        if any((rf, paths[rf][lf]) not in known for rf in self.keys for lf in pending[rf]):
            asked, marks = {}, {}
            for rf in self.keys:
                own: list = []
                tree = self._asked(trees[rf], 0, rf, set(pending[rf]), candidates, paths[rf], known, own)
                if own:
                    marks[rf] = own
                    asked[rf] = (_numbered(tree, own), len(own))
            for rf, (g, n) in self._pass(asked).items():
                for i, path in enumerate(marks[rf]):
                    known[rf, path] = (g[:, i], n[:, i])
        out = {}
        for rf in self.keys:
            for lf in pending[rf]:
                h = known.get((rf, paths[rf][lf]))
                if h is not None and h[1][0].any():
                    out[(*rf, lf)] = h
        return out

    def _asked(self, t: Tree, node: int, rf: tuple, pending: set, candidates: dict, paths: dict, known: dict, own: list):
        """(feature, bin, left, right) nested, with a path at the leaves that are asked for and None at the others."""
        if t.feature[node] >= 0:
            return (t.feature[node], t.bin[node], *(self._asked(t, c, rf, pending, candidates, paths, known, own) for c in (t.left[node], t.right[node])))
        path = paths[node]
        if node in pending:
            if (rf, path) in known:
                return None
            own.append(path)
            return path
        best = candidates.get((*rf, node))
        if self.p.growth == "leaf" and best is not None and t.depth[node] + 1 < self.p.max_depth and (rf, path + "l") not in known:
            own += [path + "l", path + "r"]
            return best[0], best[1], path + "l", path + "r"
        return None

    def _threshold(self, rf, f: int, b: int) -> float:
        ed = self.edges[rf][f]
        return float(ed[b]) if b < len(ed) else float("inf")

    def _grow(self) -> dict:
        p = self.p
        trees = {rf: Tree() for rf in self.keys}
        paths: dict = {rf: {0: ""} for rf in self.keys}
        known: dict = {}
        pending = {rf: [0] for rf in self.keys}
        candidates: dict = {}
        first = grown = True
        while grown:                                    # a leaf without children to look at may leave room for the next best
            hist = self._histograms(trees, pending, candidates, paths, known)
            for (r, f, lf), (hg, hn) in hist.items():
                t = trees[(r, f)]
                if first:
                    t.count[0], t.grad[0] = float(hn[0].sum()), float(hg[0].sum())
                best = _best_split(hg, hn, p)
                if best is not None:
                    candidates[(r, f, lf)] = best
            first = grown = False
            pending = {rf: [] for rf in self.keys}
            for rf in self.keys:
                t = trees[rf]
                mine = {lf: c for (r, f, lf), c in candidates.items() if (r, f) == rf}
                if p.growth == "depth":
                    todo = list(mine.items())
                else:
                    room = p.num_leaves - len(t.leaves())
                    todo = sorted(mine.items(), key=lambda kv: -kv[1][2])[:1] if room > 0 else []
                for lf, (fi, bi, gain, lstat, rstat) in todo:
                    if p.growth == "depth" and len(t.leaves()) >= p.num_leaves:
                        break
                    t.split(lf, fi, bi, self._threshold(rf, fi, bi), gain, lstat, rstat, p.learning_rate, p.l2)
                    paths[rf][t.left[lf]], paths[rf][t.right[lf]] = paths[rf][lf] + "l", paths[rf][lf] + "r"
                    # children at the depth limit can never split: no histogram pass for them
                    pending[rf] += [c for c in (t.left[lf], t.right[lf]) if t.depth[c] < p.max_depth]
                    candidates.pop((rf[0], rf[1], lf), None)
                    grown = True
            if p.growth == "leaf":
                for rf in self.keys:
                    if len(trees[rf].leaves()) >= p.num_leaves:
                        pending[rf] = []
        for rf, t in trees.items():  # an unsplit root still carries the mean residual step
            if len(t.feature) == 1:
                t.value[0] = p.learning_rate * t.grad[0] / (t.count[0] + p.l2) if t.count[0] else 0.0
        return trees


class GroupBooster(TreeGrower):
    """One fold model, fitted in a task that holds all its groups."""

    def __init__(self, params: BoostParams, rf: tuple, edges: dict, base: float, X: np.ndarray, n: np.ndarray, y: np.ndarray):
        self.p, self.keys, self.edges = params, [rf], {rf: edges}
        self.X, self.n, self.g, self.base = X, n, y - n * base, base

    def _pass(self, asked: dict) -> dict:
        return {rf: list(_sums(*own, self.X, self.n, self.g, self.p.bins + 1).reshape(2, len(self.X), -1, self.p.bins + 1)) for rf, own in asked.items()}

    def fit(self) -> BoostedModel:
        model = BoostedModel(self.base, [], len(self.X))
        for _ in range(self.p.rounds):
            tree, = self._grow().values()
            model.trees.append(tree)
            self.g -= self.n * _route(_splits(tree), self.X, np.asarray(tree.value))
        return model


class FoldBins:
    """Bin edges of every fold model and its training rows as groups of equal bins; profiles with as many bins share them.

    ``table`` has a row per block of rows with the groups of every fold model in it; ``groups``, made when first asked for, brings
    equal bins of a fold model together from all blocks."""

    def __init__(self, cv, bins: int, fold_keys: Sequence[tuple]):
        self.cv, self.bins, self.keys = cv, bins, list(fold_keys)
        self.q = {rf: cv.fit.transforms[rf].B.shape[0] for rf in self.keys}
        self.spark = cv.train.sparkSession
        self.rows = cv.w_rows.select("folds", "y", "w")
        self.edges = self._edges()
        self.table = self._blocks()
        self._groups = None

    @property
    def groups(self) -> tuple[DataFrame, int]:
        """(records of GROUP_COLUMNS, kept; bytes that the largest fold model's groups take in a task)"""
        if self._groups is None:
            dtype = _bin_type(self.bins)
            groups = self.table.select(F.explode("groups").alias("g")).select("g.*")
            if min(self.q.values()) * np.dtype(dtype).itemsize <= PACKED_BYTES:
                groups = groups.repartition("slot", "part").mapInArrow(_merge_parts(dtype), GROUP_SCHEMA)
            groups = groups.persist()
            most = {r["slot"]: r["m"] for r in groups.groupBy("slot").agg(F.sum("m").alias("m")).collect()}
            held = max((m * (GROUP_BYTES + self.q[self.keys[slot]] * np.dtype(dtype).itemsize) for slot, m in most.items()), default=0)
            self._groups = groups, held
        return self._groups

    def release(self) -> None:
        if self._groups is not None:
            self._groups[0].unpersist()
            self._groups = None

    def _edges(self) -> dict:
        """Per fold model and feature the bin edges: quantiles of the fold's training rows, at most one in 10,000 ranks off.

        Tasks sort their values in runs of ``RUN_ROWS`` rows and send on every ``stride``-th, half the error allowed; a Spark sketch of what
        is sent takes the other half. Few rows are all sent on. A pass takes so many cells that a task can hold their sketches."""
        probs = [i / self.bins for i in range(1, self.bins)]
        cells = [(rf, j) for rf in self.keys for j in range(self.q[rf])]
        runs = self.cv.fit.train_gram(FULL, FULL)[0, 0] / RUN_ROWS + self.rows.rdd.getNumPartitions()
        stride = max(1, int(min(self.cv.fit.transforms[rf].n for rf in self.keys) / runs / 10000))
        edges: dict = {rf: {} for rf in self.keys}
        for lo in range(0, len(cells), SKETCHES):
            own = cells[lo:lo + SKETCHES]
            maps = {}
            for i, (rf, j) in enumerate(own):
                maps.setdefault(rf, []).append((i, self.cv.fit.transforms[rf].B[j]))
            bc = self.spark.sparkContext.broadcast({rf: ([i for i, _ in m], np.stack([v for _, v in m])) for rf, m in maps.items()})

            def values(batches: Iterator[pa.RecordBatch], bc=bc) -> Iterator[pa.RecordBatch]:
                for folds, _, w in _joined(batches, RUN_ROWS):
                    for rf, (ids, B) in bc.value.items():
                        x = B @ w[_trains(folds, rf)].T
                        for i, v in zip(ids, np.sort(x, axis=1)[:, stride // 2::stride] if stride > 1 else x):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(np.ascontiguousarray(v))], ["cell", "v"])

            long = self.rows.mapInArrow(values, "cell int, v double")
            for r in long.groupBy("cell").agg(F.percentile_approx("v", probs, 10000 if stride == 1 else 20000).alias("e")).collect():
                rf, j = own[r["cell"]]
                edges[rf][j] = np.unique(np.asarray(r["e"], dtype=float))
            bc.unpersist()
        return edges

    def _blocks(self) -> DataFrame:
        keys, dtype, parts = self.keys, _bin_type(self.bins), shuffle_partitions(self.spark)
        most = max(1024, BLOCK_BYTES // (np.dtype(dtype).itemsize * max(1, sum(self.q.values()))))
        bc = self.spark.sparkContext.broadcast(({rf: self.cv.fit.transforms[rf].B for rf in keys}, self.edges))

        def groups(folds: np.ndarray, y: np.ndarray, w: np.ndarray) -> Iterator[tuple]:
            Bs, edges = bc.value
            for slot, rf in enumerate(keys):
                own = _trains(folds, rf)
                x = w[own] @ Bs[rf].T
                if not len(x):
                    continue
                X = np.stack([np.searchsorted(edges[rf][j], x[:, j], side="left").astype(dtype) for j in range(x.shape[1])])
                X, n, total = _merged(X, np.ones(len(x)), y[own])
                part = _part_of(X, parts)
                for i in np.unique(part):
                    mine = part == i
                    yield from _records(slot, int(i), X[:, mine], n[mine], total[mine])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            types = pa.struct(list(zip(GROUP_COLUMNS, _GROUP_TYPES)))
            for rows in _joined(batches, most):
                found = [dict(zip(GROUP_COLUMNS, r)) for r in groups(*rows)]
                yield pa.RecordBatch.from_arrays([pa.array([len(rows[1])], pa.int64()), pa.array([found], pa.list_(types))], ["n", "groups"])

        return self.rows.mapInArrow(run, TABLE_SCHEMA)


class FoldBooster(TreeGrower):
    """Boost one model per (repeat, fold) of a :class:`~cadence.operators.crossval.CrossValidation`.

    Where the groups of every fold model fit a task each is fitted there; else the state is one row per block of groups of a fold model, and a
    pass reads all blocks once and adds up the histograms of every pending leaf of every fold."""

    def __init__(self, cv, params: BoostParams, fold_keys: Sequence[tuple], checkpoint_every: int = 10, binned: FoldBins | None = None):
        self.cv, self.p, self.keys = cv, params, list(fold_keys)
        self.own = FoldBins(cv, params.bins, self.keys) if binned is None else None      # else released by who made them
        self.binned = binned or self.own
        self.q, self.edges, self.table = self.binned.q, self.binned.edges, self.binned.table
        self.checkpoint_every = checkpoint_every
        self.spark = cv.train.sparkSession
        self.base = {rf: float(cv.fit.transforms[rf].ybar) for rf in self.keys}

    def fit(self) -> dict:
        groups, held = self.binned.groups
        try:
            return self._fit_in_tasks(groups) if held <= FIT_BYTES else self._fit_in_passes(groups)
        finally:
            if self.own is not None:
                self.own.release()

    def _fit_in_tasks(self, groups: DataFrame) -> dict:
        """Every fold model from all its groups, a task each."""
        params, keys, base, dtype = self.p, self.keys, self.base, _bin_type(self.p.bins)
        bc = self.spark.sparkContext.broadcast(self.edges)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for b in batches:
                for slot, _, *record in zip(*(b.column(c).to_pylist() for c in GROUP_COLUMNS)):
                    held.setdefault(slot, []).append(record)
            for slot in sorted(held):
                rf = keys[slot]
                model = GroupBooster(params, rf, bc.value[rf], base[rf], *_together(held.pop(slot), dtype)).fit()
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([pickle.dumps(model)], pa.binary())], ["slot", "model"])

        fitted = groups.repartitionById(len(keys), "slot").mapInArrow(run, "slot int, model binary").collect()
        bc.unpersist()
        return {keys[r["slot"]]: pickle.loads(r["model"]) for r in sorted(fitted, key=lambda r: r["slot"])}

    def _fit_in_passes(self, groups: DataFrame) -> dict:
        conf = self.spark.conf
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(key)
        conf.set(key, "1")  # a record is a block of groups
        self.state = groups.withColumn("preds", F.lit(None).cast("binary"))
        self.recent: dict = {rf: [] for rf in self.keys}   # trees not yet folded into ``preds``
        models = {rf: BoostedModel(self.base[rf], [], self.q[rf]) for rf in self.keys}
        try:
            for i in range(self.p.rounds):
                for rf, t in self._grow().items():
                    models[rf].trees.append(t)
                    self.recent[rf].append(t)
                if (i + 1) % self.checkpoint_every == 0 and i + 1 < self.p.rounds:
                    self._materialize()
        finally:
            conf.set(key, before)
        return models

    def _pass(self, asked: dict) -> dict:
        nb, keys, base, dtype = self.p.bins + 1, self.keys, self.base, _bin_type(self.p.bins)
        bc = self.spark.sparkContext.broadcast((asked, {rf: [(_splits(t), np.asarray(t.value)) for t in ts] for rf, ts in self.recent.items()}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, recent = bc.value
            acc: dict = {}
            for b in batches:
                for slot, _, *record, preds in zip(*(b.column(c).to_pylist() for c in [*GROUP_COLUMNS, "preds"])):
                    rf = keys[slot]
                    if rf not in wanted:
                        continue
                    X, n, y = _unpacked(*record, dtype)
                    got = _sums(*wanted[rf], X, n, y - n * _predicted(X, preds, base[rf], recent[rf]), nb)
                    acc[rf] = got if rf not in acc else acc[rf] + got
            rows = [(*rf, *(v[i].reshape(-1) for i in (0, 1))) for rf, v in acc.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * 2))],
                                             ["repeat", "fold", "g", "n"])

        parts = self.state.mapInArrow(run, "repeat int, fold int, g array<double>, n array<double>")
        out = {}
        for r in tree_sum_arrays(parts, ["repeat", "fold"], ["g", "n"]).collect():
            rf = (r["repeat"], r["fold"])
            out[rf] = [np.asarray(r[c]).reshape(self.q[rf], -1, nb) for c in ("g", "n")]
        bc.unpersist()
        return out

    def _materialize(self) -> None:
        """Fold the recent trees into ``preds`` and cut the lineage (reliable checkpoint)."""
        keys, base, dtype = self.keys, self.base, _bin_type(self.p.bins)
        bc = self.spark.sparkContext.broadcast({rf: [(_splits(t), np.asarray(t.value)) for t in ts] for rf, ts in self.recent.items()})

        def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [_predicted(_unpacked(*record, dtype)[0], preds, base[keys[slot]], bc.value[keys[slot]]).tobytes()
                       for slot, _, *record, preds in zip(*(b.column(c).to_pylist() for c in [*GROUP_COLUMNS, "preds"]))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], [*GROUP_COLUMNS, "preds"])

        self.state = self.state.mapInArrow(update, GROUP_SCHEMA + ", preds binary").checkpoint(eager=True)
        self.recent = {rf: [] for rf in self.keys}


def _predicted(X: np.ndarray, preds: bytes | None, base: float, recent: list) -> np.ndarray:
    """What the model so far predicts for every group: ``preds`` and the recent trees."""
    out = np.full(X.shape[1], base) if preds is None else np.frombuffer(preds).copy()
    for splits, values in recent:
        out += _route(splits, X, values)
    return out


def score_models(df: DataFrame, key: str, models: dict, transforms: dict, by_fold: bool, w_col: str = "w") -> DataFrame:
    """Per row the mean prediction of the models of its own folds (``folds``, one per repeat) when ``by_fold`` (validation), else of every
    fold model (test rows)."""
    bc = df.sparkSession.sparkContext.broadcast({rf: (transforms[rf].B, m) for rf, m in models.items() if rf[0] != FULL})
    ktype = dict(df.dtypes)[key]
    repeats = len({r for r, _ in bc.value})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            w = np.stack(b[w_col].to_numpy())
            folds = np.stack(b["folds"].to_numpy()) if by_fold else None
            pred = np.zeros(len(b))
            for (r, f), (B, m) in bc.value.items():
                own = folds[:, r] == f if by_fold else slice(None)
                pred[own] += m.predict(w[own] @ B.T)
            yield pd.DataFrame({key: b[key].to_numpy(), "pred": pred / (repeats if by_fold else len(bc.value))})

    return df.select(key, *(["folds"] if by_fold else []), w_col).mapInPandas(run, f"{key} {ktype}, pred double")


def predict_model(df: DataFrame, key: str, model: BoostedModel, B: np.ndarray, w_col: str = "w") -> DataFrame:
    """Score rows with one boosted model on its fold design ``B @ w``."""
    bc = df.sparkSession.sparkContext.broadcast((B, model))
    ktype = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        Bm, m = bc.value
        for b in batches:
            if b.empty:
                continue
            X = np.stack(b[w_col].to_numpy()) @ Bm.T
            yield pd.DataFrame({key: b[key].to_numpy(), "pred": m.predict(X)})

    return df.select(key, w_col).mapInPandas(run, f"{key} {ktype}, pred double")
