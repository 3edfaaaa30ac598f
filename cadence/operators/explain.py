"""Interpretability (I1-I3, K1, K2): tree importances, per-row additive attributions, rankings."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPLIT = re.compile(r"feature (\d+) ")


def tree_importance(model, names: Sequence[str], kind: str = "split", keep: int | None = None) -> list[tuple[str, float]]:
    """Per-feature importance of a tree ensemble. ``split`` counts splits per feature (the reference's
    library default); ``gain`` sums split gains. ``keep`` cuts trailing columns (PCA components)."""
    if hasattr(model, "split_counts"):
        vals = model.split_counts() if kind == "split" else model.gain_importance()
        n = keep if keep is not None else len(names)
        return [(names[i], float(vals[i])) for i in range(n)]
    if kind == "gain":
        vals = model.featureImportances.toArray()
    else:
        counts: Counter = Counter()
        for t in model.trees:
            for line in t.toDebugString.splitlines():
                s = line.strip()
                if s.startswith("If ("):
                    m = _SPLIT.search(s)
                    if m:
                        counts[int(m.group(1))] += 1
        vals = np.array([counts.get(i, 0) for i in range(len(names))], dtype=float)
    n = keep if keep is not None else len(names)
    return [(names[i], float(vals[i])) for i in range(n)]


def top_features(importances: DataFrame, n: int = 12, name: str = "feature", value: str = "importance") -> DataFrame:
    """K1: highest importances first (ties by name), first n."""
    return importances.orderBy(F.desc(value), F.asc(name)).limit(n)


def linear_attributions(design: DataFrame, key: str, coef: dict[str, float], means: dict[str, float]) -> DataFrame:
    """I2 (linear models, exact): phi_j = w_j (x_j - mean_j); they sum to prediction - mean prediction."""
    return design.select(key, *[(F.lit(float(w)) * (F.col(c) - F.lit(float(means.get(c, 0.0))))).alias(c)
                                for c, w in coef.items()])


def attribution_summary(phi: DataFrame, key: str) -> DataFrame:
    """Mean absolute attribution per feature (unpivot, then a partial aggregate)."""
    cols = [c for c in phi.columns if c != key]
    long = phi.unpivot([key], cols, "feature", "phi")
    return long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))


def top_attributions(summary: DataFrame, n: int = 10) -> DataFrame:
    """K2: features by mean absolute attribution, first n."""
    return summary.orderBy(F.desc("mean_abs_phi"), F.asc("feature")).limit(n)


# ---- tree ensembles: exact path-dependent Shapley values (I2 for trees) ---------------------------------

def tree_tables(model) -> list[tuple[float, list[dict]]]:
    """(weight, nodes) per tree of a fitted Spark tree ensemble; nodes carry feature, threshold, children,
    value and training cover. Read once on the driver (size = number of nodes, not rows)."""
    weights = list(getattr(model, "treeWeights", [1.0] * len(model.trees)))
    out = []
    for w, t in zip(weights, model.trees):
        nodes: list[dict] = []

        def walk(jn) -> int:
            i = len(nodes)
            nodes.append({})
            cover = float(jn.impurityStats().count())
            if jn.getClass().getSimpleName() == "InternalNode":
                sp = jn.split()
                left, right = walk(jn.leftChild()), walk(jn.rightChild())
                nodes[i] = {"f": int(sp.featureIndex()), "thr": float(sp.threshold()), "l": left, "r": right,
                            "v": float(jn.prediction()), "cover": cover}
            else:
                nodes[i] = {"f": -1, "thr": 0.0, "l": -1, "r": -1, "v": float(jn.prediction()), "cover": cover}
            return i

        walk(t._java_obj.rootNode())
        out.append((float(w), nodes))
    return out


def _expected(nodes: list[dict], X: np.ndarray, known: set[int], i: int = 0) -> np.ndarray:
    n = nodes[i]
    if n["f"] < 0:
        return np.full(X.shape[0], n["v"])
    left, right = _expected(nodes, X, known, n["l"]), _expected(nodes, X, known, n["r"])
    if n["f"] in known:
        return np.where(X[:, n["f"]] <= n["thr"], left, right)
    cl, cr = nodes[n["l"]]["cover"], nodes[n["r"]]["cover"]
    return (cl * left + cr * right) / max(cl + cr, 1e-300)


def shapley_trees(tables: list[tuple[float, list[dict]]], X: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Exact Shapley values of the path-dependent conditional expectation, by enumerating subsets of the
    (few) features each shallow tree uses. Returns (phi rows x features, base value)."""
    from itertools import combinations
    from math import factorial

    phi = np.zeros((X.shape[0], n_features))
    base = 0.0
    for w, nodes in tables:
        used = sorted({n["f"] for n in nodes if n["f"] >= 0})
        m = len(used)
        base += w * _expected(nodes, X[:1], set())[0]
        if m == 0:
            continue
        cache = {}
        for size in range(m + 1):
            for S in combinations(used, size):
                cache[S] = _expected(nodes, X, set(S))
        for j in used:
            others = [f for f in used if f != j]
            for size in range(m):
                coef = factorial(size) * factorial(m - size - 1) / factorial(m)
                for S in combinations(others, size):
                    with_j = tuple(sorted(S + (j,)))
                    phi[:, j] += w * coef * (cache[with_j] - cache[S])
    return phi, base


def tree_attributions(df: DataFrame, key: str, features_col: str, model, names: Sequence[str]) -> DataFrame:
    """I2 (trees): per-row attributions of a boosted-tree model on Arrow batches; the node tables are
    broadcast once. Attributions plus ``base`` add up to the model's prediction."""
    import pandas as pd

    # our histogram boosters carry their node tables and a base score; Spark ML ensembles are read via py4j
    tables = model.node_tables() if hasattr(model, "node_tables") else tree_tables(model)
    offset = float(getattr(model, "base", 0.0)) if hasattr(model, "node_tables") else 0.0
    bc = df.sparkSession.sparkContext.broadcast(tables)
    names = list(names)
    ktype = dict(df.dtypes)[key]
    schema = ", ".join([f"{key} {ktype}"] + [f"{n} double" for n in names] + ["base double"])

    def run(batches):
        tb = bc.value
        for b in batches:
            if b.empty:
                continue
            X = np.stack(b[features_col].to_numpy()).astype(np.float64)
            phi, base = shapley_trees(tb, X, len(names))
            out = pd.DataFrame(phi, columns=names)
            out.insert(0, key, b[key].to_numpy())
            out["base"] = base + offset
            yield out

    return df.select(key, features_col).mapInPandas(run, schema)
