"""Fold models from one Gram aggregate: imputation, scaling, PCA and ridge as affine maps.

Every row is encoded as ``w = [1, x0_1..x0_p, m_1..m_p, e_1..e_E, y]`` where ``x0`` is the feature
(shifted by its global mean, NULL -> 0), ``m`` its missing flag and ``e`` the (shifted) embedding.
For one fold, median imputation, standardisation and the PCA projection are all affine in ``w``, so the
fold's design matrix is ``D = B w`` and its normal equations are ``B G B^T`` with ``G`` the fold's
training Gram (= all rows minus the fold's own rows). A fitted ridge is then one weight vector over
``w``: scoring is a dot product evaluated next to the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.operators.folds import FULL, fold_vectors, training_medians
from cadence.operators.gram import grouped_gram

# Reference model settings (fixed values).
RIDGE_ALPHA = 10.0
PCA_COMPONENTS = 16


@dataclass
class Layout:
    features: list[str]
    emb_col: str | None = None
    emb_dim: int = 0
    label: str = "y"

    @property
    def p(self) -> int:
        return len(self.features)

    @property
    def d(self) -> int:
        return 2 + 2 * self.p + self.emb_dim

    def x0(self, j: int) -> int:
        return 1 + j

    def miss(self, j: int) -> int:
        return 1 + self.p + j

    def emb(self, e: int) -> int:
        return 1 + 2 * self.p + e

    @property
    def y(self) -> int:
        return self.d - 1


@dataclass
class Shifts:
    feature_means: dict[str, float]
    emb_mean: list[float] = field(default_factory=list)
    has_missing: dict[str, bool] = field(default_factory=dict)


def global_shifts(df: DataFrame, layout: Layout, also: DataFrame | None = None) -> Shifts:
    """Global means (a numerical shift before accumulating sums of products) and which features have any
    NULL/NaN in ``df`` or ``also``; only those need fold medians. One aggregate per table."""
    means: dict[str, float] = {}
    missing: dict[str, bool] = {}
    if layout.features:
        bad = {c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in layout.features}
        row = df.agg(*[F.avg(F.when(~bad[c], F.col(c))).alias(c) for c in layout.features],
                     *[F.count_if(bad[c]).alias(f"_n_{i}") for i, c in enumerate(layout.features)]).first()
        means = {c: float(row[c]) if row[c] is not None else 0.0 for c in layout.features}
        missing = {c: row[f"_n_{i}"] > 0 for i, c in enumerate(layout.features)}
        if also is not None:
            r2 = also.agg(*[F.count_if(bad[c]).alias(f"_n_{i}") for i, c in enumerate(layout.features)]).first()
            missing = {c: missing[c] or r2[f"_n_{i}"] > 0 for i, c in enumerate(layout.features)}
    emb_mean: list[float] = []
    if layout.emb_col:
        pe = df.select(F.posexplode(layout.emb_col).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).collect()
        emb_mean = [0.0] * layout.emb_dim
        for r in pe:
            emb_mean[r["i"]] = float(r["m"])
    return Shifts(means, emb_mean, missing)


def design_vector(layout: Layout, shifts: Shifts, with_label: bool = True) -> Column:
    """``w`` as an array<double> column (label slot 0.0 when absent or not wanted)."""
    parts = [F.lit(1.0)]
    bad = {c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in layout.features}
    parts += [F.when(bad[c], F.lit(0.0)).otherwise(F.col(c).cast("double") - F.lit(shifts.feature_means[c]))
              for c in layout.features]
    parts += [bad[c].cast("double") for c in layout.features]
    arr = F.array(*parts)
    if layout.emb_col:
        mean = F.array(*[F.lit(float(v)) for v in shifts.emb_mean])
        arr = F.concat(arr, F.zip_with(F.col(layout.emb_col), mean, lambda e, m: e.cast("double") - m))
    y = F.coalesce(F.col(layout.label).cast("double"), F.lit(0.0)) if with_label else F.lit(0.0)
    return F.concat(arr, F.array(y))


@dataclass
class FoldTransform:
    repeat: int
    fold: int
    n: float
    ybar: float
    medians: dict[str, float]
    means: dict[str, float]
    stds: dict[str, float]
    B: np.ndarray  # q x d: design = B @ w
    names: list[str]
    pca_components: np.ndarray | None = None
    explained_variance: np.ndarray | None = None
    total_variance: float | None = None


def fit_transform(G: np.ndarray, layout: Layout, shifts: Shifts, medians: dict[str, float], repeat: int, fold: int,
                  n_components: int = PCA_COMPONENTS, standardize: bool = True) -> FoldTransform:
    """Fold preprocessing from its training Gram: median imputation, standardisation (population std,
    zero -> 1) and, if there is an embedding, centred PCA with largest-loading-positive signs, or with
    ``n_components`` 0 the embedding as it is."""
    d = layout.d
    n = G[0, 0]
    rows, names = [], []
    meds, means, stds = {}, {}, {}
    for j, c in enumerate(layout.features):
        med = medians.get(c)
        a = np.zeros(d)
        a[layout.x0(j)] = 1.0
        shifted_med = (med - shifts.feature_means[c]) if med is not None else 0.0
        a[layout.miss(j)] = shifted_med
        sz, szz = a @ G[:, 0], a @ G @ a
        mu = sz / n
        var = max(szz / n - mu * mu, 0.0)
        # constant up to rounding, relative to the column's own magnitude
        noise = n * np.finfo(float).eps * abs(mu + shifts.feature_means[c])
        sd = float(np.sqrt(var)) if var > max(noise * noise, np.finfo(float).tiny) else 1.0
        if not standardize:
            sd = 1.0
        row = a.copy()
        row[0] -= mu if standardize else -shifts.feature_means[c]
        rows.append(row / sd)
        names.append(c)
        meds[c] = med
        means[c] = mu + shifts.feature_means[c]
        stds[c] = sd
    comps = ev = tot = None
    if layout.emb_col and n_components:
        e0 = layout.emb(0)
        sl = slice(e0, e0 + layout.emb_dim)
        mu_e = G[sl, 0] / n
        cov = G[sl, sl] / n - np.outer(mu_e, mu_e)
        vals, vecs = np.linalg.eigh(cov)
        order = np.argsort(vals)[::-1][:n_components]
        comps = vecs[:, order].T
        big = np.argmax(np.abs(comps), axis=1)
        comps = comps * np.sign(comps[np.arange(comps.shape[0]), big])[:, None]
        ev = vals[order] * n / max(n - 1, 1)
        tot = float(np.trace(cov)) * n / max(n - 1, 1)
        for c_i, v in enumerate(comps):
            row = np.zeros(d)
            row[sl] = v
            row[0] = -(v @ mu_e)
            rows.append(row)
            names.append(f"pca_{c_i}")
    if layout.emb_col and not n_components:      # the embedding itself, as it is (the raw view of V16)
        for e in range(layout.emb_dim):
            row = np.zeros(d)
            row[layout.emb(e)], row[0] = 1.0, shifts.emb_mean[e]
            rows.append(row)
            names.append(f"emb_{e}")
    B = np.vstack(rows) if rows else np.zeros((0, d))
    return FoldTransform(repeat, fold, float(n), float(G[layout.y, 0] / n), meds, means, stds, B, names, comps, ev, tot)


def ridge_coef(G: np.ndarray, t: FoldTransform, layout: Layout, alpha: float = RIDGE_ALPHA) -> tuple[np.ndarray, float]:
    """V7: ridge with unpenalised intercept on the fold's design -> (coefficients per design column, intercept)."""
    n = G[0, 0]
    ey = np.zeros(layout.d)
    ey[layout.y] = 1.0
    BG = t.B @ G
    sd = BG[:, 0]                      # design sums (0 up to rounding for standardised columns)
    M = BG @ t.B.T - np.outer(sd, sd) / n
    b = BG @ ey - sd * (G[layout.y, 0] / n)
    coef = np.linalg.solve(M + alpha * np.eye(M.shape[0]), b)
    return coef, float(G[layout.y, 0] / n - coef @ sd / n)


def ridge_weights(G: np.ndarray, t: FoldTransform, layout: Layout, alpha: float = RIDGE_ALPHA) -> np.ndarray:
    """The fitted ridge as one weight vector over ``w`` (prediction = w . beta)."""
    coef, intercept = ridge_coef(G, t, layout, alpha)
    beta = t.B.T @ coef
    beta[0] += intercept
    beta[layout.y] = 0.0
    return beta


def dot(w: Column | str, beta: Sequence[float] | Column) -> Column:
    """Linear score of ``w`` next to the data (no UDF)."""
    wc = F.col(w) if isinstance(w, str) else w
    bc = beta if isinstance(beta, Column) else F.array(*[F.lit(float(b)) for b in beta])
    return F.aggregate(F.zip_with(wc, bc, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


@dataclass
class FoldFit:
    layout: Layout
    shifts: Shifts
    grams: dict[tuple, np.ndarray]
    transforms: dict[tuple, FoldTransform]
    k: int
    repeats: int

    def train_gram(self, repeat: int, fold: int) -> np.ndarray:
        total = sum(v for (r, f), v in self.grams.items() if r == 0)
        return total if repeat == FULL else total - self.grams[(repeat, fold)]

    def fold_keys(self, include_full: bool = False) -> list[tuple]:
        keys = [(r, f) for r in range(self.repeats) for f in range(self.k)]
        return keys + ([(FULL, FULL)] if include_full else [])


MOST_CELLS = 256  # Gram matrices held by a task


def fold_grams(rows: DataFrame, k: int, repeats: int, dim: int, max_tasks: int | None = None) -> dict[tuple, np.ndarray]:
    """Gram matrix of every (repeat, fold) from rows (folds, w) that are read once.

    Rows are added up per *cell*, the combination of their folds in all repeats (at most k^repeats); a fold is the sum of
    its cells. Where that is more cells than a task should hold, repeats are taken in groups that are, one pass a group."""
    per = 1
    while per < repeats and k ** (per + 1) <= MOST_CELLS:
        per += 1
    grams: dict[tuple, np.ndarray] = {}
    for lo in range(0, repeats, per):
        own = range(lo, min(repeats, lo + per))
        cell = sum((F.col("folds")[r].cast("long") * (k ** i) for i, r in enumerate(own)), F.lit(0).cast("long"))
        for (c,), m in grouped_gram(rows.select(cell.alias("cell"), "w"), ["cell"], "w", dim, max_tasks).items():
            for i, r in enumerate(own):
                at = (r, c // k ** i % k)
                grams[at] = grams[at] + m if at in grams else m
    return {(r, f): grams.get((r, f), np.zeros((dim, dim))) for r in range(repeats) for f in range(k)}


def fit_folds(df: DataFrame, folds: DataFrame, key: str, layout: Layout, k: int, repeats: int,
              n_components: int = PCA_COMPONENTS, standardize: bool = True, max_tasks: int | None = None,
              test: DataFrame | None = None, rows: DataFrame | None = None, shifts: Shifts | None = None) -> FoldFit:
    """One Gram pass (all repeats and folds) + counting passes for the medians -> every fold's preprocessing.

    Medians are computed only for features with a missing value in the training or test rows; for the
    others imputation is the identity. ``rows`` may hold ``df`` with its ``folds`` array (see ``fold_vectors``)."""
    shifts = shifts or global_shifts(df, layout, test)
    rows = df.join(fold_vectors(folds, key, repeats), key) if rows is None else rows
    need = [c for c in layout.features if shifts.has_missing.get(c)]
    # the Gram pass and the median passes are independent jobs: submit both at once
    with ThreadPoolExecutor(max_workers=2) as ex:
        g_job = ex.submit(fold_grams, rows.select("folds", design_vector(layout, shifts).alias("w")), k, repeats, layout.d, max_tasks)
        m_job = ex.submit(training_medians, rows, need, k, repeats)
        grams, medians = g_job.result(), m_job.result()
    meds: dict[tuple, dict[str, float]] = {}
    for (r, f, c), v in medians.items():
        meds.setdefault((r, f), {})[c] = v
    fit = FoldFit(layout, shifts, grams, {}, k, repeats)
    for rf in fit.fold_keys(include_full=True):
        G = fit.train_gram(*rf)
        fit.transforms[rf] = fit_transform(G, layout, shifts, meds.get(rf, {}), rf[0], rf[1], n_components, standardize)
    return fit


def design_features(df: DataFrame, w_col: str, B: np.ndarray, out: str = "features") -> DataFrame:
    """``B @ w`` per row on Arrow batches (used by the tree and kernel models, which need the columns)."""
    Bt = B.T.copy()
    schema = df.select("*", F.lit(None).cast("array<double>").alias(out)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                b[out] = []
                yield b
                continue
            W = np.stack(b[w_col].to_numpy()).astype(np.float64)
            b[out] = list(W @ Bt)
            yield b

    return df.mapInPandas(run, schema)
