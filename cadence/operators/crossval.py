"""Repeated stratified cross-validation of the base models.

All fold models share the preprocessing of :mod:`cadence.operators.models`. Linear models score with a
dot product next to the data; out-of-fold predictions average over repeats (each row is validated once
per repeat) and test predictions average over all k x r fold models. For the linear models the test
average is the average weight vector, so test rows are scored once; trees and the kernel model score
test rows once per fold model in narrow passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.folds import FULL, assign_folds, fold_vectors
from cadence.session import right_size
from cadence.operators.models import (RIDGE_ALPHA, FoldFit, Layout, design_features, design_vector, dot, fit_folds,
                                      global_shifts, ridge_weights)
from cadence.operators.svr import fourier_features
from cadence.operators.trees import fit_grouped_trees, fit_groups, group_rows

# Boosted-tree profiles of the reference (rounds, learning rate, depth, min rows per leaf).
GBT_PROFILES = {
    "a": {"maxIter": 120, "stepSize": 0.03, "maxDepth": 3, "minInstancesPerNode": 20, "seed": 42},
    "b": {"maxIter": 100, "stepSize": 0.03, "maxDepth": 3, "minInstancesPerNode": 1, "seed": 43},
}
SVR_C, SVR_EPSILON = 1.0, 0.1
SVR_TOLERANCE = 1e-3  # duality gap relative to the primal value


class CrossValidation:
    """Fold assignment + fold preprocessing for one training table; models are added on demand."""

    def __init__(self, train: DataFrame, key: str, layout: Layout, k: int = 5, repeats: int = 2, seed: int = 42,
                 n_components: int = 16, test: DataFrame | None = None):
        unlabelled = train.where(F.col(layout.label).isNull()).count()
        if unlabelled:
            raise ValueError(f"{unlabelled} training rows have no label; drop or label them first")
        # the feature table is read by many small jobs (shifts, Gram, medians, scoring): keep one copy with its folds
        train = right_size(train.persist()).persist()
        test = (train if test is train else right_size(test.persist()).persist()) if test is not None else None
        self.train, self.key, self.layout, self.k, self.repeats, self.seed = train, key, layout, k, repeats, seed
        self.test = test
        self.folds = assign_folds(train, key, layout.label, k, repeats, seed)      # on a checkpoint of its own
        self.rows = train.join(fold_vectors(self.folds, key, repeats), key).persist()
        shifts = global_shifts(train, layout, None if test is train else test)
        self.fit: FoldFit = fit_folds(train, self.folds, key, layout, k, repeats, n_components, rows=self.rows, shifts=shifts)
        self.w_rows = self.rows.select(key, "folds", F.col(layout.label).cast("double").alias("y"), design_vector(layout, shifts).alias("w"))
        self.w_train = self.w_rows.drop("folds")
        self.binned, self.boosted = {}, {}      # see boost
        self.w_test = None
        if test is not None:
            self.w_test = test.select(key, design_vector(layout, shifts, with_label=False).alias("w"))

    @property
    def frame(self) -> DataFrame:
        """(key, y, w, repeat, fold): a row once per repeat, for models that are fitted or scored per fold."""
        return self.w_rows.select(self.key, "y", "w", F.posexplode("folds").alias("repeat", "fold"))

    def release(self) -> None:
        """Drop the kept copies; frames made from this object are computed anew if read later."""
        for df in (self.rows, self.train, self.test):
            if df is not None:
                df.unpersist()
        self.release_bins()

    def release_bins(self) -> None:
        """Drop the groups of rows that boosting keeps until every profile is fitted; another profile makes them anew."""
        for own in self.binned.values():
            own.release()

    # -- linear ---------------------------------------------------------------------------------------
    def linear_predictions(self, betas: dict[tuple, np.ndarray], name: str) -> tuple[DataFrame, DataFrame | None]:
        """OOF (mean over repeats) and test (mean weight vector) predictions of per-fold linear models.

        A row looks its weights up by its fold of each repeat, so no row is copied or shuffled."""
        cv = {rf: b for rf, b in betas.items() if rf[0] != FULL}
        pred = F.lit(0.0)
        for r in range(self.repeats):
            table = F.array(*[F.array(*[F.lit(float(x)) for x in cv[r, f]]) for f in range(self.k)])   # k weight vectors
            pred = pred + dot("w", table[F.col("folds")[r]])
        oof = self.w_rows.select(self.key, (pred / self.repeats).alias("pred"), F.lit(name).alias("model"))
        test = None
        if self.w_test is not None:
            mean_beta = np.mean(np.stack(list(cv.values())), axis=0)
            test = self.w_test.select(self.key, dot("w", mean_beta).alias("pred"), F.lit(name).alias("model"))
        return oof, test

    def baseline(self):
        """V3: every fold predicts its training mean of y."""
        betas = {}
        for rf in self.fit.fold_keys(include_full=True):
            b = np.zeros(self.layout.d)
            b[0] = self.fit.transforms[rf].ybar
            betas[rf] = b
        return betas

    def ridge(self, alpha: float = RIDGE_ALPHA, only: Sequence[str] | None = None):
        """V7 for every fold and the full refit, from the fold Grams alone; ``only`` fits on some design columns (a view)
        without another pass."""
        def view(t):
            return t if only is None else replace(t, B=t.B[[t.names.index(c) for c in only]], names=list(only))

        return {rf: ridge_weights(self.fit.train_gram(*rf), view(self.fit.transforms[rf]), self.layout, alpha)
                for rf in self.fit.fold_keys(include_full=True)}

    # -- boosted trees (V8, V9) ----------------------------------------------------------------------------
    def boost(self, profile: str = "a", rounds: int | None = None, include_full: bool = False, bins: int | None = None):
        """Histogram boosting of every fold model at once (see :mod:`cadence.operators.boosting`);
        returns (oof, test, full_model)."""
        from cadence.operators.boosting import PROFILES, FoldBins, FoldBooster, score_models

        params = PROFILES[profile]
        if rounds is not None:
            params = replace(params, rounds=rounds)
        if bins is not None:
            params = replace(params, bins=bins)
        keys = self.fit.fold_keys(include_full=include_full)
        at = (params.bins, *keys)
        if at not in self.binned:           # kept for the other profile
            self.binned[at] = FoldBins(self, params.bins, keys)
        models = FoldBooster(self, params, keys, binned=self.binned[at]).fit()
        self.boosted.setdefault(at, set()).add(profile)
        if self.boosted[at] == set(PROFILES):
            self.release_bins()
        name = "gbt_" + profile
        cvm = {rf: m for rf, m in models.items() if rf[0] != FULL}
        oof = score_models(self.w_rows, self.key, cvm, self.fit.transforms, True) \
            .groupBy(self.key).agg(F.avg("pred").alias("pred")).withColumn("model", F.lit(name))
        test = None
        if self.w_test is not None:
            test = score_models(self.w_test, self.key, cvm, self.fit.transforms, False) \
                .groupBy(self.key).agg(F.avg("pred").alias("pred")).withColumn("model", F.lit(name))
        return oof, test, models.get((FULL, FULL))

    def _features(self, df: DataFrame, rf: tuple) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        t = self.fit.transforms[rf]
        return design_features(df, "w", t.B, "_d").withColumn("features", array_to_vector("_d")).drop("_d")

    def _split(self, rf: tuple) -> tuple[DataFrame, DataFrame | None]:
        r, f = rf
        if r == FULL:
            return self.w_train, None
        tr = self.frame.where((F.col("repeat") == r) & (F.col("fold") != f)).select(self.key, "y", "w")
        va = self.frame.where((F.col("repeat") == r) & (F.col("fold") == f)).select(self.key, "y", "w")
        return tr, va

    def gbt(self, profile: str = "a", rounds: int | None = None, threads: int = 4, include_full: bool = False):
        """Boosted regression trees per fold (Spark ML, level-wise), each fitted on groups of its rows (see
        :mod:`cadence.operators.trees`); returns (oof, test, full_model)."""
        params = dict(GBT_PROFILES[profile])
        if rounds is not None:
            params["maxIter"] = rounds
        name = "gbt_" + profile

        def fit_one(rf):
            tr, va = self._split(rf)
            own = self._features(tr, rf).select("features", "y").persist()     # read for thresholds and groups
            try:
                grouped = group_rows(own, params)
            finally:
                own.unpersist()
            model = fit_groups(*grouped, params)
            val = model.transform(self._features(va, rf)).select(self.key, "pred") if va is not None else None
            tst = (model.transform(self._features(self.w_test, rf)).select(self.key, "pred")
                   if self.w_test is not None and rf[0] != FULL else None)
            return rf, model, val, tst

        keys = self.fit.fold_keys(include_full=include_full)
        with ThreadPoolExecutor(max_workers=threads) as ex:
            results = list(ex.map(fit_one, keys))
        return self._collect(results, name)

    def gbt_refit(self, profile: str = "a", rounds: int | None = None):
        """V15 of the boosted trees alone: the Spark ML model of all training rows, fitted on groups of them."""
        params = dict(GBT_PROFILES[profile]) | ({} if rounds is None else {"maxIter": rounds})
        rows = self._features(self.w_train, (FULL, FULL)).select("features", "y").persist()      # read for thresholds and groups
        try:
            return fit_grouped_trees(rows, params)
        finally:
            rows.unpersist()

    def _collect(self, results, name):
        vals = [v for _, _, v, _ in results if v is not None]
        tsts = [t for _, _, _, t in results if t is not None]
        oof = _union(vals).groupBy(self.key).agg(F.avg("pred").alias("pred")).withColumn("model", F.lit(name))
        test = (_union(tsts).groupBy(self.key).agg(F.avg("pred").alias("pred")).withColumn("model", F.lit(name))
                if tsts else None)
        full = next((m for rf, m, _, _ in results if rf[0] == FULL), None)
        return oof, test, full

    # -- kernel model (V10) ---------------------------------------------------------------------------------
    def rff_svr(self, C: float = SVR_C, epsilon: float = SVR_EPSILON, n_features: int = 64, max_passes: int = 200,
                seed: int = 42, include_full: bool = False, tolerance: float = SVR_TOLERANCE):
        """RBF-kernel support-vector regression re-aimed as random Fourier features (gamma = 1/(q var(X)), per fold) and the
        linear epsilon-insensitive loss with an unpenalised intercept; see :mod:`cadence.operators.svr` for the solver.

        All folds advance together, two passes a step over the rows as they are. ``svr_gaps`` holds each fold's (rows, primal, dual); a
        fold whose duality gap is not below ``tolerance`` times its primal value after ``max_passes`` is an error."""
        from cadence.operators.svr import fit_folds_svr

        keys = self.fit.fold_keys(include_full=include_full)
        projections = {}
        for rf in keys:
            t = self.fit.transforms[rf]
            G = self.fit.train_gram(*rf)
            n, q = G[0, 0], t.B.shape[0]
            BG = t.B @ G
            mean_all = BG[:, 0].sum() / (n * q)
            msq = np.trace(BG @ t.B.T) / (n * q)
            gamma = 1.0 / (q * max(msq - mean_all ** 2, 1e-12))
            rng = np.random.default_rng([seed, rf[0] + 2, rf[1] + 2])
            omega = rng.normal(0.0, np.sqrt(2 * gamma), size=(n_features, q))
            projections[rf] = (t.B, omega, rng.uniform(0, 2 * np.pi, size=n_features), t.ybar)
        thetas, self.svr_gaps = fit_folds_svr(self.w_rows.select("folds", "y", "w"), projections, C, epsilon, tolerance, max_passes)
        return self._score_kernel({rf: [*projections[rf][:3], thetas[rf]] for rf in keys})

    def _score_kernel(self, params):
        bc = self.train.sparkSession.sparkContext.broadcast(params)      # folds x (width x features) weights
        key, repeats, k = self.key, self.repeats, self.k
        ktype = dict(self.w_rows.dtypes)[key]

        def predict(rf: tuple, w: np.ndarray) -> np.ndarray:
            B, omega, phase, theta = bc.value[rf]
            return fourier_features(w @ B.T, omega, phase) @ theta

        def out_of_fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if b.empty:
                    continue
                w, folds = np.stack(b["w"].to_numpy()), np.stack(b["folds"].to_numpy())
                pred = np.zeros(len(b))
                for r in range(repeats):
                    for f in range(k):
                        own = folds[:, r] == f
                        if own.any():
                            pred[own] += predict((r, f), w[own]) / repeats
                yield pd.DataFrame({key: b[key].to_numpy(), "pred": pred})

        def mean_model(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not b.empty:
                    w = np.stack(b["w"].to_numpy())
                    yield pd.DataFrame({key: b[key].to_numpy(), "pred": np.mean([predict((r, f), w) for r in range(repeats) for f in range(k)], axis=0)})

        schema = f"{key} {ktype}, pred double"
        oof = self.w_rows.select(key, "folds", "w").mapInPandas(out_of_fold, schema).withColumn("model", F.lit("svr"))
        test = self.w_test.select(key, "w").mapInPandas(mean_model, schema).withColumn("model", F.lit("svr")) if self.w_test is not None else None
        return oof, test, params.get((FULL, FULL))


def kernel_predict(df: DataFrame, key: str, params: list, w_col: str = "w") -> DataFrame:
    """Score rows with one fitted kernel model (projection B, frequencies, phases, weights)."""
    bc = df.sparkSession.sparkContext.broadcast(params)
    ktype = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        B, om, ph, th = bc.value
        for b in batches:
            if b.empty:
                continue
            Z = fourier_features(np.stack(b[w_col].to_numpy()) @ B.T, om, ph)
            yield pd.DataFrame({key: b[key].to_numpy(), "pred": Z @ th})

    return df.select(key, w_col).mapInPandas(run, f"{key} {ktype}, pred double")


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def oof_average(preds: DataFrame, key: str) -> DataFrame:
    """Mean of (key, model) predictions over repeats."""
    return preds.groupBy(key, "model").agg(F.avg("pred").alias("pred"))
