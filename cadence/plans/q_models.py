"""Driver queries for folds, preprocessing, base models, stacking, ablation and attributions
(V1-V16, I1-I3, K1, K2) on F5 (embeddings), F6 (one row per order) and F7 (base-model predictions)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cadence.operators import explain as I
from cadence.operators import folds as V
from cadence.operators import stack as ST
from cadence.operators.crossval import CrossValidation
from cadence.operators.folds import FULL
from cadence.operators.models import Layout, dot, ridge_coef
from cadence.plans import fixtures as fx
from cadence.plans.common import big, r6
from cadence.plans.oracle_fixtures import with_fixtures

FEATURES = ["x1", "x2", "x3", "x4", "x_const"]
TWO = ["x1", "x2"]
K_FOLDS, REPEATS, SEED = 5, 2, 42


def _cv(spark, d, features=FEATURES, test=True):
    f6 = fx.f6_reg(spark, d)
    return CrossValidation(f6, "id", Layout(list(features), label="y"), K_FOLDS, REPEATS, SEED,
                           test=f6 if test else None)


def v1_assign_folds(spark, d):
    f = V.assign_folds(fx.f6_reg(spark, d), "id", "y", K_FOLDS, REPEATS, SEED)
    return f.select(big("id"), big("repeat"), big("fold"), big("stratum"))


def v2_fold_sizes(spark, d):
    f = V.assign_folds(fx.f6_reg(spark, d), "id", "y", K_FOLDS, REPEATS, SEED)
    return V.fold_sizes(f, K_FOLDS).select(big("repeat"), big("fold"), big("n_val"), big("n_train"))


def v3_baseline_oof(spark, d):
    cv = _cv(spark, d)
    oof, _ = cv.linear_predictions(cv.baseline(), "baseline")
    return oof.select(big("id"), r6("pred"))


def v4_fold_medians(spark, d):
    f6 = fx.f6_reg(spark, d)
    f = V.assign_folds(f6, "id", "y", K_FOLDS, REPEATS, SEED)
    m = V.fold_medians(f6, f, "id", FEATURES, K_FOLDS)
    return m.select(big("repeat"), big("fold"), "feature", r6("median"))


def v5_fold_scaling(spark, d):
    cv = _cv(spark, d, test=False)
    rows = [(int(r), int(f), c, float(t.means[c]), float(t.stds[c]))
            for (r, f), t in cv.fit.transforms.items() for c in FEATURES]
    out = spark.createDataFrame(rows, "repeat bigint, fold bigint, feature string, mean double, std double")
    return out.select("repeat", "fold", "feature", r6("mean"), r6("std"))


def v6_pca_variance(spark, d):
    f5 = fx.f5_embeddings(spark, d)
    cv = CrossValidation(f5, "vec_id", Layout([], "embedding", 64, "y"), K_FOLDS, REPEATS, SEED, n_components=16)
    rows = [(int(r), int(f), float(t.total_variance), float(np.sum(t.explained_variance)))
            for (r, f), t in cv.fit.transforms.items()]
    out = spark.createDataFrame(rows, "repeat bigint, fold bigint, total_variance double, top16_variance double")
    return out.select("repeat", "fold", r6("total_variance"))


def _pca_cv(spark, d, n_components):
    f5 = fx.f5_embeddings(spark, d)
    return CrossValidation(f5, "vec_id", Layout([], "embedding", 64, "y"), K_FOLDS, REPEATS, SEED, n_components=n_components)


def v6_pca_components(spark, d):
    """All components of every fold by what must hold of them: power sums of the eigenvalues (the traces of the covariance and of its square
    and cube), unit length and right angles, and the eigenvalues as variances of the training rows' own projections."""
    cv = _pca_cv(spark, d, 64)
    rows = []
    for (r, f), t in cv.fit.transforms.items():
        e = t.explained_variance
        rows.append((int(r), int(f), float(e.sum()), float((e ** 2).sum() * 1e3), float((e ** 3).sum() * 1e6),
                     float(np.abs(t.pca_components @ t.pca_components.T - np.eye(64)).max())))
    facts = spark.createDataFrame(rows, "repeat bigint, fold bigint, trace_1 double, trace_2_e3 double, trace_3_e6 double, angle_error double")
    # variance of the first, second and last component's scores over the training rows, next to the data, against the eigenvalue
    some = (0, 1, 63)
    parts = []
    for (r, f), t in cv.fit.transforms.items():
        own = cv.w_rows if r == FULL else cv.w_rows.where(F.col("folds")[r] != f)
        scores = own.select(*[dot("w", list(t.B[i])).alias(f"s{i}") for i in some])
        off = F.greatest(*[F.abs(F.var_samp(f"s{i}") / float(t.explained_variance[i]) - 1) for i in some])
        parts.append(scores.agg(off.alias("variance_error")).select(F.lit(int(r)).cast("bigint").alias("repeat"), F.lit(int(f)).cast("bigint").alias("fold"), "variance_error"))
    errors = parts[0]
    for p in parts[1:]:
        errors = errors.unionByName(p)
    out = facts.join(errors, ["repeat", "fold"])
    return out.select("repeat", "fold", *[r6(c) for c in ("trace_1", "trace_2_e3", "trace_3_e6", "angle_error", "variance_error")])


def v6_pca_ratios(spark, d):
    cv = _pca_cv(spark, d, 16)
    rows = [(int(r), int(f), i, float(v / t.total_variance))
            for (r, f), t in cv.fit.transforms.items() for i, v in enumerate(t.explained_variance)]
    return spark.createDataFrame(rows, "repeat bigint, fold bigint, component bigint, explained_ratio double")


def v7_ridge_coefficients(spark, d):
    cv = _cv(spark, d, TWO, test=False)
    rows = []
    for (r, f), t in cv.fit.transforms.items():
        coef, icpt = ridge_coef(cv.fit.train_gram(r, f), t, cv.layout, 10.0)
        rows.append((int(r), int(f), float(coef[0]), float(coef[1]), icpt))
    out = spark.createDataFrame(rows, "repeat bigint, fold bigint, coef_x1 double, coef_x2 double, intercept double")
    return out.select("repeat", "fold", r6("coef_x1"), r6("coef_x2"), r6("intercept"))


def v11_ridge_oof(spark, d):
    cv = _cv(spark, d, TWO)
    oof, _ = cv.linear_predictions(cv.ridge(10.0), "ridge")
    return oof.select(big("id"), r6("pred"))


def v12_ridge_test_average(spark, d):
    cv = _cv(spark, d, TWO)
    _, test = cv.linear_predictions(cv.ridge(10.0), "ridge")
    return test.select(big("id"), r6("pred"))


def v8_gbt_profile_a(spark, d):
    cv = _cv(spark, d)
    oof, _, _ = cv.boost("a")
    cv.release_bins()
    return oof.select(big("id"), r6("pred"))


def v9_gbt_profile_b(spark, d):
    cv = _cv(spark, d)
    oof, _, _ = cv.boost("b")
    cv.release_bins()
    return oof.select(big("id"), r6("pred"))


def v8_spark_ml_gbt(spark, d):
    """The same profile on Spark ML's level-wise GBT (a fit per fold), for comparison."""
    cv = _cv(spark, d)
    oof, _, _ = cv.gbt("a")
    return oof.select(big("id"), r6("pred"))


def v10_rff_svr(spark, d):
    cv = _cv(spark, d)
    oof, _, _ = cv.rff_svr()
    return oof.select(big("id"), r6("pred"))


def v10_duality_gap(spark, d):
    """Each fold's kernel model: training rows, and whether its duality gap is a bound (not negative) within the tolerance."""
    from cadence.operators.crossval import SVR_TOLERANCE

    cv = _cv(spark, d, test=False)
    cv.rff_svr(include_full=True)
    rows = [(int(r), int(f), n, bool(primal >= dual), bool(primal - dual <= SVR_TOLERANCE * primal)) for (r, f), (n, primal, dual) in cv.svr_gaps.items()]
    return spark.createDataFrame(rows, "repeat bigint, fold bigint, n_train bigint, gap_is_a_bound boolean, gap_within_tolerance boolean")


def v13_stacker(spark, d):
    f7 = fx.f7_preds(fx.f6_reg(spark, d))
    s = ST.fit_stacker(f7, ["p1", "p2"], "y", 1.0)
    out = spark.createDataFrame([(float(s.weights[0]), float(s.weights[1]), s.intercept)],
                                "w_p1 double, w_p2 double, intercept double")
    return out.select(r6("w_p1"), r6("w_p2"), r6("intercept"))


def v14_stack_predict(spark, d):
    f7 = fx.f7_preds(fx.f6_reg(spark, d))
    s = ST.fit_stacker(f7, ["p1", "p2"], "y", 1.0)
    return s.predict(f7).select(big("id"), r6("pred"))


def v13_v14_four_model_stack(spark, d):
    f7 = fx.f7_preds(fx.f6_reg(spark, d))
    s = ST.fit_stacker(f7, ["p1", "p2", "p3", "p4"], "y", 1.0)
    return s.predict(f7).select(big("id"), r6("pred"))


def v15_full_refit(spark, d):
    """Full-data refit of the (two-feature) ridge, scored on the training rows."""
    cv = _cv(spark, d, TWO)
    betas = cv.ridge(10.0)
    full = betas[(FULL, FULL)]
    return cv.w_train.select(big("id"), r6(dot("w", full), "pred"))


VIEWS = {"m1": "x1", "m2": "x2", "m3": "x3", "m4": "x4"}


def _four_models(spark, d):
    """(cv, weights per model, their OOF predictions side by side with y, stacker): one ridge per view, all from the same fold Grams."""
    cv = _cv(spark, d, list(VIEWS.values()), test=False)
    betas = {m: cv.ridge(10.0, only=[c]) for m, c in VIEWS.items()}
    parts = [cv.linear_predictions(b, m)[0].select("id", F.col("pred").alias(m)) for m, b in betas.items()]
    wide = cv.w_train.select("id", "y")
    for p in parts:
        wide = wide.join(p, "id")
    wide = wide.persist()
    return cv, betas, wide, ST.fit_stacker(wide, list(VIEWS), "y", 1.0)


def v15_four_model_refit(spark, d):
    """Four base models stacked on their out-of-fold predictions, refitted on all rows and combined by the same stacker."""
    cv, betas, _, stacker = _four_models(spark, d)
    refit = cv.w_train.select("id", *[dot("w", list(b[(FULL, FULL)])).alias(m) for m, b in betas.items()])
    return stacker.predict(refit).select(big("id"), r6("pred"))


def v16_ablation_full(spark, d):
    """The ablation table as the reference prints it: text, acoustic and (raw) embedding view in sample, and the full stack out of fold."""
    _, _, wide, stacker = _four_models(spark, d)
    full = ST.rmse(stacker.predict(wide), "y", "pred")
    f6 = fx.f6_reg(spark, d).withColumn("emb", F.array("x3", "x4"))
    views = {"Text-Only": Layout(["x1"], label="y"), "Acoustic-Only": Layout(["x2"], label="y"), "Embeddings-Only": Layout([], "emb", 2, "y")}
    return ST.ablation(f6, views, full_rmse=full, raw_views=["Embeddings-Only"]).select("view", r6("rmse"))


def v16_ablation(spark, d):
    f6 = fx.f6_reg(spark, d)
    views = {"Text-Only": Layout(["x1"], label="y"), "Acoustic-Only": Layout(["x2"], label="y"),
             "Embeddings-Only": Layout(["x3"], label="y")}
    out = ST.ablation(f6, views, raw_views=["Embeddings-Only"])
    return out.select("view", r6("rmse"))


def v16_ablation_oof(spark, d):
    """Fair ablation: each single-view ridge cross-validated (in-fold imputation and scaling)."""
    f6 = fx.f6_reg(spark, d)
    views = {"Text-Only": Layout(["x1"], label="y"), "Acoustic-Only": Layout(["x2"], label="y")}
    out = ST.ablation(f6, views, mode="oof", key="id")
    return out.select("view", r6("rmse"))


def _full_two(spark, d):
    cv = _cv(spark, d, TWO, test=False)
    t = cv.fit.transforms[(FULL, FULL)]
    coef, _ = ridge_coef(cv.fit.train_gram(FULL, FULL), t, cv.layout, 10.0)
    # phi_j = coef_j * (standardised feature j); the design's training mean is 0
    phi = cv.w_train.select("id", *[dot("w", list(coef[j] * t.B[j])).alias(f"phi_{c}") for j, c in enumerate(TWO)])
    return phi


def i2_linear_attributions(spark, d):
    return _full_two(spark, d).select(big("id"), r6("phi_x1"), r6("phi_x2"))


def i3_attribution_summary(spark, d):
    return I.attribution_summary(_full_two(spark, d), "id").select("feature", r6("mean_abs_phi"))


def k2_top_attributions(spark, d):
    s = I.attribution_summary(_full_two(spark, d), "id")
    return I.top_attributions(s, 10).select("feature", r6("mean_abs_phi"))


def i1_k1_tree_importance(spark, d):
    """Split counts of the first tree profile at its full rounds (Spark ML), fitted on all rows."""
    model = _cv(spark, d, test=False).gbt_refit("a")
    df = spark.createDataFrame(I.tree_importance(model, FEATURES, kind="split"), "feature string, importance double")
    return I.top_features(df, 12)


def _tree_phi(spark, d):
    from pyspark.ml.functions import array_to_vector

    from cadence.operators.models import design_features

    cv = _cv(spark, d, test=False)
    model = cv.gbt_refit("a")
    t = cv.fit.transforms[(FULL, FULL)]
    feats = design_features(cv.w_train.select("id", "w"), "w", t.B, "x").select("id", "x")
    phi = I.tree_attributions(feats, "id", "x", model, t.names)
    return phi, model, model.transform(feats.withColumn("features", array_to_vector("x"))).select("id", "pred")


def i2_tree_attributions(spark, d):
    phi, _, _ = _tree_phi(spark, d)
    return phi.select(big("id"), *[r6(c) for c in FEATURES], r6("base"))


def i2_tree_additivity(spark, d):
    """Rows whose attributions and base add up to the tree model's own prediction, and the number of trees."""
    phi, model, pred = _tree_phi(spark, d)
    total = sum((F.col(c) for c in FEATURES), F.col("base"))
    j = phi.join(pred, "id").select((F.abs(total - F.col("pred")) <= 1e-9).alias("adds_up"))
    return j.agg(big(F.count(F.lit(1)), "n_rows"), big(F.count_if("adds_up"), "n_adding_up")).withColumn("n_trees", F.lit(len(model.trees)).cast("bigint"))


def i3_k2_tree_attribution_summary(spark, d):
    phi, _, _ = _tree_phi(spark, d)
    return I.top_attributions(I.attribution_summary(phi.drop("base"), "id"), 10).select("feature", r6("mean_abs_phi"))


def cv_stack_metrics(spark, d):
    """The reference's main flow on F6: four base models out of fold, non-negative stack, metrics."""
    from cadence.operators.metrics import metrics_table
    cv = _cv(spark, d)
    parts = [cv.linear_predictions(cv.ridge(), "ridge")[0], cv.boost("a", rounds=None)[0],
             cv.boost("b", rounds=None)[0], cv.rff_svr()[0]]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    models = ["ridge", "gbt_a", "gbt_b", "svr"]
    wide = long.groupBy("id").pivot("model", models).agg(F.first("pred")).join(cv.w_train.select("id", "y"), "id")
    wide = wide.checkpoint(eager=True)  # the models score once; the stacker and every metric read the scores
    stacker = ST.fit_stacker(wide, models, "y")
    scored = stacker.predict(wide)
    return metrics_table(scored, "y", "pred", "id").select("metric", r6("value"))


QUERIES = {
    "v1_assign_folds": v1_assign_folds,
    "v2_fold_sizes": v2_fold_sizes,
    "v3_baseline_oof": v3_baseline_oof,
    "v4_fold_medians": v4_fold_medians,
    "v5_fold_scaling": v5_fold_scaling,
    "v6_pca_variance": v6_pca_variance,
    "v6_pca_components": v6_pca_components,
    "v6_pca_ratios": v6_pca_ratios,
    "v7_ridge_coefficients": v7_ridge_coefficients,
    "v8_gbt_profile_a": v8_gbt_profile_a,
    "v9_gbt_profile_b": v9_gbt_profile_b,
    "v8_spark_ml_gbt": v8_spark_ml_gbt,
    "v10_rff_svr": v10_rff_svr,
    "v10_duality_gap": v10_duality_gap,
    "v11_ridge_oof": v11_ridge_oof,
    "v12_ridge_test_average": v12_ridge_test_average,
    "v13_stacker": v13_stacker,
    "v14_stack_predict": v14_stack_predict,
    "v13_v14_four_model_stack": v13_v14_four_model_stack,
    "v15_full_refit": v15_full_refit,
    "v15_four_model_refit": v15_four_model_refit,
    "v16_ablation": v16_ablation,
    "v16_ablation_full": v16_ablation_full,
    "v16_ablation_oof": v16_ablation_oof,
    "i1_k1_tree_importance": i1_k1_tree_importance,
    "i2_linear_attributions": i2_linear_attributions,
    "i2_tree_attributions": i2_tree_attributions,
    "i2_tree_additivity": i2_tree_additivity,
    "i3_k2_tree_attribution_summary": i3_k2_tree_attribution_summary,
    "i3_attribution_summary": i3_attribution_summary,
    "k2_top_attributions": k2_top_attributions,
    "cv_stack_metrics": cv_stack_metrics,
}

# ---- oracles -------------------------------------------------------------------------------------------
_FOLDS = """f AS (SELECT id, repeat, stratum,
              CAST((row_number() OVER (PARTITION BY repeat ORDER BY stratum, md5('42:' || CAST(repeat AS VARCHAR) || ':' || CAST(id AS VARCHAR)), id) - 1) % 5 AS BIGINT) AS fold
       FROM (SELECT id, CAST(round_even(y, 0) AS BIGINT) AS stratum, r.repeat FROM f6_reg, range(2) r(repeat)) b),
tf AS (SELECT f.id, f.repeat, fo.fold FROM f, range(5) fo(fold) WHERE fo.fold <> f.fold
       UNION ALL SELECT id, -1, -1 FROM f6_reg)"""


def _mo(body: str) -> str:
    return with_fixtures("WITH " + _FOLDS + ",\n" + body, "f6_reg")


_LONG = """long AS (SELECT id, 'x1' AS feature, x1 AS v FROM f6_reg UNION ALL SELECT id, 'x2', x2 FROM f6_reg
        UNION ALL SELECT id, 'x3', x3 FROM f6_reg UNION ALL SELECT id, 'x4', x4 FROM f6_reg UNION ALL SELECT id, 'x_const', x_const FROM f6_reg),
med AS (SELECT repeat, fold, feature, quantile_cont(v, 0.5) AS m FROM tf JOIN long USING (id) WHERE v IS NOT NULL GROUP BY ALL)"""

# two-feature ridge (x1, x2), alpha 10, for every fold and the full refit
_RIDGE2 = """m2 AS (SELECT repeat, fold, max(m) FILTER (WHERE feature = 'x1') AS m1, max(m) FILTER (WHERE feature = 'x2') AS m2 FROM med GROUP BY ALL),
z AS (SELECT tf.repeat, tf.fold, r.id, r.y, coalesce(r.x1, m2.m1) AS z1, coalesce(r.x2, m2.m2) AS z2
      FROM tf JOIN f6_reg r USING (id) JOIN m2 USING (repeat, fold)),
st AS (SELECT repeat, fold, avg(z1) AS mu1, avg(z2) AS mu2, avg(y) AS ybar,
              CASE WHEN stddev_pop(z1) < 1e-9 THEN 1.0 ELSE stddev_pop(z1) END AS sd1,
              CASE WHEN stddev_pop(z2) < 1e-9 THEN 1.0 ELSE stddev_pop(z2) END AS sd2 FROM z GROUP BY ALL),
s AS (SELECT z.repeat, z.fold, (z1 - mu1) / sd1 AS s1, (z2 - mu2) / sd2 AS s2, y - ybar AS yc FROM z JOIN st USING (repeat, fold)),
g AS (SELECT repeat, fold, sum(s1 * s1) + 10 AS a11, sum(s1 * s2) AS a12, sum(s2 * s2) + 10 AS a22, sum(s1 * yc) AS b1, sum(s2 * yc) AS b2
      FROM s GROUP BY ALL),
cf AS (SELECT g.repeat, g.fold, (b1 * a22 - a12 * b2) / (a11 * a22 - a12 * a12) AS c1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS c2,
              st.ybar, st.mu1, st.mu2, st.sd1, st.sd2, m2.m1, m2.m2 FROM g JOIN st USING (repeat, fold) JOIN m2 USING (repeat, fold)),
pr AS (SELECT r.id, cf.repeat, cf.fold, cf.ybar + cf.c1 * (coalesce(r.x1, cf.m1) - cf.mu1) / cf.sd1 + cf.c2 * (coalesce(r.x2, cf.m2) - cf.mu2) / cf.sd2 AS pred
       FROM f6_reg r, cf)"""

_STACK2 = """WITH c AS (SELECT id, y, p1, p2, y - avg(y) OVER () AS yc, p1 - avg(p1) OVER () AS c1, p2 - avg(p2) OVER () AS c2 FROM f7_preds),
g AS (SELECT sum(c1 * c1) + 1 AS a11, sum(c1 * c2) AS a12, sum(c2 * c2) + 1 AS a22, sum(c1 * yc) AS b1, sum(c2 * yc) AS b2,
             avg(y) AS ybar, avg(p1) AS m1, avg(p2) AS m2 FROM c),
cand AS (SELECT (b1 * a22 - a12 * b2) / (a11 * a22 - a12 * a12) AS w1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS w2 FROM g
         UNION ALL SELECT b1 / a11, 0.0 FROM g UNION ALL SELECT 0.0, b2 / a22 FROM g UNION ALL SELECT 0.0, 0.0 FROM g),
best AS (SELECT w1, w2, ybar - w1 * m1 - w2 * m2 AS b FROM cand, g WHERE w1 >= 0 AND w2 >= 0
         ORDER BY w1 * w1 * a11 + 2 * w1 * w2 * a12 + w2 * w2 * a22 - 2 * (b1 * w1 + b2 * w2) LIMIT 1)
"""

_ABL = """WITH mz AS (SELECT quantile_cont(x1, 0.5) AS q1, quantile_cont(x2, 0.5) AS q2, avg(y) AS ybar FROM f6_reg),
z AS (SELECT y, coalesce(x1, q1) AS z1, coalesce(x2, q2) AS z2, x3 FROM f6_reg, mz),
st AS (SELECT avg(z1) AS mu1, CASE WHEN stddev_pop(z1) < 1e-9 THEN 1.0 ELSE stddev_pop(z1) END AS sd1,
              avg(z2) AS mu2, CASE WHEN stddev_pop(z2) < 1e-9 THEN 1.0 ELSE stddev_pop(z2) END AS sd2, avg(x3) AS mu3, avg(y) AS ybar FROM z),
s AS (SELECT y, y - ybar AS yc, (z1 - mu1) / sd1 AS s1, (z2 - mu2) / sd2 AS s2, x3 - mu3 AS c3, ybar FROM z, st),
cf AS (SELECT sum(s1 * yc) / (sum(s1 * s1) + 10) AS k1, sum(s2 * yc) / (sum(s2 * s2) + 10) AS k2, sum(c3 * yc) / (sum(c3 * c3) + 10) AS k3 FROM s)
SELECT 'Text-Only' AS view, round(sqrt(avg(power(least(greatest(ybar + k1 * s1, 0.0), 5.0) - y, 2))), 6) AS rmse FROM s, cf
UNION ALL SELECT 'Acoustic-Only', round(sqrt(avg(power(least(greatest(ybar + k2 * s2, 0.0), 5.0) - y, 2))), 6) FROM s, cf
UNION ALL SELECT 'Embeddings-Only', round(sqrt(avg(power(least(greatest(ybar + k3 * c3, 0.0), 5.0) - y, 2))), 6) FROM s, cf"""

_PHI = """WITH mz AS (SELECT quantile_cont(x1, 0.5) AS q1, quantile_cont(x2, 0.5) AS q2 FROM f6_reg),
z AS (SELECT id, y, coalesce(x1, q1) AS z1, coalesce(x2, q2) AS z2 FROM f6_reg, mz),
st AS (SELECT avg(z1) AS mu1, CASE WHEN stddev_pop(z1) < 1e-9 THEN 1.0 ELSE stddev_pop(z1) END AS sd1,
              avg(z2) AS mu2, CASE WHEN stddev_pop(z2) < 1e-9 THEN 1.0 ELSE stddev_pop(z2) END AS sd2, avg(y) AS ybar FROM z),
s AS (SELECT id, (z1 - mu1) / sd1 AS s1, (z2 - mu2) / sd2 AS s2, y - ybar AS yc FROM z, st),
g AS (SELECT sum(s1 * s1) + 10 AS a11, sum(s1 * s2) AS a12, sum(s2 * s2) + 10 AS a22, sum(s1 * yc) AS b1, sum(s2 * yc) AS b2 FROM s),
phi AS (SELECT id, (b1 * a22 - a12 * b2) / (a11 * a22 - a12 * a12) * s1 AS phi_x1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) * s2 AS phi_x2 FROM s, g),
sm AS (SELECT 'phi_x1' AS feature, avg(abs(phi_x1)) AS mean_abs_phi FROM phi UNION ALL SELECT 'phi_x2', avg(abs(phi_x2)) FROM phi)
"""

_PCA = """WITH f AS (SELECT vec_id, repeat,
              CAST((row_number() OVER (PARTITION BY repeat ORDER BY stratum, md5('42:' || CAST(repeat AS VARCHAR) || ':' || CAST(vec_id AS VARCHAR)), vec_id) - 1) % 5 AS BIGINT) AS fold
       FROM (SELECT vec_id, CAST(round_even(label / 2.0, 0) AS BIGINT) AS stratum, r.repeat FROM embeddings, range(2) r(repeat)) b),
tf AS (SELECT f.vec_id, f.repeat, fo.fold FROM f, range(5) fo(fold) WHERE fo.fold <> f.fold UNION ALL SELECT vec_id, -1, -1 FROM embeddings),
e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS j FROM embeddings),
vj AS (SELECT repeat, fold, j, var_samp(CAST(v AS DOUBLE)) AS var FROM tf JOIN e USING (vec_id) GROUP BY ALL)
SELECT CAST(repeat AS BIGINT) AS repeat, CAST(fold AS BIGINT) AS fold, round(sum(var), 6) AS total_variance FROM vj GROUP BY ALL"""

_PCA_SUMS = _PCA[:_PCA.index("vj AS")] + """x AS (SELECT tf.repeat, tf.fold, a.j AS i, b.j, covar_samp(CAST(a.v AS DOUBLE), CAST(b.v AS DOUBLE)) AS c
      FROM tf JOIN e a ON a.vec_id = tf.vec_id JOIN e b ON b.vec_id = tf.vec_id GROUP BY ALL),
sq AS (SELECT a.repeat, a.fold, a.i, b.j, sum(a.c * b.c) AS c FROM x a JOIN x b ON a.repeat = b.repeat AND a.fold = b.fold AND a.j = b.i GROUP BY ALL),
t1 AS (SELECT repeat, fold, sum(c) AS t FROM x WHERE i = j GROUP BY ALL), t2 AS (SELECT repeat, fold, sum(c) AS t FROM sq WHERE i = j GROUP BY ALL),
t3 AS (SELECT a.repeat, a.fold, sum(a.c * b.c) AS t FROM sq a JOIN x b ON a.repeat = b.repeat AND a.fold = b.fold AND a.i = b.j AND a.j = b.i GROUP BY ALL)
SELECT CAST(t1.repeat AS BIGINT) AS repeat, CAST(t1.fold AS BIGINT) AS fold, round(t1.t, 6) AS trace_1, round(t2.t * 1e3, 6) AS trace_2_e3, round(t3.t * 1e6, 6) AS trace_3_e6,
       CAST(0 AS DOUBLE) AS angle_error, CAST(0 AS DOUBLE) AS variance_error
FROM t1 JOIN t2 ON t1.repeat = t2.repeat AND t1.fold = t2.fold JOIN t3 ON t1.repeat = t3.repeat AND t1.fold = t3.fold"""


def _nonneg_sql(source: str, models: list[str]) -> str:
    """CTEs up to ``best`` (w_1.., b): the stacker's ridge over all active sets of ``models`` in ``source`` (y and one column per model), each
    solved by elimination; of the solutions without a negative weight the one of least loss."""
    from itertools import combinations

    k = len(models)
    means = ", ".join(f"avg({m}) AS mu{i}" for i, m in enumerate(models))
    cross = ", ".join(f"sum(({models[i]} - mu{i}) * ({models[j]} - mu{j})){' + 1' if i == j else ''} AS a{min(i, j)}{max(i, j)}" for i in range(k) for j in range(i, k))
    out = [f"mu AS (SELECT avg(y) AS muy, {means} FROM {source})",
           f"g0 AS (SELECT {cross}, {', '.join(f'sum(({m} - mu{i}) * (y - muy)) AS b{i}' for i, m in enumerate(models))} FROM {source}, mu)"]
    a = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    tries = []
    for size in range(1, k + 1):
        for own in combinations(range(k), size):
            name = "s" + "".join(map(str, own))
            before = "g0"
            for n, p in enumerate(own[:-1]):                                  # eliminate p from the later rows
                rest = own[n + 1:]
                cols = [f"{a(i, j)} - {a(p, i)} * {a(p, j)} / {a(p, p)} AS {a(i, j)}" for x, i in enumerate(rest) for j in rest[x:]]
                cols += [f"b{i} - {a(p, i)} * b{p} / {a(p, p)} AS b{i}" for i in rest]
                kept = [f"{a(q, j)} AS {a(q, j)}" for m, q in enumerate(own[:n + 1]) for j in own[m:]] + [f"b{q} AS b{q}" for q in own[:n + 1]]
                out.append(f"{name}_{n} AS (SELECT {', '.join(kept + cols)} FROM {before})")
                before = f"{name}_{n}"
            for p in reversed(own):                                           # back substitution, one weight a step
                later = [q for q in own if q > p]
                value = f"(b{p}{''.join(f' - {a(p, q)} * w{q}' for q in later)}) / {a(p, p)}"
                out.append(f"{name}_w{p} AS (SELECT *, {value} AS w{p} FROM {before})")
                before = f"{name}_w{p}"
            tries.append("SELECT " + ", ".join(f"w{i}" if i in own else f"0.0::DOUBLE AS w{i}" for i in range(k)) + f" FROM {before}")
    tries.append("SELECT " + ", ".join(f"0.0::DOUBLE AS w{i}" for i in range(k)))
    loss = " + ".join([f"w{i} * w{j} * {a(i, j)}" for i in range(k) for j in range(k)]) + " - 2 * (" + " + ".join(f"w{i} * b{i}" for i in range(k)) + ")"
    out.append("cand AS (" + " UNION ALL ".join(tries) + ")")
    out.append(f"best AS (SELECT {', '.join(f'w{i}' for i in range(k))}, muy - {' - '.join(f'w{i} * mu{i}' for i in range(k))} AS b0 FROM cand, g0, mu "
               f"WHERE {' AND '.join(f'w{i} >= 0' for i in range(k))} ORDER BY {loss} LIMIT 1)")
    return ",\n".join(out)


# one-feature ridge per view and training set: prediction of every row by every fold model, out of fold and refitted
_FOUR = _LONG + """,
    v AS (SELECT unnest(['m1', 'm2', 'm3', 'm4']) AS model, unnest(['x1', 'x2', 'x3', 'x4']) AS feature),
    z AS (SELECT v.model, tf.repeat, tf.fold, l.id, r.y, coalesce(l.v, m.m) AS z
          FROM v JOIN long l ON l.feature = v.feature JOIN tf ON tf.id = l.id
          JOIN med m ON m.repeat = tf.repeat AND m.fold = tf.fold AND m.feature = v.feature JOIN f6_reg r ON r.id = l.id),
    st AS (SELECT model, repeat, fold, avg(z) AS mu, CASE WHEN stddev_pop(z) < 1e-9 THEN 1.0 ELSE stddev_pop(z) END AS sd, avg(y) AS ybar FROM z GROUP BY ALL),
    cf AS (SELECT z.model, z.repeat, z.fold, sum(((z.z - mu) / sd) * (y - ybar)) / (sum(((z.z - mu) / sd) * ((z.z - mu) / sd)) + 10) AS c
           FROM z JOIN st USING (model, repeat, fold) GROUP BY ALL),
    asked AS (SELECT id, repeat, fold FROM f UNION ALL SELECT id, -1, -1 FROM f6_reg),
    pr AS (SELECT v.model, q.id, q.repeat, st.ybar + cf.c * (coalesce(l.v, m.m) - st.mu) / st.sd AS p
           FROM v JOIN long l ON l.feature = v.feature JOIN asked q ON q.id = l.id
           JOIN st ON st.model = v.model AND st.repeat = q.repeat AND st.fold = q.fold JOIN cf ON cf.model = v.model AND cf.repeat = q.repeat AND cf.fold = q.fold
           JOIN med m ON m.repeat = q.repeat AND m.fold = q.fold AND m.feature = v.feature),
    mean AS (SELECT model, id, repeat < 0 AS refit, avg(p) AS p FROM pr GROUP BY ALL),
    four AS (SELECT mean.id, refit, any_value(r.y) AS y, max(p) FILTER (WHERE model = 'm1') AS m1, max(p) FILTER (WHERE model = 'm2') AS m2,
                    max(p) FILTER (WHERE model = 'm3') AS m3, max(p) FILTER (WHERE model = 'm4') AS m4 FROM mean JOIN f6_reg r USING (id) GROUP BY ALL),
    oof4 AS (SELECT * FROM four WHERE NOT refit),
    """ + _nonneg_sql("oof4", ["m1", "m2", "m3", "m4"])
_STACKED = "least(greatest(b0 + w0 * m1 + w1 * m2 + w2 * m3 + w3 * m4, 0.0), 5.0)"

ORACLES = {
    "v1_assign_folds": _mo("x AS (SELECT 1) SELECT CAST(id AS BIGINT) AS id, CAST(repeat AS BIGINT) AS repeat, fold, stratum FROM f"),
    "v2_fold_sizes": _mo("""x AS (SELECT repeat, fold, count(*) AS n FROM f GROUP BY ALL)
        SELECT CAST(repeat AS BIGINT) AS repeat, fold, CAST(n AS BIGINT) AS n_val,
               CAST(sum(n) OVER (PARTITION BY repeat) - n AS BIGINT) AS n_train FROM x"""),
    "v3_baseline_oof": _mo("""fm AS (SELECT repeat, fold, sum(y) AS s, count(*) AS n FROM f JOIN f6_reg USING (id) GROUP BY ALL),
        tm AS (SELECT repeat, fold, (sum(s) OVER (PARTITION BY repeat) - s) / (sum(n) OVER (PARTITION BY repeat) - n) AS m FROM fm)
        SELECT CAST(id AS BIGINT) AS id, round(avg(m), 6) AS pred FROM f JOIN tm USING (repeat, fold) GROUP BY id"""),
    "v4_fold_medians": _mo(_LONG + """
        SELECT CAST(repeat AS BIGINT) AS repeat, CAST(fold AS BIGINT) AS fold, feature, round(m, 6) AS median FROM med"""),
    "v5_fold_scaling": _mo(_LONG + """,
        z AS (SELECT tf.repeat, tf.fold, long.feature, coalesce(long.v, med.m) AS z FROM tf JOIN long USING (id) JOIN med USING (repeat, fold, feature))
        SELECT CAST(repeat AS BIGINT) AS repeat, CAST(fold AS BIGINT) AS fold, feature, round(avg(z), 6) AS mean,
               round(CASE WHEN stddev_pop(z) < 1e-9 THEN 1.0 ELSE stddev_pop(z) END, 6) AS std FROM z GROUP BY ALL"""),
    "v6_pca_variance": _PCA,
    "v7_ridge_coefficients": _mo(_LONG + ",\n" + _RIDGE2 + """
        SELECT CAST(repeat AS BIGINT) AS repeat, CAST(fold AS BIGINT) AS fold, round(c1, 6) AS coef_x1, round(c2, 6) AS coef_x2,
               round(ybar, 6) AS intercept FROM cf"""),
    "v11_ridge_oof": _mo(_LONG + ",\n" + _RIDGE2 + """
        SELECT CAST(pr.id AS BIGINT) AS id, round(avg(pred), 6) AS pred FROM pr JOIN f ON pr.id = f.id AND pr.repeat = f.repeat AND pr.fold = f.fold
        GROUP BY pr.id"""),
    "v12_ridge_test_average": _mo(_LONG + ",\n" + _RIDGE2 + """
        SELECT CAST(id AS BIGINT) AS id, round(avg(pred), 6) AS pred FROM pr WHERE repeat >= 0 GROUP BY id"""),
    "v15_full_refit": _mo(_LONG + ",\n" + _RIDGE2 + """
        SELECT CAST(id AS BIGINT) AS id, round(pred, 6) AS pred FROM pr WHERE repeat = -1"""),
    "v10_duality_gap": _mo("""n AS (SELECT repeat, fold, count(*) AS n FROM tf GROUP BY ALL)
        SELECT CAST(repeat AS BIGINT) AS repeat, CAST(fold AS BIGINT) AS fold, CAST(n AS BIGINT) AS n_train, true AS gap_is_a_bound, true AS gap_within_tolerance FROM n"""),
    "v6_pca_components": _PCA_SUMS,
    "v13_v14_four_model_stack": with_fixtures("WITH " + _nonneg_sql("f7_preds", ["p1", "p2", "p3", "p4"]) + """
        SELECT CAST(id AS BIGINT) AS id, round(least(greatest(b0 + w0 * p1 + w1 * p2 + w2 * p3 + w3 * p4, 0.0), 5.0), 6) AS pred FROM f7_preds, best""", "f7_preds"),
    "v15_four_model_refit": _mo(_FOUR + f" SELECT CAST(id AS BIGINT) AS id, round({_STACKED}, 6) AS pred FROM four, best WHERE refit"),
    "v16_ablation_full": _mo(_FOUR + f""",
        full_ AS (SELECT sqrt(avg(power({_STACKED} - y, 2))) AS rmse FROM oof4, best),
        ey AS (SELECT y, x3, x4, y - avg(y) OVER () AS yc, x3 - avg(x3) OVER () AS c3, x4 - avg(x4) OVER () AS c4, avg(y) OVER () AS my FROM f6_reg),
        eg AS (SELECT sum(c3 * c3) + 10 AS a, sum(c3 * c4) AS b, sum(c4 * c4) + 10 AS c, sum(c3 * yc) AS p, sum(c4 * yc) AS q FROM ey),
        er AS (SELECT sqrt(avg(power(least(greatest(my + (p * c - b * q) / (a * c - b * b) * c3 + (a * q - b * p) / (a * c - b * b) * c4, 0.0), 5.0) - y, 2))) AS rmse FROM ey, eg)
        SELECT 'Text-Only' AS view, round(sqrt(avg(power(least(greatest(m1, 0.0), 5.0) - y, 2))), 6) AS rmse FROM four WHERE refit
        UNION ALL SELECT 'Acoustic-Only', round(sqrt(avg(power(least(greatest(m2, 0.0), 5.0) - y, 2))), 6) FROM four WHERE refit
        UNION ALL SELECT 'Embeddings-Only', round(rmse, 6) FROM er UNION ALL SELECT 'Full Multi-View Stack', round(rmse, 6) FROM full_"""),
    "v13_stacker": with_fixtures(_STACK2 + "SELECT round(w1, 6) AS w_p1, round(w2, 6) AS w_p2, round(b, 6) AS intercept FROM best", "f7_preds"),
    "v14_stack_predict": with_fixtures(_STACK2 + """SELECT CAST(id AS BIGINT) AS id,
        round(least(greatest(b + w1 * p1 + w2 * p2, 0.0), 5.0), 6) AS pred FROM f7_preds, best""", "f7_preds"),
    "v16_ablation": with_fixtures(_ABL, "f6_reg"),
    "i2_tree_additivity": with_fixtures("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_adding_up, CAST(120 AS BIGINT) AS n_trees FROM f6_reg", "f6_reg"),
    "i2_linear_attributions": with_fixtures(_PHI + "SELECT CAST(id AS BIGINT) AS id, round(phi_x1, 6) AS phi_x1, round(phi_x2, 6) AS phi_x2 FROM phi", "f6_reg"),
    "i3_attribution_summary": with_fixtures(_PHI + "SELECT feature, round(mean_abs_phi, 6) AS mean_abs_phi FROM sm", "f6_reg"),
    "k2_top_attributions": with_fixtures(_PHI + "SELECT feature, round(mean_abs_phi, 6) AS mean_abs_phi FROM sm ORDER BY mean_abs_phi DESC, feature LIMIT 10", "f6_reg"),
}
ORACLES["v16_ablation_oof"] = _mo(_LONG + """,
    v AS (SELECT 'Text-Only' AS view, 'x1' AS feature UNION ALL SELECT 'Acoustic-Only', 'x2'),
    z AS (SELECT v.view, tf.repeat, tf.fold, l.id, r.y, coalesce(l.v, m.m) AS z
          FROM v JOIN long l ON l.feature = v.feature JOIN tf ON tf.id = l.id
          JOIN med m ON m.repeat = tf.repeat AND m.fold = tf.fold AND m.feature = v.feature
          JOIN f6_reg r ON r.id = l.id WHERE tf.repeat >= 0),
    st AS (SELECT view, repeat, fold, avg(z) AS mu, CASE WHEN stddev_pop(z) < 1e-9 THEN 1.0 ELSE stddev_pop(z) END AS sd,
                  avg(y) AS ybar FROM z GROUP BY ALL),
    cf AS (SELECT z.view, z.repeat, z.fold, sum(((z.z - mu) / sd) * (y - ybar)) / (sum(((z.z - mu) / sd) * ((z.z - mu) / sd)) + 10) AS c
           FROM z JOIN st USING (view, repeat, fold) GROUP BY ALL),
    pr AS (SELECT v.view, f.id, f.repeat, st.ybar + cf.c * (coalesce(l.v, m.m) - st.mu) / st.sd AS p
           FROM v JOIN long l ON l.feature = v.feature JOIN f ON f.id = l.id
           JOIN st ON st.view = v.view AND st.repeat = f.repeat AND st.fold = f.fold
           JOIN cf ON cf.view = v.view AND cf.repeat = f.repeat AND cf.fold = f.fold
           JOIN med m ON m.repeat = f.repeat AND m.fold = f.fold AND m.feature = v.feature),
    oof AS (SELECT view, id, avg(p) AS p FROM pr GROUP BY ALL)
    SELECT view, round(sqrt(avg(power(least(greatest(p, 0.0), 5.0) - y, 2))), 6) AS rmse FROM oof JOIN f6_reg USING (id) GROUP BY view""")


# ---- the end-to-end flow on documents as clips ------------------------------------------------------------

EMBEDDING = 384  # dimensions, as the reference's


def scoring_run_documents(spark, d):
    """Main flow on F1: text + syntax + sentence-score views and a TF-IDF embedding (PCA 16 in-fold),
    four base models out of fold, stack, metrics, refit, ablation, importances, checked predictions."""
    from cadence.functions.text import text_features
    from cadence.operators import scores as SC
    from cadence.operators.syntax import syntax_features
    from cadence.operators.assemble import assemble
    from cadence.plans.scoring_run import run_scoring

    f1 = fx.f1_transcripts(spark, d).persist()  # read by every view
    keys = ["split", "filename"]
    spine = f1.select(*keys, "doc_id", "label")
    tf = text_features(F.col("clean_transcript"))
    text_view = f1.select(*keys, *[c.cast("double").alias(n) for n, c in tf.items()])
    sents = fx.f3_sents(f1)
    syn = syntax_features(fx.f3_tokens(sents), spine=f1.select("doc_id"))
    scores = SC.score_stats(SC.eligible_sentences(fx.f4_scores(sents), SC.ACCEPTABILITY_MIN_LEN), f1.select("doc_id"))
    lm = SC.ngram_lm_fit(sents, ["doc_id", "sent_no"])
    losses = SC.ngram_lm_score(SC.eligible_sentences(sents, SC.LOSS_MIN_LEN), lm, ["doc_id", "sent_no"], fitted=True)
    loss = SC.loss_stats(losses, f1.select("doc_id"))
    per_doc = syn.join(scores, "doc_id").join(loss, "doc_id")
    per_doc = f1.select(*keys, "doc_id").join(per_doc, "doc_id").drop("doc_id")
    emb = SC.embed_text(f1, keys, "raw_transcript", dim=EMBEDDING)
    table = assemble(spine, [text_view, per_doc, emb], keys).drop("doc_id").checkpoint(eager=True)
    SC.release_lm(lm)
    f1.unpersist()
    text_cols = [c for c in text_view.columns if c not in keys]
    doc_cols = [c for c in per_doc.columns if c not in keys]
    features = [c for c in text_cols + doc_cols if c not in ("spacy_sent_count",)] + ["spacy_sent_count"]
    # file names are unique across splits here, so the name alone is the model key
    res = run_scoring(table, "filename", "label", features, {"Text-Only": text_cols, "Syntax-Scores-Only": doc_cols},
                      "embedding", EMBEDDING, name_col="filename")
    train_row = spark.createDataFrame([("train_refit_rmse", float(res.train_rmse))], "metric string, value double")
    abl = res.ablation.select(F.concat(F.lit("ablation_rmse:"), "view").alias("metric"), F.col("rmse").alias("value"))
    chk = res.checks.select(F.concat(F.lit("check:"), "check").alias("metric"), F.col("passed").cast("double").alias("value"))
    return res.metrics.unionByName(train_row).unionByName(abl).unionByName(chk).select("metric", r6("value"))


QUERIES["scoring_run_documents"] = scoring_run_documents
