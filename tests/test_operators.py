"""Edge cases and independent numpy re-computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadence.functions import text as T
from cadence.functions import signal as S
from cadence.operators import metrics as M
from cadence.operators.folds import FULL, assign_folds
from cadence.operators.keys import dedupe_first
from cadence.operators.models import Layout, fit_folds, ridge_coef
from cadence.operators.ordinal import average_rank, exact_quantiles, ordinal_within
from cadence.operators.stack import fit_stacker, nonneg_ridge
from cadence.operators.syntax import token_depths


def test_ordinal_with_one_hot_group(spark):
    # one group holds most rows: positions must still be dense and ordered
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 7).alias("g"),
                                  (F.col("id") * 7919 % 5003).alias("o"))
    r = ordinal_within(df, ["g"], ["o"]).toPandas()
    for _, grp in r.groupby("g"):
        grp = grp.sort_values("o")
        assert list(grp["ord"]) == list(range(len(grp)))


def test_exact_quantiles_match_numpy(spark):
    vals = [1.0, 2.0, 4.0, 9.0, None, 3.5, 3.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = exact_quantiles(df, [], "x", {"q25": 0.25, "med": 0.5, "q90": 0.9}).first()
    arr = np.array([v for v in vals if v is not None])
    assert q["q25"] == pytest.approx(np.quantile(arr, 0.25))
    assert q["med"] == pytest.approx(np.median(arr))
    assert q["q90"] == pytest.approx(np.quantile(arr, 0.9))


def test_average_rank_ties(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 3.0, 2.0, 3.0])], "k long, v double")
    r = {row["k"]: row["r"] for row in average_rank(df, "v", ["k"], "r").collect()}
    assert r == {1: 1.0, 3: 2.0, 0: 4.0, 2: 4.0, 4: 4.0}


def test_text_edge_cases(spark):
    rows = [("",), ("a a a",), ("it it's fine",), ("um like you know",), ("he go home",)]
    df = spark.createDataFrame(rows, "t string")
    feats = T.text_features(F.col("t"))
    out = df.select("t", T.num_words("t").alias("nw"), feats["adjacent_repeats"].alias("rep"),
                    feats["disfluency_filler_count"].alias("fill"), feats["sv_errors"].alias("sv")).toPandas()
    by = out.set_index("t")
    assert by.loc["", "nw"] == 1 and by.loc["", "rep"] == 0
    assert by.loc["a a a", "rep"] == 1            # run of three -> floor(3/2)
    assert by.loc["it it's fine", "rep"] == 1     # regex form matches 'it it' before the apostrophe
    assert by.loc["um like you know", "fill"] == 2  # the two-word filler never equals one token
    assert by.loc["he go home", "sv"] == 1


def test_clip_keeps_null_and_round_even(spark):
    df = spark.createDataFrame([(None,), (2.5,), (7.0,), (-1.0,), (3.5,)], "x double")
    out = df.select(T.clip("x").alias("c"), T.round_even("x").alias("r")).collect()
    assert out[0]["c"] is None
    assert [o["c"] for o in out[1:]] == [2.5, 5.0, 0.0, 3.5]
    assert [o["r"] for o in out[1:]] == [2, 7, -1, 4]


def test_metrics_constant_input_is_null(spark):
    df = spark.createDataFrame([(i, 1.0, float(i)) for i in range(5)], "id long, y double, p double")
    b = M.basic_metrics(df, "y", "p").first()
    assert b["pearson"] is None and b["r2"] is None
    assert M.qwk(spark.createDataFrame([(1, 2.0, 2.0)], "id long, y double, p double"), "y", "p").first()["qwk"] is None


def test_qwk_uses_label_positions(spark):
    y = [0, 1, 2, 4, 4, 2]
    p = [0, 2, 2, 4, 1, 2]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "id long, y double, p double")
    got = M.qwk(df, "y", "p").first()["qwk"]
    labels = sorted(set(y) | set(p))
    idx = {v: i for i, v in enumerate(labels)}
    K = len(labels)
    O = np.zeros((K, K))
    for a, b in zip(y, p):
        O[idx[a], idx[b]] += 1
    W = np.array([[(i - j) ** 2 for j in range(K)] for i in range(K)], dtype=float)
    E = np.outer(O.sum(1), O.sum(0)) / O.sum()
    assert got == pytest.approx(1 - (W * O).sum() / (W * E).sum())


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, "b"), (2, 5, "z")], "k int, o int, v string")
    out = {r["k"]: r["v"] for r in dedupe_first(df, ["k"], ["o"]).collect()}
    assert out == {1: "a", 2: "z"}


def test_folds_balanced_and_each_row_once(spark):
    df = spark.range(103).select(F.col("id"), (F.col("id") % 6 / 1.3).alias("y"))
    f = assign_folds(df, "id", "y", k=5, repeats=2, seed=7).toPandas()
    for r, g in f.groupby("repeat"):
        assert len(g) == 103 and g["id"].is_unique
        sizes = g.groupby("fold").size()
        assert sizes.max() - sizes.min() <= 1
        per = g.groupby(["stratum", "fold"]).size().unstack(fill_value=0)
        assert (per.max(axis=1) - per.min(axis=1)).max() <= 1


def test_gram_ridge_matches_numpy_with_imputation(spark):
    rng = np.random.default_rng(0)
    n = 400
    X = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.1] + [3.0, -2.0, 100.0]
    y = X @ [0.5, -0.2, 3.0] + rng.normal(size=n)
    X[rng.random(n) < 0.15, 1] = np.nan
    pdf = pd.DataFrame({"id": np.arange(n), "a": X[:, 0], "b": X[:, 1], "c": X[:, 2], "y": y})
    df = spark.createDataFrame(pdf)
    lay = Layout(["a", "b", "c"], label="y")
    folds = assign_folds(df, "id", "y", 5, 1, 3)
    fit = fit_folds(df, folds, "id", lay, 5, 1)
    fpd = folds.toPandas().set_index("id")
    for rf in [(0, 0), (0, 3), (FULL, FULL)]:
        tr = pdf if rf[0] == FULL else pdf[fpd.loc[pdf["id"], "fold"].to_numpy() != rf[1]]
        Xt = tr[["a", "b", "c"]].to_numpy().copy()
        med = np.nanmedian(Xt, axis=0)
        Xt = np.where(np.isnan(Xt), med, Xt)
        mu, sd = Xt.mean(0), Xt.std(0)
        Z = (Xt - mu) / sd
        yt = tr["y"].to_numpy()
        want = np.linalg.solve(Z.T @ Z + 10.0 * np.eye(3), Z.T @ (yt - yt.mean()))
        got, icpt = ridge_coef(fit.train_gram(*rf), fit.transforms[rf], lay, 10.0)
        assert np.allclose(got, want, rtol=1e-8, atol=1e-10)
        assert icpt == pytest.approx(yt.mean())


def test_pca_variance_matches_numpy(spark):
    rng = np.random.default_rng(1)
    n, e = 200, 8
    E = rng.normal(size=(n, e)) @ rng.normal(size=(e, e))
    pdf = pd.DataFrame({"id": np.arange(n), "y": rng.integers(0, 5, n).astype(float)})
    pdf["emb"] = list(E)
    df = spark.createDataFrame(pdf, "id long, y double, emb array<double>")
    folds = assign_folds(df, "id", "y", 5, 1, 3)
    fit = fit_folds(df, folds, "id", Layout([], "emb", e, "y"), 5, 1, n_components=3)
    t = fit.transforms[(FULL, FULL)]
    vals = np.sort(np.linalg.eigvalsh(np.cov(E.T)))[::-1]
    assert np.allclose(t.explained_variance, vals[:3], rtol=1e-8)
    assert t.total_variance == pytest.approx(np.trace(np.cov(E.T)))


def test_nonneg_stacker_kkt():
    rng = np.random.default_rng(2)
    X = rng.normal(size=(300, 4))
    y = X @ [1.0, -0.5, 0.3, 0.0] + rng.normal(size=300)
    Xc, yc = X - X.mean(0), y - y.mean()
    A, b = Xc.T @ Xc, Xc.T @ yc
    w = nonneg_ridge(A, b, 1.0)
    grad = 2 * ((A + np.eye(4)) @ w - b)
    assert np.all(w >= 0)
    assert np.all(np.abs(grad[w > 0]) < 1e-8)
    assert np.all(grad[w == 0] >= -1e-8)


def test_fit_stacker_intercept(spark):
    df = spark.createDataFrame([(i, float(i % 5), float(i % 5) * 0.9 + 0.3, 2.0) for i in range(50)],
                               "id long, y double, p1 double, p2 double")
    s = fit_stacker(df, ["p1", "p2"], "y", 1.0)
    assert s.weights[0] > 0 and s.weights[1] == 0.0


def test_pointer_jumping_depth_chain(spark):
    # a chain of 40 tokens (depth up to 40) and a star
    rows = [(1, 0, t, t - 1 if t > 0 else 0) for t in range(40)] + [(2, 0, t, 0) for t in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, sent_no long, tok_no long, head_tok long")
    d = {(r["doc_id"], r["tok_no"]): r["depth"] for r in token_depths(df).collect()}
    assert d[(1, 39)] == 40 and d[(1, 0)] == 1 and d[(2, 5)] == 2


def test_signal_kernels_match_reference_math():
    y = np.array([0.0, 0.5, -0.5, 1.0, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0])
    r = S.np_frame_rms(y, 4, 2)
    p = np.pad(y, 2)
    assert np.allclose(r, [np.sqrt(np.mean(p[i:i + 4] ** 2)) for i in range(0, len(p) - 3, 2)])
    start, end = S.np_trim_bounds(y, 30.0, 4, 2)
    assert start == 0 and end <= len(y)
    assert S.np_trim_bounds(np.zeros(12), 30.0, 4, 2) == (0, 12)  # equally quiet: nothing trimmed


def test_tree_attributions_add_up_to_prediction(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    from cadence.operators.explain import tree_attributions

    rng = np.random.default_rng(3)
    n = 300
    X = rng.normal(size=(n, 4))
    y = 2 * (X[:, 0] > 0) + X[:, 1] * X[:, 2] + 0.1 * rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "y": y})
    pdf["x"] = list(X)
    df = spark.createDataFrame(pdf, "id long, y double, x array<double>").withColumn("features", array_to_vector("x"))
    model = GBTRegressor(maxIter=8, maxDepth=3, stepSize=0.1, seed=1, labelCol="y").fit(df)
    phi = tree_attributions(df, "id", "x", model, ["a", "b", "c", "d"]).toPandas().set_index("id").sort_index()
    pred = model.transform(df).select("id", "prediction").toPandas().set_index("id").sort_index()["prediction"]
    total = phi[["a", "b", "c", "d"]].sum(axis=1) + phi["base"]
    assert np.allclose(total.to_numpy(), pred.to_numpy(), atol=1e-8)
    assert phi["d"].abs().mean() < phi["a"].abs().mean()


def test_ranks_and_quantiles_with_one_value_in_most_rows(spark):
    from cadence.operators.ordinal import value_positions

    n = 200_000
    df = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 10 < 9, 0.0).otherwise((F.col("id") % 997).cast("double")).alias("v"))
    pdf = df.toPandas()
    got = average_rank(df, "v", ["k"], "r").toPandas().set_index("k")["r"].sort_index()
    assert np.allclose(got.to_numpy(), pdf["v"].rank().to_numpy())
    q = exact_quantiles(df, [], "v", {"a": 0.5, "b": 0.93, "c": 0.999}).first()
    assert [q["a"], q["b"], q["c"]] == pytest.approx(pdf["v"].quantile([0.5, 0.93, 0.999]).tolist())
    # no task sees the rows of the frequent value: what is ordered are distinct values
    placed = value_positions(df, [], "v")
    assert placed.count() == pdf["v"].nunique() and placed.agg(F.sum("_c")).first()[0] == n


def test_medians_by_counting_match_numpy(spark):
    """Negative values, both zeros, NULL, NaN, one value in most rows, an empty column; 3 repeats of 4 folds."""
    from cadence.operators.folds import FULL, fold_medians, fold_vectors

    rng = np.random.default_rng(4)
    n = 3000
    cols = {"a": rng.normal(0, 1e3, n), "b": np.where(rng.random(n) < 0.7, 2.5, rng.normal(0, 1e-9, n)), "c": np.where(rng.random(n) < 0.5, 0.0, -0.0),
            "d": np.full(n, np.nan), "e": rng.integers(-3, 4, n).astype(float)}
    cols["a"][::7] = np.nan
    pdf = pd.DataFrame({"id": np.arange(n), **cols})
    rows = spark.createDataFrame(pdf).withColumn("e", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("e")))
    fold = np.stack([rng.permutation(n) % 4 for _ in range(3)], axis=1)
    folds = spark.createDataFrame(pd.DataFrame([(i, r, int(fold[i, r])) for i in range(n) for r in range(3)], columns=["id", "repeat", "fold"]))
    got = {(r.repeat, r.fold, r.feature): r.median for r in fold_medians(rows, folds, "id", list(cols), 4).collect()}
    pdf.loc[pdf["id"] % 5 == 0, "e"] = np.nan
    want = {}
    for c in cols:
        for r, f in [(r, f) for r in range(3) for f in range(4)] + [(FULL, FULL)]:
            own = pdf[c][fold[:, r] != f] if r != FULL else pdf[c]
            if own.notna().any():
                want[r, f, c] = own.median()
    assert got == pytest.approx(want, rel=1e-14) and not [k for k in got if k[2] == "d"]
    assert fold_vectors(folds, "id", 3).count() == n


def test_medians_shuffle_nothing_that_grows_with_the_rows(spark):
    from cadence.operators import selection

    def sent(n):
        seen = []
        data = spark.range(n).select(F.array(F.lit(0)).alias("g"), F.rand(1).alias("x"))
        count = selection.tree_sum_arrays
        selection.tree_sum_arrays = lambda parts, keys, values: seen.append(parts.count()) or count(parts, keys, values)
        try:
            selection.radix_medians(data, ["x"], 1, [0], lambda c, t: c[0], [F.lit(0)])
        finally:
            selection.tree_sum_arrays = count
        return seen

    assert max(sent(200_000)) <= max(sent(20_000)) <= 16


def test_fold_grams_read_rows_once_and_equal_filtered_ones(spark):
    from cadence.operators import models

    rng = np.random.default_rng(6)
    n, k, repeats = 400, 3, 4
    fold = np.stack([rng.permutation(n) % k for _ in range(repeats)], axis=1)
    w = rng.normal(size=(n, 4))
    rows = spark.createDataFrame([(fold[i].tolist(), w[i].tolist()) for i in range(n)], "folds array<int>, w array<double>")
    for most in (256, 10, 1):                      # one pass, two passes of two repeats, one repeat a pass
        models.MOST_CELLS, before = most, models.MOST_CELLS
        try:
            got = models.fold_grams(rows, k, repeats, 4)
        finally:
            models.MOST_CELLS = before
        for (r, f), m in got.items():
            own = w[fold[:, r] == f]
            assert np.allclose(m, own.T @ own)
        assert len(got) == k * repeats


def test_histogram_booster_rules_and_attributions(spark):
    from dataclasses import replace

    from cadence.operators.boosting import PROFILES, FoldBooster, predict_model
    from cadence.operators.crossval import CrossValidation
    from cadence.operators.explain import tree_attributions
    from cadence.operators.models import design_features

    rng = np.random.default_rng(5)
    n = 600
    X = rng.normal(size=(n, 3))
    y = 2.0 * (X[:, 0] > 0.3) + np.sin(X[:, 1]) + 0.1 * rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "a": X[:, 0], "b": X[:, 1], "c": X[:, 2], "y": y})
    df = spark.createDataFrame(pdf)
    cv = CrossValidation(df, "id", Layout(["a", "b", "c"], label="y"), 5, 1, 3)
    for prof in ("a", "b"):
        params = replace(PROFILES[prof], rounds=15, learning_rate=0.3)
        models = FoldBooster(cv, params, [(0, 0), (FULL, FULL)]).fit()
        full = models[(FULL, FULL)]
        for t in full.trees:
            leaves = t.leaves()
            assert len(leaves) <= params.num_leaves
            assert max(t.depth) <= params.max_depth
            assert min(t.count[i] for i in leaves) >= params.min_leaf
        tr = cv.fit.transforms[(FULL, FULL)]
        pred = predict_model(cv.w_train, "id", full, tr.B).toPandas().set_index("id").sort_index()["pred"]
        assert np.sqrt(np.mean((pred.to_numpy() - y) ** 2)) < 0.6 * np.std(y)
        feats = design_features(cv.w_train.select("id", "w"), "w", tr.B, "x")
        phi = tree_attributions(feats, "id", "x", full, tr.names).toPandas().set_index("id").sort_index()
        total = phi[tr.names].sum(axis=1) + phi["base"]
        assert np.allclose(total.to_numpy(), pred.to_numpy(), atol=1e-8)
        assert full.split_counts()[2] <= full.split_counts()[0]


def test_histogram_booster_reads_rows_once_a_level(spark, monkeypatch):
    """Rows are not copied per fold, a leaf-wise tree takes a pass a level, and edges keep their ranks when runs are thinned."""
    from dataclasses import replace

    from cadence.operators import boosting
    from cadence.operators.crossval import CrossValidation

    rng = np.random.default_rng(3)
    n = 6000
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.integers(0, 9, n).astype(float)})
    pdf["y"] = np.sin(3 * pdf["a"]) + pdf["b"] + 0.1 * rng.normal(size=n)
    cv = CrossValidation(spark.createDataFrame(pdf), "id", Layout(["a", "b"], label="y"), 5, 2, 3)
    params = replace(boosting.PROFILES["a"], rounds=2)
    plain = boosting.FoldBooster(cv, params, cv.fit.fold_keys())
    assert sum(r.n for r in plain.table.select("n").collect()) == n          # one place per row
    passes = []
    real = boosting.FoldBooster._pass
    monkeypatch.setattr(boosting.FoldBooster, "_pass", lambda self, asked: passes.append(1) or real(self, asked))
    models = plain.fit()
    assert len(passes) <= 2 * params.max_depth
    # two trees from the definition: gradients and counts of every leaf
    rows = cv.w_rows.toPandas()
    for rf, m in models.items():
        t = cv.fit.transforms[rf]
        own = np.stack(rows["folds"])[:, rf[0]] != rf[1]
        X, y = np.stack(rows["w"])[own] @ t.B.T, rows["y"].to_numpy()[own]
        pred = np.full(len(y), y.mean())
        for tree in m.trees:
            leaf = tree.leaf_of(X, use_bins=False)
            for at in tree.leaves():
                assert tree.count[at] == (leaf == at).sum() >= params.min_leaf
                assert np.isclose(tree.value[at], params.learning_rate * (y - pred)[leaf == at].mean(), atol=1e-9)
            pred += np.asarray(tree.value)[leaf]
    # with runs of a few rows a stride of 2 or more: every edge within its share of ranks
    monkeypatch.setattr(boosting, "RUN_ROWS", 1 << 40)
    big = pd.concat([pdf.assign(id=pdf["id"] + i * n) for i in range(40)])
    wide = CrossValidation(spark.createDataFrame(big).coalesce(2), "id", Layout(["a", "b"], label="y"), 5, 1, 3)
    booster = boosting.FoldBooster(wide, params, [(0, 0)])
    rows = wide.w_rows.toPandas()
    x = np.sort(np.stack(rows["w"])[np.stack(rows["folds"])[:, 0] != 0] @ wide.fit.transforms[0, 0].B[0])
    edges = booster.edges[0, 0][0]
    assert len(edges) == params.bins - 1
    ranks = (np.searchsorted(x, edges, "left") + 1, np.searchsorted(x, edges, "right"))
    want = np.arange(1, params.bins) / params.bins * len(x)
    assert (ranks[0] - want <= 2e-4 * len(x)).all() and (want - ranks[1] <= 2e-4 * len(x)).all()


def test_fourier_features_are_exact_cosines():
    from cadence.operators.svr import ROWS, cosine_of_turns, fourier_features

    t = np.concatenate([np.linspace(-3, 3, 4001), [0.25, -0.25, 0.5, 0.75, 1e6 + 0.125]])
    assert np.abs(cosine_of_turns(t.copy()) - np.cos(2 * np.pi * (t - np.rint(t)))).max() < 1e-14
    rng = np.random.default_rng(1)
    x, omega, phase = rng.normal(size=(2 * ROWS + 7, 3)), rng.normal(size=(16, 3)), rng.uniform(0, 6, 16)
    want = np.hstack([np.sqrt(2 / 16) * np.cos(x @ omega.T + phase), np.ones((len(x), 1))])
    assert np.abs(fourier_features(x, omega, phase) - want).max() < 1e-13
    assert fourier_features(x[:0], omega, phase).shape == (0, 17)


def test_every_base_model_beats_baseline_out_of_fold(spark):
    from cadence.operators.crossval import CrossValidation

    rng = np.random.default_rng(11)
    n = 800
    X = rng.normal(size=(n, 4))
    y = np.clip(2.5 + X[:, 0] + 0.8 * np.tanh(2 * X[:, 1]) + 0.3 * rng.normal(size=n), 0, 5)
    pdf = pd.DataFrame({"id": np.arange(n), **{f"f{j}": X[:, j] for j in range(4)}, "y": y})
    pdf.loc[::13, "f2"] = np.nan
    df = spark.createDataFrame(pdf)
    cv = CrossValidation(df, "id", Layout([f"f{j}" for j in range(4)], label="y"), 5, 2, 42)
    truth = df.select("id", "y")

    def oof_rmse(oof):
        return M.basic_metrics(oof.join(truth, "id"), "y", "pred").first()["rmse"]

    base = oof_rmse(cv.linear_predictions(cv.baseline(), "baseline")[0])
    assert oof_rmse(cv.linear_predictions(cv.ridge(), "ridge")[0]) < 0.7 * base
    assert oof_rmse(cv.boost("a", rounds=30)[0]) < base
    assert oof_rmse(cv.boost("b", rounds=30)[0]) < base
    assert oof_rmse(cv.rff_svr(n_features=32)[0]) < 0.8 * base


def test_feature_store_reuses_only_exact_key_sets(spark):
    from cadence.session import scratch_path
    from cadence.sources.store import FeatureStore

    store = FeatureStore(spark, scratch_path(spark, "t_store_cache"))
    keys = spark.createDataFrame([("train", f"f{i}") for i in range(5)], "split string, filename string")
    calls = []

    def build():
        calls.append(1)
        return keys.withColumn("v", F.length("filename"))

    assert store.get_or_build("view", keys, build).count() == 5 and len(calls) == 1
    store.get_or_build("view", keys, build)
    assert len(calls) == 1                                   # exact match: reused
    more = keys.union(spark.createDataFrame([("test", "f9")], "split string, filename string"))
    assert store.get_or_build("view", more, lambda: (calls.append(1), more.withColumn("v", F.lit(1)))[1]).count() == 6
    assert len(calls) == 2                                   # mismatch: rebuilt


def test_tree_sum_two_levels_equals_one(spark, monkeypatch):
    import cadence.operators.gram as gm

    parts = spark.range(400).repartition(80).select((F.col("id") % 3).alias("k"),
                                                    F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    one = {r["k"]: r["v"] for r in gm.tree_sum_arrays(parts.coalesce(4), ["k"], ["v"]).collect()}
    monkeypatch.setattr(gm, "SINGLE_LEVEL_TASKS", 1)
    two = {r["k"]: r["v"] for r in gm.tree_sum_arrays(parts, ["k"], ["v"]).collect()}
    assert one == two
    assert two[0] == [float(sum(i for i in range(400) if i % 3 == 0)), float(len(range(0, 400, 3)))]


def test_token_depths_absent_head_sparse_numbers_and_cycle(spark):
    from cadence.operators.syntax import token_depths

    rows = [(1, 0, 0, 0), (1, 0, 1, 0), (1, 0, 2, 9), (1, 0, 3, 2), (1, 1, 10, 10), (1, 1, 30, 10), (1, 1, 70, 30), (1, 2, 5, None)]
    toks = spark.createDataFrame(rows, "doc_id long, sent_no long, tok_no long, head_tok long")
    got = {(r.sent_no, r.tok_no): r.depth for r in token_depths(toks).collect()}
    assert got == {(0, 0): 1, (0, 1): 2, (0, 2): 1, (0, 3): 2, (1, 10): 1, (1, 30): 2, (1, 70): 3, (2, 5): 1}
    cycle = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 2), (1, 0, 2, 1)], "doc_id long, sent_no long, tok_no long, head_tok long")
    with pytest.raises(Exception, match="cycle"):
        token_depths(cycle).collect()


def test_syntax_features_shuffle_tokens_once_for_counts_and_depths(spark):
    """No join of two aggregates of the tokens; the depths are those of ``token_depths``; sentences without a key have none."""
    from cadence.operators.syntax import syntax_features, token_depths

    rows = [(1, 0, 0, 0), (1, 0, 1, 0), (1, 0, 2, 1), (1, 1, 5, None), (2, 0, 3, 3), (2, 0, 9, 3), (2, 0, 11, 9), (2, 0, 12, 11), (None, 0, 0, 0), (None, 0, 1, 0)]
    toks = spark.createDataFrame([(*r, "Word", "VERB", "nsubj", False, True) for r in rows],
                                 "doc_id long, sent_no long, tok_no long, head_tok long, text string, pos string, dep string, is_punct boolean, is_alpha boolean")
    out = syntax_features(toks, vocabulary=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2
    got = {r.doc_id: (r.spacy_mean_dep_depth, r.spacy_max_dep_depth) for r in out.collect()}
    each = {}
    for r in token_depths(toks).collect():
        each.setdefault(r.doc_id, []).append(r.depth)
    assert got == {**{d: (sum(x) / len(x), float(max(x))) for d, x in each.items() if d is not None}, None: (1.0, 1.0)}


def test_cv_stack_scores_every_model_once(spark, monkeypatch):
    """The stacker and the metrics read the base models' predictions from one scoring."""
    from types import SimpleNamespace

    from cadence.plans import q_models

    scored = spark.sparkContext.accumulator(0)
    rows = spark.range(0, 60, 1, 3).selectExpr("id", "id % 5 + 0.5D as y")

    def model(name, k):
        def run(batches):
            for b in batches:
                scored.add(len(b))
                yield b.assign(pred=b["y"] * k, model=name)[["id", "pred", "model"]]
        return rows.mapInPandas(run, "id long, pred double, model string")

    cv = SimpleNamespace(ridge=lambda: None, linear_predictions=lambda b, n: (model("ridge", 0.9), None), w_train=rows,
                         boost=lambda p, rounds: (model("gbt_" + p, 0.8 if p == "a" else 0.7), None, None), rff_svr=lambda: (model("svr", 0.6), None, None))
    monkeypatch.setattr(q_models, "_cv", lambda spark, d: cv)
    got = {r.metric: r.value for r in q_models.cv_stack_metrics(spark, "").collect()}
    assert got["n"] == 60.0 and scored.value == 4 * 60


def test_missing_labels_are_an_error(spark):
    from cadence.operators.crossval import CrossValidation
    from cadence.operators.models import Layout

    rows = spark.createDataFrame([(i, None if i % 2 else 4.0, float(i)) for i in range(20)], "id long, y double, x double")
    with pytest.raises(ValueError, match="10 training rows"):
        CrossValidation(rows, "id", Layout(["x"]))


def test_small_scale_column_is_standardised(spark):
    from cadence.operators.crossval import CrossValidation
    from cadence.operators.models import Layout

    rows = spark.createDataFrame([(i, float(i % 5), 1.0 + 1e-7 * (i % 7), 3.0) for i in range(70)], "id long, y double, x double, c double")
    cv = CrossValidation(rows, "id", Layout(["x", "c"]))
    for t in cv.fit.transforms.values():
        assert 1e-7 < t.stds["x"] < 3e-7 and t.stds["c"] == 1.0


def test_stacker_moments_far_from_zero_and_incomplete_rows(spark):
    from cadence.operators.stack import _moments

    rng = np.random.default_rng(0)
    x = 1e7 + rng.standard_normal((400, 2))
    y = 1e7 + rng.standard_normal(400)
    rows = [(float(a), float(b), float(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 1.0), (1.0, 1.0, None)]
    n, _, A, b, yy, _ = _moments(spark.createDataFrame(rows, "p double, q double, y double"), ["p", "q"], "y")
    xc, yc = x - x.mean(axis=0), y - y.mean()
    assert n == 400 and np.allclose(A, xc.T @ xc, rtol=1e-5) and np.allclose(b, xc.T @ yc, rtol=1e-4, atol=1e-4) and abs(yy - yc @ yc) < 1e-3


def test_bad_signals_give_zeros_and_an_error(spark):
    from cadence.operators.signal import signal_features, spectral_features

    tone = [float(np.sin(i)) for i in range(64)]
    rows = [(1, 64, tone), (2, None, tone), (3, 64, None), (4, 64, []), (5, 64, [1.0, None]), (6, 64, [1.0, float("nan")]), (7, 0, tone), (8, 64, [float("inf")])]
    df = spark.createDataFrame(rows, "id long, sr int, samples array<double>")
    why = {2: "no sample rate", 3: "no samples", 4: "no samples", 5: "a sample is missing or not finite", 6: "a sample is missing or not finite", 7: "no sample rate",
           8: "a sample is missing or not finite"}
    for out, names, needs_rate in ((signal_features(df, ["id"], frame=16, hop=8, n_mels=8), 32, True), (spectral_features(df, ["id"], n_fft=16, hop=8, n_mels=8), 28, True),
                                   (signal_features(df, ["id"], frame=16, hop=8, spectral=False), 4, False)):
        got = {r["id"]: r for r in out.collect()}
        assert len(got) == len(rows)
        for i, r in got.items():
            wrong = i in why and (needs_rate or why[i] != "no sample rate")
            assert r["error"] == (why[i] if wrong else None)
            assert len(r) == names + 2 and all(v == 0.0 for v in list(r)[1:-1]) == wrong


def plain_features(y, sr, frame, hop, n_mels, trim):
    """The summary of one clip in one piece, from the array kernels and plain transforms."""
    from cadence.operators.signal import cosine_basis, mel_filters

    y = S.np_peak_normalize(y)
    if trim:
        a, b = S.np_trim_bounds(y, 30.0, frame, hop)
        y = y[a:b]
    r, z = S.np_frame_rms(y, frame, hop), S.np_frame_zcr(y, frame, hop)
    p = np.pad(y, frame // 2)
    f = np.stack([p[i * hop:i * hop + frame] for i in range(1 + len(y) // hop)])
    m = np.abs(np.fft.rfft(f * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)), axis=1))
    w = m.sum(axis=1)
    c = np.where(w > 0, (m * np.fft.rfftfreq(frame, 1 / sr)).sum(axis=1) / np.where(w > 0, w, 1), 0)
    db = 10 * np.log10(np.maximum(1e-10, (m ** 2) @ mel_filters(sr, frame, n_mels).T))
    mfcc = np.maximum(db, db.max() - 80) @ cosine_basis(n_mels, 13).T
    return [r.mean(), r.std(), z.mean(), z.std(), c.mean(), c.std(), *mfcc.mean(axis=0), *mfcc.std(axis=0)]


def test_frames_across_blocks_equal_the_clip_in_one_piece(spark):
    """Blocks of 32 samples, frames of 16 every 8: lengths below a block, on and around block and hop edges, with and without trimming."""
    from cadence.operators import signal as G

    rng = np.random.default_rng(10)
    clips = {n: rng.normal(size=n) * np.where(np.abs(np.arange(n) - n / 2) < n / 5, 1.0, 0.003) for n in (1, 7, 8, 31, 32, 33, 40, 63, 64, 65, 96, 200, 256)}
    clips[500] = np.zeros(50)
    df = spark.createDataFrame([(i, 64, y.tolist()) for i, y in clips.items()], "id long, sr int, samples array<double>")
    blocks = G.sample_blocks(df, ["id"], size=32)
    assert blocks.count() == sum(-(-len(y) // 32) for y in clips.values())
    for trim in (False, True):
        got = {r["id"]: list(r)[1:-1] for r in G.block_features(blocks, df, ["id"], 16, 8, 8, trim=trim, size=32).collect()}
        for i, y in clips.items():
            assert np.allclose(got[i], plain_features(y, 64, 16, 8, 8, trim), atol=1e-9), (i, trim)
    with pytest.raises(ValueError):
        G.block_frames(blocks, ["id"], 16, 5, size=32)


def test_mel_filters_have_unit_area_and_the_scale_bends_at_1_khz():
    from cadence.operators import signal as G

    assert [G._scale_of_hz(x) for x in (0.0, 200.0, 1000.0)] == [0.0, 3.0, 15.0] and abs(G._scale_of_hz(6400.0) - 42.0) < 1e-9
    assert np.allclose(G._hz_of_scale(np.array([3.0, 15.0, 42.0])), [200.0, 1000.0, 6400.0])
    f = G.mel_filters(16000, 8192, 40)
    assert np.allclose(f.sum(axis=1) * 16000 / 8192, 1.0, atol=0.02)
    assert np.allclose(G.cosine_basis(8, 8) @ G.cosine_basis(8, 8).T, np.eye(8))


def test_signal_columns_match_the_kernels(spark):
    rng = np.random.default_rng(8)
    clips = [(rng.standard_normal(n) * (np.arange(n) > n // 3)).tolist() for n in (1, 5, 16, 63, 200)] + [[0.0] * 40, []]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(clips)] + [(99, None)], "id long, s array<double>")
    for center in (True, False):
        got = {r.id: r for r in df.select("id", S.peak_normalize("s").alias("y"), S.frame_rms("s", 16, 5, center).alias("r"), S.frame_zcr("s", 16, 5, center).alias("z"),
                                          S.trim_bounds("s", 30.0, 16, 5).alias("b")).collect()}
        assert got[99].y is None and got[99].r is None and got[99].b is None
        for i, c in enumerate(clips):
            y = np.asarray(c, float)
            assert np.allclose(got[i].y, S.np_peak_normalize(y))
            assert np.allclose(got[i].r, S.np_frame_rms(y, 16, 5, center)[:len(got[i].r)]) and (not len(y) or len(got[i].r) == len(S.np_frame_rms(y, 16, 5, center)))
            if len(y):
                assert np.allclose(got[i].z, S.np_frame_zcr(y, 16, 5, center))
                assert (got[i].b["start"], got[i].b["end"]) == S.np_trim_bounds(y, 30.0, 16, 5)


def test_kernel_model_reaches_its_duality_gap_or_raises(spark):
    """The reported primal value is the model's own linear loss, the dual bounds every other model, and few passes are an error."""
    from cadence.operators.crossval import CrossValidation
    from cadence.operators.svr import fourier_features

    rng = np.random.default_rng(12)
    n = 300
    X = rng.normal(size=(n, 2))
    y = np.sin(2 * X[:, 0]) + 0.3 * X[:, 1] + 0.2 * rng.standard_t(2, n)
    pdf = pd.DataFrame({"id": np.arange(n), "a": X[:, 0], "b": X[:, 1], "y": y})
    cv = CrossValidation(spark.createDataFrame(pdf), "id", Layout(["a", "b"]), k=3, repeats=2)
    oof, _, full = cv.rff_svr(n_features=12, include_full=True, tolerance=1e-4)
    assert set(cv.svr_gaps) == {(r, f) for r in range(2) for f in range(3)} | {(FULL, FULL)}
    rows = cv.w_rows.toPandas()
    w, folds, target = np.stack(rows["w"]), np.stack(rows["folds"]), rows["y"].to_numpy()

    def primal(theta, z, t):
        return 0.5 * theta[:-1] @ theta[:-1] + np.maximum(np.abs(t - z @ theta) - 0.1, 0).sum()

    B, omega, phase, theta = full
    z = fourier_features(w @ B.T, omega, phase)
    got_n, p, d = cv.svr_gaps[FULL, FULL]
    assert got_n == n and abs(p - primal(theta, z, target)) <= 1e-9 * p and 0 <= p - d <= 1e-4 * p
    for scale in (1e-3, 1e-2, 0.1, 1.0):
        for _ in range(50):
            assert primal(theta + scale * rng.normal(size=len(theta)), z, target) >= d
    for (r, f), (rows_in, p, d) in cv.svr_gaps.items():
        assert rows_in == (n if r == FULL else (folds[:, r] != f).sum()) and 0 <= p - d <= 1e-4 * p
    assert np.sqrt(np.mean((oof.toPandas().set_index("id").sort_index()["pred"] - y) ** 2)) < 0.9 * y.std()
    with pytest.raises(RuntimeError, match="duality gap"):
        cv.rff_svr(n_features=12, max_passes=2)


def test_shuffled_manifest_fails(spark):
    from cadence.operators.publish import IntegrityError, check_predictions

    preds = spark.createDataFrame([(0, "a", 1.0), (1, "b", 2.0)], "position long, filename string, label double")
    shuffled = spark.createDataFrame([(0, "b"), (1, "a")], "position long, filename string")
    with pytest.raises(IntegrityError, match="C4"):
        check_predictions(preds, shuffled, strict=True)


def test_word_gaps_and_sums_across_blocks(spark, monkeypatch):
    """Blocks of three words: gaps inside and between blocks, clips of one block, of a whole number of blocks, and of one word."""
    from cadence.operators import words as W

    rng = np.random.default_rng(8)
    rows = []
    for clip, n in enumerate((1, 2, 3, 4, 6, 7, 20)):
        t = np.cumsum(rng.uniform(0.1, 1.0, 2 * n))
        rows += [(clip, i, float(t[2 * i]), float(t[2 * i + 1]), None if i == 5 else float(rng.random())) for i in range(n)]
    words = spark.createDataFrame(rows, "clip long, ord long, start_s double, end_s double, probability double")
    monkeypatch.setattr(W, "BLOCK_WORDS", 3)
    pdf = words.toPandas().sort_values(["clip", "ord"])
    pdf["gap"] = pdf.groupby("clip")["start_s"].shift(-1) - pdf["end_s"]
    got = W.word_gaps(words, ["clip"]).toPandas().sort_values(["clip", "ord"])
    assert np.allclose(got["gap"], pdf["gap"], equal_nan=True)
    out = W.word_aggregates(words, ["clip"]).toPandas().set_index("clip").sort_index()
    for clip, own in pdf.groupby("clip"):
        long = own["gap"][own["gap"] > 0.3]
        r = out.loc[clip]
        assert r["n_word_rows"] == len(own) and r["pause_count_03"] == len(long) and r["pause_count_05"] == (own["gap"] > 0.5).sum()
        assert np.allclose([r["mean_pause_len"], r["max_pause_len"]], [long.mean(), long.max()], equal_nan=True)
        assert np.allclose([r["speech_sum"], r["mean_word_prob"], r["min_word_prob"], r["low_conf_ratio"]],
                           [(own["end_s"] - own["start_s"]).sum(), own["probability"].mean(), own["probability"].min(),
                            (own["probability"].dropna() < 0.5).mean()])


def test_word_table_is_not_joined_with_itself(spark):
    from cadence.operators import words as W

    words = spark.range(10).select(F.lit(1).alias("clip"), F.col("id").alias("ord"), F.lit(0.0).alias("start_s"), F.lit(1.0).alias("end_s"), F.lit(0.5).alias("probability"))
    plan = W.word_aggregates(words, ["clip"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_json_words_keep_their_space_unless_trimmed(spark):
    from cadence.operators.words import words_from_json

    text = spark.createDataFrame([('[{"word": " hi ", "start": 1.0, "probability": 0.5}, {"prob": 0.25}]',)], "js string")
    kept, cut = text.select(words_from_json(F.col("js"), trim=False), words_from_json(F.col("js"))).first()
    assert [w["word"] for w in kept] == [" hi ", ""] and [w["word"] for w in cut] == ["hi", ""]
    assert [w["probability"] for w in kept] == [0.5, 0.25] and kept[0]["end"] == 0.0


def test_density_equals_the_plain_sum(spark):
    """Outliers, one value in most rows, a narrow bandwidth and grid points that nothing reaches."""
    from cadence.operators import profile as P

    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(0, 1, 500), np.full(800, 0.25), [40.0, -300.0], rng.uniform(5, 6, 50)])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    for h in (None, 0.01, 3.0):
        got = P.kde(df, "v", grid_size=400, bandwidth=h).toPandas().sort_values("grid_i")
        w = h or v.std(ddof=1) * len(v) ** -0.2
        want = np.exp(-0.5 * ((got["x"].to_numpy()[:, None] - v[None, :]) / w) ** 2).sum(axis=1) / (len(v) * w * np.sqrt(2 * np.pi))
        assert len(got) == 400 and P.kde_error_bound(w) < 5e-7
        assert np.abs(got["density"] - want).max() <= P.kde_error_bound(w) + 1e-12 * want.max()


def test_killed_write_leaves_the_old_version(spark):
    """A write that dies after some of its tasks have written files, a write that reads the table it replaces, and a lost race."""
    from cadence.session import scratch_path
    from cadence.sources.store import FeatureStore

    store = FeatureStore(spark, scratch_path(spark, "t_snapshots"), ["k"])
    assert not store.exists("t")
    with pytest.raises(FileNotFoundError):
        store.read("t")
    rows = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") < 50, "train").otherwise("test").alias("split"))
    assert store.write(rows.withColumn("v", F.lit(1)), "t") == 0
    dying = rows.repartitionByRange(8, "k").withColumn("v", F.when(F.col("k") == 99, F.raise_error(F.lit("killed"))).otherwise(F.lit(2)).cast("int"))
    with pytest.raises(Exception, match="killed"):
        store.write(dying, "t")
    assert store.versions("t") == [0] and {r["v"] for r in store.read("t").collect()} == {1} and store.read("t").count() == 100
    assert store.write(store.read("t").withColumn("v", F.col("v") + 2), "t") == 1
    assert {r["v"] for r in store.read("t").collect()} == {3} and {r["v"] for r in store.read("t", version=0).collect()} == {1}
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit("t", "lost", 1)
    assert store.path("t") == store.path("t", 1) and store.read("t").where("split = 'train'").count() == 50
    assert store.expire("t") == 2 and store.versions("t") == [1] and store.read("t").count() == 100   # version 0 and the dead write
    with pytest.raises(FileNotFoundError):
        store.read("t", version=0)


def test_media_are_listed_by_tasks(spark, tmp_path):
    from cadence.sources import media as M

    for name, size in (("train/a.wav", 3), ("train/b c.wav", 0), ("test/a.wav", 7), ("train/deep/er/x.wav", 2), ("train/_SUCCESS", 1), ("test/.hidden", 1)):
        path = tmp_path / "m" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    (tmp_path / "m" / "empty").mkdir()
    got = M.list_media(spark, str(tmp_path / "m"))
    assert sorted((r.split, r.filename, r.length) for r in got.collect()) == [("er", "x.wav", 2), ("test", "a.wav", 7), ("train", "a.wav", 3), ("train", "b c.wav", 0)]
    assert "binaryFile" not in got._jdf.queryExecution().toString()
    manifest = spark.createDataFrame([("train", "a.wav"), ("test", "b.wav")], "split string, filename string")
    inv = {(r.split, r.filename): (r.n_files, r.bytes, r.missing) for r in M.media_inventory(manifest, got).collect()}
    assert inv == {("train", "a.wav"): (1, 3, False), ("test", "b.wav"): (0, 0, True)}
    with pytest.raises(FileNotFoundError):
        M.list_media(spark, str(tmp_path / "none"))


def test_feature_run_transcribes_what_is_new_and_keeps_failures(spark):
    from cadence.plans.feature_run import build_features, failed_clips, update_transcripts
    from cadence.session import scratch_path
    from cadence.sources.store import FeatureStore

    store, asked = FeatureStore(spark, scratch_path(spark, "t_feature_run")), []

    def transcribe(clips):
        asked.append(sorted(r["filename"] for r in clips.collect()))
        return clips.select("split", "filename", F.length("filename").alias("n"), F.when(F.col("filename") == "bad", "unreadable").alias("error"))

    views = {"v": lambda t: t.select("split", "filename", (F.col("n") * 2.0).alias("twice"))}
    rows = [("train", "a", 1.0), ("train", "bad", 2.0), ("train", "a", 3.0)]
    first = spark.createDataFrame(rows, "split string, filename string, label double")
    out = build_features(store, first, transcribe, views)
    assert out.transcribed == 2 and asked == [["a", "bad"]] and out.views == {"v": ["twice"]} and out.features == ["twice"]
    assert sorted((r.filename, r.label, r.twice) for r in out.table.collect()) == [("a", 1.0, 2.0), ("bad", 2.0, 6.0)]
    assert [r["filename"] for r in failed_clips(store).collect()] == ["bad"]
    more = first.union(spark.createDataFrame([("test", "ccc", None)], first.schema))
    out = build_features(store, more, transcribe, views)
    assert out.transcribed == 1 and asked[1:] == [["ccc"]] and out.table.count() == 3 and store.versions("v") == [0, 1]
    assert update_transcripts(store, more, transcribe) == 0 and len(asked) == 2 and store.versions("transcripts") == [0, 1]
    assert build_features(store, first, transcribe, views).table.count() == 2          # only the manifest's clips
    twice = {"v": lambda t: t.select("split", "filename", F.explode(F.array(F.lit(1), F.lit(2))).alias("x"))}
    other = FeatureStore(spark, scratch_path(spark, "t_feature_run"))
    assert build_features(other, first, transcribe, twice).table.count() == 4
    assert build_features(other, first, transcribe, twice, dedupe_after_join=True).table.count() == 2


def test_raw_embedding_view_is_fitted(spark):
    from cadence.operators.stack import ablation

    rng = np.random.default_rng(3)
    e = rng.normal(size=(300, 3)) + 5
    y = 2.5 + 0.5 * (e[:, 0] - 5) - 0.3 * (e[:, 2] - 5)
    df = spark.createDataFrame([(float(a), v.tolist()) for a, v in zip(y, e)], "y double, emb array<double>")
    got = {r.view: r.rmse for r in ablation(df, {"Embeddings-Only": Layout([], "emb", 3, "y")}, raw_views=["Embeddings-Only"], full_rmse=0.25).collect()}
    ec, yc = e - e.mean(axis=0), y - y.mean()
    w = np.linalg.solve(ec.T @ ec + 10 * np.eye(3), ec.T @ yc)
    assert abs(got["Embeddings-Only"] - np.sqrt(np.mean((np.clip(y.mean() + ec @ w, 0, 5) - y) ** 2))) < 1e-9
    assert got["Full Multi-View Stack"] == 0.25


def test_acceptability_model_converges_or_raises(spark, monkeypatch):
    from cadence.operators import scores as SC

    rows = spark.createDataFrame([(f"the {a} {b} dog", float((i * 7) % 3 > 0)) for i, (a, b) in enumerate([(x, y) for x in ("red", "old", "big") for y in ("wet", "sad", "shy", "red")])],
                                 "t string, ok double")
    model = SC.acceptability_fit(rows, "t", "ok", num_features=1 << 10)
    assert model.rows == 12 and model.gradient <= SC.ACCEPTABILITY_GRADIENT
    # the gradient by numpy, on the features as the model hashes them
    got = [(np.asarray(r["_features"].toArray()), r["ok"], r["_prob"][1]) for r in model.transform(rows.select(F.col("t").alias("_text"), "ok")).collect()]
    x, y, p = (np.array(v) for v in zip(*got))
    sd = x.std(axis=0, ddof=1)
    use = sd > 0
    g = ((p - y) @ x[:, use] / 12 + SC.ACCEPTABILITY_REG * sd[use] ** 2 * model.stages[-1].coefficients.toArray()[use]) / sd[use]
    assert max(np.abs(g).max(), abs((p - y).sum()) / 12) == pytest.approx(model.gradient, rel=1e-6, abs=1e-12)
    monkeypatch.setattr(SC, "ACCEPTABILITY_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="gradient"):
        SC.acceptability_fit(rows, "t", "ok", num_features=1 << 10)


def test_entry_hides_only_a_missing_subpackage(tmp_path):
    """Without llm and the pipeline the entry imports; a broken import inside llm is not hidden."""
    import shutil
    import subprocess
    import sys

    root = tmp_path / "r"
    src = __import__("pathlib").Path(__file__).resolve().parents[1]
    shutil.copytree(src / "cadence", root / "cadence", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(src / "__spark_entry__.py", root)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=120)
    bare = run()
    assert bare.returncode == 0 and int(bare.stdout) > 100
    (root / "cadence" / "llm").mkdir()
    (root / "cadence" / "llm" / "__init__.py").write_text("")
    (root / "cadence" / "llm" / "oracles.py").write_text("import no_such_module\n")
    (root / "corpus_pipeline.py").write_text("from cadence.llm import oracles\n")
    assert run().returncode != 0


def _grouped_rows(spark, n=3000):
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 60, n) / 7, rng.normal(size=n).round(1), np.full(n, 2.0)], axis=1)
    pdf = pd.DataFrame({"y": x[:, 0] * (x[:, 1] > 0.3) + rng.normal(size=n), "x": list(x)})
    from pyspark.ml.functions import array_to_vector
    return spark.createDataFrame(pdf, "y double, x array<double>").select("y", array_to_vector("x").alias("features")).persist()


def test_trees_on_groups_of_rows_are_the_trees_of_the_rows(spark):
    from pyspark.ml.regression import GBTRegressor

    from cadence.operators.explain import tree_importance, tree_tables
    from cadence.operators.trees import fit_grouped_trees

    rows = _grouped_rows(spark)
    params = {"maxIter": 5, "stepSize": 0.1, "maxDepth": 3, "minInstancesPerNode": 20, "seed": 42}
    plain = GBTRegressor(featuresCol="features", labelCol="y", predictionCol="pred", **params).fit(rows)
    grouped = fit_grouped_trees(rows, params)
    for (w, a), (v, b) in zip(tree_tables(plain), grouped.node_tables(), strict=True):
        assert w == v and [(n["f"], n["thr"], n["cover"]) for n in a] == [(n["f"], n["thr"], n["cover"]) for n in b]
        assert np.allclose([n["v"] for n in a], [n["v"] for n in b], atol=1e-9)
    assert tree_importance(plain, ["a", "b", "c"]) == tree_importance(grouped, ["a", "b", "c"])
    both = plain.transform(rows).withColumnRenamed("pred", "was")
    assert grouped.transform(both).where(F.abs(F.col("pred") - F.col("was")) > 1e-9).count() == 0
    few = rows.limit(30)                  # fewer than two leaves of 20 rows: no split
    assert all(t.numNodes == 1 for t in fit_grouped_trees(few, params).trees)


def test_fit_reads_groups_not_rows(spark):
    """The boosted fit of the refit sees one weighted row per combination of bins."""
    from pyspark.ml.regression import GBTRegressor

    from cadence.operators import trees as T

    rows, seen = _grouped_rows(spark), []

    class Seen(GBTRegressor):
        def fit(self, df):
            seen.append(df.agg(F.count(F.lit(1)), F.sum("n")).first())
            return super().fit(df)

    real, T.GBTRegressor = T.GBTRegressor, Seen
    try:
        T.fit_grouped_trees(rows, {"maxIter": 2, "stepSize": 0.1, "maxDepth": 2, "minInstancesPerNode": 1, "seed": 1})
    finally:
        T.GBTRegressor = real
    assert seen[0][1] == 3000 and seen[0][0] <= 32 * 32


def test_bigram_scores_of_the_fitted_corpus(spark):
    from cadence.operators import scores as SC

    sents = spark.createDataFrame([(1, 0, "a b  a b"), (1, 1, "b a"), (2, 0, "<s> a"), (2, 1, "a b")], "doc_id long, sent_no long, sent string")
    lm = SC.ngram_lm_fit(sents, ["doc_id", "sent_no"])
    plans = [SC.ngram_lm_score(sents, lm, ["doc_id", "sent_no"], fitted=f) for f in (False, True)]
    was, now = (sorted((r[0], r[1], round(r[2], 9), r[3]) for r in p.collect()) for p in plans)
    assert was == now and [r[3] for r in now] == [5, 3, 3, 3]
    assert "Union" not in plans[1]._jdf.queryExecution().optimizedPlan().toString()      # the occurrences are not shuffled for the table too


def test_acceptability_hashes_its_rows_once(spark):
    from cadence.operators import scores as SC

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        seen.add(1)
        return f"the {i % 3} old {i % 5} dog"

    rows = spark.range(40).repartition(4).select(text("id").alias("t"), (F.col("id") % 2).cast("double").alias("ok"))
    SC.acceptability_fit(rows.where("ok >= 0"), "t", "ok", num_features=1 << 8)
    assert seen.value <= 80       # once for the null check, once for the text


def _boosted_rows(spark, n=4000):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.integers(0, 40, n) / 3, "b": rng.integers(0, 9, n).astype(float), "c": rng.normal(size=n).round(1)})
    pdf["y"] = np.sin(pdf["a"]) + 0.3 * pdf["b"] * (pdf["c"] > 0) + 0.1 * rng.normal(size=n)
    return spark.createDataFrame(pdf)


def test_boosting_in_tasks_equals_boosting_in_passes(spark, monkeypatch):
    """Groups that fit a task are boosted there, in one job for all rounds, with the trees of the passes; a fold's trees don't depend on the others."""
    from dataclasses import replace

    from cadence.operators import boosting
    from cadence.operators.crossval import CrossValidation

    cv = CrossValidation(_boosted_rows(spark), "id", Layout(["a", "b", "c"], label="y"), 3, 1, 3)
    passes = []
    real = boosting.FoldBooster._pass
    monkeypatch.setattr(boosting.FoldBooster, "_pass", lambda self, asked: passes.append(1) or real(self, asked))
    for profile in ("a", "b"):
        params, keys = replace(boosting.PROFILES[profile], rounds=12), cv.fit.fold_keys(include_full=True)
        binned = boosting.FoldBins(cv, params.bins, keys)
        here = boosting.FoldBooster(cv, params, keys, binned=binned).fit()
        assert not passes
        monkeypatch.setattr(boosting, "FIT_BYTES", 0)
        there = boosting.FoldBooster(cv, params, keys, binned=binned, checkpoint_every=5).fit()
        alone = boosting.FoldBooster(cv, params, keys[:1]).fit()
        monkeypatch.setattr(boosting, "FIT_BYTES", 1 << 30)
        assert passes
        passes.clear()
        for a, b in [(here[rf].trees, there[rf].trees) for rf in keys] + [(here[keys[0]].trees, alone[keys[0]].trees)]:
            for s, t in zip(a, b, strict=True):
                assert (s.feature, s.bin, s.left, s.count) == (t.feature, t.bin, t.left, t.count) and np.allclose(s.value, t.value, atol=1e-12)
        groups, _ = binned.groups
        m, n = groups.select("slot", "m", "n").toPandas().assign(n=lambda x: x["n"].map(lambda v: np.frombuffer(v).sum())).groupby("slot")[["m", "n"]].sum().to_numpy().T
        assert (n == [cv.fit.transforms[rf].n for rf in keys]).all() and (m < n).all()


def test_queries_boost_all_rounds(spark, monkeypatch):
    """The registered boosting queries run the reference's rounds (120 and 100)."""
    from cadence.operators import crossval
    from cadence.operators.boosting import BoostedModel, FoldBooster
    from cadence.operators.crossval import CrossValidation
    from cadence.plans import q_models

    cv = CrossValidation(_boosted_rows(spark, 400), "id", Layout(["a", "b", "c"], label="y"), 2, 1, 3)
    monkeypatch.setattr(q_models, "_cv", lambda spark, d: cv)
    rounds = []
    monkeypatch.setattr(FoldBooster, "fit", lambda self: rounds.append(self.p.rounds) or {rf: BoostedModel(0.0, [], 3) for rf in self.keys})
    q_models.v8_gbt_profile_a(spark, "")
    q_models.v9_gbt_profile_b(spark, "")
    q_models.cv_stack_metrics(spark, "")
    assert rounds == [120, 100, 120, 100]
    fitted = []
    real = crossval.fit_groups
    monkeypatch.setattr(crossval, "fit_groups", lambda *a: fitted.append(real(*a)) or fitted[-1])
    assert q_models.v8_spark_ml_gbt(spark, "").count() == 400
    assert [len(m.trees) for m in fitted] == [120, 120]


def test_scoring_run_takes_all_rounds_and_dimensions(spark, monkeypatch):
    from cadence.plans import q_models, scoring_run

    asked = []

    class Stop(Exception):
        pass

    def seen(table, key, label, features, views, emb_col, emb_dim, **more):
        asked.append((emb_dim, len(table.first()[emb_col]), more.get("gbt_rounds")))
        raise Stop

    monkeypatch.setattr(scoring_run, "run_scoring", seen)
    with pytest.raises(Stop):
        q_models.scoring_run_documents(spark, "/root/testdata/sf0.001")
    assert asked == [(384, 384, None)]


def test_spark_ml_folds_are_the_plain_fits(spark):
    """Spark ML's trees per fold, fitted on groups of its rows, predict what a plain fit of the fold's rows does."""
    from pyspark.ml.regression import GBTRegressor

    from cadence.operators.crossval import GBT_PROFILES, CrossValidation

    cv = CrossValidation(_boosted_rows(spark, 1500), "id", Layout(["a", "b", "c"], label="y"), 2, 1, 3)
    got = {r.id: r.pred for r in cv.gbt("a", rounds=4)[0].collect()}
    for rf in cv.fit.fold_keys():
        tr, va = cv._split(rf)
        own = cv._features(tr, rf).select("features", "y").persist()
        plain = GBTRegressor(featuresCol="features", labelCol="y", predictionCol="pred", **(GBT_PROFILES["a"] | {"maxIter": 4})).fit(own)
        for r in plain.transform(cv._features(va, rf)).select("id", "pred").collect():
            assert abs(got[r.id] - r.pred) < 1e-9


def test_bigram_occurrences_of_frequent_bigrams_stay(spark, monkeypatch):
    """Whatever number of bigrams every task holds, sentences score the same; occurrences of those are not shuffled."""
    from cadence.operators import scores as SC

    words = ["the", "of", "a", "cat", "dog", "sat"]
    sents = spark.createDataFrame([(i, j, " ".join(words[(i * k + j) % 6] for k in range(8))) for i in range(40) for j in range(3)],
                                  "doc_id long, sent_no long, sent string")
    lm = SC.ngram_lm_fit(sents, ["doc_id", "sent_no"])
    assert lm["bigrams"].count() > 10
    scored = []
    for held in (0, 10, 1000):
        monkeypatch.setattr(SC, "FREQUENT_BIGRAMS", held)
        for fitted in (False, True):
            scored.append(sorted((r[0], r[1], round(r[2], 9), r[3]) for r in SC.ngram_lm_score(sents, lm, ["doc_id", "sent_no"], fitted=fitted).collect()))
    assert len(scored[0]) == 120 and all(s == scored[0] for s in scored)
