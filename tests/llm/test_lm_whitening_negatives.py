"""Operators 11 to 13 against brute force, and their edge rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadence.llm import hard_negatives as H
from cadence.llm import lm_score as L
from cadence.llm import whitening as W
from cadence.llm.int_vectors import exact_gram, exact_products, pack_block, pack_rows, unpack_block, unpack_rows
from cadence.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# ---- 11 -------------------------------------------------------------------------------------------


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def plain_scores(docs, order, weights):
    """Base and interpolated score of every (id, text) by dictionaries of whole n-grams."""
    count, context, n = Counter(), Counter(), 0
    seq = [(i, ["<s>"] * (order - 1) + tokens(t)) for i, t in docs]
    for i, s in seq:
        if crc(i) % 5 != 1:
            for k in range(order - 1, len(s)):
                n += 1
                for j in range(1, order + 1):
                    count[tuple(s[k - j + 1:k + 1])] += 1
                    context[tuple(s[k - j + 1:k])] += 1
    vocabulary = sum(1 for g in count if len(g) == 1)
    out = []
    for i, s in seq:
        base = model = 0.0
        for k in range(order - 1, len(s)):
            p = 1 / (vocabulary + 1)
            for j in range(1, order + 1):
                c = context[tuple(s[k - j + 1:k])]
                w = weights[j - 1][c.bit_length()]
                p = w * (count[tuple(s[k - j + 1:k + 1])] / c if c else 0.0) + (1 - w) * p
            base += math.log10((count[s[k],] + 0.5) / (n + 0.5 * (vocabulary + 1)))
            model += math.log10(p)
        known = sum(count[w,] > 0 for w in s[order - 1:])
        out.append((i, crc(i) % 5 == 1, len(s) - order + 1, known, n, base, model))
    return out


def held_out_loglik(docs, order, weights):
    """Mean ln P of every training token under the counts of the other fold."""
    folds = defaultdict(list)
    for i, t in docs:
        if crc(i) % 5 != 1:
            folds[crc(i) // 5 % 2].append(["<s>"] * (order - 1) + tokens(t))
    vocabulary = len({w for f in folds.values() for s in f for w in s if w != "<s>"})
    total = n = 0
    for own, other in ((0, 1), (1, 0)):
        count, context = Counter(), Counter()
        for s in folds[other]:
            for k in range(order - 1, len(s)):
                for j in range(1, order + 1):
                    count[tuple(s[k - j + 1:k + 1])] += 1
                    context[tuple(s[k - j + 1:k])] += 1
        for s in folds[own]:
            for k in range(order - 1, len(s)):
                p = 1 / (vocabulary + 1)
                for j in range(1, order + 1):
                    c = context[tuple(s[k - j + 1:k])]
                    w = weights[j - 1][c.bit_length()]
                    p = w * (count[tuple(s[k - j + 1:k + 1])] / c if c else 0.0) + (1 - w) * p
                total += math.log(p)
                n += 1
    return total / n


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_dictionaries_of_ngrams(spark, order, monkeypatch):
    """Several chunks per task, so that counts meet across chunks."""
    monkeypatch.setattr(L, "CHUNK_TEXT", 20_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3)
    counted = L.count_ngrams(docs, order)
    assert counted.chunks.count() > 3
    model = L.fit(counted)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {r[0]: r for r in plain_scores(rows, order, model.weights)}
    got = {r.doc_id: tuple(r) for r in L.score_documents(docs, order).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:5] == w[:5] and got[i][5:] == pytest.approx(w[5:], rel=1e-9)
    if order > 1:                                     # the learned weights are no worse than their neighbours on the held-out events
        best = held_out_loglik(rows, order, model.weights)
        for shift in (0.9, 1.1):
            assert held_out_loglik(rows, order, np.clip(model.weights * shift, 0, 0.999)) <= best + 1e-4


def test_held_out_text_scores_better_than_the_base(spark):
    got = QUERIES["op11_lm_scoring"](spark, SF).toPandas()
    held = got[got["held_out"]]
    assert len(held) > 20 and (held["score"] > held["base_score"]).mean() > 0.9 and (got["score"] <= 0).all()
    again = QUERIES["op11_lm_scoring"](spark, SF).toPandas()
    assert got.sort_values("doc_id")["score"].to_numpy() == pytest.approx(again.sort_values("doc_id")["score"].to_numpy(), rel=1e-12)


def test_lm_edges(spark, edge_docs, no_docs):
    got = L.score_documents(edge_docs)
    rows = got.collect()
    assert len(rows) == edge_docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len({tuple(r) for r in by[2]}) == 1                            # repeated rows
    for i in (4, 5, 6):                                                   # NULL, empty, white space: the end alone
        assert by[i][0].n_tokens == 1
    assert by[7][0].n_tokens == 60_001 and by[8][0].n_tokens == 60_002    # very long texts
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert L.score_documents(no_docs).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(200) if crc(i) % 5 == 1], "doc_id long, text string")
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in L.score_documents(only_held).collect()} == {(0, 0, 0.0, 0.0)}
    with pytest.raises(ValueError):
        L.count_ngrams(no_docs, 9)


def test_weights_of_a_known_mixture():
    """Events drawn from 0.7 of one estimate and 0.3 of the uniform one, in cells of one bucket."""
    rng = np.random.default_rng(0)
    p = rng.choice([0.5, 0.1, 0.0], 20_000)
    v = 99
    keep = rng.random(20_000) < (0.7 * p + 0.3 / (v + 1)) / 0.5
    steps = np.where(p > 0, np.rint(-np.log2(np.where(p > 0, p, 1)) * L.STEPS), L.NO_STEP).astype(int)[keep]
    cell = (7 << 8) | steps
    u, inv = np.unique(cell, return_inverse=True)
    cells = {"cell": u, "n": np.bincount(inv), "ln1": np.bincount(inv, weights=np.log(np.where(p > 0, p, 1))[keep])}
    w = L.learn_weights(cells, 1, v)
    pk, n = np.exp(cells["ln1"] / cells["n"]) * ((u & 255) != L.NO_STEP), cells["n"]
    ll = lambda x: float((n * np.log(x * pk + (1 - x) / (v + 1))).sum())
    best = max(np.linspace(0.001, 0.999, 999), key=ll)
    assert abs(w[0, 7] - best) < 0.01 and w[0, 0] == 0 and w[0, 8] == w[0, 7]


# ---- 12 -------------------------------------------------------------------------------------------


def test_whitening_equals_numpy_on_the_whole_table(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.floor(256 * np.stack(emb["embedding"].to_numpy()).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    e, v = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    e, v = e[::-1], v[:, ::-1]
    got = QUERIES["op12_embedding_whitening"](spark, SF).toPandas()
    assert got.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 4 * len(emb) and set(got["n"]) == {n} and (got["identity_error"] <= 1e-12).all()
    at = got["vec_id"].map({i: k for k, i in enumerate(emb["vec_id"])}).to_numpy()
    assert (got["deviation"].to_numpy() == ((n * x - s) ** 2).sum(axis=1)[at]).all()
    for c in range(4):
        own = (got["component"] == c + 1).to_numpy()
        want = (x[at[own]] - s / n) @ v[:, c] / np.sqrt(e[c])
        g = got["whitened"].to_numpy()[own]
        assert min(np.abs(g - want).max(), np.abs(g + want).max()) < 1e-9
        assert got["explained"].to_numpy()[own] == pytest.approx(e[c] / e.sum(), rel=1e-12)


def test_characteristic_polynomial_roots_and_components(spark):
    rng = np.random.default_rng(1)
    cases = [rng.integers(-50, 50, (40, 6)), np.diag([9, 9, 9, 4, 4, 0]), np.zeros((3, 5), int), rng.integers(-10 ** 6, 10 ** 6, (30, 4)),
             np.ones((4, 4), int) * 7, np.array([[3]])]
    for x in cases:
        x = x.astype(object)
        a = x.T.dot(x)
        e = W.symmetric_functions(spark, a)
        want = np.poly(a.astype(float)) if a.any() else np.eye(1, len(a) + 1)[0]
        assert [(-1) ** k * c for k, c in enumerate(e)] == pytest.approx(want.tolist(), rel=1e-6, abs=1e-6 * max(1, float(np.abs(want).max())))
        positive = sum(1 for c in e[1:] if c)
        assert positive == np.linalg.matrix_rank(x.astype(float))
        roots, shift = W.leading_roots(e, positive)
        assert [r / 2 ** shift for r in roots] == pytest.approx(np.linalg.eigvalsh(a.astype(float))[::-1][:positive].tolist(), rel=1e-9)
        v = W.leading_components(a, roots, shift)
        assert np.allclose(v @ v.T, np.eye(positive), atol=1e-12)
        if positive:
            assert np.allclose(a.astype(float) @ v.T, v.T * [r / 2 ** shift for r in roots], rtol=1e-9, atol=1e-9 * float(roots[0] / 2 ** shift))


def test_close_eigenvalues_are_separated(spark):
    """Two eigenvalues that agree in 30 digits: doubles cannot tell their vectors apart."""
    big = 10 ** 30
    a = np.array([[big, 1, 0], [1, big, 0], [0, 0, 5]], object)
    roots, shift = W.leading_roots(W.symmetric_functions(spark, a), 2)
    assert [r >> shift for r in roots] == [big + 1, big - 1] or roots[0] - roots[1] == 2 << shift
    v = W.leading_components(a, roots, shift)
    assert np.allclose(np.abs(v), np.array([[1, 1, 0], [1, 1, 0]]) / math.sqrt(2), atol=1e-12) and v[0][0] * v[0][1] > 0 > v[1][0] * v[1][1]


def test_whitening_edges(spark):
    bad = [(101, None), (102, []), (103, [1.0, None, 2.0]), (104, [float("nan"), 0.0, 0.0]), (105, [float("inf"), 0.0, 0.0]), (106, [1e300, 0.0, 0.0]), (107, [1.0, 2.0])]
    good = [(i, [float(i % 4), float(i % 3) * -0.37, 0.25]) for i in range(12)] + [(None, [0.0, 0.0, 0.25]), (3, [3.0, 0.0, 0.25]), (3, [3.0, 0.0, 0.25])]
    df = spark.createDataFrame(bad + good, "vec_id long, embedding array<double>")
    for c in ("width", "x", "n", "component", "v", "cell"):
        df = df.withColumn(c, F.lit("clash"))
    out = W.whiten(df).toPandas()
    assert len(out) == 2 * len(good)                                      # the third dimension is constant: two components
    assert set(out["vec_id"].dropna()) == {i for i, _ in good if i is not None} and out["vec_id"].isna().sum() == 2
    assert (out["n"] == 12).all() and (out["identity_error"] < 1e-12).all()   # (i mod 4, i mod 3) are 12 distinct vectors
    assert W.whiten(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert W.whiten(one).count() == 0
    large = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 3.0]), (3, [5e11, -7.0])], "vec_id long, embedding array<double>")
    got = W.whiten(large).toPandas()
    x = np.floor(256 * np.array([[1e12, 0], [-1e12, 3], [5e11, -7]])).astype(int).astype(object)
    s = x.sum(axis=0)
    assert [int(v) for v in got.sort_values(["vec_id", "component"])["deviation"][::2]] == [int(((3 * r - s) ** 2).sum()) for r in x]
    assert (got["identity_error"] < 1e-9).all()


def test_integer_vectors_round_trip():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-5, 5, (3, 7)), rng.integers(-30_000, 30_000, (3, 7)), rng.integers(-2 ** 40, 2 ** 40, (3, 7)), np.full((1, 7), -128), np.full((1, 7), 128)])
    assert (unpack_rows(pack_rows(x), 7) == x).all() and (unpack_block(pack_block(x), 7) == x).all()
    assert len(set(pack_rows(np.array([[1, 2], [1, 2], [2, 1]])))) == 2
    for y in (x, x[:0], rng.integers(-2 ** 62, 2 ** 62, (9000, 2))):
        assert (exact_gram(y) == (y.astype(object).T.dot(y.astype(object)) if len(y) else 0)).all()
    a = rng.integers(-2 ** 28, 2 ** 28, (5, 4))
    assert (exact_products(a, a).astype(object) == a.astype(object).dot(a.T.astype(object))).all()
    with pytest.raises(OverflowError):
        exact_products(a << 20, a << 20)


# ---- 13 -------------------------------------------------------------------------------------------


def plain_negatives(rows, positives=5, negatives=10, low=30, high=90):
    """rows (id, label, x, anchor) by full sorts."""
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x = np.array([r[2] for r in rows], dtype=np.int64)
    out = []
    for a in [i for i, r in enumerate(rows) if r[3]]:
        s = x @ x[a]
        order = np.lexsort((ids, -s))
        for p in [j for j in order if labels[j] == labels[a] and j != a][:positives]:
            own = [j for j in order if labels[j] != labels[a] and low * int(s[p]) <= 100 * int(s[j]) <= high * int(s[p])][:negatives]
            out += [(int(ids[a]), int(ids[p]), k + 1, int(ids[j]), int(s[p]), int(s[j])) for k, j in enumerate(own)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives_equal_full_sorts(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    rows = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, np.floor(256 * np.asarray(v, float)).astype(int), i % 100 == 0) for i, v, lab in zip(emb["vec_id"], emb["embedding"], emb["label"])]
    want = plain_negatives(rows)
    assert want and found(QUERIES["op13_hard_negatives"](spark, SF)) == want


def test_many_blocks_packs_and_cells_ties_and_copies(spark, monkeypatch):
    """Small blocks, packs and cells; equal scores, repeated rows (also of anchors), labels of one row, anchors without positives."""
    for name, value in (("BLOCK_ROWS", 16), ("PACK_ANCHORS", 8), ("CELL_ZONES", 4), ("CELL_PACKS", 2), ("TASK_BLOCKS", 3)):
        monkeypatch.setattr(H, name, value)
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (300, 4)) + 4 * rng.integers(0, 2, (300, 1))
    rows = [(int(i), int(rng.integers(0, 4)) if i else 77, x[i], bool(i % 5 == 0)) for i in range(300)]
    df = spark.createDataFrame([(i, lab, (v / 256).tolist(), a) for i, lab, v, a in rows], "id long, label long, embedding array<double>, anchor boolean")
    assert found(H.mine(df)) == plain_negatives(rows)
    assert found(H.mine(df, 2, 3, 50, 120)) == plain_negatives(rows, 2, 3, 50, 120)
    copies = [(i % 60, lab, x[i % 60], a) for i, (_, lab, _, a) in enumerate(rows[:120])]
    copies = [(i, copies[i][1], v, copies[i][3]) for i, _, v, _ in copies]                # every row twice
    df = spark.createDataFrame([(i, lab, (v / 256).tolist(), a) for i, lab, v, a in copies], "id long, label long, embedding array<double>, anchor boolean")
    assert found(H.mine(df)) == plain_negatives(copies)


def test_bounds_hold_and_prune_clustered_blocks(spark):
    rng = np.random.default_rng(4)
    q = rng.integers(-100, 100, (20, 6))
    zones = [rng.integers(-100, 100, (30, 6)) + 500 * rng.integers(-1, 2, (1, 6)) for _ in range(15)]
    lower, upper = H.bounds(q, np.stack([z.min(axis=0) for z in zones]), np.stack([z.max(axis=0) for z in zones]))
    for k, z in enumerate(zones):
        s = q @ z.T
        assert (s.min(axis=1) >= lower[:, k]).all() and (s.max(axis=1) <= upper[:, k]).all()
    # eight clusters far apart, all labels in each: an anchor's blocks are those of its own cluster
    centre = np.eye(8) * 4
    v = np.concatenate([c + rng.normal(0, 0.02, (256, 8)) for c in centre])
    df = spark.createDataFrame([(i, int(i % 4), x.tolist(), i % 100 == 0) for i, x in enumerate(v)], "id long, label long, embedding array<double>, anchor boolean")
    rows = H._rows(df)
    import cadence.llm.hard_negatives as mod
    before, mod.BLOCK_ROWS = mod.BLOCK_ROWS, 32
    try:
        blocks = H._blocks(H._with_curve(rows, 8), 8)
        packs = H._packs(blocks, 8, 5)
        zones = blocks.select("block", "low_label", "high_label", "low", "high")
        first = packs.withColumn("least", F.col("floors")).withColumn("most", F.transform("floors", lambda _: F.lit(2 ** 62)))
        asked = H._requests(first, zones, 8, 1, True)
        read = asked.select(F.sum(F.size("places"))).first()[0]
        anchors, n = packs.select(F.sum(F.size("ids"))).first()[0], blocks.count()
        assert read <= 0.25 * anchors * n
    finally:
        mod.BLOCK_ROWS = before
    full = [(i, i % 4, np.floor(256 * x).astype(int), i % 100 == 0) for i, x in enumerate(v)]
    assert found(H.mine(df)) == plain_negatives(full)


def test_hilbert_curve_visits_every_cell_by_unit_steps():
    for dims, bits in ((1, 3), (2, 1), (2, 4), (3, 3), (5, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        at = H.hilbert_index(grid, bits)
        assert sorted(at.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_hard_negative_edges(spark):
    schema = "id long, label long, embedding array<double>, anchor boolean"
    bad = [(None, 1, [1.0, 1.0], True), (100, None, [1.0, 1.0], True), (101, 1, None, True), (102, 1, [], True), (103, 1, [1.0, None], True), (104, 1, [float("nan"), 1.0], True),
           (105, 1, [1.0], True), (106, 1, [float("-inf"), 1.0], True), (107, 1, [1e300, 1.0], False)]
    good = [(1, 1, [1.0, 0.0], True), (2, 1, [1.0, 0.0], False), (3, 2, [0.5, 0.0], False), (4, 2, [0.0, 1.0], True), (5, 3, [-1.0, 0.0], True), (6, 3, [1.0, 0.0], False)]
    df = spark.createDataFrame(bad + good, schema)
    for c in ("block", "pack", "x", "rank", "width", "score", "place", "win", "labels"):
        df = df.withColumn(c, F.lit("clash"))
    want = plain_negatives([(i, lab, np.floor(256 * np.array(v)).astype(int), a) for i, lab, v, a in good])
    assert found(H.mine(df)) == want and (1, 2, 1, 3, 65536, 32768) in want
    assert H.mine(df.limit(0)).count() == 0
    assert H.mine(spark.createDataFrame(good[:1], schema)).count() == 0
    assert H.mine(spark.createDataFrame([(i, lab, v, False) for i, lab, v, _ in good], schema)).count() == 0
    large = [(1, 1, [2.0 ** 22 + 1, 0.0], True), (2, 1, [2.0 ** 22, 1.0], False), (3, 2, [2.0 ** 21, 0.0], False), (4, 2, [2.0 ** 20, 0.0], False)]
    assert found(H.mine(spark.createDataFrame(large, schema))) == plain_negatives([(i, lab, (256 * np.array(v)).astype(np.int64), a) for i, lab, v, a in large])
