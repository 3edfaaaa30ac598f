"""Driver queries for P7-P9, metrics (Q1-Q7), integrity checks (C1-C4) and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.functions.text import clip, round_even
from cadence.operators import metrics as M
from cadence.operators import profile as E
from cadence.operators.ordinal import ordinal_within
from cadence.operators.publish import check_predictions
from cadence.plans import fixtures as fx
from cadence.plans.common import big, r6
from cadence.plans.oracle_fixtures import with_fixtures


def _preds(spark, d):
    """F7 with the clipped fourth model as the evaluated prediction."""
    return fx.f7_preds(fx.f6_reg(spark, d)).withColumn("pred", clip("p4"))


def p7_p9_clip_round_residual(spark, d):
    p = _preds(spark, d)
    return p.select(big("id"), r6("pred", "clipped"), big(round_even("y"), "y_class"),
                    big(round_even("pred"), "pred_class"), r6(M.residual("y", "pred"), "residual"))


def q1_rmse(spark, d):
    return M.basic_metrics(_preds(spark, d), "y", "pred").select(r6("rmse"))


def q2_mae(spark, d):
    return M.basic_metrics(_preds(spark, d), "y", "pred").select(r6("mae"))


def q3_pearson(spark, d):
    return M.basic_metrics(_preds(spark, d), "y", "pred").select(r6("pearson"))


def q4_spearman(spark, d):
    return M.spearman(_preds(spark, d), "y", "pred", "id").select(r6("spearman"))


def q5_r2(spark, d):
    return M.basic_metrics(_preds(spark, d), "y", "pred").select(r6("r2"))


def q6_qwk(spark, d):
    return M.qwk(_preds(spark, d), "y", "pred").select(r6("qwk"))


def q7_metrics_table(spark, d):
    return M.metrics_table(_preds(spark, d), "y", "pred", "id").select("metric", r6("value"))


def c1_c4_check_predictions(spark, d):
    f7 = fx.f7_preds(fx.f6_reg(spark, d))
    named = f7.select(F.concat(F.lit("ord_"), F.col("id").cast("string")).alias("filename"), "id", "y",
                      F.col("p4").alias("label"))
    manifest = ordinal_within(named.select("filename", "id"), [], ["id"], out="position")
    preds = ordinal_within(named, [], ["y", "id"], out="position")  # published in another order
    out = check_predictions(preds, manifest, None, 0.0, 5.0)
    return out.select("check", "passed", r6("observed"))


def e1_describe(spark, d):
    out = E.describe(fx.f6_reg(spark, d), "x2")
    return out.select(big("count"), *[r6(c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]])


def e2_histogram(spark, d):
    h = E.histogram(fx.f1_transcripts(spark, d), "label", 10)
    return h.select(big("bin"), r6("lower"), r6("upper"), big("count"))


def e3_kde(spark, d):
    k = E.kde(fx.f1_transcripts(spark, d), "label", grid_size=200)
    return k.select(big("grid_i"), r6("x"), r6("density"))


def e4_box_summary(spark, d):
    b = E.box_summary(fx.f6_reg(spark, d), "x1")
    return b.select(*[r6(c) for c in ["q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi"]], big("n_outliers"))


def e5_split_counts(spark, d):
    return E.split_counts(fx.f1_transcripts(spark, d)).select("split", big("rows"), big("columns"))


def e6_scatter_pairs(spark, d):
    return E.scatter_pairs(_preds(spark, d), "id", "y", "pred").select(big("id"), r6("y_true"), r6("y_pred"))


def k3_head(spark, d):
    return E.head(fx.f1_transcripts(spark, d), 10, ["filename"]).select("filename", "split", r6("label"))


QUERIES = {
    "p7_p9_clip_round_residual": p7_p9_clip_round_residual,
    "q1_rmse": q1_rmse,
    "q2_mae": q2_mae,
    "q3_pearson": q3_pearson,
    "q4_spearman": q4_spearman,
    "q5_r2": q5_r2,
    "q6_qwk": q6_qwk,
    "q7_metrics_table": q7_metrics_table,
    "c1_c4_check_predictions": c1_c4_check_predictions,
    "e1_describe": e1_describe,
    "e2_histogram": e2_histogram,
    "e3_kde": e3_kde,
    "e4_box_summary": e4_box_summary,
    "e5_split_counts": e5_split_counts,
    "e6_scatter_pairs": e6_scatter_pairs,
    "k3_head": k3_head,
}

_BASE = """WITH base AS (SELECT id, y, least(greatest(p4, 0.0), 5.0) AS p FROM f7_preds),
m AS (SELECT count(*) AS n, sqrt(avg((p - y) * (p - y))) AS rmse, avg(abs(p - y)) AS mae, corr(y, p) AS pearson,
             1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) AS r2 FROM base),
rk AS (SELECT (rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0) AS ry,
              (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0) AS rp FROM base),
sp AS (SELECT corr(ry, rp) AS spearman FROM rk),
c AS (SELECT CAST(round_even(y, 0) AS BIGINT) AS a, CAST(round_even(p, 0) AS BIGINT) AS b FROM base),
l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT a AS v FROM c UNION SELECT b FROM c) u),
o AS (SELECT la.i AS ia, lb.i AS ib, count(*) AS n FROM c JOIN l la ON c.a = la.v JOIN l lb ON c.b = lb.v GROUP BY 1, 2),
ra AS (SELECT ia, sum(n) AS r FROM o GROUP BY ia), cb AS (SELECT ib, sum(n) AS cc FROM o GROUP BY ib),
qk AS (SELECT 1 - (SELECT sum((ia - ib) * (ia - ib) * n) FROM o)
              / ((SELECT sum((ra.ia - cb.ib) * (ra.ia - cb.ib) * ra.r * cb.cc) FROM ra, cb) / (SELECT sum(n) FROM o)) AS qwk)
"""


def _m(select: str) -> str:
    return with_fixtures(_BASE + select, "f7_preds")


_F1, _F6, _F7 = "f1_transcripts", "f6_reg", "f7_preds"
ORACLES = {
    "p7_p9_clip_round_residual": with_fixtures("""SELECT CAST(id AS BIGINT) AS id, round(p, 6) AS clipped,
        CAST(round_even(y, 0) AS BIGINT) AS y_class, CAST(round_even(p, 0) AS BIGINT) AS pred_class, round(p - y, 6) AS residual
        FROM (SELECT id, y, least(greatest(p4, 0.0), 5.0) AS p FROM f7_preds) t""", _F7),
    "q1_rmse": _m("SELECT round(rmse, 6) AS rmse FROM m"),
    "q2_mae": _m("SELECT round(mae, 6) AS mae FROM m"),
    "q3_pearson": _m("SELECT round(pearson, 6) AS pearson FROM m"),
    "q4_spearman": _m("SELECT round(spearman, 6) AS spearman FROM sp"),
    "q5_r2": _m("SELECT round(r2, 6) AS r2 FROM m"),
    "q6_qwk": _m("SELECT round(qwk, 6) AS qwk FROM qk"),
    "q7_metrics_table": _m("""SELECT metric, round(value, 6) AS value FROM (
        SELECT 'n' AS metric, CAST(n AS DOUBLE) AS value FROM m UNION ALL SELECT 'rmse', rmse FROM m
        UNION ALL SELECT 'mae', mae FROM m UNION ALL SELECT 'pearson', pearson FROM m UNION ALL SELECT 'r2', r2 FROM m
        UNION ALL SELECT 'spearman', spearman FROM sp UNION ALL SELECT 'qwk', qwk FROM qk) t"""),
    "c1_c4_check_predictions": with_fixtures("""WITH a AS (SELECT id, p4 AS label, row_number() OVER (ORDER BY id) AS pm,
              row_number() OVER (ORDER BY y, id) AS pp FROM f7_preds),
        mism AS (SELECT count(*) AS k FROM a x JOIN a z ON x.pp = z.pm WHERE x.id <> z.id)
        SELECT 'C1_row_count' AS "check", true AS passed, round(CAST(count(*) AS DOUBLE), 6) AS observed FROM a
        UNION ALL SELECT 'C2_no_missing', count(*) FILTER (WHERE label IS NULL OR isnan(label)) = 0,
                         CAST(count(*) FILTER (WHERE label IS NULL OR isnan(label)) AS DOUBLE) FROM a
        UNION ALL SELECT 'C3_min_in_range', min(label) >= 0.0, round(min(label), 6) FROM a
        UNION ALL SELECT 'C3_max_in_range', max(label) <= 5.0, round(max(label), 6) FROM a
        UNION ALL SELECT 'C4_order_matches', (SELECT k FROM mism) = 0, CAST((SELECT k FROM mism) AS DOUBLE)""", _F7),
    "e1_describe": with_fixtures("""SELECT CAST(count(x2) AS BIGINT) AS count, round(avg(x2), 6) AS mean, round(stddev_samp(x2), 6) AS std,
        round(min(x2), 6) AS min, round(quantile_cont(x2, 0.25), 6) AS q25, round(quantile_cont(x2, 0.5), 6) AS q50,
        round(quantile_cont(x2, 0.75), 6) AS q75, round(max(x2), 6) AS max FROM f6_reg""", _F6),
    "e2_histogram": with_fixtures("""WITH x AS (SELECT label AS v FROM f1_transcripts WHERE label IS NOT NULL),
        r AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 10 AS w FROM x),
        b AS (SELECT CAST(least(floor((v - lo) / w), 9) AS BIGINT) AS bin, lo, w FROM x, r)
        SELECT bin, round(min(lo) + bin * min(w), 6) AS lower, round(min(lo) + (bin + 1) * min(w), 6) AS upper,
               CAST(count(*) AS BIGINT) AS count FROM b GROUP BY bin""", _F1),
    "e3_kde": with_fixtures("""WITH x AS (SELECT label AS v FROM f1_transcripts WHERE label IS NOT NULL),
        s AS (SELECT count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h, min(v) AS lo, max(v) AS hi FROM x),
        g AS (SELECT i, lo - 3.0 * h + i * (((hi + 3.0 * h) - (lo - 3.0 * h)) / 199) AS gx FROM s, range(200) t(i))
        SELECT CAST(i AS BIGINT) AS grid_i, round(min(gx), 6) AS x,
               round(sum(exp(-0.5 * ((gx - v) / h) * ((gx - v) / h))) / (min(n) * min(h) * sqrt(2 * pi())), 6) AS density
        FROM g, x, s GROUP BY i""", _F1),
    "e4_box_summary": with_fixtures("""WITH q AS (SELECT quantile_cont(x1, 0.25) AS q1, quantile_cont(x1, 0.5) AS median,
              quantile_cont(x1, 0.75) AS q3 FROM f6_reg)
        SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
               round(min(x1) FILTER (WHERE x1 >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo,
               round(max(x1) FILTER (WHERE x1 <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
               CAST(count(*) FILTER (WHERE x1 < q1 - 1.5 * (q3 - q1) OR x1 > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers
        FROM f6_reg, q GROUP BY q1, median, q3""", _F6),
    "e5_split_counts": with_fixtures("SELECT split, CAST(count(*) AS BIGINT) AS rows, CAST(6 AS BIGINT) AS columns FROM f1_transcripts GROUP BY split", _F1),
    "e6_scatter_pairs": with_fixtures("SELECT CAST(id AS BIGINT) AS id, round(y, 6) AS y_true, round(least(greatest(p4, 0.0), 5.0), 6) AS y_pred FROM f7_preds", _F7),
    "k3_head": with_fixtures("SELECT filename, split, round(label, 6) AS label FROM f1_transcripts ORDER BY filename LIMIT 10", _F1),
}
