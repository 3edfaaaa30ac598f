"""Driver queries for syntax aggregates (X1-X7) and sentence scores / corpus models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from cadence.operators import scores as S
from cadence.operators import syntax as X
from cadence.plans import fixtures as fx
from cadence.plans.common import big, r6
from cadence.plans.oracle_fixtures import with_fixtures


def _tokens(spark, d):
    return fx.f3_tokens(fx.f3_sents(fx.f1_transcripts(spark, d)))


def _syntax(spark, d, depth=False, vocabulary=False):
    return X.syntax_features(_tokens(spark, d), depth=depth, vocabulary=vocabulary)


def x1_sentence_lengths(spark, d):
    s = _syntax(spark, d)
    return s.select("doc_id", big("spacy_sent_count"), r6("spacy_mean_sent_len"), r6("spacy_max_sent_len"),
                    r6("spacy_std_sent_len"))


def x2_completeness(spark, d):
    return _syntax(spark, d).select("doc_id", r6("spacy_completeness_ratio"))


def x3_tree_depth(spark, d):
    return _syntax(spark, d, depth=True).select("doc_id", r6("spacy_mean_dep_depth"), r6("spacy_max_dep_depth"))


def x3_token_depths(spark, d):
    dep = X.token_depths(_tokens(spark, d))
    return dep.select(big("doc_id"), big("sent_no"), big("tok_no"), big("depth"))


def x4_x5_dependency_counts(spark, d):
    return _syntax(spark, d).select("doc_id", big("spacy_subclause_count"), big("spacy_passive_count"))


def x6_pos_ratios(spark, d):
    s = _syntax(spark, d)
    return s.select("doc_id", *[r6(f"spacy_pos_{k}_ratio") for k in ("noun", "verb", "adj", "adv", "pron")])


def x7_type_token_ratio(spark, d):
    return _syntax(spark, d, vocabulary=True).select("doc_id", r6("spacy_ttr"))


def m1_eligible_sentences(spark, d):
    sents = fx.f3_sents(fx.f1_transcripts(spark, d))
    e = S.eligible_sentences(sents, S.ACCEPTABILITY_MIN_LEN, first_k=S.ACCEPTABILITY_FIRST_K)
    return e.select(big("doc_id"), big("sent_no"), "sent")


def m2_score_stats(spark, d):
    f1 = fx.f1_transcripts(spark, d)
    sc = fx.f4_scores(fx.f3_sents(f1))
    e = S.eligible_sentences(sc, S.ACCEPTABILITY_MIN_LEN)
    out = S.score_stats(e, f1)
    return out.select(big("doc_id"), *[r6(c) for c in out.columns if c != "doc_id"])


def m3_loss_stats(spark, d):
    f1 = fx.f1_transcripts(spark, d)
    sc = fx.f4_scores(fx.f3_sents(f1))
    e = S.eligible_sentences(sc, S.LOSS_MIN_LEN)
    out = S.loss_stats(e, f1)
    return out.select(big("doc_id"), *[r6(c) for c in out.columns if c != "doc_id"])


def m4_bigram_lm(spark, d):
    sents = fx.f3_sents(fx.f1_transcripts(spark, d)).persist()  # fitted on and scored from
    lm = S.ngram_lm_fit(sents, ["doc_id", "sent_no"])
    e = S.eligible_sentences(sents, S.LOSS_MIN_LEN)
    out = S.ngram_lm_score(e, lm, ["doc_id", "sent_no"], fitted=True)
    return out.select(big("doc_id"), big("sent_no"), r6("loss"), big("n_bigrams"))


def m5_acceptability_model(spark, d):
    f1 = fx.f1_transcripts(spark, d)
    labels = f1.where(F.col("split") == "train").select(
        "clean_transcript", (F.col("label") >= 2.5).cast("double").alias("ok"))
    model = S.acceptability_fit(labels, "clean_transcript", "ok")
    sents = S.eligible_sentences(fx.f3_sents(f1), S.ACCEPTABILITY_MIN_LEN)
    scored = S.acceptability_score(model, sents, ["doc_id", "sent_no"])
    out = S.score_stats(scored, f1)
    return out.select(big("doc_id"), *[r6(c) for c in out.columns if c != "doc_id"])


def m5_gradient(spark, d):
    """The acceptability model's training rows, and whether its gradient is within the tolerance."""
    f1 = fx.f1_transcripts(spark, d)
    labels = f1.where(F.col("split") == "train").select("clean_transcript", (F.col("label") >= 2.5).cast("double").alias("ok"))
    model = S.acceptability_fit(labels, "clean_transcript", "ok")
    return spark.createDataFrame([(model.rows, bool(model.gradient <= S.ACCEPTABILITY_GRADIENT))], "n_train bigint, converged boolean")


def m6_embed_text(spark, d):
    f1 = fx.f1_transcripts(spark, d)
    e = S.embed_text(f1, ["split", "filename"], "raw_transcript", dim=384)
    return e.select("split", "filename", big(F.size("embedding"), "dim"),
                    r6(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), "norm"))


def m6_token_idf(spark, d):
    out = S.token_idf(fx.f1_transcripts(spark, d), "raw_transcript")
    return out.select("token", big("doc_freq"), r6("idf"))


def _length_scorer(b: pd.DataFrame) -> pd.DataFrame:
    toks = b["sent"].str.split(" ")
    return pd.DataFrame({"doc_id": b["doc_id"], "sent_no": b["sent_no"],
                         "n_chars": b["sent"].str.len().astype("int64"), "n_tokens": toks.str.len().astype("int64")})


def m7_external_scorer(spark, d):
    sents = fx.f3_sents(fx.f1_transcripts(spark, d))
    return S.apply_scorer(sents.select("doc_id", "sent_no", "sent"), _length_scorer,
                          "doc_id long, sent_no long, n_chars long, n_tokens long")


QUERIES = {
    "x1_sentence_lengths": x1_sentence_lengths,
    "x2_completeness": x2_completeness,
    "x3_tree_depth": x3_tree_depth,
    "x3_token_depths": x3_token_depths,
    "x4_x5_dependency_counts": x4_x5_dependency_counts,
    "x6_pos_ratios": x6_pos_ratios,
    "x7_type_token_ratio": x7_type_token_ratio,
    "m1_eligible_sentences": m1_eligible_sentences,
    "m2_score_stats": m2_score_stats,
    "m3_loss_stats": m3_loss_stats,
    "m4_bigram_lm": m4_bigram_lm,
    "m5_acceptability_model": m5_acceptability_model,
    "m5_gradient": m5_gradient,
    "m6_embed_text": m6_embed_text,
    "m6_token_idf": m6_token_idf,
    "m7_external_scorer": m7_external_scorer,
}

_S = """WITH s AS (SELECT doc_id, sent_no, count(*) FILTER (WHERE NOT is_punct) AS len_np,
        max(CASE WHEN pos IN ('VERB', 'AUX') THEN 1 ELSE 0 END) * max(CASE WHEN dep LIKE '%subj%' THEN 1 ELSE 0 END) AS complete
      FROM f3_tokens GROUP BY doc_id, sent_no),
sd AS (SELECT doc_id, count(*) AS ns, avg(len_np) AS mean_len, max(len_np) AS max_len, stddev_pop(len_np) AS std_len,
              sum(complete) AS comp FROM s GROUP BY doc_id),
td AS (SELECT doc_id, count(*) AS ntok, avg(floor(log2(tok_no + 1)) + 1) AS mdep, max(floor(log2(tok_no + 1)) + 1) AS xdep,
              count(*) FILTER (WHERE dep IN ('advcl', 'relcl', 'acl')) AS nsub, count(*) FILTER (WHERE dep IN ('auxpass', 'nsubjpass')) AS npass,
              count(*) FILTER (WHERE pos IN ('NOUN', 'PROPN')) AS nn, count(*) FILTER (WHERE pos IN ('VERB', 'AUX')) AS nv,
              count(*) FILTER (WHERE pos = 'ADJ') AS nadj, count(*) FILTER (WHERE pos = 'ADV') AS nadv,
              count(*) FILTER (WHERE pos = 'PRON') AS npron,
              count(DISTINCT lower(text)) FILTER (WHERE is_alpha) AS types, count(*) FILTER (WHERE is_alpha) AS nalpha
       FROM f3_tokens GROUP BY doc_id),
x AS (SELECT * FROM sd JOIN td USING (doc_id))
"""


def _x(select: str) -> str:
    return with_fixtures(_S + select, "f3_tokens")


_LM = """WITH toks AS (SELECT doc_id, sent_no, list_filter(string_split(sent, ' '), lambda t: t <> '') AS tk FROM f3_sents),
bg AS (SELECT doc_id, sent_no, unnest(list_concat(['<s>'], tk)) AS w1, unnest(list_concat(tk, ['</s>'])) AS w2 FROM toks),
c12 AS (SELECT w1, w2, count(*) AS c12 FROM bg GROUP BY w1, w2),
c1 AS (SELECT w1, sum(c12) AS c1 FROM c12 GROUP BY w1),
v AS (SELECT count(*) AS v FROM (SELECT w2 AS w FROM c12 UNION SELECT w1 FROM c12) u WHERE w <> '<s>'),
el AS (SELECT doc_id, sent_no FROM f3_sents WHERE length(trim(sent)) > 5)
SELECT CAST(b.doc_id AS BIGINT) AS doc_id, CAST(b.sent_no AS BIGINT) AS sent_no,
       round(avg(-ln((coalesce(c12.c12, 0) + 1.0) / (coalesce(c1.c1, 0) + 1.0 * v.v))), 6) AS loss, CAST(count(*) AS BIGINT) AS n_bigrams
FROM bg b JOIN el ON b.doc_id = el.doc_id AND b.sent_no = el.sent_no
     LEFT JOIN c12 ON b.w1 = c12.w1 AND b.w2 = c12.w2 LEFT JOIN c1 ON b.w1 = c1.w1 CROSS JOIN v
GROUP BY b.doc_id, b.sent_no"""

ORACLES = {
    "x1_sentence_lengths": _x("""SELECT doc_id, CAST(greatest(ns, 1) AS BIGINT) AS spacy_sent_count, round(mean_len, 6) AS spacy_mean_sent_len,
        round(CAST(max_len AS DOUBLE), 6) AS spacy_max_sent_len, round(std_len, 6) AS spacy_std_sent_len FROM x"""),
    "x2_completeness": _x("SELECT doc_id, round(CAST(comp AS DOUBLE) / greatest(ns, 1), 6) AS spacy_completeness_ratio FROM x"),
    "x3_tree_depth": _x("SELECT doc_id, round(mdep, 6) AS spacy_mean_dep_depth, round(xdep, 6) AS spacy_max_dep_depth FROM x"),
    "x3_token_depths": with_fixtures("""SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(sent_no AS BIGINT) AS sent_no, CAST(tok_no AS BIGINT) AS tok_no,
        CAST(floor(log2(tok_no + 1)) + 1 AS BIGINT) AS depth FROM f3_tokens""", "f3_tokens"),
    "x4_x5_dependency_counts": _x("SELECT doc_id, CAST(nsub AS BIGINT) AS spacy_subclause_count, CAST(npass AS BIGINT) AS spacy_passive_count FROM x"),
    "x6_pos_ratios": _x("""SELECT doc_id, round(nn / greatest(ntok, 1), 6) AS spacy_pos_noun_ratio, round(nv / greatest(ntok, 1), 6) AS spacy_pos_verb_ratio,
        round(nadj / greatest(ntok, 1), 6) AS spacy_pos_adj_ratio, round(nadv / greatest(ntok, 1), 6) AS spacy_pos_adv_ratio,
        round(npron / greatest(ntok, 1), 6) AS spacy_pos_pron_ratio FROM x"""),
    "x7_type_token_ratio": _x("SELECT doc_id, round(CAST(types AS DOUBLE) / greatest(nalpha, 1), 6) AS spacy_ttr FROM x"),
    "m1_eligible_sentences": with_fixtures("""SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(sent_no AS BIGINT) AS sent_no, sent FROM f3_sents
        WHERE sent_no < 5 AND length(trim(sent)) > 3""", "f3_sents"),
    "m2_score_stats": with_fixtures("""WITH e AS (SELECT * FROM f4_scores WHERE length(trim(sent)) > 3),
        a AS (SELECT doc_id, avg(score) AS m, min(score) AS n, stddev_pop(score) AS s, avg(CASE WHEN score < 0.5 THEN 1.0 ELSE 0.0 END) AS f FROM e GROUP BY doc_id)
        SELECT CAST(t.doc_id AS BIGINT) AS doc_id, round(coalesce(m, 0.5), 6) AS cola_mean_prob, round(coalesce(n, 0.5), 6) AS cola_min_prob,
               round(coalesce(s, 0.0), 6) AS cola_std_prob, round(coalesce(f, 0.0), 6) AS cola_frac_below_05
        FROM f1_transcripts t LEFT JOIN a ON t.doc_id = a.doc_id""", "f1_transcripts", "f4_scores"),
    "m3_loss_stats": with_fixtures("""WITH e AS (SELECT * FROM f4_scores WHERE length(trim(sent)) > 5),
        a AS (SELECT doc_id, avg(loss) AS m, max(loss) AS x FROM e GROUP BY doc_id)
        SELECT CAST(t.doc_id AS BIGINT) AS doc_id, round(coalesce(m, 3.5), 6) AS gpt2_mean_loss, round(coalesce(x, 3.5), 6) AS gpt2_max_loss,
               round(exp(least(coalesce(m, 3.5), 10.0)), 6) AS gpt2_ppl
        FROM f1_transcripts t LEFT JOIN a ON t.doc_id = a.doc_id""", "f1_transcripts", "f4_scores"),
    "m4_bigram_lm": with_fixtures(_LM, "f3_sents"),
    "m5_gradient": with_fixtures("SELECT CAST(count(*) AS BIGINT) AS n_train, true AS converged FROM f1_transcripts WHERE split = 'train'", "f1_transcripts"),
    "m6_embed_text": with_fixtures(r"""SELECT split, filename, CAST(384 AS BIGINT) AS dim,
        CASE WHEN regexp_matches(raw_transcript, '[\p{L}\p{M}\p{Nd}\p{Pc}]') THEN 1.0 ELSE 0.0 END AS norm FROM f1_transcripts""", "f1_transcripts"),
    "m6_token_idf": with_fixtures(r"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(raw_transcript), '[^\p{L}\p{M}\p{Nd}\p{Pc}]+')) AS token FROM f1_transcripts)
        SELECT token, count(*) AS doc_freq, round(ln((SELECT count(*) FROM f1_transcripts) + 1.0) - ln(count(*) + 1.0), 6) AS idf FROM t WHERE token <> '' GROUP BY token""", "f1_transcripts"),
    "m7_external_scorer": with_fixtures("""SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(sent_no AS BIGINT) AS sent_no, CAST(length(sent) AS BIGINT) AS n_chars,
        CAST(len(string_split(sent, ' ')) AS BIGINT) AS n_tokens FROM f3_sents""", "f3_sents"),
}
