"""DuckDB definitions of the derived views F1-F8, prepended as CTEs to each oracle query.

They follow FIXTURES.md, except that the token view covers every document (whole tables, no id subset).
"""

from __future__ import annotations

FIXTURE_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "f1_transcripts": ((), r"""
SELECT 'doc_' || CAST(d.doc_id AS VARCHAR) AS filename, d.doc_id,
       CASE WHEN l.doc_id IS NULL THEN 'test' ELSE 'train' END AS split,
       CASE WHEN l.doc_id IS NOT NULL THEN CAST(2*quality + (1-toxic) AS DOUBLE) + CAST(n_chars % 1000 AS DOUBLE)/500 END AS label,
       d.text AS raw_transcript,
       trim(regexp_replace(lower(d.text), '\s+', ' ', 'g')) AS clean_transcript
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "f2_words": ((), r"""
SELECT * FROM (
  SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord, event_type AS word,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / CAST(3e10 AS DOUBLE) AS start_s,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / CAST(3e10 AS DOUBLE) + (value - 5)/97 AS end_s,
         CAST(json_extract_string(props, '$.k') AS DOUBLE)/97 AS probability
  FROM events) t
UNION ALL
SELECT user_id + 1000000, 0, event_type, 0.0, (value - 5)/97, CAST(json_extract_string(props, '$.k') AS DOUBLE)/97
FROM events WHERE user_id % 10 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"""),
    "f2_clips": ((), r"""
SELECT user_id + k AS clip_id, n + (user_id + k) % 3 AS n_words,
       CAST(n AS DOUBLE) * 0.75E0 - CAST(CASE WHEN (user_id + k) % 7 = 0 THEN 1000 ELSE 0 END AS DOUBLE) AS trimmed_dur
FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) u, (VALUES (0), (1000000), (2000000)) v(k)
WHERE k = 0 OR user_id % 10 = 0"""),
    "f2_segments": (("f2_words",), r"""
SELECT clip_id, CAST(floor(ord / 10) AS BIGINT) AS seg_no,
       CASE WHEN CAST(floor(ord / 10) AS BIGINT) % 4 <> 3 THEN -avg(probability) END AS avg_logprob,
       min(probability) / 10 AS no_speech_prob
FROM f2_words GROUP BY clip_id, CAST(floor(ord / 10) AS BIGINT)"""),
    "f3_sents": (("f1_transcripts",), r"""
SELECT doc_id, trim(s) AS sent, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS sent_no
FROM (SELECT doc_id, unnest(string_split(clean_transcript, '.')) AS s,
             unnest(range(len(string_split(clean_transcript, '.')))) AS pos FROM f1_transcripts) t
WHERE trim(s) <> ''"""),
    "f3_tokens": (("f3_sents",), r"""
SELECT doc_id, sent_no, tok_no, tok AS text,
       CASE WHEN tok_no = 0 THEN 0 ELSE CAST(floor((tok_no - 1) / 2) AS BIGINT) END AS head_tok,
       CASE length(tok) % 7 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'PRON' WHEN 2 THEN 'AUX' WHEN 3 THEN 'ADJ' WHEN 4 THEN 'ADV' WHEN 5 THEN 'VERB' ELSE 'PROPN' END AS pos,
       CASE (length(tok) + tok_no) % 8 WHEN 0 THEN 'nsubj' WHEN 1 THEN 'nsubjpass' WHEN 2 THEN 'auxpass' WHEN 3 THEN 'advcl' WHEN 4 THEN 'relcl' WHEN 5 THEN 'acl' ELSE 'obj' END AS dep,
       length(tok) = 1 AS is_punct, regexp_full_match(tok, '[a-z]+') AS is_alpha
FROM (SELECT doc_id, sent_no, unnest(string_split(sent, ' ')) AS tok, unnest(range(len(string_split(sent, ' ')))) AS tok_no
      FROM f3_sents) t"""),
    "f4_scores": (("f3_sents",), r"""
SELECT doc_id, sent_no, sent, CAST(length(sent) * 37 % 101 AS DOUBLE)/97 AS score, CAST(length(sent) % 130 AS DOUBLE)*10/97 AS loss
FROM f3_sents"""),
    "f6_reg": ((), r"""
SELECT id + k AS id, y, x1, CASE WHEN k = 0 THEN x2 END AS x2, x3, x4, x_const
FROM (SELECT l_orderkey AS id, least(CAST(5 AS DOUBLE), CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) * 1999700 AS DOUBLE)) AS y,
             CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS x1,
             CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) * 100 AS DOUBLE) AS x2,
             CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) * 100 AS DOUBLE) AS x3,
             CAST(count(*) AS DOUBLE) AS x4, CAST(7 AS DOUBLE) AS x_const
      FROM lineitem GROUP BY l_orderkey) o, (VALUES (0), (1000000000)) v(k)
WHERE k = 0 OR id % 11 = 0"""),
    "f7_preds": (("f6_reg",), r"""
SELECT id, y, y*0.8E0 + 0.5E0 + CAST(id % 7 - 3 AS DOUBLE)*0.05E0 AS p1, y*0.6E0 + 0.9E0 + CAST(id % 5 - 2 AS DOUBLE)*0.1E0 AS p2,
       2.5E0 + CAST(id % 11 - 5 AS DOUBLE)*0.2E0 AS p3, y + CAST(id % 13 - 6 AS DOUBLE)*0.3E0 AS p4
FROM f6_reg"""),
    "f8_signal": ((), r"""
SELECT vec_id + k AS clip_id, 64 AS sr,
       CASE WHEN k < 2000000
            THEN list_concat(list_concat([CAST(0 AS DOUBLE) for i in range(16)],
                 [CASE WHEN k = 0 THEN CAST(x AS DOUBLE) ELSE CAST(0 AS DOUBLE) END for x in embedding]),
                 [CAST(0 AS DOUBLE) for i in range(16)]) END AS samples
FROM embeddings, (VALUES (0), (1000000), (2000000)) v(k)
WHERE k = 0 OR vec_id % 50 = 0"""),
}


def with_fixtures(body: str, *names: str) -> str:
    """Prefix ``body`` (which may start with its own ``WITH``-less CTE list via ``, name AS (...)``) with the
    fixture CTEs it needs, dependencies first."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in FIXTURE_SQL[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n][1]}\n)" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
