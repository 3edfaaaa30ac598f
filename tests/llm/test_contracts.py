"""The contract queries against DuckDB SQL, brute force, or held-out accuracy; all on whole tables."""

import hashlib
import html
import re
from collections import defaultdict

import numpy as np
import pytest

from cadence.llm.oracles import ORACLES
from cadence.llm.queries import QUERIES
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), duck(SF).execute(ORACLES[name]).df()) is None


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")


def test_op1_only_the_new_shard_takes_rows(spark):
    rows = QUERIES["op1_sharding"](spark, SF).toPandas()
    moved = rows[rows["shard"] != rows["grown_shard"]]
    assert len(moved) and set(moved["grown_shard"]) == {8}
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_op3_finds_planted_items_and_nothing_else(spark, docs):
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d, i.item_id) for d, t in zip(docs["doc_id"], docs["text"]) for i in items if norm(i.text) in norm(t)}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op3_decontamination"](spark, SF).collect()}
    assert want and got == want


def jaccard_classes(texts: dict, threshold: float = 0.8):
    """Brute force: (links per document, class per document)."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    shared = defaultdict(int)
    for own in by.values():
        for a in range(len(own)):
            for b in range(a):
                shared[own[b], own[a]] += 1
    links, parent = dict.fromkeys(sets, 0), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= threshold:
            links[a] += 1
            links[b] += 1
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return links, {i: root(i) for i in sets}


def test_op5_equals_all_pairs(spark, docs):
    links, classes = jaccard_classes(dict(zip(docs["doc_id"], docs["text"])))
    got = QUERIES["op5_ngram_join"](spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    assert got["n_links"].to_dict() == links
    assert got["class_id"].to_dict() == classes


def test_op6_held_out_accuracy(spark, docs):
    got = QUERIES["op6_language_id"](spark, SF).toPandas().merge(docs[["doc_id", "lang"]], on="doc_id")
    held = got[got["held_out"]]
    assert len(got) == len(docs) and len(held) > 30
    assert (held["lang_pred"] == held["lang"]).mean() >= 0.97
    assert got["score"].between(0, 1).all()


def removed_bytes(texts: list[tuple[int, str]], length: int = 50) -> dict:
    """Brute force: doc_id to (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        own = [b[j:j + length] for j in range(len(b) - length + 1)]
        cover = np.zeros(len(b) + 1, int)
        for j, w in enumerate(own):
            if w in seen:
                cover[j] += 1
                cover[j + length] -= 1
        gone = np.cumsum(cover)[:len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest())
        seen.update(own)
    return out


def test_op8_equals_brute_force(spark, docs):
    want = removed_bytes(list(zip(docs["doc_id"], docs["text"])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op8_suffix_dedup"](spark, SF).collect()}
    assert got == want


def test_op9_recovers_roles_and_texts(spark):
    """On sf0.01: sf0.001 has about twenty conversations to learn from."""
    true = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").toPandas()
    got = QUERIES["op9_chat_format"](spark, "/root/testdata/sf0.01").toPandas()
    both = got.merge(true, on=["conv_id", "turn"], suffixes=("", "_true"))
    held = both[both["held_out"]]
    assert len(got) == len(true) and len(held) > 100
    assert (held["role"] == held["role_true"]).mean() >= 0.97
    assert (held["text"] == held["text_true"].str.strip()).mean() >= 0.97


def test_op10_equals_the_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    got = QUERIES["op10_html_extraction"](spark, SF).toPandas().set_index("page_id")
    assert len(got) == len(pages)
    for i, page in zip(pages["page_id"], pages["html"]):
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S).group(1)
        body = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", re.sub(r"<[^>]*\Z", "", body)))
        want = " ".join(html.unescape(body).split())
        assert got["text"][i] == want and got["n_chars"][i] == len(want)
