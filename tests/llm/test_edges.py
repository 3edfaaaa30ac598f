"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, per operator and stage."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadence.llm import chat, decontam, exact_dedup, html_extract, langid, mixing, ngram_join, sharding, suffix_dedup, url_filter
from cadence.llm.common import words_of
from cadence.llm.components import components

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_sharding(edge_docs, no_docs):
    tree = sharding.even_tree(8)
    rows = sharding.shard_documents(edge_docs, tree).toPandas()
    assert len(rows) == edge_docs.count() and rows[["size", "text_crc32", "shard", "slot", "grown_shard"]].notna().all().all()
    assert (rows["size"] >= 1).all()
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert sharding.shard_documents(no_docs, tree).count() == 0
    assert sharding.shard_rows(edge_docs, tree).columns.count("shard") == 1


def test_sharding_weights_confine_movement(spark):
    tree = [sharding.Leaf("r0", "k0", 0, 3.0), sharding.Leaf("r0", "k0", 1), sharding.Leaf("r0", "k1", 2, 2.0), sharding.Leaf("r1", "k2", 3, 2.0)]
    heavier = [*tree[:3], sharding.Leaf("r1", "k2", 3, 4.0)]
    keys = spark.range(40_000).select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), heavier).alias("b")).toPandas()
    share = keys["a"].value_counts(normalize=True)
    assert abs(share[0] - 3 / 8) < 0.02 and abs(share[1] - 1 / 8) < 0.02
    assert set(keys.loc[keys["a"] != keys["b"], "b"]) == {3}


def test_mixing(edge_docs, no_docs, spark):
    rows = mixing.mix_documents(edge_docs).toPandas()
    assert len(rows) == edge_docs.count()
    assert (rows["taken"] <= 2 * rows["size"]).all() and (rows["taken"] >= 0).all()
    by = rows.groupby(["source_size", "target"])["taken"].sum().reset_index()
    assert (abs(by["taken"] - np.floor(by["target"])) < 1).all()
    assert mixing.mix_documents(no_docs).count() == 0
    mixed = mixing.mixed_rows(edge_docs)
    assert mixed.columns == edge_docs.columns
    words = mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == rows["taken"].sum()
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert mixing.mix_documents(empty).agg(F.sum("taken")).first()[0] == 0


def test_ngram_join(edge_docs, no_docs):
    rows = ngram_join.near_duplicates(edge_docs).toPandas()
    assert len(rows) == edge_docs.count()
    known = rows.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")
    assert known.loc[[1, 2, 3], "class_id"].tolist() == [1, 1, 1]     # case does not count
    assert known.loc[[7, 8], "class_id"].tolist() == [7, 7]           # very long texts
    assert known.loc[[11, 12], "class_id"].tolist() == [11, 11]       # fewer than five words
    assert known.loc[[5, 6], "n_links"].tolist() == [0, 0] and known.loc[6, "class_id"] == 6
    assert known.loc[1, "n_links"] == 4                               # two rows of 2, 3 and the row without an id
    assert ngram_join.near_duplicates(no_docs).count() == 0
    kept = ngram_join.keep_one_per_class(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {1, 4, 5, 6, 7, 9, 10, 11, 13} == set(ids) - {None}


def test_ngram_join_blocks_and_components(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    rng = np.random.default_rng(3)
    texts = [" ".join(base)]
    for k in range(120):
        w = list(base)
        w[int(rng.integers(0, 200))] = f"x{k}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    got = ngram_join.near_duplicates(docs).toPandas().set_index("doc_id")
    from tests.llm.test_contracts import jaccard_classes

    links, classes = jaccard_classes(dict(enumerate(texts)))
    assert got["n_links"].to_dict() == links and got["class_id"].to_dict() == classes
    chain = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(300)], "a string, b string")
    assert {r.root for r in components(chain).collect()} == {"0000"}


def test_language_id(edge_docs, no_docs):
    rows = langid.identify(edge_docs).toPandas()
    assert len(rows) == edge_docs.count()
    known = rows.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")
    assert (known.loc[[4, 5, 6, 9], "lang_pred"] == "und").all() and (known.loc[[4, 5, 6, 9], "score"] == 0).all()
    assert known.loc[1, "lang_pred"] in {"en", "fr"}
    assert langid.identify(no_docs).count() == 0
    nothing = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(nothing).collect()} == {"und"}
    assert langid.keep_identified(edge_docs).columns == edge_docs.columns


def test_language_mixture(spark):
    de, en = "und die der nicht ist ein mit sich auf dem werden", "the of and that with this from have they were been"
    train = [(i, " ".join([de, de]), "de") for i in range(40)] + [(i + 40, " ".join([en, en]), "en") for i in range(40)]
    docs = spark.createDataFrame(train + [(1000, f"{de} {en}", None), (1001, f"{de} {de} {de} {en[:11]}", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert abs(got[1000].score - 0.5) < 0.15
    assert got[1001].lang_pred == "de" and got[1001].score > 0.7


def test_exact_dedup(edge_docs, no_docs):
    rows = exact_dedup.exact_groups(edge_docs).toPandas()
    assert len(rows) == edge_docs.count()
    one = rows[rows["doc_id"] == 1].iloc[0]
    assert one["keep_id"] == 3 and one["group_size"] == 5 and not one["kept"]
    empty = hashlib.sha256(b"").hexdigest()
    blank = rows[rows["text_sha256"] == empty]
    assert len(blank) == 3 and set(blank["keep_id"]) == {5.0}
    assert exact_dedup.exact_groups(no_docs).count() == 0


def test_exact_dedup_with_a_batch_that_is_null(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "A", 3), (3, "b", None), (4, "a", None)], "doc_id long, text string, day int")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(rows, F.col("day")).collect()}
    assert got == {1: (4, 3, False), 2: (4, 3, False), 4: (4, 3, True), 3: (3, 1, True)}


def test_binary_fuse_filter():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 10, 1000, 40_000):
        keys = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64))
        seed, length, segments, prints = exact_dedup.build_filter(keys)
        assert exact_dedup.in_filter(keys, seed, length, segments, prints).all()
        other = rng.integers(0, 2 ** 63, 20_000, dtype=np.uint64)
        assert exact_dedup.in_filter(other, seed, length, segments, prints).mean() < 0.002


def test_filter_positives_are_checked(spark, monkeypatch):
    """Many false positives change nothing: they fail the exact digests."""
    monkeypatch.setattr(exact_dedup, "in_filter", lambda keys, *rest: np.ones(len(keys), bool))
    docs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(40)], "doc_id long, text string")
    rows = exact_dedup.exact_groups(docs).toPandas()
    assert (rows["group_size"] == 2).all() and (rows["keep_id"] == rows["doc_id"] // 2 * 2 + 1).all()


def test_exact_dedup_ids_with_several_texts(spark):
    rows = [(5, t, 0) for t in "abcdefgh"] + [(9 + i, t, 1) for i, t in enumerate("abcdefgh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, batch int")
    got = exact_dedup.exact_groups(docs, F.col("batch")).toPandas()
    assert (got["group_size"] == 2).all()
    assert sorted(got.loc[got["kept"], "doc_id"]) == list(range(9, 17)) and (got["keep_id"] >= 9).all()


def test_suffix_dedup(edge_docs, no_docs, spark):
    rows = suffix_dedup.removed(edge_docs).toPandas()
    assert len(rows) == edge_docs.count()
    two = rows[rows["doc_id"] == 2]
    assert (two["n_removed"] == two["n_bytes"]).all() and (two["n_spans"] == 1).all()
    eight = rows[rows["doc_id"] == 8].iloc[0]
    from tests.llm.test_contracts import removed_bytes

    want = removed_bytes([(r.doc_id, r.text) for r in edge_docs.where("doc_id in (7, 8)").collect()])[8]
    assert (eight["n_bytes"], eight["n_removed"], eight["n_spans"], eight["kept_sha256"]) == want and want[1] > 500_000
    assert (rows[rows["n_bytes"] < 50]["n_removed"] == 0).all()
    assert suffix_dedup.removed(no_docs).count() == 0
    passage = "A" * 60  # a run of one byte has ties in every window
    docs = spark.createDataFrame([(3, "x" + passage + "y"), (1, passage), (2, "q" * 49 + passage[:49])], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.removed(docs).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (60, 1)}
    texts = suffix_dedup.removed(docs, with_text=True).where("doc_id = 3").first()
    assert bytes(texts.kept) == b"xy"


def test_suffix_dedup_sends_copies_once():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("abcdefghij"), 1000))
    rows = [*[text] * 50, "x" + text[:600]]
    shas = [hashlib.sha256(t.encode()).hexdigest() for t in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(shas), pa.array([int(s[:15], 16) for s in shas]), pa.array(rows)], ["sha", "key", "text"])
    task = [b for b in suffix_dedup._emit(iter([batch, batch]), 1)]
    assert sum(n for b in task for n in b.column("docs").to_pylist()) == 2
    sent = pd.concat([b.to_pandas() for _ in range(20) for b in task])  # twenty tasks that hold the same texts
    for blob in suffix_dedup._mark(sent)["places"]:
        places = np.frombuffer(blob, "<i4")
        assert len(places) and len(np.unique(places)) == len(places)


def test_url_filter_deep_paths(spark):
    day = F.lit("2024-05-01").cast("date")
    entries = spark.createDataFrame([("deep", "h.example/a/b/c/d"), ("page", "h.example/a/b/x/y/z.html")], "list string, pattern string")
    entries = entries.select("list", "pattern", day.alias("day"), F.lit("add").alias("action"))
    urls = ["http://h.example/a/b/c/d/e/f?q=1", "http://h.example/a/b/c/d", "http://h.example/a/b/c", "http://h.example/a/b/x/y/z.html#top", "http://h.example/a/b/x/y/z", "http://h.example/"]
    captures = spark.createDataFrame(list(enumerate(urls)), "id long, url string").withColumn("day", day)
    got = {r.id: (r.lists, r.pattern) for r in url_filter.decide(captures, entries).collect()}
    deep, page, none = ("deep", "h.example/a/b/c/d"), ("page", "h.example/a/b/x/y/z.html"), ("", None)
    assert got == {0: deep, 1: deep, 2: none, 3: page, 4: none, 5: none}


def test_url_filter_hosts(spark):
    """User info, ports, trailing dots, address literals, upper case, and what only looks like a host."""
    hosts = {"http://user:pw@evil.com/x": "evil.com", "http://user@evil.com/x": "evil.com", "http://a@b@evil.com": "evil.com", "http://evil.com./x": "evil.com", "HTTP://EVIL.com:8080?q": "evil.com",
             "http://10.0.0.1:80/x": "10.0.0.1", "http://[2001:DB8::1]:80/x": "[2001:db8::1]", "http://u:p@[::1]/": "[::1]", "http://x/@evil.com": "x", "http://x?@evil.com": "x",
             "evil.com/x": "", "http:///x": "", "": "", None: ""}
    urls = spark.createDataFrame([(u,) for u in hosts], "url string")
    got = {r.url: (r.h, r.p) for r in urls.select("url", url_filter.host_of(F.col("url")).alias("h"), url_filter.patterns_of(F.col("url")).alias("p")).collect()}
    assert {u: h for u, (h, _) in got.items()} == hosts
    assert got["http://10.0.0.1:80/x"][1] == ["10.0.0.1", "10.0.0.1/x"] and got["http://[2001:DB8::1]:80/x"][1] == ["[2001:db8::1]", "[2001:db8::1]/x"]
    assert got["http://user:pw@evil.com/x"][1] == ["evil.com", "evil.com/x"] and got[""][1] == []
    day = F.lit("2024-05-01").cast("date")
    entries = spark.createDataFrame([("bad", "evil.com"), ("bad", "0.0.1")], "list string, pattern string").select("list", "pattern", day.alias("day"), F.lit("add").alias("action"))
    long = "http://evil.com/" + "/".join(f"s{i}" for i in range(300))
    captures = urls.union(spark.createDataFrame([(long,), ("http://sub.evil.com/y",)], "url string")).select(F.monotonically_increasing_id().alias("id"), "url", day.alias("day"))
    blocked = {r.url for r in url_filter.decide(captures, entries).collect() if r.blocked}
    assert blocked == {u for u, h in hosts.items() if h == "evil.com"} | {long, "http://sub.evil.com/y"}
    assert url_filter.url_decisions(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_filter(spark):
    entries = spark.createDataFrame([("spam", "bad.example", "2024-01-10", "add"), ("spam", "bad.example", "2024-02-01", "drop"),
                                     ("spam", "bad.example", "2024-03-01", "add"), ("spam", "bad.example", "2024-03-01", "add"), ("adult", "ok.example/x", "2024-01-01", "add"),
                                     ("adult", "tie.example", "2024-01-05", "add"), ("adult", "tie.example", "2024-01-05", "drop"), (None, None, None, None)],
                                    "list string, pattern string, day string, action string").withColumn("day", F.to_date("day"))
    rows = [(1, "http://bad.example/a", "2024-01-09"), (2, "http://bad.example/a", "2024-01-10"), (3, "https://www.Bad.example:80/", "2024-01-31"),
            (4, "http://bad.example", "2024-02-01"), (5, "http://bad.example", "2024-12-01"), (6, "http://ok.example/x/y", "2024-05-01"),
            (7, "http://ok.example/z", "2024-05-01"), (8, None, "2024-05-01"), (9, "http://bad.example", None), (10, "http://tie.example", "2024-01-06"), (2, "http://bad.example/a", "2024-01-10")]
    captures = spark.createDataFrame([(*r, "x") for r in rows], "id long, url string, day string, pattern string").withColumn("day", F.to_date("day"))
    got = sorted((r.id, r.blocked, r.lists) for r in url_filter.decide(captures, entries).collect())
    assert got == [(1, False, ""), (2, True, "spam"), (2, True, "spam"), (3, True, "spam"), (4, False, ""), (5, True, "spam"), (6, True, "adult"),
                   (7, False, ""), (8, False, ""), (9, False, ""), (10, False, "")]
    assert url_filter.decide(captures.limit(0), entries).count() == 0
    assert {r.blocked for r in url_filter.decide(captures, entries.limit(0)).collect()} == {False}


def test_decontamination(spark, edge_docs, no_docs):
    item = "what is the tall green lighthouse keeper doing near stormy cliffs every evening before supper time. he repairs nets"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "unrelated words about quantum gardening machines and other curious instruments of science")], "item_id long, text string")
    paraphrase = item.replace("tall ", "").replace("stormy", "windy").replace("every evening", "each night")
    noise = " ".join(f"filler{i}" for i in range(400))
    docs = spark.createDataFrame([(1, f"{noise} {item.upper()} {noise}", "k"), (2, f"{noise} {paraphrase}", "k"), (3, noise, "k"), (4, None, None), (5, "", "k"), (1, f"{noise} {item.upper()} {noise}", "k")],
                                 "doc_id long, text string, matches string")
    found = sorted((r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect())
    assert found == [(1, 1), (1, 1), (2, 1)]
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert decontam.leaks(no_docs, bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0
    assert decontam.without_leaks(edge_docs, bench).count() == edge_docs.count()


def test_decontamination_short_and_frequent_items(spark):
    """Word-for-word copies of short items and of items with low IDF, and a near copy of the latter, in full windows."""
    rng = np.random.default_rng(8)
    noise = lambda n: " ".join(f"n{rng.integers(10 ** 6)}" for _ in range(n))
    often = "please keep calm while our engines cool down after landing tonight"
    rare = [" ".join(f"r{i}x{j}" for j in range(16)) for i in range(60)]
    bench = spark.createDataFrame([(1, "zyzzyva"), (2, "blue heron"), (3, "four little grey mice"), (4, often), *enumerate(rare, 5)], "item_id long, text string")
    texts = [f"{noise(45)} {often} {noise(45)}" if d % 3 == 0 else noise(100) for d in range(300)]
    texts += [f"{noise(20)} {x} {noise(40)}" for x in ("zyzzyva", "Blue  heron", "blue grey heron", "four little grey mice", "four grey little mice", often.replace("calm", "quiet"), *rare)]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    assert got == {(d, 4) for d in range(0, 300, 3)} | {(300, 1), (301, 2), (303, 3), (305, 4)} | {(306 + i, 5 + i) for i in range(60)}


def test_decontamination_items_of_common_words(spark):
    """Copies of one item that a third of the documents hold, and an item made of words that most items have."""
    rng = np.random.default_rng(9)
    noise = lambda n: " ".join(f"n{rng.integers(10 ** 6)}" for _ in range(n))
    copied = "seven brass lanterns hang above our old harbour gate tonight"
    frame = "which of these is the one that you would call"
    rare = [f"{frame} " + " ".join(f"r{i}x{j}" for j in range(16)) for i in range(12)]
    bench = spark.createDataFrame([*((i, copied) for i in range(6)), (6, frame), *enumerate(rare, 7)], "item_id long, text string")
    texts = [f"{noise(40)} {copied.replace('old', 'new') if d % 6 else copied} {noise(40)} {frame.replace('one', 'two')}" if d % 3 == 0 else noise(80) for d in range(90)]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    assert got == {(d, i) for d in range(0, 90, 3) for i in range(7)}
    groups = decontam._models(spark.createDataFrame([(t,) for t in texts], "text string"), decontam.parse_items(bench.collect()))[1]
    assert {i for g in groups for i in g.items.tolist()} == set(range(19))


def test_decontamination_recall_of_paraphrases(spark):
    """Latent candidates and checks against a full LCS of every window: recall at least 0.9, no others."""
    rng = np.random.default_rng(11)
    draw = lambda n: [f"c{rng.integers(40)}" if rng.random() < 0.4 else f"v{rng.integers(3000)}" for _ in range(n)]
    items = [draw(int(rng.integers(14, 60))) for _ in range(150)]
    docs = []
    for d in range(150):
        text = draw(300)
        if d % 2 == 0:
            text[100:100] = [w if rng.random() > 0.1 else "zz" + w for w in items[d]]
        docs.append((d, " ".join(text)))
    parsed = decontam.parse_items([{"item_id": i, "text": " ".join(w)} for i, w in enumerate(items)])
    import pyarrow as pa

    (_, _, hashes, first), = decontam.words(pa.array([t for _, t in docs]))
    want = {(d, x.item_id) for d in range(150) for x in parsed for s in range(0, first[d + 1] - first[d], decontam.STEP)
            if decontam._verify(hashes[first[d]:first[d + 1]], s, x, decontam._masks(x), 1.0)}
    assert len(want) > 50
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert got <= want


def test_randomised_svd():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((60, 8)) @ rng.standard_normal((8, 90))
    v = decontam.randomised_svd(a, 8)
    assert np.allclose(a @ v @ v.T, a)


def test_chat(spark):
    talk = [("System: be brief", "system"), ("User: hello there?", "user"), ("Assistant: hi\nhow can I help you with that today, in as much detail as you like to have", "assistant"),
            ("what is this?", "user"), ("AI: a test", "assistant")]
    rows = [(c, t, x, r, "z") for c in range(30) for t, (x, r) in enumerate(talk)] + [(None, 0, None, None, "z"), (99, 0, "", None, "z")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string, state string")
    lines = chat.lines_of(conv, "conv_id", "turn", "text", "role")
    model = chat.learn(lines)
    got = chat.turns(chat.decode(lines, model)).where("conv = 3").orderBy("turn").collect()
    assert [(r.role, r.text.split("\n")[0]) for r in got] == [("system", "be brief"), ("user", "hello there?"), ("assistant", "hi"), ("user", "what is this?"), ("assistant", "a test")]
    assert got[2].n_lines == 2 and got[0].rendered == "<|system|>\nbe brief\n<|end|>"
    assert chat.turns(chat.decode(lines.limit(0), model)).count() == 0
    assert chat.turns(chat.decode(lines, model)).where("conv is null or conv = 99").count() == 2


def test_chat_chunks_decode_like_one_sequence(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = ["User: a", "b?", "Assistant: c", "a much longer line that goes on and on and on and on until it is long", "e"]
    rows = [(c, t, words[int(rng.integers(0, 5))], ["user", "assistant"][int(rng.integers(0, 2))]) for c in range(3) for t in range(200)]
    lines = chat.lines_of(spark.createDataFrame(rows, "conv_id long, turn long, text string, role string"), "conv_id", "turn", "text", "role")
    model = chat.learn(lines)
    symbols = chat._seen(lines).select("c", "ord", "sym")

    def scores():
        """Log probability of the decoded path of each conversation (equally likely paths may differ)."""
        out = {}
        for c, own in chat.decode(lines, model).join(symbols, ["c", "ord"]).toPandas().groupby("c"):
            own = own.sort_values("ord")
            before = [chat.STATES, *own["state"][:-1]]
            out[c] = sum(model.enter[a, b] + model.shows[b, s] for a, b, s in zip(before, own["state"], own["sym"]))
            starts = (own["state"] % 2 == 0).cumsum() - 1
            assert own["turn"].tolist() == starts.clip(lower=0).tolist()
        return out

    whole = scores()
    monkeypatch.setattr(chat, "CHUNK", 7)
    assert scores() == pytest.approx(whole, abs=1e-9)


def test_html(spark):
    chrome = "<nav><a>Menu</a></nav><div class='site-notice cookie-notice'>We use cookies</div><p>Daily template line</p>"
    pages = [
        (1, "http://h.example/a/1", f"<html><head><title>T</title></head><body>{chrome}<p>First   story\n&amp; caf&eacute;</p><footer>f</footer></body></html>"),
        (2, "http://h.example/a/2", f"<body>{chrome}<p>Second story</p><section id=comments><p>nice</p></section>"),
        (3, "http://other.example/", "<body><article><h1>H</h1><p>One<b>two</b><br>three<aside>side</aside><form>f</form><script>var x='<p>no</p>';</script></article><div>after</div>"),
        (4, "http://other.example/copy", "<body><article><h1>H</h1><p>One<b>two</b><br>three</article>"),
        (5, None, None), (None, "", ""), (6, "http://h.example/z", "<p>cut &am <a href='"), (3, "http://other.example/", "<p>again</p>"),
    ]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, lines string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.main_texts(df).collect()]
    text = dict((p, t) for p, t, _ in got if p not in (None, 3))
    assert text == {1: "First story & café", 2: "Second story", 4: "H Onetwo three", 5: "", 6: "cut &am"}
    assert sorted(t for p, t, _ in got if p == 3) == ["H Onetwo three", "again"]
    assert len(got) == len(pages) and all(n == len(t) for _, t, n in got)
    assert html_extract.main_texts(df.limit(0)).count() == 0


def test_html_heavy_template_and_copies(spark):
    """A template share of 80 % and more goes; copies, also between other copies, take it from a further page."""
    chrome = "".join(f"<div>Template line {i}</div>" for i in range(8))
    page = lambda own, top="": f"<body><nav>{top}</nav>{chrome}" + "".join(f"<p>{x}</p>" for x in own)
    story = ["Copied story", "told twice"]
    pages = [(i, f"http://h.example/a/{i}", page([f"Own {i}", f"words {i}"])) for i in range(3)]
    pages += [(i, f"http://h.example/b/{i}", page(story, f"crumb {i}")) for i in range(3, 9)]
    pages += [(9, "http://h.example/b/9", page([*story, "and more"])), (10, "http://alone.example/1", page(story)), (11, "http://alone.example/2", page(story))]
    pages += [(12, "http://nest.example/5", page(story)), *((13 + i, f"http://nest.example/{x}", page([*story, f"More {x}"])) for i, x in enumerate((3, 4, 6, 7))), (17, "http://nest.example/9", page(["End"]))]
    got = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()}
    whole = " ".join([*(f"Template line {i}" for i in range(8)), *story])
    assert got == {**{i: f"Own {i} words {i}" for i in range(3)}, **{i: "Copied story told twice" for i in range(3, 9)}, 9: "and more", 10: whole, 11: whole,
                   12: "Copied story told twice", 13: "More 3", 14: "More 4", 15: "More 6", 16: "More 7", 17: "End"}


def test_html_template_inside_articles(spark):
    """A line that a page's article shares with the four runs on either side goes; a quote, a copied story and a small host keep theirs."""
    page = lambda *own: "<body><div>Chrome</div><article>" + "".join(f"<p>{x}</p>" for x in own) + "</article></body>"
    share = "Share this story"
    pages = [(i, f"http://h.example/a/{i}", page(f"Title {i}", share, f"first {i}", f"last {i}")) for i in range(10)]
    pages[3] = (3, "http://h.example/a/3", page("Title 3", "A quote", share, "first 3", "last 3"))
    pages[4] = (4, "http://h.example/a/4", page("Title 4", "A quote", share, "first 4", "last 4"))
    pages += [(30 + i, f"http://copy.example/{i}", page("One story", "told often")) for i in range(10)]
    pages += [(20 + i, f"http://few.example/{i}", page(f"Title {i}", share, f"end {i}")) for i in range(3)]
    pages += [(None, None, page("Alone")), (4, "http://h.example/a/4", pages[4][2])]
    got = html_extract.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    # the first and last four runs of the host have fewer than four on one side
    for i in range(10):
        own = [f"Title {i}", *(["A quote"] if i in (3, 4) else []), *([] if i in (4, 5) else [share]), f"first {i}", f"last {i}"]
        assert text[i] == " ".join(own)
    assert [r.text for r in got if r.page_id == 4] == ["Title 4 A quote first 4 last 4"] * 2
    assert {text[30 + i] for i in range(10)} == {"One story told often"} and text[None] == "Alone"
    assert [text[20 + i] for i in range(3)] == [f"Title {i} {share} end {i}" for i in range(3)]


def test_common_lines():
    assert html_extract.common_lines(list("abcbdab"), list("bdcaba")).__len__() == 4
    assert html_extract.common_lines([], ["a"]) == set() and html_extract.common_lines(["a"], []) == set()


def test_words():
    text = "a  b\tc".encode() + "d e".encode()
    h, start, end, first = words_of(np.frombuffer(text, np.uint8), np.array([0, 6, 6, 9]))
    assert [text[a:b].decode() for a, b in zip(start, end)] == ["a", "b", "c", "d", "e"] and first.tolist() == [0, 3, 3, 5]
    assert len(set(h.tolist())) == 5


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_edge_rows(spark, edge_docs, no_docs, name, stage, sf_small):
    out = stage(spark, edge_docs, sf_small)
    assert [c for c in out.columns if c != "shard"] == [c for c in edge_docs.columns if c != "shard"]
    assert out.count() >= 1
    assert stage(spark, no_docs, sf_small).count() == 0


def test_pipeline_against_brute_force(spark, sf_small):
    """Every decision taken again in plain Python, stage by stage."""
    import re

    from tests.llm.test_contracts import jaccard_classes

    docs = spark.read.parquet(f"{sf_small}/documents.parquet").toPandas()
    docs = docs[docs["text"].str.contains(r"[^\W\d_]", regex=True)]
    _, classes = jaccard_classes(dict(zip(docs["doc_id"], docs["text"])))
    docs = docs[[classes[i] == i for i in docs["doc_id"]]]
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [norm(t) for t in spark.read.parquet(f"{sf_small}/benchmark.parquet").toPandas()["text"]]
    docs = docs[[not any(x in norm(t) for x in items) for t in docs["text"]]].copy()
    docs["size"] = [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in docs["text"]]
    docs["order"] = [hashlib.md5(f"mix:{i}".encode()).hexdigest() for i in docs["doc_id"]]
    sizes = docs.groupby("source")["size"].sum().sort_index()
    weight = dict(zip(sizes.index, [(5, 2, 1)[i % 3] for i in range(len(sizes))]))
    left, open_ = 1.5 * sizes.sum(), set(sizes.index)
    goal: dict[str, float] = {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2.0 * sizes[s] <= level * weight[s]}
        if not full:
            goal |= {s: level * weight[s] for s in open_}
            break
        goal |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    want = []
    for s, own in docs.sort_values("order").groupby("source"):
        budget = int(goal[s])
        for epoch in range(2):
            for i, n in zip(own["doc_id"], own["size"]):
                take = min(budget, n)
                budget -= take
                if take:
                    want.append((i, take))
    rows = corpus_pipeline.run(spark, sf_small).toPandas()
    got = sorted((i, len(re.findall(r"[^\x20\x09-\x0D]+", t))) for i, t in zip(rows["doc_id"], rows["text"]))
    assert got == sorted(want)
    assert set(rows["shard"]) <= set(range(8)) and rows.groupby("doc_id")["shard"].nunique().max() == 1


def test_suffix_dedup_sends_only_the_documents_of_a_bucket():
    """What a task sends stays near the size of its minimizers, however many buckets there are."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]), pa.array(rng.integers(0, 2 ** 60, len(texts))), pa.array(texts)], ["sha", "key", "text"])
    size, found = sum(map(len, texts)), []
    for buckets, most in ((12, 0.5), (625, 1.0), (6250, 1.0)):
        out = list(suffix_dedup._emit(iter([batch, batch]), buckets))
        sent = sum(len(x.as_py()) + 24 for b in out for x in b.column("data"))
        assert sent <= most * size, (buckets, sent / size)
        found.append(sum(sum(b.column("n").to_pylist()) for b in out))
        for b in out[:1]:
            for d, n, blob in list(zip(b.column("docs").to_pylist(), b.column("n").to_pylist(), b.column("data").to_pylist()))[:20]:
                keys, each, at, _ = suffix_dedup.unpacked_planes(blob, (d, 8), (d, 4), (n, 4), (n, 4))
                assert int(each.sum()) == n and len(np.unique(np.cumsum(keys))) == d and at.max() < 2000
    assert len(set(found)) == 1


def test_language_proportions_equal_plain_em():
    """The batched EM with rows that settle early against one row at a time in plain Python."""
    rng = np.random.default_rng(7)
    sizes = [1, 2, 5, 40, 300, 3]
    row = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum([0, *sizes[:-1]])
    like = rng.random((len(row), 4)) ** np.repeat(rng.integers(1, 6, len(sizes)), sizes)[:, None]
    share, ll = langid._fit(np.full((len(sizes), 4), 0.25), like, row, first)
    for i, n in enumerate(sizes):
        own, s = like[first[i]:first[i] + n].tolist(), [0.25] * 4
        while True:
            new = [0.0] * 4
            for w in own:
                total = sum(a * b for a, b in zip(w, s))
                new = [x + a * b / total / n for x, a, b in zip(new, w, s)]
            moved, s = max(abs(a - b) for a, b in zip(new, s)), new
            if moved < langid.TOLERANCE:
                break
        assert np.allclose(share[i], s, atol=1e-12)
        assert abs(ll[i] - sum(np.log(sum(a * b for a, b in zip(w, s))) for w in own)) < 1e-9


def plain_viterbi(model, symbols):
    """(best log probability, one path) by the textbook recursion over Python lists."""
    score = [model.enter[chat.STATES][s] + model.shows[s][symbols[0]] for s in range(chat.STATES)]
    back = []
    for x in symbols[1:]:
        best = [max(range(chat.STATES), key=lambda p: score[p] + model.step[p][s]) for s in range(chat.STATES)]
        score = [score[best[s]] + model.step[best[s]][s] + model.shows[s][x] for s in range(chat.STATES)]
        back.append(best)
    path = [max(range(chat.STATES), key=lambda s: score[s])]
    for best in reversed(back):
        path.append(best[path[-1]])
    return max(score), path[::-1]


def path_score(model, path, symbols):
    before = [chat.STATES, *path[:-1]]
    return sum(model.enter[b][s] + model.shows[s][x] for b, s, x in zip(before, path, symbols))


def test_chat_equals_plain_viterbi_also_in_one_long_block(spark, monkeypatch):
    """Random models and lines: one line, ties, repeated rows, many orders, and blocks of many lines cut inside the block."""
    monkeypatch.setattr(chat, "CHUNK", 5)
    monkeypatch.setattr(chat, "CHUNK_LINES", 7)
    rng = np.random.default_rng(11)
    lines = ["User: hi", "plain text", "### Assistant", "what is it?", "x" * 200, "", "[System] be kind"]
    say = lambda n: "\n".join(rng.choice(lines, n))
    rows = [(1, 0, say(1)), (2, 0, say(60)), (3, 0, say(3)), (3, 1, say(40)), (3, 2, say(2)), (3, 9, say(15)), (3, 10, None), *[(4, i, say(int(rng.integers(1, 4)))) for i in range(33)],
            (5, 0, "same"), (5, 0, "same"), (5, 1, "\n".join(["same"] * 30)), (6, 0, "User: " + "very long " * 20_000)]
    table = chat.lines_of(spark.createDataFrame(rows, "conv_id long, turn long, text string"), "conv_id", "turn", "text")
    chunks = chat._chunked(chat._seen(table)).toPandas()
    assert chunks.groupby(["c", "chunk"]).size().max() <= 5 * 7
    for _, own in chunks.sort_values(["ord", "line_no"], kind="stable").groupby("c"):
        assert own["chunk"].is_monotonic_increasing
    for seed in (1, 2):
        r = np.random.default_rng(seed)
        model = chat.Model(r.integers(0, 9, chat.STATES).astype(float), r.integers(0, 9, (chat.STATES, chat.STATES)).astype(float), r.integers(0, 9, (chat.STATES, chat.SYMBOLS)).astype(float))
        got = chat.decode(table, model).toPandas()
        symbols = chat._seen(table).toPandas()
        assert len(got) == len(symbols)
        for c, own in got.groupby("c"):
            seen = symbols[symbols["c"] == c].sort_values(["ord", "line_no", "line"], kind="stable")["sym"].tolist()
            path = own.sort_values(["ord", "line_no", "line"], kind="stable")["state"].tolist()
            assert abs(path_score(model, path, seen) - plain_viterbi(model, seen)[0]) < 1e-9
