"""Operator 3: benchmark decontamination by latent semantic retrieval.

1. Benchmark items become TF-IDF passages of at most ``ITEM_WORDS`` words. Document frequencies of their words come
   from every document (tasks return counts of the benchmark's words only, one partial aggregate sums them).
2. Groups of passages are factored by randomised SVD (Gaussian range finder with power steps), one Spark task a
   group. A group keeps ``RANK`` latent dimensions.
3. Every text is cut into overlapping word windows. A window's latent vector is the sum of its words' projected
   TF-IDF rows. Candidates are the passages whose cosine with it reaches ``COSINE`` (the window's length counts all
   its words, also those that no item has) and those of which it holds a share of ``HELD``: the dot product against
   the passage's own projected norm, which neither the other words of the window nor a low IDF lessen.
   Beside this, every item is looked up by a run of ``SHORT`` of its words (all of them if it has fewer), so that a
   word-for-word copy is a candidate whatever its length and weights.
4. A candidate's item is compared with the words around the window by longest common subsequence. At least
   ``SAME`` of the item's words in order is a leak. A paraphrase needs ``LIKE`` of them and the item's answer (its last
   sentence, when it has more than one) word for word. Items of fewer than ``SHORT`` words must occur word for word.

The benchmark is the stated query set: ``ITEMS_PER_PASS`` items (a bounded model, broadcast) meet all documents in
one pass, and more items take more passes. Documents are neither shuffled nor collected.

Words are lower-cased runs of letters, digits and non-ASCII characters. Edge cases: NULL or empty texts match
nothing; NULL or wordless items are never matched; equal items each match; repeated rows are judged alike; empty
tables give no rows; other columns are ignored by ``leaks`` and carried whole by ``without_leaks``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import mix64, packed, utf8_chunks, words_of

STEP = 16                # words between window starts; a window is two steps
ITEM_WORDS = 48
GROUP, RANK = 128, 96
COSINE, HELD = 0.18, 0.35
SAME, LIKE, SHORT = 0.8, 0.6, 8
COMMON, SPREAD = 0.2, 0.125  # a word in more than these shares of the documents and of the distinct items (and in more than two)
                             # carries no weight, unless such words alone can make up a leak of an item
ITEMS_PER_PASS = 4096


def _letters() -> np.ndarray:
    """Byte map that turns ASCII other than letters and digits into spaces (texts are lower-cased before)."""
    return np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


_MAP = _letters()


def words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, word hashes, first word of each row) per chunk."""
    for lo, n, data, offs in utf8_chunks(texts):
        h, _, _, first = words_of(_MAP[data], offs)
        yield lo, n, h, first


class Item(NamedTuple):
    item_id: int
    words: np.ndarray
    answer: np.ndarray


def parse_items(rows: list) -> list[Item]:
    """Items with words, from (item_id, lower-cased text) rows."""
    out = []
    for r in rows:
        whole = next(words(pa.array([r["text"] or ""], pa.string())))[2]
        parts = [p for p in _sentences(r["text"] or "") if any(ch.isalnum() for ch in p)]
        answer = next(words(pa.array([parts[-1]], pa.string())))[2] if len(parts) > 1 else whole[:0]
        if len(whole):
            out.append(Item(r["item_id"], whole, answer))
    return out


def _sentences(text: str) -> list[str]:
    for mark in "?!\n":
        text = text.replace(mark, ".")
    return text.split(".")


def _document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """(documents holding each word, documents) over all of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # words of at most ITEMS_PER_PASS items

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        total, rows = np.zeros(len(vocab), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, n, h, first in words(batch.column("text")):
                at = np.searchsorted(vocab, h)
                at[at == len(vocab)] = 0
                ok = np.flatnonzero(vocab[at] == h) if len(vocab) else np.zeros(0, np.int64)
                row = np.searchsorted(first, ok, side="right") - 1
                seen = np.unique(row * len(vocab) + at[ok])
                total += np.bincount(seen % len(vocab), minlength=len(vocab))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(total[hit], rows))], ["term", "n"])

    got = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(vocabulary), np.int64)
    real = got[got["term"] >= 0]
    df[real["term"].to_numpy()] = real["n"].to_numpy()
    return df, int(got.loc[got["term"] < 0, "n"].sum())


def randomised_svd(a: np.ndarray, rank: int, seed: int = 1, power: int = 2) -> np.ndarray:
    """Right singular vectors (columns x rank) of ``a`` by the randomised range finder."""
    rank = min(rank, *a.shape)
    rng = np.random.default_rng(seed)
    y = a @ rng.standard_normal((a.shape[1], min(rank + 8, min(a.shape))))
    for _ in range(power):
        q, _ = np.linalg.qr(y)
        z, _ = np.linalg.qr(a.T @ q)
        y = a @ z
    q, _ = np.linalg.qr(y)
    _, _, vt = np.linalg.svd(q.T @ a, full_matrices=False)
    return vt[:rank].T


def _fit(pdf: pd.DataFrame, idf: np.ndarray) -> pd.DataFrame:
    """One group of passages (item, terms) to its latent model: terms, term projections, passage directions."""
    pdf = pdf.sort_values(["item", "part"], kind="stable")
    bags = [np.frombuffer(t, np.int64) for t in pdf["terms"]]
    terms = np.unique(np.concatenate(bags))
    a = np.zeros((len(bags), len(terms)))
    for i, bag in enumerate(bags):
        np.add.at(a[i], np.searchsorted(terms, bag), 1.0)
    a *= idf[terms]
    norm = np.linalg.norm(a, axis=1, keepdims=True)
    a /= np.where(norm > 0, norm, 1.0)
    v = randomised_svd(a, RANK)
    latent = a @ v
    size = np.linalg.norm(latent, axis=1, keepdims=True)
    latent /= np.where(size > 1e-9, size, 1.0)
    return pd.DataFrame([[terms.tobytes(), (idf[terms][:, None] * v).astype(np.float32).tobytes(), latent.astype(np.float32).tobytes(),
                          (norm * size).astype(np.float32).tobytes(), pdf["item"].to_numpy(np.int64).tobytes(), v.shape[1]]],
                        columns=["terms", "project", "latent", "norms", "items", "rank"])


class Group(NamedTuple):
    terms: np.ndarray    # vocabulary index to row of project, -1 where absent
    project: np.ndarray
    latent: np.ndarray
    norms: np.ndarray    # projected length of each passage
    items: np.ndarray


class Weights(NamedTuple):
    vocabulary: np.ndarray   # sorted word hashes of the items
    idf: np.ndarray          # 0 for common words
    unknown: float           # weight of a word that no item has: the mean of the others


class Runs(NamedTuple):
    size: int
    starts: np.ndarray                          # per vocabulary word, whether a run starts with it
    items: dict[int, list[tuple[int, int]]]     # run hash to (item number, place of the run in the item)


def _run_hashes(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place."""
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out = mix64(out + h[at + j])
    return out


def _item_runs(items: list[Item], vocabulary: np.ndarray, df: np.ndarray) -> list[Runs]:
    """One run of words of each item, from its rarest word that has enough words after it, by run size."""
    by: dict[int, Runs] = {}
    for i, item in enumerate(items):
        size = min(len(item.words), SHORT)
        at = np.searchsorted(vocabulary, item.words[:len(item.words) - size + 1])
        place = int(np.argmin(df[at]))
        runs = by.setdefault(size, Runs(size, np.zeros(len(vocabulary), bool), {}))
        runs.starts[at[place]] = True
        runs.items.setdefault(int(_run_hashes(item.words, np.array([place]), size)[0]), []).append((i, place))
    return list(by.values())


def _models(docs: DataFrame, items: list[Item]) -> tuple[Weights, list[Group], list[Runs]]:
    """(word weights, latent groups, runs for the word-for-word lookup)."""
    spark = docs.sparkSession
    vocabulary = np.unique(np.concatenate([x.words for x in items]))
    df, n = _document_frequencies(docs, vocabulary)
    idf = np.log((n + 1.0) / (df + 1.0)) + 0.1
    texts = {x.words.tobytes(): np.searchsorted(vocabulary, x.words) for x in items}  # copies of an item count once
    spread = np.bincount(np.concatenate([np.unique(x) for x in texts.values()]), minlength=len(vocabulary))
    common = (df > COMMON * n) & (spread > max(2.0, SPREAD * len(texts)))
    for own in [x for x in texts.values() if common[x].mean() >= LIKE]:  # a leak of such an item may hold its common words only
        common[own] = False
    idf[common] = 0.0
    weights = Weights(vocabulary, idf, float(idf[idf > 0].mean()))
    rows, number = [], 0
    for i, item in enumerate(items):
        starts = range(0, max(1, len(item.words) - ITEM_WORDS // 2), ITEM_WORDS // 2) if len(item.words) > ITEM_WORDS else [0]
        for part, s in enumerate(starts):
            at = np.searchsorted(vocabulary, item.words[s:s + ITEM_WORDS])
            bag = at[idf[at] > 0]
            if len(bag):
                rows.append((number // GROUP, i, part, bag.astype(np.int64).tobytes()))
                number += 1
    if not rows:
        return weights, [], _item_runs(items, vocabulary, df)
    passages = spark.createDataFrame(pd.DataFrame(rows, columns=["grp", "item", "part", "terms"]), "grp int, item long, part int, terms binary")
    fitted = passages.groupBy("grp").applyInPandas(lambda pdf: _fit(pdf, idf), "terms binary, project binary, latent binary, norms binary, items binary, rank int")
    groups = []
    for r in fitted.collect():  # at most passages / GROUP models of one pass
        terms = np.frombuffer(r["terms"], np.int64)
        where = np.full(len(vocabulary), -1, np.int32)
        where[terms] = np.arange(len(terms))
        groups.append(Group(where, np.frombuffer(r["project"], np.float32).reshape(-1, r["rank"]),
                            np.frombuffer(r["latent"], np.float32).reshape(-1, r["rank"]), np.frombuffer(r["norms"], np.float32),
                            np.frombuffer(r["items"], np.int64)))
    return weights, groups, _item_runs(items, vocabulary, df)


def lcs(masks: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence of an item (bit mask of places per word) and ``text``."""
    full = (1 << size) - 1
    v = full
    for w in text:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _contains(text: np.ndarray, part: np.ndarray) -> bool:
    if not len(part) or len(part) > len(text):
        return False
    at = np.flatnonzero(text[:len(text) - len(part) + 1] == part[0])
    return any(np.array_equal(text[i:i + len(part)], part) for i in at)


MATCH = "item_id long, overlap double, cosine double, answer boolean, start_word long"


def _known_words(h: np.ndarray, vocabulary: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, vocabulary index) of the words that an item has."""
    maybe = np.flatnonzero(known[h >> np.uint64(44)])
    at = np.searchsorted(vocabulary, h[maybe])
    at[at == len(vocabulary)] = 0
    ok = vocabulary[at] == h[maybe]
    return maybe[ok], at[ok]


def _copies(h: np.ndarray, first: np.ndarray, place: np.ndarray, term: np.ndarray, runs: list[Runs]) -> Iterator[tuple[int, int, int]]:
    """(row, word within the row where the item would start, item number) wherever an item's run occurs."""
    for size, starts, items in runs:
        at = place[starts[term]]
        row = np.searchsorted(first, at, side="right") - 1
        whole = at + size <= first[row + 1]
        at, row = at[whole], row[whole]
        hashes = _run_hashes(h, at, size)
        for k in np.flatnonzero(np.isin(hashes, np.fromiter(items, np.uint64, len(items)))).tolist():
            for i, offset in items[int(hashes[k])]:
                yield int(row[k]), max(0, int(at[k] - first[row[k]]) - offset), i


def _windows(h: np.ndarray, first: np.ndarray, place: np.ndarray, term: np.ndarray, weights: Weights,
             groups: list[Group]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first word within the row, item number, cosine) of candidate windows, per group."""
    _, idf, unknown = weights
    if not len(h):
        return
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    steps = -(-np.diff(first) // STEP)
    step0 = np.concatenate([[0], np.cumsum(steps)])
    block = step0[row] + (np.arange(len(h)) - first[row]) // STEP
    square = np.full(len(h), unknown * unknown)
    square[place] = idf[term] ** 2
    length = np.add.reduceat(square, np.flatnonzero(np.diff(block, prepend=-1)))
    place, term = place[idf[term] > 0], term[idf[term] > 0]
    if not len(place):
        return
    used, cut = np.unique(block[place], return_index=True)
    owner = np.searchsorted(step0, used, side="right") - 1
    follows = np.append(owner[1:] == owner[:-1], False) & np.append(used[1:] == used[:-1] + 1, False)
    after = used + 1
    has_next = after < step0[owner + 1]
    size = np.sqrt(length[used] + np.where(has_next, length[np.minimum(after, len(length) - 1)], 0.0)).astype(np.float32)
    for g in groups:
        local = g.terms[term]
        has = np.flatnonzero(local >= 0)
        if not len(has):
            continue
        where = np.searchsorted(cut, has, side="right") - 1  # which used block
        hit, start = np.unique(where, return_index=True)
        sums = np.zeros((len(used) + 1, g.project.shape[1]), np.float32)
        sums[hit] = np.add.reduceat(g.project[local[has]], start, axis=0)
        # a window is a step with words of the items and the step after it
        pair = sums[:-1] + np.where(follows[:, None], sums[1:], 0)
        dot = pair @ g.latent.T
        i, j = np.nonzero(dot >= np.minimum(COSINE * size[:, None], HELD * g.norms))
        yield owner[i], (used[i] - step0[owner[i]]) * STEP, g.items[j], dot[i, j] / size[i]


def _search(rows: DataFrame, items: list[Item], weights: Weights, groups: list[Group], runs: list[Runs]) -> DataFrame:
    """rows (key, text) to (key, matches)."""
    known = np.zeros(1 << 20, bool)
    known[weights.vocabulary >> np.uint64(44)] = True
    shared = rows.sparkSession.sparkContext.broadcast((items, weights, known, groups, runs))  # bounded by ITEMS_PER_PASS
    key = rows.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, known, groups, runs = shared.value
        masks: dict[int, dict[int, int]] = {}
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("overlap", pa.float64()), ("cosine", pa.float64()), ("answer", pa.bool_()), ("start_word", pa.int64())]))
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for lo, n, h, first in words(batch.column("text")):
                best: dict[tuple[int, int], dict] = {}

                def check(r: int, s: int, i: int, c: float | None) -> None:
                    if i not in masks:
                        masks[i] = _masks(items[i])
                    match = _verify(h[first[r]:first[r + 1]], s, items[i], masks[i], c)
                    if match and match["overlap"] > best.get((r, i), {"overlap": 0.0})["overlap"]:
                        best[r, i] = match

                place, term = _known_words(h, weights.vocabulary, known)
                for owner, start, item, cosine in _windows(h, first, place, term, weights, groups):
                    for candidate in zip(owner.tolist(), start.tolist(), item.tolist(), cosine.tolist()):
                        check(*candidate)
                for r, s, i in _copies(h, first, place, term, runs):
                    if best.get((r, i), {"overlap": 0.0})["overlap"] < 1.0:
                        check(r, s, i, None)
                for (r, i), match in sorted(best.items()):
                    found[lo + r].append(match)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, kind)], ["key", "matches"])

    return rows.select("key", "text").mapInArrow(run, f"key {key.simpleString()}, matches array<struct<{MATCH.replace(' ', ':').replace(',:', ',')}>>")


def _masks(item: Item) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(item.words.tolist()):
        out[w] = out.get(w, 0) | (1 << i)
    return out


def _verify(text: np.ndarray, start: int, item: Item, masks: dict[int, int], cosine: float | None) -> dict | None:
    """The match of an item near a window, or None."""
    m = len(item.words)
    near = text[max(0, start - m):start + 2 * STEP + m]
    share = lcs(masks, m, near.tolist()) / m
    if share < LIKE:
        return None
    answer = _contains(near, item.answer)
    leak = _contains(near, item.words) if m < SHORT else share >= SAME or answer
    return {"item_id": item.item_id, "overlap": share, "cosine": None if cosine is None else min(1.0, cosine), "answer": answer, "start_word": max(0, start - m)} if leak else None


def _passes(benchmark: DataFrame) -> Iterator[list[Item]]:
    """Blocks of at most about ITEMS_PER_PASS items, by hash."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).where("text is not null")
    blocks = max(1, math.ceil(rows.count() / ITEMS_PER_PASS))
    for b in range(blocks):
        items = parse_items(rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect())
        if items:
            yield items


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per (document, item it leaks): doc_id, item_id, overlap, cosine (NULL if only the word-for-word lookup
    found it), answer, start_word."""
    texts = docs.select(docs["`doc_id`"].alias("key"), F.lower(F.coalesce(docs["`text`"], F.lit(""))).alias("text"))
    out = None
    for items in _passes(benchmark):
        found = _search(texts, items, *_models(texts, items))
        found = found.select(F.col("key").alias("doc_id"), F.explode("matches").alias("m")).select("doc_id", "m.*")
        out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MATCH}")
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item."""
    out = docs
    for items in _passes(benchmark):
        rows = packed(out, text=F.lower(F.coalesce(out["`text`"], F.lit("")))).withColumnRenamed("row", "key")
        found = _search(rows, items, *_models(rows.select("text"), items))
        out = found.where(F.size("matches") == 0).select("key.*")
    return out
