"""Operator 6: language identification as mixture inference.

Model: for every language a conditional byte-trigram model of words (hashed trigram counts over context counts,
additive smoothing), learned from all labelled training rows. Tasks count in numpy and return only their non-zero
counts; the sums come from one partial aggregate, and at most languages x 81,920 counts reach the driver
(``MOST_LANGUAGES`` bounds it; more is an error).

Inference, per whole text: each word has a likelihood under every language. Expectation-maximisation estimates the
document's language proportions (words are drawn from the mixture), until none moves by a thousandth; the languages, ordered by proportion, give
nested sets, each fitted again, and the set with the best likelihood less half a log(words) per extra language is
selected. The prediction is the largest proportion in it, the score that proportion. A flat background takes
part as one more component, so that ``other`` says how much of the text no language explains.

Edge cases: NULL text, or a text without any letter, is ``und`` with score 0 (also when nothing could be learned);
rows with NULL lang teach nothing; a NULL doc_id counts as the empty string in the split; ties go to the first
language in code point order; repeated rows are predicted alike; an empty table gives no rows; other columns are
ignored by ``identify`` and carried whole by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import packed, utf8_chunks

UNKNOWN = "und"
MOST_LANGUAGES = 256
GRAMS, CONTEXTS = 1 << 16, 1 << 14
SMOOTH = 0.05
SYMBOLS = 60.0
BACKGROUND = np.log(1.0 / SYMBOLS)
TOLERANCE, MOST_ROUNDS = 1e-3, 10_000


def _classes() -> np.ndarray:
    """Byte to symbol: 0 for ASCII other than letters, 1-26 for letters, 27-127 for bytes of other characters."""
    out = np.zeros(256, np.uint32)
    for b in range(256):
        if ord("a") <= (b | 32) <= ord("z") and b < 128:
            out[b] = (b | 32) - ord("a") + 1
        elif b >= 128:
            out[b] = 27 + (b - 128) % 101
    return out


_CLASS = _classes()


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashed trigram, context, index of each word's first gram) of the words in ``data``; a word ends
    with a gram that holds the symbol after it. Rows must end in white space."""
    c = _CLASS[data]
    before = np.concatenate([[0], c[:-1]]).astype(np.uint32)
    second = np.concatenate([[0, 0], c[:-2]])[:len(c)].astype(np.uint32)
    second[before == 0] = 0
    at = np.flatnonzero((c != 0) | (before != 0))
    c, before, second = c[at], before[at], second[at]
    context = (second << np.uint32(7)) | before
    tri = (((context << np.uint32(7)) | c) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return at, tri, context, np.flatnonzero(before == 0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): non-zero counts of a task; contexts follow the grams."""
    names: dict[str, int] = {}
    total = np.zeros((0, GRAMS + CONTEXTS), np.int64)
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for name in set(langs) - names.keys():
            names[name] = len(names)
        if len(names) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        total = np.vstack([total, np.zeros((len(names) - len(total), GRAMS + CONTEXTS), np.int64)])
        which = np.array([names[x] for x in langs], np.int64)
        for lo, n, data, offs in utf8_chunks(batch.column("text")):
            at, tri, context, _ = _grams(data)
            row = which[lo + np.searchsorted(offs, at, side="right") - 1] * (GRAMS + CONTEXTS)
            total += np.bincount(row + tri, minlength=total.size).reshape(total.shape)
            total += np.bincount(row + GRAMS + context, minlength=total.size).reshape(total.shape)
    for name, i in names.items():
        hit = np.flatnonzero(total[i])
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(total[i][hit])],
                                         ["lang", "gram", "n"])


def _terminated(text: Column) -> Column:
    return F.concat(F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log trigram terms, log context terms) from rows (text, lang), lang not NULL."""
    rows = labelled.select(F.col("lang"), _terminated(F.col("text")).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counts.toPandas()
    langs = sorted(got["lang"].unique(), key=lambda x: x.encode())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.zeros((len(langs), GRAMS + CONTEXTS))
    table[got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64), got["gram"].to_numpy(np.int64)] = got["n"].to_numpy()
    return langs, np.log(table[:, :GRAMS] + SMOOTH), np.log(table[:, GRAMS:] + SMOOTH * SYMBOLS)


def _fit(share: np.ndarray, like: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for all rows of a chunk until no share of a row moves by ``TOLERANCE``; rows that have settled take no further part. Zero
    shares stay zero. Returns (shares, log likelihood per row)."""
    share = share.copy()
    words = np.diff(np.append(first, len(row)))
    open_, part_like, part_row, part_first = np.arange(len(share)), like, row, first
    live = np.ones(len(share), bool)
    for _ in range(MOST_ROUNDS):
        part = part_like * share[open_][part_row]
        part /= part.sum(axis=1, keepdims=True)
        new = np.add.reduceat(part, part_first, axis=0) / words[open_][:, None]
        moved = np.abs(new - share[open_]).max(axis=1)
        share[open_[live]] = new[live]                              # settled rows stay: a row does not depend on its chunk
        live &= moved >= TOLERANCE
        if not live.any():
            break
        if live.mean() < 0.7:                                       # go on with the rows that still move
            keep = live[part_row]
            open_, part_like = open_[live], part_like[keep]
            part_row = (np.cumsum(live) - 1)[part_row[keep]]
            part_first = np.searchsorted(part_row, np.arange(len(open_)))
            live = np.ones(len(open_), bool)
    return share, np.add.reduceat(np.log((like * share[row]).sum(axis=1)), first)


def _mixture(like: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Selected proportions (rows x components) of rows that all have words; ``row`` is sorted."""
    first = np.searchsorted(row, np.arange(rows))
    words = np.diff(np.append(first, len(row)))
    width = like.shape[1]
    share, best_ll = _fit(np.full((rows, width), 1.0 / width), like, row, first)
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(width)[None, :], axis=1)
    best, best_score = share, best_ll - 0.5 * np.log(words + 1.0) * (width - 1)
    for size in range(width - 1, 0, -1):
        start = np.where(rank < size, share + 1e-9, 0.0)
        start /= start.sum(axis=1, keepdims=True)
        fitted, ll = _fit(start, like, row, first)
        score = ll - 0.5 * np.log(words + 1.0) * (size - 1)
        better = score >= best_score
        best = np.where(better[:, None], fitted, best)
        best_score = np.where(better, score, best_score)
    return best


def _word_likelihoods(data: np.ndarray, grams: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words x (languages + 1) likelihoods scaled to a maximum of 1, byte position of each word)."""
    at, tri, context, first = _grams(data)
    out = np.empty((len(first), len(grams) + 1))
    for i in range(len(grams)):
        out[:, i] = np.add.reduceat(grams[i][tri] - contexts[i][context], first)
    out[:, -1] = np.diff(np.append(first, len(at))) * BACKGROUND
    out -= out.max(axis=1, keepdims=True)
    return np.exp(np.maximum(out, -60.0)), at[first]


def predict(rows: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """rows (key, text) to (key, lang_pred, score, other); the key comes back as it is."""
    langs, grams, contexts = model
    shared = rows.sparkSession.sparkContext.broadcast((langs, grams, contexts))  # at most MOST_LANGUAGES x 81,920 doubles
    key = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, grams, contexts = shared.value
        names = np.array([*langs, UNKNOWN], dtype=object)
        for batch in batches:
            lettered = np.array(batch.column("lettered").to_pylist(), dtype=bool)
            for lo, n, data, offs in utf8_chunks(batch.column("text")):
                pred, score, other = np.full(n, len(langs)), np.zeros(n), np.zeros(n)
                if langs and len(data):
                    like, at = _word_likelihoods(data, grams, contexts)
                    row = np.searchsorted(offs, at, side="right") - 1
                    ok = np.flatnonzero(lettered[lo:lo + n] & (np.bincount(row, minlength=n) > 0))
                    if len(ok):
                        dense = np.full(n, -1)
                        dense[ok] = np.arange(len(ok))
                        use = dense[row] >= 0
                        share = _mixture(like[use], dense[row[use]], len(ok))
                        pred[ok] = np.argmax(share[:, :-1], axis=1)
                        score[ok], other[ok] = share[:, :-1].max(axis=1), share[:, -1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(lo, n), pa.array(names[pred].tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(np.clip(other, 0, 1))],
                    ["key", "lang_pred", "score", "other"])

    texts = rows.select("key", _terminated(F.col("text")).alias("text"),
                        F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)).alias("lettered"))
    return texts.mapInArrow(run, f"key {key}, lang_pred string, score double, other double")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(3)) == 1


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The model of the labelled rows outside the held-out fold."""
    rows = docs.select(docs["`doc_id`"].alias("doc_id"), docs["`text`"].alias("text"), docs["`lang`"].alias("lang"))
    return learn(rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, other for every row of ``docs``."""
    out = predict(docs.select(F.col("doc_id").alias("key"), "text"), learned(docs))
    return out.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "lang_pred", "score", "other")


def keep_identified(docs: DataFrame, most_other: float = 0.9) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known and explains at least a tenth of their words."""
    rows = packed(docs, text=docs["`text`"])
    out = predict(rows.select(F.col("row").alias("key"), "text"), learned(docs))
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("other") < most_other)).select("key.*")
