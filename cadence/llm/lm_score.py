"""Operator 11: language-model scores by deleted interpolation of n-gram maximum-likelihood estimates.

Model of order n: P_j(w | h) = l_j(b) c(h w) / c(h) + (1 - l_j(b)) P_{j-1}(w | shorter h), down to the unigram estimate
and the uniform 1 / (V + 1). b is the bucket of the context's frequency, its number of binary digits, so buckets
have no upper end. The weights come from expectation-maximisation on held-out counts: the training documents are
dealt into two folds, and every token of one fold is an event under the counts of the other (the counts that are left
when its own fold is deleted). The final estimates use the counts of both folds.

Plan. Documents are packed into chunks of about 8 MB of text (one row each, written once). A chunk sends its distinct
n-gram hashes with their counts per fold, sorted and cut by hash range into slots: one row per (order, slot, chunk), so what
is shuffled is linear in the distinct n-grams of a chunk and no n-gram, however frequent, is more than one entry a
chunk. A slot sums the counts and answers every chunk in the chunk's own order. Chunk and answers then meet once for the held-out
events, which become a histogram over (bucket, estimates in half-octave steps) with the exact mean logarithms per cell, and
once for the scores. The driver sees that histogram, whose size is bounded by its steps, and three totals. The number of
slots grows with the input, so that a slot holds about a million entries at every size.

Hashes have 64 bits for words and 56 for longer n-grams; two n-grams of one hash would share their counts.

Edge cases: NULL text is the empty text, which has one token, the end; a NULL doc_id counts as the empty string in the split;
repeated rows are scored alike and all count; a context never seen in training leaves the shorter ones; without training rows
every score is 0 (V = 0, so the one unknown word has probability 1); an empty table gives no rows; a text longer than a chunk is a
chunk of its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import CHUNK_BYTES, mix64, utf8_chunks, words_of, written
from cadence.session import shuffle_partitions

ORDER = 2
MOST_ORDER = 5                  # cells of the held-out histogram pack (bucket, step) pairs into 64 bits
CHUNK_TEXT = 8_000_000
SLOT_TEXT = 6_000_000           # bytes of text per slot: about a million tokens
LEAST_SLOTS = 64
STEPS = 2.0                     # cells per octave of an estimate
TOLERANCE, MOST_ROUNDS = 1e-6, 20_000
START, END = np.uint64(0x5EED0000000000A1), np.uint64(0x5EED0000000000E5)
NO_STEP = 255


@dataclass(frozen=True)
class Model:
    order: int
    tokens: int                 # N
    vocabulary: int             # V
    weights: np.ndarray         # (order, 65): l_j of bucket b at [j - 1, b]


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == 1


def _fold(doc_id: Column) -> Column:
    """0 held out, 1 and 2 the folds of the training documents."""
    crc = F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8"))
    return F.when(F.pmod(crc, F.lit(5)) == 1, F.lit(0)).otherwise(F.pmod(F.floor(crc / 5), F.lit(2)) + 1).cast("int")


# ---- chunks -----------------------------------------------------------------------------------------


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed byte planes (high bytes of small numbers cost nothing)."""
    return pa.compress(b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays),
                       codec="zstd", asbytes=True)


def _unzip(blob: bytes, n: int, *types: type) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize for t in types]
    raw = np.frombuffer(pa.decompress(blob, n * sum(sizes), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for t, size in zip(types, sizes):
        out.append(np.ascontiguousarray(raw[at:at + n * size].reshape(size, n).T).reshape(-1).view(t))
        at += n * size
    return out


def _chunked(docs: DataFrame) -> DataFrame:
    """One row per chunk: ids, folds and byte lengths of its documents, their lower-cased texts compressed."""
    key = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id"), _fold(F.col("doc_id")).alias("fold"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, folds, sizes, texts, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            data = b"".join(texts)
            one = lambda arrays, kind: pa.ListArray.from_arrays([0, sum(map(len, arrays))], pa.concat_arrays(arrays).cast(kind) if kind else pa.concat_arrays(arrays))
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | number], pa.int64()), one(ids, None), one(folds, pa.int32()), one(sizes, pa.int64()), pa.array([len(data)], pa.int64()),
                 pa.array([pa.compress(data, codec="zstd", asbytes=True)], pa.binary())], ["chunk", "ids", "folds", "sizes", "bytes", "texts"])

        for batch in batches:
            for lo, n, data, offs in utf8_chunks(batch.column("text"), CHUNK_TEXT):
                if held and held + len(data) > CHUNK_TEXT:
                    yield flush()
                    number, ids, folds, sizes, texts, held = number + 1, [], [], [], [], 0
                ids.append(batch.column("doc_id").slice(lo, n))
                folds.append(batch.column("fold").slice(lo, n))
                sizes.append(pa.array(np.diff(offs)))
                texts.append(np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8).tobytes())
                held += len(data)
        if ids:
            yield flush()

    schema = f"chunk long, ids array<{key}>, folds array<int>, sizes array<long>, bytes long, texts binary"
    return written(rows.mapInArrow(run, schema), "lm-chunks", "uncompressed")


def _tokens(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, document of each): every document is a start mark, its words and the end."""
    offs = np.concatenate([[0], np.cumsum(sizes)])
    docs = len(sizes)
    hashes, words, lo = [], [], 0
    while lo < docs:                                    # whole documents, about CHUNK_BYTES of text at a time
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK_BYTES, side="right")) - 1)
        h, _, _, first = words_of(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
        hashes.append(h)
        words.append(np.diff(first))
        lo = hi
    words = np.concatenate(words)
    first = np.concatenate([[0], np.cumsum(words)])
    doc = np.repeat(np.arange(docs, dtype=np.int32), words + 2)
    begin = first[:-1] + 2 * np.arange(docs)
    tok = np.empty(len(doc), np.uint64)
    inner = np.ones(len(doc), bool)
    inner[begin] = inner[begin + words + 1] = False
    tok[inner], tok[begin], tok[begin + words + 1] = np.concatenate(hashes), START, END
    return tok, doc


def _keys(tok: np.ndarray, order: int) -> list[np.ndarray]:
    """n-gram hash ending at every token for orders 1 to ``order``; at a start mark it is the mark itself."""
    mark = tok == START
    out = [tok]
    for _ in range(1, order):
        k = np.empty_like(tok)
        k[1:] = mix64(out[-1][:-1] * np.uint64(0xD1342543DE82EF95) + tok[1:]) >> np.uint64(8)
        k[mark] = START >> np.uint64(8)
        out.append(k)
    return out


def _bits(order: int) -> int:
    return 64 if order == 1 else 56


def _one_chunk(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, document of each, fold of each document) of a chunk row."""
    data = np.frombuffer(pa.decompress(row["texts"], row["bytes"], codec="zstd", asbytes=True), np.uint8) if row["bytes"] else np.zeros(0, np.uint8)
    tok, doc = _tokens(data, np.asarray(row["sizes"], np.int64))
    return tok, doc, np.asarray(row["folds"], np.int64)


def _row(table: pa.Table | pa.RecordBatch, i: int) -> dict:
    """A chunk row without its ids; number lists as numpy arrays."""
    flat = lambda c: table.column(c)[i].values.to_numpy()
    return {"chunk": table.column("chunk")[i].as_py(), "folds": flat("folds"), "sizes": flat("sizes"),
            "bytes": table.column("bytes")[i].as_py(), "texts": table.column("texts")[i].as_buffer()}


# ---- counts -----------------------------------------------------------------------------------------


def _counts(order: int, slots: int):
    """Chunk rows to one row per (order, slot) with the sorted distinct hashes and their counts in either fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = _row(batch, i)
                tok, doc, folds = _one_chunk(row)
                fold = folds[doc]
                for j, keys in enumerate(_keys(tok, order), 1):
                    u, inv = np.unique(keys, return_inverse=True)
                    a, b = (np.bincount(inv[fold == f], minlength=len(u)).astype(np.uint32) for f in (1, 2))
                    ends = np.searchsorted(u, np.arange(1, slots, dtype=np.uint64) << np.uint64(_bits(j) - slots.bit_length() + 1))
                    cut = [0, *ends.tolist(), len(u)]
                    full = [s for s in range(slots) if cut[s] < cut[s + 1]]
                    blobs = [_zip(np.diff(u[cut[s]:cut[s + 1]], prepend=np.uint64(0)), a[cut[s]:cut[s + 1]], b[cut[s]:cut[s + 1]]) for s in full]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([j] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array([row["chunk"]] * len(full), pa.int64()),
                         pa.array([cut[s + 1] - cut[s] for s in full], pa.int32()), pa.array(blobs, pa.binary())], ["order", "slot", "chunk", "n", "blob"])
    return run


ANSWER = "chunk long, order int, slot int, n int, blob binary, vocabulary long, tokens_a long, tokens_b long"


def _answer(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
    """All chunks of one (order, slot): total counts of either fold, in each chunk's own order."""
    order, slot = rows[0][0], rows[0][1]
    parts = [_unzip(blob, n, np.uint64, np.uint32, np.uint32) for _, _, _, n, blob in rows]
    keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    u, inv = np.unique(keys, return_inverse=True)
    a, b = (np.bincount(inv, weights=np.concatenate([p[f] for p in parts]), minlength=len(u)).astype(np.int64) for f in (1, 2))
    totals = (0, 0, 0)
    if order == 1:
        real = u != START
        totals = (int(((a + b) > 0)[real].sum()), int(a[real].sum()), int(b[real].sum()))
    chunks, at, blobs = [], 0, []
    for _, _, chunk, n, _ in rows:
        own = inv[at:at + n]
        blobs.append(_zip(a[own], b[own]))
        chunks.append(chunk)
        at += n
    k = len(rows)
    first = lambda x: pa.array([x] + [0] * (k - 1), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(chunks, pa.int64()), pa.array([order] * k, pa.int32()), pa.array([slot] * k, pa.int32()), pa.array([r[3] for r in rows], pa.int32()),
         pa.array(blobs, pa.binary()), *map(first, totals)], [f.split()[0] for f in ANSWER.split(", ")])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (order, slot) to answers."""
    held: list[tuple] = []
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("order", "slot", "chunk", "n", "blob"))):
            if held and held[-1][:2] != r[:2]:
                yield _answer(held)
                held = []
            held.append(r)
    if held:
        yield _answer(held)


# ---- what a token sees ------------------------------------------------------------------------------


def _seen(row: dict, answers: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """(document, fold) of every predicted token, its n-gram's counts (fold 1, fold 2) per order, and its context's for
    orders 2 and up."""
    tok, doc, folds = _one_chunk(row)
    at = np.flatnonzero(tok != START)
    by = {}
    for o, s, n, blob in zip(*(answers.column(c).to_pylist() for c in ("order", "slot", "n", "blob"))):
        by.setdefault(o, []).append((s, n, blob))
    grams, contexts, last = [], [], None
    for j, keys in enumerate(_keys(tok, order), 1):
        _, inv = np.unique(keys, return_inverse=True)
        parts = [_unzip(blob, n, np.int64, np.int64) for _, n, blob in sorted(by[j], key=lambda x: x[0])]
        both = [np.concatenate([p[f] for p in parts])[inv] for f in (0, 1)]
        if last is not None:
            contexts.append((last[0][at - 1], last[1][at - 1]))
        grams.append((both[0][at], both[1][at]))
        last = both
    return doc[at], folds[doc[at]], grams, contexts


def _digits(count: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency: binary digits of the count."""
    return np.frexp(count.astype(np.float64))[1]


def _estimates(grams: list[np.ndarray], contexts: list[np.ndarray], tokens: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Maximum-likelihood estimates per order and the bucket of the context they rest on."""
    totals = [np.full(len(grams[0]), tokens), *contexts]
    return [np.divide(g, t, out=np.zeros(len(g)), where=t > 0) for g, t in zip(grams, totals)], [_digits(t) for t in totals]


def _histogram(order: int, tokens: tuple[int, int]):
    """Chunk and answers to held-out events: (cell, n, sum of ln p per order)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _, fold, grams, contexts = _seen(_row(left, 0), right, order)
        cells, logs = [], []
        for own, other in ((1, 1), (2, 0)):
            use = fold == own
            p, bucket = _estimates([g[other][use] for g in grams], [c[other][use] for c in contexts], tokens[other])
            cell = np.zeros(int(use.sum()), np.int64)
            ln = []
            for q, b in zip(p, bucket):
                x = np.log(q, out=np.zeros(len(q)), where=q > 0)
                step = np.where(q > 0, np.rint(x * (-STEPS / np.log(2))), NO_STEP).astype(np.int64)
                cell = (cell << 14) | (b.astype(np.int64) << 8) | np.minimum(step, NO_STEP)
                ln.append(x)
            cells.append(cell)
            logs.append(ln)
        cell = np.concatenate(cells)
        u, inv = np.unique(cell, return_inverse=True)
        return pa.table([pa.array(u), pa.array(np.bincount(inv, minlength=len(u)).astype(np.int64)),
                         *(pa.array(np.bincount(inv, weights=np.concatenate([x[j] for x in logs]), minlength=len(u)).astype(np.float64)) for j in range(order))],
                        names=["cell", "n", *(f"ln{j + 1}" for j in range(order))])
    return run


def learn_weights(cells: dict[str, np.ndarray], order: int, vocabulary: int) -> np.ndarray:
    """(order, 65) weights by expectation-maximisation over the cells of held-out events.

    Half an event more counts either way in each bucket, so that no weight reaches 0 or 1. A bucket without events takes
    the weight of the nearest one below it that has some (0 for an unseen context)."""
    n = cells["n"].astype(np.float64)
    bucket = [(cells["cell"] >> (14 * (order - 1 - j) + 8)) & 63 for j in range(order)]
    has = [((cells["cell"] >> (14 * (order - 1 - j))) & 255) != NO_STEP for j in range(order)]
    p = [np.where(has[j], np.exp(cells[f"ln{j + 1}"] / np.maximum(n, 1)), 0.0) for j in range(order)]
    weight = np.full((order, 65), 0.5)
    weight[:, 0] = 0.0
    for _ in range(MOST_ROUNDS):
        below = [np.full(len(n), 1.0 / (vocabulary + 1))]
        for j in range(order):
            w = weight[j][bucket[j]]
            below.append(w * p[j] + (1 - w) * below[-1])
        reach, new = np.ones(len(n)), weight.copy()
        for j in range(order - 1, -1, -1):                 # posterior of stopping at order j + 1, given that it was reached
            w = weight[j][bucket[j]]
            stop = reach * w * p[j] / below[j + 1]
            den = np.bincount(bucket[j], weights=n * reach, minlength=65)
            num = np.bincount(bucket[j], weights=n * stop, minlength=65)
            new[j] = np.where(den > 0, (num + 0.5) / (den + 1.0), weight[j])
            reach = reach - stop
        new[:, 0] = 0.0
        moved = np.abs(new - weight).max()
        weight = new
        if moved < TOLERANCE:
            break
    else:
        raise RuntimeError(f"interpolation weights still move by {moved:.1e} after {MOST_ROUNDS} rounds")
    for j in range(order):
        seen = np.bincount(bucket[j], weights=n, minlength=65) > 0
        seen[0] = True
        weight[j] = weight[j][np.maximum.accumulate(np.where(seen, np.arange(65), 0))]
        weight[j][0] = 0.0
    return weight


def _scores(model: Model):
    """Chunk and answers to one row per document."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, _, grams, contexts = _seen(_row(left, 0), right, model.order)
        docs = len(left.column("folds")[0])
        grams, contexts = [a + b for a, b in grams], [a + b for a, b in contexts]
        p, bucket = _estimates(grams, contexts, model.tokens)
        prob = np.full(len(doc), 1.0 / (model.vocabulary + 1))
        for j in range(model.order):
            w = model.weights[j][bucket[j]]
            prob = w * p[j] + (1 - w) * prob
        base = np.log10((grams[0] + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1)))
        per = lambda x=None: np.bincount(doc, weights=x, minlength=docs)
        folds = left.column("folds")[0].values
        return pa.table([left.column("ids")[0].values, pa.array(folds.to_numpy() == 0), pa.array(per().astype(np.int64)), pa.array(per(grams[0] > 0).astype(np.int64)),
                         pa.array(np.full(docs, model.tokens, np.int64)), pa.array(per(base)), pa.array(per(np.log10(prob)))],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


# ---- operator ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Counted:
    """Packed chunks of a corpus, the answers to them, and the training totals per fold."""

    chunks: DataFrame
    answers: DataFrame
    order: int
    tokens: tuple[int, int]
    vocabulary: int


def count_ngrams(docs: DataFrame, order: int = ORDER) -> Counted:
    """Pack ``docs`` and look up the training counts of all their n-grams."""
    if not 1 <= order <= MOST_ORDER:
        raise ValueError(f"order must be 1 to {MOST_ORDER}")
    chunks = _chunked(docs.select(docs["`doc_id`"].alias("doc_id"), docs["`text`"].alias("text")))
    size = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    slots = 1 << (max(LEAST_SLOTS, size // SLOT_TEXT) - 1).bit_length()
    parts = max(shuffle_partitions(docs.sparkSession), order * slots // 16)
    rows = chunks.mapInArrow(_counts(order, slots), "order int, slot int, chunk long, n int, blob binary")
    dealt = rows.repartition(parts, "order", "slot").sortWithinPartitions("order", "slot", "chunk")
    answers = written(dealt.mapInArrow(_answers, ANSWER), "lm-answers", "uncompressed")
    v, a, b = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("vocabulary", "tokens_a", "tokens_b")]).first()
    return Counted(chunks, answers, order, (a, b), v)


def _met(counted: Counted, fn, schema: str) -> DataFrame:
    answers = counted.answers.select("chunk", "order", "slot", "n", "blob")
    return counted.chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(fn, schema)


def fit(counted: Counted) -> Model:
    """Interpolation weights from the held-out events of the training folds."""
    logs = [f"ln{j + 1}" for j in range(counted.order)]
    rows = _met(counted, _histogram(counted.order, counted.tokens), "cell long, n long, " + ", ".join(f"{c} double" for c in logs))
    got = rows.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in logs]).toPandas()
    cells = {c: got[c].to_numpy() for c in got.columns}
    return Model(counted.order, sum(counted.tokens), counted.vocabulary, learn_weights(cells, counted.order, counted.vocabulary))


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    counted = count_ngrams(docs, order)
    key = docs.schema["doc_id"].dataType.simpleString()
    return _met(counted, _scores(fit(counted)), f"doc_id {key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
