"""Operator 12: whitening by the exact characteristic polynomial of the integer scatter matrix.

Each entry c becomes x = floor(256 c). The fit list is every distinct x vector once; with n vectors, sums S and products M the
scatter A = n M - S S^T is an integer matrix, n^2 times the covariance. M and S are exact sums of per-task products.

The characteristic polynomial of A is computed modulo enough primes below 2^31 (Hessenberg reduction and the recurrence
over its leading blocks; the primes are rows of a Spark table, many to a task) and put together by Chinese remaindering.
A is positive semi-definite, so the polynomial has real roots only, and the sign changes of its Taylor shift by a count the
roots above a exactly, with multiplicity: bisection isolates the leading roots, and bisection on the sign refines them to
``BITS`` bits below the trace. Components are null-space vectors of A - e I by inverse iteration in integer arithmetic of that precision,
checked by their residual; equal roots give an orthonormal set. The driver holds only matrices of the size of the dimension.

Edge cases: rows whose vector is NULL, empty, or holds a NULL, a non-finite entry or one too large for a long drop out, as do those of
another length than the most frequent one (the longer of two equally frequent); a NULL vec_id is kept; repeated rows are whitened
alike and count once in the fit list; components whose eigenvalue is 0 are left out, so a table of one distinct vector, like an empty one,
gives no rows; other columns are ignored. Component signs: the largest entry (the first of equals) is positive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm.common import written
from cadence.llm.int_vectors import exact_gram, pack_rows, unpack_rows, vectors_of

COMPONENTS = 4
BITS = 192
PRIME_TOP = 1 << 31
BATCH_ENTRIES = 1 << 22         # matrix entries per batch of primes


@dataclass(frozen=True)
class Whitener:
    n: int
    sums: list[int]
    components: np.ndarray      # (k, width), unit rows
    eigenvalues: np.ndarray     # of the covariance, falling
    explained: np.ndarray


# ---- exact polynomial -------------------------------------------------------------------------------


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all n below 3.2e9."""
    if n % 2 == 0:
        return n == 2
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        if a % n == 0:
            continue
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_below(top: int, product_bits: int) -> list[int]:
    """Largest primes below ``top`` whose product has more than ``product_bits`` bits."""
    out, bits, p = [], 0.0, top - 1
    while bits <= product_bits + 1:
        if _is_prime(p):
            out.append(p)
            bits += math.log2(p)
        p -= 1
    return out


def charpoly_mod(a: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Characteristic polynomials of ``a`` (Python integers) modulo every prime: (primes, width + 1), highest power first."""
    width, p = len(a), primes.astype(np.int64)
    h = np.stack([(a % int(q)).astype(np.int64) for q in p])
    p3, p2 = p[:, None, None], p[:, None]
    every = np.arange(len(p))
    for m in range(1, width - 1):
        found = h[:, m:, m - 1] != 0
        i = np.argmax(found, axis=1) + m
        has = found.any(axis=1)
        i = np.where(has, i, m)
        h[every, m], h[every, i] = h[every, i].copy(), h[every, m].copy()
        h[every, :, m], h[every, :, i] = h[every, :, i].copy(), h[every, :, m].copy()
        inverse = np.array([pow(int(x), -1, int(q)) if ok else 0 for x, q, ok in zip(h[:, m, m - 1], p, has)], np.int64)
        u = h[:, m + 1:, m - 1] * inverse[:, None] % p2
        h[:, m + 1:, :] = (h[:, m + 1:, :] - u[:, :, None] * h[:, m:m + 1, :] % p3) % p3
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1:] * u[:, None, :] % p3).sum(axis=2)) % p2
    poly = np.zeros((width + 1, len(p), width + 1), np.int64)      # leading block, prime, power
    poly[0, :, 0] = 1
    for m in range(1, width + 1):
        new = np.zeros((len(p), width + 1), np.int64)
        new[:, 1:] = poly[m - 1, :, :-1]
        new = (new - h[:, m - 1, m - 1][:, None] * poly[m - 1] % p2) % p2
        chain = np.ones(len(p), np.int64)
        for i in range(1, m):
            chain = chain * h[:, m - i, m - i - 1] % p
            new = (new - (chain * h[:, m - i - 1, m - 1] % p)[:, None] * poly[m - i - 1] % p2) % p2
        poly[m] = new
    return poly[width][:, ::-1]


def symmetric_functions(spark: SparkSession, a: np.ndarray) -> list[int]:
    """e_0 to e_width of the roots, exact; the power of the variable at e_k is width - k, its sign (-1)^k.

    For a positive semi-definite matrix 0 <= e_k <= C(width, k) (trace / width)^k (Maclaurin), which sets the number of primes."""
    width = len(a)
    trace = int(sum(a[i, i] for i in range(width)))
    bound = max(math.comb(width, k) * trace ** k // width ** k for k in range(width + 1)) + 1
    primes = primes_below(PRIME_TOP, bound.bit_length() + 1)
    per = max(1, BATCH_ENTRIES // (width * width))
    tasks = max(1, min(-(-len(primes) // 4), spark.sparkContext.defaultParallelism))
    matrix = a.tolist()                                            # width x width, whatever the rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.array(matrix, object)
        for b in batches:
            for lo in range(0, len(b), per):
                q = b["p"].to_numpy()[lo:lo + per]
                yield pd.DataFrame({"p": q, "c": charpoly_mod(own, q).tolist()})

    rows = spark.createDataFrame(pd.DataFrame({"p": primes}), "p long").repartition(tasks, "p").mapInPandas(run, "p long, c array<long>").collect()
    product = math.prod(r["p"] for r in rows)
    out = [0] * (width + 1)
    for r in rows:
        rest = product // r["p"]
        unit = rest * pow(rest, -1, r["p"])
        for k, c in enumerate(r["c"]):
            out[k] += (c if k % 2 == 0 else -c) % r["p"] * unit
    out = [x % product for x in out]
    squares = int((a * a).sum())                                   # trace of a^2, as a is symmetric
    if out[0] != 1 or out[1] != trace or (width > 1 and 2 * out[2] != trace * trace - squares) or max(out) > bound:
        raise ArithmeticError("the remainders do not give the matrix's characteristic polynomial")
    return out


# ---- roots ------------------------------------------------------------------------------------------


def _shifted_changes(coefs: list[int], a: int) -> int:
    """Sign changes of the coefficients of q(y + a): for a polynomial with real roots only, its roots above a."""
    c = list(coefs)
    for end in range(len(c) - 1, 0, -1):
        for i in range(1, end + 1):
            c[i] += a * c[i - 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _value(coefs: list[int], a: int) -> int:
    out = 0
    for c in coefs:
        out = out * a + c
    return out


def leading_roots(e: list[int], count: int, bits: int = BITS) -> tuple[list[int], int]:
    """(the ``count`` largest roots times 2^shift, rounded up; shift); roots repeat with their multiplicity."""
    shift = max(0, bits - e[1].bit_length())
    coefs = [(x << (shift * k)) * (-1) ** k for k, x in enumerate(e)]
    out: list[int] = []
    while len(out) < count:
        k = len(out) + 1
        lo, hi, above_lo, above_hi = -1, e[1] << shift, len(e) - 1, 0
        while hi - lo > 1 and above_lo - above_hi > 1:
            mid = (lo + hi) // 2
            above = _shifted_changes(coefs, mid)
            lo, hi, above_lo, above_hi = (mid, hi, above, above_hi) if above >= k else (lo, mid, above_lo, above)
        if above_lo - above_hi == 1 and hi - lo > 1:
            up = _value(coefs, hi) or _value(coefs, hi + 1)
            while hi - lo > 1:
                mid = (lo + hi) // 2
                v = _value(coefs, mid)
                if v == 0:
                    lo, hi = mid - 1, mid
                    break
                lo, hi = (lo, mid) if (v > 0) == (up > 0) else (mid, hi)
        out += [hi] * min(above_lo - above_hi, count - len(out))
    return out, shift


# ---- null space -------------------------------------------------------------------------------------


def _null_vectors(b: np.ndarray, count: int, bits: int = BITS) -> list[np.ndarray]:
    """``count`` orthogonal vectors (integers, largest entry 2^bits) that the nearly singular integer matrix ``b`` sends next to 0."""
    width, one = len(b), 1 << bits
    lu, steps = b.copy(), []
    for k in range(width):                                          # elimination with partial pivots, factors in fixed point
        i = max(range(k, width), key=lambda r: abs(lu[r, k]))
        lu[[k, i]] = lu[[i, k]]
        if lu[k, k] == 0:
            lu[k, k] = 1
        f = lu[k + 1:, k] * one // lu[k, k]
        lu[k + 1:, k + 1:] = lu[k + 1:, k + 1:] - f[:, None] * lu[k, k + 1:][None, :] // one
        steps.append((i, f))
    found: list[np.ndarray] = []
    for c in range(count):
        v = np.array([one - one * ((i + 1) * (c + 2) * 2654435761 % 1009) // 505 for i in range(width)], object)
        for _ in range(4):
            y = v.copy()
            for k, (i, f) in enumerate(steps):
                y[[k, i]] = y[[i, k]]
                y[k + 1:] = y[k + 1:] - f * y[k] // one
            x = np.zeros(width, object)
            for k in range(width - 1, -1, -1):
                x[k] = (int(y[k]) * one - int((lu[k, k + 1:] * x[k + 1:]).sum())) // int(lu[k, k])
            for w in found:
                x = x - w * int((x * w).sum()) // int((w * w).sum())
            top = max(abs(int(t)) for t in x)
            v = np.array([int(t) * one // top for t in x], object)
        found.append(v)
    return found


def leading_components(a: np.ndarray, roots: list[int], shift: int) -> np.ndarray:
    """Unit eigenvectors of the integer matrix ``a`` for its leading positive roots."""
    out, width = [], len(a)
    for value in dict.fromkeys(roots):
        b = a * (1 << shift)
        for i in range(width):
            b[i, i] -= value
        for v in _null_vectors(b, roots.count(value)):
            residual = max(abs(int(x)) for x in b.dot(v))
            if residual > value * int(max(abs(v))) >> 60:
                raise ArithmeticError("inverse iteration did not reach the null space")
            length = math.isqrt(int((v * v).sum()))
            unit = np.array([float(Fraction(int(x), length)) for x in v])
            out.append(unit * np.sign(unit[np.argmax(np.abs(unit))]))
    return np.array(out).reshape(-1, width)


# ---- Spark side -------------------------------------------------------------------------------------


def _integers(rows: DataFrame) -> DataFrame:
    """(vec_id, width, x): packed integer vectors of the valid rows."""
    key = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, width, flat = vectors_of(batch.column("embedding"))
            at, w = np.flatnonzero(valid), width[valid]
            begin = np.cumsum(w) - w
            for one in np.unique(w):
                own = np.flatnonzero(w == one)
                x = flat[begin[own][:, None] + np.arange(one)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at[own])), pa.array([int(one)] * len(own), pa.int32()), pa.array(pack_rows(x), pa.binary())],
                                                 ["vec_id", "width", "x"])

    return rows.mapInArrow(run, f"vec_id {key}, width int, x binary")


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S, M) of the packed rows, exact. Cell i * width + j holds M[i, j] (i <= j), the next cells S, the last n."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, m = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            x = unpack_rows(batch.column("x").to_pylist(), width)
            n += len(x)
            s = s + np.array([int(c) for c in x.astype(object).sum(axis=0)] if x.size and np.abs(x).max() > 2 ** 40 else x.sum(axis=0).tolist(), object)
            m = m + exact_gram(x)
        cells = [*(upper[0] * width + upper[1]).tolist(), *range(width * width, width * width + width), width * width + width]
        values = [*m[upper].tolist(), *s.tolist(), n]
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array([str(v) for v in values], pa.string())], ["cell", "v"])

    parts = fit.select("x").mapInArrow(run, "cell long, v string")
    got = {r["cell"]: int(r["v"]) for r in parts.groupBy("cell").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    m = np.zeros((width, width), object)
    for i, j in zip(*upper):
        m[i, j] = m[j, i] = got[int(i) * width + int(j)]
    return got[width * width + width], [got[width * width + i] for i in range(width)], m


def fit_whitener(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitener:
    """Whitener of the distinct packed rows ``fit``."""
    n, sums, m = _sums(fit, width)
    s = np.array(sums, object)
    a = m * n - s[:, None] * s[None, :]
    e = symmetric_functions(fit.sparkSession, a)
    positive = sum(1 for k in range(1, width + 1) if e[k])          # roots above 0: e_k vanishes from there on
    roots, shift = leading_roots(e, min(components, positive))
    vectors = leading_components(a, roots, shift)
    return Whitener(n, sums, vectors, np.array([float(Fraction(r, n * n << shift)) for r in roots]),
                    np.array([float(Fraction(r, e[1] << shift)) for r in roots]))


def _centred(x: np.ndarray, w: Whitener) -> tuple[np.ndarray, np.ndarray]:
    """(x - S/n as doubles rounded once, exact sum of (n x - S)^2 as Python integers)."""
    top = max(abs(int(x.max())), abs(int(x.min()))) * w.n + max(abs(s) for s in w.sums)
    if top * top * x.shape[1] < 1 << 63:
        d = x * w.n - np.array(w.sums, np.int64)
        return d / float(w.n), (d * d).sum(axis=1).astype(object)
    d = x.astype(object) * w.n - np.array(w.sums, object)
    return (d / w.n).astype(np.float64), (d * d).sum(axis=1)


def _whitened(w: Whitener, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d, deviation = _centred(x, w)
    return d @ w.components.T / np.sqrt(w.eigenvalues), deviation


def _identity_error(fit: DataFrame, width: int, w: Whitener) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, from per-task sums."""
    k = len(w.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            y = _whitened(w, unpack_rows(batch.column("x").to_pylist(), width))[0]
            y = np.column_stack([y, np.ones(len(y))])
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange((k + 1) ** 2)), pa.array(total.reshape(-1))], ["cell", "v"])

    parts = fit.select("x").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    t = np.zeros((k + 1) ** 2)
    for r in parts:
        t[r["cell"]] = r["v"]
    t = t.reshape(k + 1, k + 1) / w.n
    return float(np.abs(t[:k, :k] - np.outer(t[k, :k], t[k, :k]) - np.eye(k)).max())


SCHEMA = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (a whole decimal), whitened, explained, identity_error for every valid row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    key = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {key}, {SCHEMA}"
    rows = written(_integers(vectors.select(vectors["`vec_id`"].alias("vec_id"), vectors["`embedding`"].alias("embedding"))), "whitening-rows", "zstd")
    widths = rows.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not widths:
        return spark.createDataFrame([], schema)
    width = widths[0]["width"]
    rows = rows.where(F.col("width") == width)
    fit = written(rows.select("x").distinct(), "whitening-fit", "zstd")
    w = fit_whitener(fit, width, components)
    k = len(w.components)
    if k == 0:
        return spark.createDataFrame([], schema)
    error = _identity_error(fit, width, w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            x = unpack_rows(batch.column("x").to_pylist(), width)
            if not len(x):
                continue
            y, deviation = _whitened(w, x)
            n = len(x) * k
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(n, w.n, np.int64)),
                 pa.array([Decimal(int(v)) for v in np.repeat(deviation, k)], pa.decimal128(38, 0)), pa.array(y.reshape(-1)), pa.array(np.tile(w.explained, len(x))), pa.array(np.full(n, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, schema)
