"""Embeddings as exact integers: floor(256 c) of every component, packed rows, exact products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SCALE = 256.0
LIMB = 20                       # bits; 2^40 x 2^12 rows stays below 2^53
LIMB_ROWS = 1 << 12
_KINDS = (np.int8, np.int16, np.int32, np.int64)


def vectors_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(valid, width, values) of a list column: a row is valid if it is not NULL or empty and all entries are finite numbers whose
    floor(256 c) fits a long. ``values`` holds the entries of the valid rows one after the other, as longs."""
    n = len(column)
    column = column.cast(pa.large_list(pa.float64()))
    width = np.diff(column.offsets.to_numpy())
    flat = column.flatten() if not column.null_count else pa.concat_arrays([column.values.slice(column.offsets[0].as_py(), int(width.sum()))])
    entries = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(entries * SCALE)
    good = np.isfinite(x) & (np.abs(x) < 2.0 ** 63)
    if flat.null_count:
        good &= ~np.asarray(flat.is_null())
    row = np.repeat(np.arange(n), width)
    valid = (width > 0) & (np.bincount(row[~good], minlength=n) == 0)
    if column.null_count:
        valid &= ~np.asarray(column.is_null())
    return valid, width, x[valid[row]].astype(np.int64)


def _kind(top: int) -> type:
    return next(k for k in _KINDS if top <= np.iinfo(k).max)


def pack_rows(x: np.ndarray) -> list[bytes]:
    """Every row in the smallest integer type that holds it, after one byte for the type: equal rows give equal bytes."""
    top = np.maximum(x.max(axis=1), -(x.min(axis=1) + 1)) if len(x) else np.zeros(0, np.int64)
    out = np.empty(len(x), object)
    low = -1
    for code, kind in enumerate(_KINDS):
        high = np.iinfo(kind).max
        at = np.flatnonzero((top > low) & (top <= high))
        low = high
        raw = x[at].astype(kind).tobytes()
        size = x.shape[1] * np.dtype(kind).itemsize
        for i, r in enumerate(at):
            out[r] = bytes([code]) + raw[i * size:(i + 1) * size]
    return out.tolist()


def unpack_rows(rows: list[bytes], width: int) -> np.ndarray:
    """Inverse of :func:`pack_rows`."""
    out = np.empty((len(rows), width), np.int64)
    by: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by.setdefault(r[0], []).append(i)
    for code, at in by.items():
        out[at] = np.frombuffer(b"".join(rows[i][1:] for i in at), _KINDS[code]).reshape(len(at), width)
    return out


def pack_block(x: np.ndarray) -> bytes:
    """A matrix in the smallest integer type that holds it, after one byte for the type."""
    kind = _kind(max(int(x.max()), -int(x.min()) - 1)) if x.size else np.int8
    return bytes([_KINDS.index(kind)]) + x.astype(kind).tobytes()


def unpack_block(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, _KINDS[blob[0]], offset=1).reshape(-1, width).astype(np.int64)


def exact_gram(x: np.ndarray) -> np.ndarray:
    """x^T x as Python integers, exact at any magnitude: in doubles where they are exact, else in limbs."""
    width = x.shape[1]
    total = np.zeros((width, width), object)
    if not len(x):
        return total
    top = max(abs(int(x.max())), abs(int(x.min())))
    if top * top * len(x) < 1 << 53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    for lo in range(0, len(x), LIMB_ROWS):
        rest, limbs = x[lo:lo + LIMB_ROWS], []
        while True:
            if rest.min() >= -(1 << LIMB) and rest.max() < 1 << LIMB:
                limbs.append(rest.astype(np.float64))
                break
            limbs.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
            rest = rest >> LIMB
        for a, p in enumerate(limbs):
            for b, q in enumerate(limbs):
                total = total + (p.T @ q).astype(np.int64).astype(object) * (1 << (LIMB * (a + b)))
    return total


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b^T as longs, exact; an inner product that might not fit a long is an error."""
    top = lambda x: max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    bound = top(a) * top(b) * max(1, a.shape[1])
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    raise OverflowError("inner products of these vectors do not fit a long")
