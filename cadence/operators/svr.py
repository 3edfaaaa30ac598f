"""Support-vector regression on random Fourier features: the linear epsilon-insensitive loss, with a duality gap.

Minimise P(w, b) = 1/2 |w|^2 + C sum max(0, |y - w z - b| - epsilon). The corners of the loss are rounded over a width mu, which
leaves a smooth convex problem that Newton steps with a line search solve; mu shrinks by four whenever the gradient has. The slopes
of the rounded loss are, times C, dual variables in [-C, C]; scaling down the heavier sign makes their sum 0 and so feasible, and

    D = sum a y - epsilon sum |a| - 1/2 |sum a z|^2 <= min P.

P - D bounds how far the model is from the optimum, whatever mu was. A fold ends when its gap is at most ``tolerance`` times P.

One pass gives every fold's gradient, Hessian and both sides of the gap, a second the loss along the step for all trial lengths.
Rows are read as they are: a row counts in the folds that it trains, without a copy. Tasks send sums of (features + 1)^2 numbers per fold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cadence.operators.folds import FULL
from cadence.operators.gram import BLOCK, sum_vectors

STEPS = (1.0, 0.5, 0.25, 0.125, 1 / 16, 1 / 64, 1 / 256, 1 / 4096)
FIRST_WIDTH, SHRINK = 1.0, 4.0
LEAST_DAMPING, MOST_DAMPING = 1e-6, 10.0   # added to the Hessian, times C and the rows


ROWS = 1024  # rows whose features are made at a time: they stay in a core's cache
_SINE = [(-1) ** k * (2 * math.pi) ** (2 * k + 1) / math.factorial(2 * k + 1) for k in range(10)]   # of 2 pi s, for |s| <= 1/4


def cosine_of_turns(t: np.ndarray) -> np.ndarray:
    """cos(2 pi t) to double precision, in whole-array steps (many times faster than numpy's cosine of doubles); overwrites ``t``."""
    t -= np.rint(t)
    np.abs(t, out=t)
    np.subtract(0.25, t, out=t)
    u = t * t
    out = u * _SINE[-1]
    for c in _SINE[-2:0:-1]:
        out += c
        out *= u
    out += _SINE[0]
    out *= t
    return out


def fourier_features(x: np.ndarray, omega: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """sqrt(2 / D) cos(omega x + phase) and a constant."""
    width = omega.shape[0]
    turns, shift, scale = omega.T / (2 * math.pi), phase / (2 * math.pi), np.sqrt(2.0 / width)
    z = np.empty((x.shape[0], width + 1))
    for lo in range(0, x.shape[0], ROWS):
        t = x[lo:lo + ROWS] @ turns
        t += shift
        np.multiply(cosine_of_turns(t), scale, out=z[lo:lo + ROWS, :-1])
    z[:, -1] = 1.0
    return z


def _pass(rows: DataFrame, projections: dict, active: list[tuple], part: Callable, width: int) -> dict[tuple, np.ndarray]:
    """Sum over the training rows of every fold in ``active`` of ``part(fold, Z, y)``, a vector of ``width`` numbers."""
    blocks = -(-width // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = {rf: np.zeros(width) for rf in active}
        for b in batches:
            if not len(b):
                continue
            w = b.column("w").flatten().to_numpy().reshape(len(b), -1)
            folds = b.column("folds").flatten().to_numpy().reshape(len(b), -1)
            y = b.column("y").to_numpy()
            for rf in active:
                own = np.arange(len(b)) if rf[0] == FULL else np.flatnonzero(folds[:, rf[0]] != rf[1])
                B, omega, phase = projections[rf][:3]
                for lo in range(0, len(own), ROWS):
                    at = own[lo:lo + ROWS]
                    acc[rf] += part(rf, fourier_features(w[at] @ B.T, omega, phase), y[at])
        out = [(*rf, i, v[i * BLOCK:(i + 1) * BLOCK]) for rf, v in acc.items() for i in range(blocks)]
        yield pa.RecordBatch.from_arrays([*[pa.array([o[c] for o in out], pa.int64()) for c in (0, 1)], pa.array([o[2] for o in out], pa.int32()),
                                          pa.array([o[3] for o in out], pa.list_(pa.float64()))], ["repeat", "fold", "_block", "_v"])

    return sum_vectors(rows.mapInArrow(run, "repeat long, fold long, _block int, _v array<double>"), ["repeat", "fold"])


def rounded_loss(residual: np.ndarray, epsilon: float, mu: float) -> np.ndarray:
    a = np.maximum(np.abs(residual) - epsilon, 0.0)
    return np.where(a < mu, a * a / (2 * mu), a - mu / 2)


def fit_folds_svr(rows: DataFrame, projections: dict[tuple, tuple], C: float, epsilon: float, tolerance: float, max_passes: int) -> tuple[dict, dict]:
    """(theta per fold, (rows, primal, dual) per fold) from rows (folds, y, w); ``projections`` holds (B, omega, phase, first intercept)."""
    dim = next(iter(projections.values()))[1].shape[0] + 1
    theta = {rf: np.append(np.zeros(dim - 1), p[3]) for rf, p in projections.items()}
    mu = dict.fromkeys(theta, FIRST_WIDTH)
    active, gaps = list(theta), {}
    damping = dict.fromkeys(theta, 0.0)
    penal = np.append(np.ones(dim - 1), 0.0)
    for _ in range(max_passes // 2):
        now, widths = dict(theta), dict(mu)

        def local(rf: tuple, z: np.ndarray, y: np.ndarray, now=now, widths=widths) -> np.ndarray:
            r = y - z @ now[rf]
            excess = np.abs(r) - epsilon
            slope = np.clip(excess / widths[rf], 0.0, 1.0)
            plus, minus = np.where(r > 0, slope, 0.0), np.where(r < 0, slope, 0.0)
            bent = z[(excess > 0) & (excess < widths[rf])]
            return np.concatenate([(bent.T @ bent).reshape(-1), plus @ z, minus @ z,
                                   [plus @ y, minus @ y, np.maximum(excess, 0.0).sum(), len(y)]])

        sums = _pass(rows, projections, active, local, dim * dim + 2 * dim + 4)
        steps = {}
        for rf in list(active):
            v = sums[rf]
            H, up, down = v[:dim * dim].reshape(dim, dim), v[dim * dim:dim * dim + dim], v[dim * dim + dim:dim * dim + 2 * dim]
            up_y, down_y, hinge, n = v[-4:]
            w2 = 0.5 * float(theta[rf][:-1] @ theta[rf][:-1])
            primal = w2 + C * hinge
            # sums of the slopes of either sign are the last entries of up and down (the constant feature)
            total = min(up[-1], down[-1])
            f_up, f_down = (total / up[-1] if up[-1] > 0 else 0.0), (total / down[-1] if down[-1] > 0 else 0.0)
            az = C * (f_up * up - f_down * down)[:-1]
            dual = C * (f_up * up_y - f_down * down_y) - epsilon * 2 * C * total - 0.5 * float(az @ az)
            if rf not in gaps or primal - dual < gaps[rf][1] - gaps[rf][2]:
                gaps[rf] = (int(n), primal, dual)
            if primal - dual <= tolerance * primal:
                gaps[rf] = (int(n), primal, dual)
                active.remove(rf)
                continue
            g = penal * theta[rf] - C * (up - down)
            if np.abs(g).max() <= 1e-3 * tolerance * C * n:              # solved at this width
                mu[rf] /= SHRINK
                steps[rf] = np.zeros(dim)
                continue
            hessian = np.diag(penal) + (C / widths[rf]) * H
            hessian[np.arange(dim), np.arange(dim)] += damping[rf] * C * n
            hessian[-1, -1] += 1e-9 * C * n
            steps[rf] = np.linalg.solve(hessian, -g)
        if not active:
            return theta, gaps
        moving = [rf for rf in active if steps[rf].any()]
        if moving:
            def along(rf: tuple, z: np.ndarray, y: np.ndarray, now=now, widths=widths, steps=steps) -> np.ndarray:
                r, d = y - z @ now[rf], z @ steps[rf]
                return np.array([rounded_loss(r - t * d, epsilon, widths[rf]).sum() for t in (0.0, *STEPS)])

            losses = _pass(rows, projections, moving, along, 1 + len(STEPS))
            for rf in moving:
                at = [theta[rf] + t * steps[rf] for t in (0.0, *STEPS)]
                values = [0.5 * float(p[:-1] @ p[:-1]) + C * x for p, x in zip(at, losses[rf])]
                best = int(np.argmin(values))
                if best == 0:                                            # too long a step: the loss bends inside it
                    damping[rf] = max(10 * damping[rf], LEAST_DAMPING)
                    if damping[rf] > MOST_DAMPING:                       # no way down left: solved at this width
                        mu[rf], damping[rf] = mu[rf] / SHRINK, 0.0
                    continue
                damping[rf] = damping[rf] / 10 if damping[rf] > LEAST_DAMPING else 0.0
                if values[0] - values[best] <= 1e-3 * tolerance * abs(values[0]):
                    mu[rf] /= SHRINK                                     # as good as solved at this width
                theta[rf] = at[best]
    worst = max((gaps[rf][1] - gaps[rf][2]) / gaps[rf][1] for rf in active)
    raise RuntimeError(f"the kernel model's duality gap is still {worst:.1e} of its primal value after {max_passes} passes")
