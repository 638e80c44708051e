"""Kernels for what is inherently sequential: recursive filters, splines, state estimation, warping.

Each takes and gives NumPy arrays of one run, which is bounded by a ride's length; Spark deals the runs (see per_run)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_run(df: DataFrame, by: str, order: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a kernel to each run's rows in order. Runs are dealt by key and sorted by Spark; a batch of rows holds many short runs, and no more than one is kept beyond it."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            keys = rows[by].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(rows)]
            for a, b in zip(cuts, cuts[1:]):
                part = rows.iloc[a:b]
                if held and held[0][by].iloc[0] != part[by].iloc[0]:
                    yield pd.concat(held, ignore_index=True)
                    held = []
                held.append(part)
        if held:
            yield pd.concat(held, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for own in runs(b for b in batches if len(b)):
            out.append(kernel(own))
            size += len(out[-1])
            if size > 10_000:
                yield pd.concat(out, ignore_index=True)
                out, size = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    return df.where(F.col(by).isNotNull()).repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, schema)


def per_run_arrays(df: DataFrame, by: str, order: list[str], kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """per_run for kernels that take and give a run's columns as arrays: a short run costs no tables of its own, which take longer than its numbers."""

    def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
        held: list[dict[str, np.ndarray]] = []
        for rows in batches:
            columns = {c: rows[c].to_numpy() for c in rows.columns}
            cuts = [0, *(np.flatnonzero(columns[by][1:] != columns[by][:-1]) + 1).tolist(), len(rows)]
            for a, b in zip(cuts, cuts[1:]):
                part = {c: x[a:b] for c, x in columns.items()}
                if held and held[0][by][0] != part[by][0]:
                    yield joined(held)
                    held = []
                held.append(part)
        if held:
            yield joined(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for own in runs(b for b in batches if len(b)):
            out.append(kernel(own))
            size += len(out[-1][by])
            if size > 10_000:
                yield pd.DataFrame(joined(out))
                out, size = [], 0
        if out:
            yield pd.DataFrame(joined(out))

    return df.where(F.col(by).isNotNull()).repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, schema)


# Filters ------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def butterworth(order: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a digital low-pass; share: cutoff over the Nyquist frequency."""
    k = np.arange(order)
    analog = 2 * np.tan(np.pi * share / 2) * np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    a = np.real(np.poly((2 + analog) / (2 - analog)))
    b = np.real(np.poly(-np.ones(order)))
    return b * a.sum() / b.sum(), a


@lru_cache(maxsize=64)
def _block_tables(b: tuple, a: tuple, block: int) -> tuple[np.ndarray, ...]:
    """Of one filter: the impulse response over a block, what a block's samples bring to the state after it, what the state before it gives to its outputs, and how a state goes on over a block."""
    n = len(a) - 1
    a_, b_ = np.array(a), np.array(b)
    step = np.zeros((n, n))
    step[:, 0] = -a_[1:]
    step[:-1, 1:] += np.eye(n - 1)
    feed = b_[1:] - a_[1:] * b_[0]
    powers = [np.eye(n)]
    for _ in range(block):
        powers.append(step @ powers[-1])
    impulse = np.concatenate(([b_[0]], [p[0] @ feed for p in powers[: block - 1]]))
    at = np.arange(block)[:, None] - np.arange(block)
    own = np.where(at >= 0, impulse[np.maximum(at, 0)], 0.0)
    gather = np.array([powers[block - 1 - i] @ feed for i in range(block)])
    return own.T.copy(), gather, np.array([p[0] for p in powers[:block]]).T.copy(), powers[block]


def recursive_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray, block: int = 128) -> np.ndarray:
    """Transposed direct form, from a given state.

    In blocks: a block's output is its input times the impulse response, plus what the state before it still gives; both
    are matrix products over all blocks, and only the states go from block to block."""
    own, gather, later, over = _block_tables(tuple(np.asarray(b, float)), tuple(np.asarray(a, float)), block)
    rows = np.concatenate((x, np.zeros(-len(x) % block))).reshape(-1, block)
    inner, brought, z, states = rows @ own, rows @ gather, np.asarray(state, float), np.empty((len(rows), len(a) - 1))
    for i in range(len(rows)):
        states[i] = z
        z = over @ z + brought[i]
    return (inner + states @ later).ravel()[: len(x)]


def settled_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state in which a constant input of 1 gives 1."""
    return _settled_state(tuple(np.asarray(b, float)), tuple(np.asarray(a, float)))


@lru_cache(maxsize=64)
def _settled_state(b: tuple, a: tuple) -> np.ndarray:
    b, a = np.array(b), np.array(a)
    n = len(a) - 1
    step = np.zeros((n, n))
    step[:, 0] = -a[1:]
    step[:-1, 1:] += np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - step, b[1:] - a[1:] * b[0])


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, with odd extensions of 3 * (order + 1) samples (or what there is)."""
    pad = min(3 * len(a), len(x) - 1)
    wide = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    zi = settled_state(b, a)
    once = recursive_filter(b, a, wide, zi * wide[0])[::-1]
    return recursive_filter(b, a, once, zi * once[0])[::-1][pad : pad + len(x)]


def low_pass(y: np.ndarray, rate: float, cutoff: float, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth over the finite samples as if they were contiguous; short series come back as they are."""
    y = np.asarray(y, float)
    if len(y) < max(3 * order, 8) or not rate > 0:
        return y
    good = np.isfinite(y)
    if good.sum() < max(3 * order, 8):
        return y
    out = y.copy()
    out[good] = zero_phase(*butterworth(order, min(cutoff / (rate / 2), 0.99)), y[good])
    return out


# A drift's cutoff in Hz at most, and as parts of the rate: at most, at least, and where it would pass the Nyquist frequency.
DRIFT_HZ, DRIFT_PART, DRIFT_LEAST, DRIFT_SHARE, DRIFT_ORDER = 0.05, 80, 1000, 0.1, 2


def drift(residual: np.ndarray, rate: float) -> np.ndarray:
    """The slow part of a residual, gaps as 0."""
    known = np.where(np.isfinite(residual), residual, 0.0)
    cutoff = float(np.clip(DRIFT_HZ, rate / DRIFT_LEAST, max(rate / DRIFT_PART, rate / DRIFT_LEAST)))
    nyquist = rate / 2
    return low_pass(known, rate, cutoff if cutoff < 0.98 * nyquist else DRIFT_SHARE * nyquist, DRIFT_ORDER)


@lru_cache(maxsize=64)
def polynomial_weights(width: int, order: int) -> np.ndarray:
    """Weights of a local polynomial's value at the centre of its window."""
    x = np.arange(width) - width // 2
    return np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0]


def local_polynomial(y: np.ndarray, width: int, order: int) -> np.ndarray:
    """Savitzky-Golay smoothing; the ends lie on the polynomials of the first and the last window."""
    half = width // 2
    out = np.convolve(y, polynomial_weights(width, order)[::-1], "same")
    x = np.arange(width)
    fit = np.vander(x, order + 1, increasing=True)
    for rows, own in ((slice(0, width), slice(0, half)), (slice(len(y) - width, len(y)), slice(width - half, width))):
        curve = fit @ np.linalg.lstsq(fit, y[rows], rcond=None)[0]
        out[rows][own] = curve[own]
    return out


def smooth(y: np.ndarray, rate: float, seconds: float = 1.0, order: int = 3) -> np.ndarray:
    """Savitzky-Golay over a window in seconds; gaps count as the median; short series come back as they are."""
    y = np.asarray(y, float)
    n = len(y)
    if n < 7:
        return y
    width = min(max(round(rate * seconds) | 1, 5), n if n % 2 else n - 1)
    if n <= width:
        return y
    filled = np.where(np.isfinite(y), y, np.nanmedian(y) if np.isfinite(y).any() else 0.0)
    return local_polynomial(filled, width, min(order, width - 1))


def _three_diagonals(low: np.ndarray, mid: np.ndarray, high: np.ndarray, r: np.ndarray) -> list[float]:
    """Solves low[i] x[i - 1] + mid[i] x[i] + high[i] x[i + 1] = r[i], forward and back."""
    low, high, mid, r = low.tolist(), high.tolist(), mid.tolist(), r.tolist()
    for i in range(1, len(r)):
        share = low[i] / mid[i - 1]
        mid[i] -= share * high[i - 1]
        r[i] -= share * r[i - 1]
    out = [r[-1] / mid[-1]]
    for i in range(len(r) - 2, -1, -1):
        out.append((r[i] - high[i] * out[-1]) / mid[i])
    return out[::-1]


def spline_gaps(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A cubic spline (not-a-knot) through the finite samples; it changes gaps alone, not the samples."""
    good = np.isfinite(y) & np.isfinite(t)
    x, first = np.unique(t[good], return_index=True)
    if good.all() or len(x) < 4:
        return y if good.all() or not good.any() else np.where(np.isfinite(y), y, np.interp(t, x, y[good][first]))
    v, h = y[good][first], np.diff(x)
    n = len(x)
    # Second derivatives of the inner knots: three diagonals, once those of the ends are put in by the next two (not-a-knot).
    low, mid, high = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    r = 6 * (np.diff(v[1:]) / h[1:] - np.diff(v[:-1]) / h[:-1])
    mid[0] += h[0] * (h[0] + h[1]) / h[1]
    high[0] -= h[0] ** 2 / h[1]
    mid[-1] += h[-1] * (h[-1] + h[-2]) / h[-2]
    low[-1] -= h[-1] ** 2 / h[-2]
    c = np.zeros(n)
    c[1:-1] = _three_diagonals(low, mid, high, r)
    c[0] = ((h[0] + h[1]) * c[1] - h[0] * c[2]) / h[1]
    c[-1] = ((h[-1] + h[-2]) * c[-2] - h[-1] * c[-3]) / h[-2]
    at = np.clip(np.searchsorted(x, t[~good], side="right") - 1, 0, n - 2)
    a, b, k = t[~good] - x[at], x[at + 1] - t[~good], h[at]
    out = y.copy()
    out[~good] = (c[at] * b**3 + c[at + 1] * a**3) / (6 * k) + (v[at] / k - c[at] * k / 6) * b + (v[at + 1] / k - c[at + 1] * k / 6) * a
    return out


def repaired_time(t: np.ndarray, eps: float = 1e-7) -> np.ndarray:
    """Rising times: what isn't after all before it stands at their latest, plus eps for each such row in a row. Times are relative to the first, where eps is not lost."""
    known = np.asarray(t, float) - (t[0] if len(t) else 0.0)
    latest = np.fmax.accumulate(known) if len(known) else known
    stays = np.arange(len(known)) > 0
    stays[1:] &= ~(known[1:] > latest[:-1])
    place = np.arange(len(known))
    fresh = np.maximum.accumulate(np.where(stays, 0, place))
    return latest + eps * (place - fresh)


def vertical_velocity(h: np.ndarray, t: np.ndarray, most: float = 50.0) -> np.ndarray:
    """Rates of change by central differences, held within a bound; 0 where there is none."""
    if len(h) < 2:
        return np.zeros(len(h))
    with np.errstate(all="ignore"):
        rate = np.gradient(h, repaired_time(t))
    return np.where(np.isfinite(rate), np.clip(rate, -most, most), 0.0)


def filled(y: np.ndarray, default: float = 0.0) -> np.ndarray:
    good = np.isfinite(y)
    return np.interp(np.arange(len(y)), np.flatnonzero(good), y[good]) if good.any() else np.full(len(y), default)


# Matching -----------------------------------------------------------------------------------------------------------


def best_lag(a: np.ndarray, b: np.ndarray, step_s: float) -> tuple[float, float]:
    """Lag in seconds of the greatest cross-correlation (positive: a is later), and its normalised height."""
    n = min(len(a), len(b))
    if n < 8:
        return 0.0, 0.0
    x, y = a[:n] - a[:n].mean(), b[:n] - b[:n].mean()
    size = 1 << (2 * n - 1).bit_length()
    c = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)
    c = np.concatenate((c[-(n - 1) :], c[:n]))
    k = int(np.argmax(c))
    return (k - (n - 1)) * max(step_s, 1 / 500), float(c[k] / (n * (x.std() * y.std() + 1e-12)))


def apart(at: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Of rising places the higher of close ones: from the highest down (the first on ties), each that has none kept within `distance`.

    Kept places stand at least `distance` apart, so a bucket of that width holds one at most, and three buckets are asked."""
    if distance < 2 or not len(at):
        return at
    buckets = [-distance] * (int(at[-1]) // distance + 3)
    for i in at[np.argsort(-height, kind="stable")].tolist():
        b = i // distance + 1
        if i - buckets[b - 1] >= distance and abs(i - buckets[b]) >= distance and (buckets[b + 1] < 0 or buckets[b + 1] - i >= distance):
            buckets[b] = i
    return np.array([i for i in buckets if i >= 0], int)


def _foot(y: np.ndarray, at: np.ndarray, half: int) -> np.ndarray:
    """For each place the least value before it, as far as none is higher and `half` samples at most; its own value if there is none.

    By doubling: the greatest and least value of 1, 2, 4, ... samples, and the longest stretch that fits put together from them."""
    levels = [(y, y)]
    while 2 ** len(levels) <= half:
        width = 2 ** (len(levels) - 1)
        high, low = levels[-1]
        levels.append((np.maximum(high[:-width], high[width:]), np.minimum(low[:-width], low[width:])))
        if len(levels[-1][0]) < 2 * width + 1:
            break
    own, foot, begin, limit = y[at], y[at].copy(), at.copy(), np.maximum(at - half, 0)
    for k in range(len(levels) - 1, -1, -1):
        for _ in range(2 if k == len(levels) - 1 else 1):
            start = begin - 2**k
            fits = start >= limit
            there = np.maximum(start, 0)
            fits &= levels[k][0][np.minimum(there, len(levels[k][0]) - 1)] <= own
            foot = np.where(fits, np.minimum(foot, levels[k][1][np.minimum(there, len(levels[k][1]) - 1)]), foot)
            begin = np.where(fits, start, begin)
    return foot


def peaks(y: np.ndarray, height: float, distance: int, prominence: float, width: int) -> np.ndarray:
    """Local maxima of a least height, the higher of close ones, of a least prominence within a window."""
    y = np.asarray(y, float)
    at = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:]) & (y[1:-1] >= height)) + 1
    at = apart(at, y[at], distance)
    if not len(at):
        return at
    before = _foot(y, at, width // 2)
    after = _foot(y[::-1], len(y) - 1 - at, width // 2)
    return at[y[at] - np.maximum(before, after) >= prominence]


# The filter's noise: acceleration and bias in the state, a metre's third in heights at least; the first state's variances.
_NOISE, _LEAST, _FIRST = (0.15, 0.6, 0.01), 0.35**2, (4.0, 4.0, 0.8)


def _then(first: tuple, then: tuple) -> tuple:
    """Two stretches of a Kalman filter as one: (A, b, C, eta, J), stacks of matrices; associative."""
    a1, b1, c1, e1, j1 = first
    a2, b2, c2, e2, j2 = then
    inner = np.linalg.inv(np.eye(3) + c1 @ j2)
    left, right = a2 @ inner, np.swapaxes(a1, -1, -2) @ np.swapaxes(inner, -1, -2)
    return (
        left @ a1,
        (left @ (b1 + (c1 @ e2[..., None])[..., 0])[..., None])[..., 0] + b2,
        left @ c1 @ np.swapaxes(a2, -1, -2) + c2,
        (right @ (e2 - (j2 @ b1[..., None])[..., 0])[..., None])[..., 0] + e1,
        right @ j2 @ a1 + j1,
    )


def _elements(dt: np.ndarray, seen: np.ndarray, push: np.ndarray, noise: float) -> tuple:
    """What one step of the filter does, for each step: predict over dt with an acceleration, then see a height."""
    n, half = len(dt), dt * dt / 2
    f = np.tile(np.eye(3), (n, 1, 1))
    f[:, 0, 1], f[:, 0, 2], f[:, 1, 2] = dt, -half, -dt
    q = np.zeros((n, 3, 3))
    q[:, 0, 0], q[:, 1, 1], q[:, 2, 2] = _NOISE[0] * dt**4, _NOISE[1] * dt**2, _NOISE[2] * dt
    moved = np.stack([half * push, dt * push, np.zeros(n)], -1)
    s, off = q[:, 0, 0] + noise, seen - moved[:, 0]
    k = q[:, :, 0] / s[:, None]
    left = np.tile(np.eye(3), (n, 1, 1))
    left[:, :, 0] -= k
    row = f[:, 0, :]
    return left @ f, moved + k * off[:, None], left @ q, row * (off / s)[:, None], row[:, :, None] * row[:, None, :] / s[:, None, None]


#: Up to so many steps the filter goes one by one: blocks of matrices cost more than they save.
_ONE_BY_ONE = 2048


def _fused_steps(dt: np.ndarray, seen: np.ndarray, push: np.ndarray, noise: float, state: np.ndarray, cov: np.ndarray) -> tuple[list[float], list[float]]:
    """Heights and climbs after each step of the filter, in plain numbers."""
    (x, v, b), heights, climbs = state.tolist(), [], []
    hh, hc, hb, cc, cb, bb = (float(cov[i, j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))
    q1, q2, q3 = _NOISE
    for d, z, a in zip(dt.tolist(), seen.tolist(), push.tolist()):
        half = d * d / 2
        x, v = x + d * v + half * (a - b), v + d * (a - b)
        h1, h2, h3 = hh + d * hc - half * hb, hc + d * cc - half * cb, hb + d * cb - half * bb
        c2, c3 = cc - d * cb, cb - d * bb
        hh, hc, hb = h1 + d * h2 - half * h3 + q1 * d**4, h2 - d * h3, h3
        cc, cb, bb = c2 - d * c3 + q2 * d**2, c3, bb + q3 * d
        total = hh + noise
        k1, k2, k3, off = hh / total, hc / total, hb / total, z - x
        x, v, b = x + k1 * off, v + k2 * off, b + k3 * off
        cc, cb, bb = cc - k2 * hc, cb - k2 * hb, bb - k3 * hb
        hh, hc, hb = hh - k1 * hh, hc - k1 * hc, hb - k1 * hb
        heights.append(x)
        climbs.append(v)
    return heights, climbs


def fuse_vertical(t: np.ndarray, h: np.ndarray, acc: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Linear Kalman filter of height, climb and accelerometer bias: fused height and climb.

    The run is cut into about as many blocks as a block has steps. What a block does to any state comes from composing its
    steps, for all blocks at once; that takes the first state from block to block; then all blocks filter from their own
    first states, side by side. Short runs go step by step."""
    noise = max(float(np.nanvar(h - low_pass(h, rate, 0.5, 2))), _LEAST)
    n = len(h)
    if n < 2:
        return np.asarray(h, float).copy(), np.zeros(n)
    state, cov = np.array([h[0], 0.0, 0.0]), np.diag(_FIRST)
    gain = cov[:, 0] / (cov[0, 0] + noise)
    cov = cov - np.outer(gain, cov[0])
    if n <= _ONE_BY_ONE:
        heights, climbs = _fused_steps(np.clip(np.diff(t), 1e-4, 0.5), h[1:], acc[1:], noise, state, cov)
        return np.array([h[0], *heights]), np.clip(np.array([0.0, *climbs]), -50.0, 50.0)
    size = max(1, int(np.sqrt(n - 1)))
    blocks = -(-(n - 1) // size)
    fit = lambda x: np.concatenate((x, np.zeros(blocks * size - len(x)))).reshape(blocks, size)
    dt, seen, push = fit(np.clip(np.diff(t), 1e-4, 0.5)), fit(h[1:]), fit(acc[1:])
    whole = _elements(dt[:, 0], seen[:, 0], push[:, 0], noise)
    for i in range(1, size):
        whole = _then(whole, _elements(dt[:, i], seen[:, i], push[:, i], noise))
    states, covs = np.empty((blocks, 3)), np.empty((blocks, 3, 3))
    for k in range(blocks):
        states[k], covs[k] = state, cov
        none = np.zeros((3, 3))
        _, state, cov, _, _ = _then((none, state, cov, np.zeros(3), none), tuple(x[k] for x in whole))
    heights, climbs = np.empty((blocks, size)), np.empty((blocks, size))
    x, p = states.T.copy(), covs
    hh, hc, hb, cc, cb, bb = (p[:, i, j].copy() for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))
    for i in range(size):
        d, a = dt[:, i], push[:, i]
        half = d * d / 2
        x = np.stack([x[0] + d * x[1] + half * (a - x[2]), x[1] + d * (a - x[2]), x[2]])
        h1, h2, h3 = hh + d * hc - half * hb, hc + d * cc - half * cb, hb + d * cb - half * bb
        c2, c3 = cc - d * cb, cb - d * bb
        hh, hc, hb = h1 + d * h2 - half * h3 + _NOISE[0] * d**4, h2 - d * h3, h3
        cc, cb, bb = c2 - d * c3 + _NOISE[1] * d**2, c3, bb + _NOISE[2] * d
        total = hh + noise
        k1, k2, k3, off = hh / total, hc / total, hb / total, seen[:, i] - x[0]
        x = x + np.stack([k1, k2, k3]) * off
        cc, cb, bb = cc - k2 * hc, cb - k2 * hb, bb - k3 * hb
        hh, hc, hb = hh - k1 * hh, hc - k1 * hc, hb - k1 * hb
        heights[:, i], climbs[:, i] = x[0], x[1]
    back = lambda first, rest: np.concatenate(([first], rest.ravel()[: n - 1]))
    return back(h[0], heights), np.clip(back(0.0, climbs), -50.0, 50.0)


def z_scores(y: np.ndarray) -> np.ndarray:
    s = y.std()
    return np.zeros(len(y)) if s < 1e-9 else (y - y.mean()) / s


def warping_path(a: np.ndarray, b: np.ndarray, band: int) -> list[tuple[int, int]]:
    """Dynamic time warping within a band around the diagonal; of the matrix only the band is held.

    Along a row a cell is the least, over the cells where the row may have been entered, of the entry plus what lies between."""
    n, m = len(a), len(b)
    band = max(band, abs(n - m) + 1)
    lows = [max(1, round(i * m / n) - band) for i in range(n + 1)]
    highs = [min(m, round(i * m / n) + band) for i in range(n + 1)]
    rows, lows[0], highs[0] = [np.array([0.0])], 0, 0
    reach = lambda i, lo, hi: np.concatenate([np.full(max(0, min(lows[i], hi + 1) - lo), np.inf), rows[i][max(0, lo - lows[i]) : max(0, hi + 1 - lows[i])], np.full(max(0, hi - max(highs[i], lo - 1)), np.inf)])
    for i in range(1, n + 1):
        lo, hi = lows[i], highs[i]
        d = np.abs(b[lo - 1 : hi] - a[i - 1])
        above = reach(i - 1, lo - 1, hi)
        entry = np.minimum(above[1:], above[:-1])
        before = np.concatenate(([0.0], np.cumsum(d)))
        rows.append(before[1:] + np.minimum.accumulate(entry - before[:-1]))
    path, i, j = [], n, m
    cost = lambda i, j: rows[i][j - lows[i]] if lows[i] <= j <= highs[i] else np.inf
    while i and j:
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda s: cost(*s))
    return path[::-1]


def warp_onto(base: np.ndarray, other: np.ndarray, values: np.ndarray, band: int = 50) -> np.ndarray:
    """Values of the other run on the base's places: the median of all that the path maps there. Runs of under 8 places come back as they are."""
    return warp_all(base, other, [values], band)[0]


def warp_all(base: np.ndarray, other: np.ndarray, series: list[np.ndarray], band: int = 50) -> list[np.ndarray]:
    """warp_onto for several series of the other run, along one path."""
    if min(len(base), len(other)) < 8:
        return series
    path = warping_path(z_scores(base), z_scores(other), band)

    def onto(values: np.ndarray) -> np.ndarray:
        own: list[list[float]] = [[] for _ in base]
        known = values.tolist()
        for i, j in path:
            own[i].append(known[j])
        return filled(np.array([_median(v) for v in own]))

    return [onto(values) for values in series]


def _median(v: list[float]) -> float:
    """The median of a few numbers; NaN of none, or with a NaN among them."""
    if not v or any(x != x for x in v):
        return np.nan
    v, half = sorted(v), len(v) // 2
    return v[half] if len(v) % 2 else (v[half - 1] + v[half]) / 2


#: Beyond so many lengths the kernel is under 1e-16; places are predicted so many at a time.
_REACH, _PLACES = 8.6, 512


def _lower_solve(low: np.ndarray, y: np.ndarray, block: int = 64) -> np.ndarray:
    """x of low x = y for a lower triangle, by blocks."""
    x = y.copy()
    for i in range(0, len(y), block):
        rows = slice(i, i + block)
        x[rows] = np.linalg.solve(low[rows, rows], x[rows] - low[rows, :i] @ x[:i])
    return x


def gaussian_process(x: np.ndarray, y: np.ndarray, most: int = 2500) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sigma of a process with a squared-exponential kernel and noise at rising places; hyper-parameters by likelihood over a grid.

    Trained on every k-th point so that at most about `most` are. Places are predicted in blocks, each from the points that
    its places can feel, so that time grows with the places and memory doesn't."""
    step = max(1, -(-len(x) // most))
    tx, mean, scale = x[::step], y.mean(), y.std() or 1.0
    ty = (y[::step] - mean) / scale
    span, best, diagonal = max(float(x[-1] - x[0]), 1.0), None, np.arange(len(tx))
    kernel = lambda u, v, length: np.exp(-((u[:, None] - v) ** 2) / (2 * length**2))
    for length in np.unique(np.clip(span / np.array([160, 80, 40, 20, 10]), 1.0, max(5.0, span / 2))):
        k = kernel(tx, tx, length)
        for noise in (1e-3, 1e-2, 0.05, 0.3):
            k[diagonal, diagonal] = 1 + noise + 1e-4
            try:
                low = np.linalg.cholesky(k)
            except np.linalg.LinAlgError:
                continue
            likelihood = -0.5 * (_lower_solve(low, ty) ** 2).sum() - np.log(np.diag(low)).sum()
            if best is None or likelihood > best[0]:
                best = likelihood, length, noise
    if best is None:
        width = min(31, len(y) - 1 | 1)
        out = local_polynomial(y, width, 2) if len(y) > width > 2 else y
        return out, np.full(len(y), (y - out).std())
    _, length, noise = best
    k = kernel(tx, tx, length)
    k[diagonal, diagonal] = 1 + noise + 1e-4
    inverse = np.linalg.inv(k)
    del k
    weights, out, sigma = inverse @ ty, np.empty(len(x)), np.empty(len(x))
    for i in range(0, len(x), _PLACES):
        own = x[i : i + _PLACES]
        a, b = np.searchsorted(tx, (own[0] - _REACH * length, own[-1] + _REACH * length))
        cross = kernel(own, tx[a:b], length)
        out[i : i + _PLACES] = cross @ weights[a:b] * scale + mean
        taken = np.einsum("ij,ij->i", cross @ inverse[a:b, a:b], cross)
        sigma[i : i + _PLACES] = np.sqrt(np.maximum(1 + noise - taken, 1e-12)) * scale
    return out, sigma
