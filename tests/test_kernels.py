"""Kernels against closed forms and plain loops."""

import numpy as np
import pytest

from ridgeline.functions import dsp

rng = np.random.default_rng(1)


def test_constant_and_polynomial():
    assert np.allclose(dsp.low_pass(np.full(200, 3.5), 100, 4), 3.5)
    x = np.arange(120.0)
    assert np.allclose(dsp.smooth(2 + 3 * x - 0.1 * x**2, 100, 0.31, 2), 2 + 3 * x - 0.1 * x**2)
    assert np.allclose(dsp.low_pass(np.array([1.0, 2, 3]), 100, 4), [1, 2, 3])


def test_two_tones():
    t = np.arange(0, 20, 0.01)
    slow, fast = np.sin(2 * np.pi * 0.2 * t), np.sin(2 * np.pi * 20 * t)
    out = dsp.low_pass(slow + fast, 100, 4, 2)
    assert np.abs(out - slow)[100:-100].max() < 0.02


def test_gain_at_cutoff():
    for order in (2, 4):
        b, a = dsp.butterworth(order, 0.2)
        z = np.exp(-1j * np.pi * 0.2 * np.arange(order + 1))
        assert abs(abs((b @ z) / (a @ z)) - np.sqrt(0.5)) < 1e-9
        assert abs(b.sum() / a.sum() - 1) < 1e-12


def test_gaps_and_nan():
    y = np.array([0.0, 1, np.nan, 27, 64, 125, np.nan, 343])
    assert np.allclose(dsp.spline_gaps(np.arange(8.0), y), np.arange(8.0) ** 3)
    noisy = np.where(rng.random(100) < 0.2, np.nan, 1.0)
    assert np.isnan(dsp.low_pass(noisy, 100, 4)).sum() == np.isnan(noisy).sum()


def test_velocity_with_repeated_times():
    t = np.array([0.0, 1, 1, 2, 3])
    v = dsp.vertical_velocity(np.arange(5.0), t)
    assert np.isfinite(v).all() and np.abs(v).max() <= 50


def test_lag_of_a_shifted_copy():
    a = rng.normal(size=300)
    lag, peak = dsp.best_lag(np.roll(a, 7), a, 0.04)
    assert lag == pytest.approx(0.28) and peak > 0.9
    assert dsp.best_lag(a[:5], a[:5], 0.04) == (0.0, 0.0)


def test_peaks():
    y = np.zeros(100)
    y[[20, 24, 60]] = [3, 2, 1.5]
    assert dsp.peaks(y, 1.3, 6, 0.35, 18).tolist() == [20, 60]
    assert dsp.peaks(y, 2.5, 6, 0.35, 18).tolist() == [20]


def test_kalman_follows_a_climb():
    t = np.arange(0, 30, 0.04)
    h, v = dsp.fuse_vertical(t, 2 * t + rng.normal(0, 0.3, len(t)), np.zeros(len(t)), 25)
    assert abs(v[-200:].mean() - 2) < 0.2 and np.abs(h - 2 * t)[-200:].mean() < 0.4


def test_warping_like_a_plain_loop():
    a, b = rng.normal(size=12), rng.normal(size=15)
    cost = np.full((13, 16), np.inf)
    cost[0, 0] = 0
    for i in range(1, 13):
        for j in range(1, 16):
            cost[i, j] = abs(a[i - 1] - b[j - 1]) + min(cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
    path = dsp.warping_path(a, b, 100)
    assert sum(abs(a[i] - b[j]) for i, j in path) == pytest.approx(cost[-1, -1])
    base = np.sin(np.arange(60) / 6)
    assert np.allclose(dsp.warp_onto(base, base, base), base)


def test_gaussian_process_smooths():
    x = np.arange(200.0)
    y = np.sin(x / 30) + rng.normal(0, 0.2, 200)
    mean, sigma = dsp.gaussian_process(x, y)
    assert np.abs(mean - np.sin(x / 30)).mean() < 0.1 and (sigma > 0).all()


def test_block_filter_like_the_recursion():
    rng = np.random.default_rng(3)
    for order, share in ((1, 0.2), (2, 0.05), (4, 0.3), (4, 0.9)):
        b, a = dsp.butterworth(order, share)
        for n in (1, 5, 127, 128, 129, 1000):
            x, z = rng.normal(size=n), rng.normal(size=order)
            state, want = [*z.tolist(), 0.0], []
            for v in x:
                y = b[0] * v + state[0]
                for j in range(order):
                    state[j] = state[j + 1] + b[j + 1] * v - a[j + 1] * y
                want.append(y)
            assert np.allclose(dsp.recursive_filter(b, a, x, z), want, rtol=1e-7, atol=1e-8)


def test_spline_of_an_hour_with_gaps():
    """Not-a-knot reproduces cubics; a run of 360,000 samples takes linear time and memory."""
    t = np.arange(360_000) * 0.01
    y = np.sin(t / 40) * 100
    y[::1000] = np.nan
    got = dsp.spline_gaps(t, y)
    assert np.abs(got - np.sin(t / 40) * 100).max() < 1e-6
    x = np.array([0.0, 1, 2.5, 3, 4.2, 6])
    v = x**3 - 2 * x
    v[2] = np.nan
    assert np.allclose(dsp.spline_gaps(x, v), x**3 - 2 * x)


def test_warping_like_a_whole_matrix():
    rng = np.random.default_rng(5)
    for n, m, band in ((9, 9, 50), (30, 22, 3), (40, 41, 5), (12, 60, 2)):
        a, b = rng.normal(size=n), rng.normal(size=m)
        wide = max(band, abs(n - m) + 1)
        cost = np.full((n + 1, m + 1), np.inf)
        cost[0, 0] = 0
        for i in range(1, n + 1):
            for j in range(max(1, round(i * m / n) - wide), min(m, round(i * m / n) + wide) + 1):
                cost[i, j] = abs(a[i - 1] - b[j - 1]) + min(cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1])
        path = dsp.warping_path(a, b, band)
        assert path[0] == (0, 0) and path[-1] == (n - 1, m - 1)
        assert sum(abs(a[i] - b[j]) for i, j in path) == pytest.approx(cost[n, m])
        assert all((p - i, q - j) in ((1, 1), (1, 0), (0, 1)) for (i, j), (p, q) in zip(path, path[1:]))


def test_fill_looks_ahead_in_one_pass(spark):
    """Filling from both sides of one run of 100,000 rows: no frame is worked out anew for each row."""
    import time

    from pyspark.sql import functions as F

    from ridgeline.operators import sequences as Q

    o = Q.Ordered("run_id", "unix_ns")
    rows = spark.range(100_000).select(F.lit(1).alias("run_id"), F.col("id").alias("unix_ns"), F.when(F.col("id") % 50_000 == 40_000, F.col("id") * 1.0).alias("v"))
    began = time.perf_counter()
    got = Q.fill_linear(rows.withColumn("w", Q.fill_both("v", o)), "v", o, "filled").agg(F.sum("w"), F.min("filled"), F.max("filled")).first()
    assert got[1] == 40_000 and got[2] == 90_000 and got[0] == 40_000 * 90_000 + 90_000 * 10_000
    assert time.perf_counter() - began < 30


def plain_peaks(y, height, distance, prominence, width):
    at = [i for i in range(1, len(y) - 1) if y[i] > y[i - 1] and y[i] >= y[i + 1] and y[i] >= height]
    kept = []
    for i in sorted(at, key=lambda i: (-y[i], i)):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    out = []
    for i in sorted(kept):
        feet = []
        for way in (-1, 1):
            foot, j = y[i], i + way
            while 0 <= j < len(y) and abs(j - i) <= width // 2 and y[j] <= y[i]:
                foot, j = min(foot, y[j]), j + way
            feet.append(foot)
        if y[i] - max(feet) >= prominence:
            out.append(i)
    return out


def test_peaks_like_a_plain_search():
    rng = np.random.default_rng(6)
    for n in (3, 4, 10, 60, 400):
        for distance, width in ((1, 0), (1, 1), (2, 5), (6, 18), (9, 64), (50, 500)):
            y = np.round(rng.normal(1, 0.7, n), 1)  # with ties
            assert dsp.peaks(y, 0.9, distance, 0.3, width).tolist() == plain_peaks(y.tolist(), 0.9, distance, 0.3, width), (n, distance, width)
    assert dsp.peaks(np.zeros(2), 0, 3, 0, 4).tolist() == []


def test_peaks_of_an_hour():
    import time

    y = np.random.default_rng(7).normal(1, 1, 360_000)
    began = time.perf_counter()
    found = dsp.peaks(y, 1.3, 6, 0.35, 18)
    assert time.perf_counter() - began < 1 and np.diff(found).min() >= 6 and len(found) > 20_000


def plain_kalman(t, h, acc, rate):
    noise = max(float(np.nanvar(h - dsp.low_pass(h, rate, 0.5, 2))), 0.35**2)
    x, p, want = np.array([h[0], 0.0, 0.0]), np.diag([4.0, 4.0, 0.8]), []
    for i in range(len(h)):
        if i:
            dt = min(max(t[i] - t[i - 1], 1e-4), 0.5)
            f = np.array([[1, dt, -dt * dt / 2], [0, 1, -dt], [0, 0, 1]])
            x = f @ x + np.array([dt * dt / 2, dt, 0]) * acc[i]
            p = f @ p @ f.T + np.diag([0.15 * dt**4, 0.6 * dt**2, 0.01 * dt])
        gain = p[:, 0] / (p[0, 0] + noise)
        x = x + gain * (h[i] - x[0])
        p = p - np.outer(gain, p[0])
        want.append([x[0], min(max(x[1], -50.0), 50.0)])
    return np.array(want)


def test_kalman_blocks_like_a_loop():
    """Uneven clocks, repeated and far times, every size of the last block."""
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 5, 10, 17, 50, 101, 3000):
        t = np.cumsum(rng.choice([0.0, 0.004, 0.04, 0.3, 2.0], n))
        h, acc = np.cumsum(rng.normal(size=n)), rng.normal(size=n) * 3
        assert np.allclose(np.array(dsp.fuse_vertical(t, h, acc, 25.0)).T, plain_kalman(t, h, acc, 25.0), rtol=1e-7, atol=1e-8), n


def test_an_hour_through_every_kernel():
    import time

    rng = np.random.default_rng(9)
    n = 360_000
    t, y = np.arange(n) * 0.01, np.cumsum(rng.normal(size=n)) * 0.05
    began = time.perf_counter()
    dsp.low_pass(y, 100, 4, 2), dsp.smooth(y, 100), dsp.drift(y, 100), dsp.vertical_velocity(y, t), dsp.peaks(np.abs(y), 1.3, 6, 0.35, 18)
    dsp.spline_gaps(t, np.where(rng.random(n) < 0.1, np.nan, y)), dsp.best_lag(y, np.roll(y, 50), 0.01), dsp.fuse_vertical(t, y, rng.normal(size=n), 100.0)
    assert time.perf_counter() - began < 10


def test_repaired_time_like_a_loop():
    rng = np.random.default_rng(10)
    for _ in range(50):
        t = np.round(np.cumsum(rng.choice([-0.3, 0.0, 0.1, 0.5], 60)), 6) + 1.7e9
        want, last = [0.0], 0.0
        relative = t - t[0]
        latest = relative[0]
        for v in relative[1:]:
            last = v if v > latest else last + 1e-7
            latest = max(latest, v)
            want.append(last)
        got = dsp.repaired_time(t)
        assert np.allclose(got, want, atol=1e-12) and (np.diff(got) > 0).all()


def test_gaussian_process_like_whole_matrices():
    x = np.arange(0.0, 900.0, 1.5)
    y = np.sin(x / 50) + rng.normal(0, 0.1, len(x))
    mean, sigma = dsp.gaussian_process(x, y, 300)
    tx, ty = x[::2], (y[::2] - y.mean()) / y.std()
    best = None
    for length in np.unique(np.clip(898.5 / np.array([160, 80, 40, 20, 10]), 1.0, 898.5 / 2)):
        for noise in (1e-3, 1e-2, 0.05, 0.3):
            k = np.exp(-((tx[:, None] - tx) ** 2) / (2 * length**2)) + (noise + 1e-4) * np.eye(len(tx))
            likelihood = -0.5 * ty @ np.linalg.solve(k, ty) - 0.5 * np.linalg.slogdet(k)[1]
            if best is None or likelihood > best[0]:
                best = likelihood, length, noise, k
    _, length, noise, k = best
    cross = np.exp(-((x[:, None] - tx) ** 2) / (2 * length**2))
    assert np.allclose(mean, cross @ np.linalg.solve(k, ty) * y.std() + y.mean(), atol=1e-6)
    assert np.allclose(sigma, np.sqrt(1 + noise - np.einsum("ij,ji->i", cross, np.linalg.solve(k, cross.T))) * y.std(), atol=1e-6)


def test_gaussian_process_of_a_long_trail():
    """100,000 places: memory for the training points alone."""
    import tracemalloc

    x = np.arange(100_000.0)
    y = np.sin(x / 2000)
    tracemalloc.start()
    mean, _ = dsp.gaussian_process(x, y, 2500)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.abs(mean - y).max() < 0.05 and most < 300e6


def test_short_runs_step_by_step_like_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    for n in (2, 3, 30, 700):
        t, h, acc = np.cumsum(rng.uniform(0.01, 0.1, n)), rng.normal(size=n).cumsum(), rng.normal(size=n)
        monkeypatch.setattr(dsp, "_ONE_BY_ONE", 2048)
        one = dsp.fuse_vertical(t, h, acc, 25.0)
        monkeypatch.setattr(dsp, "_ONE_BY_ONE", 1)
        monkeypatch.setattr(dsp, "_fused_steps", None)
        blocks = dsp.fuse_vertical(t, h, acc, 25.0)
        monkeypatch.undo()
        assert np.allclose(one, blocks, rtol=1e-9, atol=1e-9), n


def test_series_are_warped_along_one_path(monkeypatch):
    rng, found, own = np.random.default_rng(5), [], dsp.warping_path
    base, other, third = rng.normal(size=(3, 60))
    third[7] = np.nan
    monkeypatch.setattr(dsp, "warping_path", lambda *a: found.append(own(*a)) or found[-1])
    got = dsp.warp_all(base, other, [other, third])
    assert len(found) == 1
    for values, series in zip((other, third), got):
        places = [[values[j] for i, j in found[0] if i == k] for k in range(60)]
        assert np.array_equal(series, dsp.filled(np.array([np.median(p) if p else np.nan for p in places])))


def test_runs_as_arrays_across_batches(spark):
    """Runs longer than a batch, runs that end with one, a null key; a kernel that drops rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, i, float(i * k)) for k, n in ((1, 7), (2, 20), (3, 1), (4, 14)) for i in range(n)] + [(None, 0, 1.0)]
        df = spark.createDataFrame(rows, "k long, i long, y double").repartition(3)
        kernel = lambda own: {"k": own["k"][::2], "i": own["i"][::2], "total": np.full(len(own["k"][::2]), own["y"].sum())}
        got = {tuple(r) for r in dsp.per_run_arrays(df, "k", ["i"], kernel, "k long, i long, total double").collect()}
        assert got == {(k, i, float(k * n * (n - 1) // 2)) for k, n in ((1, 7), (2, 20), (3, 1), (4, 14)) for i in range(0, n, 2)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
