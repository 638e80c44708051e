"""A canonical reference from several runs of one trail, and how sure it is."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import dsp
from ridgeline.functions import scalar as S
from ridgeline.operators import aggregates as A
from ridgeline.operators import generators as G
from ridgeline.operators import sequences as Q
from ridgeline.plans import compare
from ridgeline.sources.shared import written


def corrected_altitude(runs: DataFrame, by: str) -> DataFrame:
    """runs with altitude_m from the pressure, corrected for speed by the density at the run's mean height; without a pressure from the first altitude that there is. Without any, an error."""
    if "pressure_mbar" in runs.columns:
        o = Q.Ordered(by, "unix_ns")
        speed = F.col("speed_m_s") if "speed_m_s" in runs.columns else F.lit(0.0)
        plain = S.hypsometric_m(F.col("pressure_mbar"))
        density = S.air_density(F.coalesce(F.avg(S.finite(plain)).over(o.all), F.lit(0.0)))
        return runs.withColumn("altitude_m", S.finite(S.hypsometric_m(F.col("pressure_mbar") + S.dynamic_pressure_mbar(density, speed))))
    name = next((c for c in ("altitude_from_pressure_m", "altitude_smooth_m", "altitude_m") if c in runs.columns), None)
    if name is None:
        raise ValueError("telemetry has neither a pressure nor an altitude")
    return runs.withColumn("altitude_m", S.finite(F.col(name)))


def vertical_acceleration(runs: DataFrame, by: str) -> DataFrame:
    """runs with vertical_acc, upward, from what there is: total acceleration along gravity less gravity, acceleration along gravity, the z axis less its median, or 0."""
    axes = lambda t: [f"{t}_{a}_filt" for a in "xyz"]
    has = lambda names: all(c in runs.columns for c in names)
    size = F.greatest(S.magnitude(*[F.col(c) for c in axes("gravity")]), F.lit(1e-6))
    along = lambda t: sum((F.col(a) * F.col(g) for a, g in list(zip(axes(t), axes("gravity")))[1:]), F.col(axes(t)[0]) * F.col(axes("gravity")[0])) / size
    if has(axes("gravity")) and has(axes("total_acc")):
        value = S.GRAVITY_M_S2 - along("total_acc")
    elif has(axes("gravity")) and has(axes("acc")):
        value = -along("acc")
    elif "acc_z_filt" in runs.columns:
        value = F.col("acc_z_filt") - F.percentile("acc_z_filt", F.lit(0.5)).over(Q.Ordered(by, "unix_ns").all)
    else:
        value = F.lit(0.0)
    return runs.withColumn("vertical_acc", S.finite(value))


def fuse(runs: DataFrame, by: str = "run_id") -> DataFrame:
    """Height and climb of each run, from its corrected altitude and its vertical acceleration, fused by a Kalman filter: by, distance_m, time_s, altitude_m, vz_m_s. Runs of under four places or a metre go."""
    runs = vertical_acceleration(corrected_altitude(runs, by), by)

    def kernel(own: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        t, h = np.asarray(own["time_s"], float), dsp.filled(np.asarray(own["altitude_m"], float))
        rate = 1 / max(float(np.median(np.diff(t))) if len(t) > 1 else 0.04, 1e-3)
        trend = dsp.low_pass(h, rate, min(0.35, max(0.03, rate / 80)), 2)
        r = h - trend
        phi = float(np.clip((r[:-1] * r[1:]).sum() / ((r[:-1] ** 2).sum() + 1e-12), -0.98, 0.98)) if len(r) > 1 else 0.0
        white = trend + np.concatenate((r[:1], r[1:] - phi * r[:-1]))
        acc = dsp.filled(np.asarray(own["vertical_acc"], float))
        height, climb = dsp.fuse_vertical(t, white, acc, rate)
        # Of one distance the first in time.
        d = np.asarray(own["distance_m"], float)
        at = np.lexsort((t, d))
        there = d[at]
        at = at[np.concatenate(([True], (there[1:] != there[:-1]) & ~np.isnan(there[:-1])))]
        known = d[at][~np.isnan(d[at])]
        if len(at) < 4 or not len(known) or known[-1] - known[0] <= 1:
            at = at[:0]
        return {by: own[by][at], "distance_m": d[at], "time_s": t[at], "altitude_m": height[at], "vz_m_s": climb[at]}

    names = [by, "unix_ns", "distance_m", "time_s", "altitude_m", "vertical_acc"]
    return dsp.per_run_arrays(runs.select(*names), by, ["unix_ns"], kernel, f"{by} long, distance_m double, time_s double, altitude_m double, vz_m_s double")


def synthesise(runs: DataFrame, trail: str, by: str = "run_id", step: float = 1.0) -> DataFrame:
    """trail, distance_m, time_s, time_sigma_s, altitude_m, vz_m_s, grade, sigma_m, confidence_m, reliability, low_m, high_m: a reference for each trail of at least two runs.

    Times are medians over runs on a common grid; altitudes and climbs of the other runs are warped onto the first run's and averaged, and a Gaussian process smooths the outcome.
    Each run belongs to one trail and is warped in a task of its own; a trail meets again as one averaged profile, a row for each step."""
    fused = written(fuse(runs, by).join(runs.select(trail, by).distinct(), by), "fused")
    limits = fused.groupBy(trail, by).agg(F.max("distance_m").alias("_d")).groupBy(trail).agg((F.floor(F.min("_d") / step) * step + step / 2).alias("_most"), F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    grid = G.distance_grid(fused.select(trail, by).distinct().join(limits, trail), [trail, by], "_most", step)
    own = fused
    rows = grid
    for c in ("time_s", "altitude_m", "vz_m_s"):
        rows = rows.join(compare.time_on_grid(own, grid, [trail, by], time=c).select(trail, by, "grid_index", c), [trail, by, "grid_index"])
    rows = written(rows, "gridded")
    times = A.dispersion(rows, [trail, "distance_m"], "time_s").select(trail, "distance_m", F.col("median").alias("time_s"), F.col("sigma").alias("time_sigma_s"))

    onto = _warped(rows.select(trail, by, "grid_index", "distance_m", "altitude_m", "vz_m_s"), trail, by)
    o = Q.Ordered([trail, by], "grid_index")
    slope = F.coalesce((o.lead("altitude_m") - o.lag("altitude_m")) / 2, o.lead("altitude_m") - F.col("altitude_m"), F.col("altitude_m") - o.lag("altitude_m"), F.lit(0.0)) / step
    onto = written(onto.withColumn("_q", Q.srvf(slope)), "warped")
    half = lambda c: F.percentile(c, F.lit(0.5))
    place = [trail, "grid_index", "distance_m"]
    mean = onto.groupBy(*place).agg(F.avg("_q").alias("_q"), half("vz_m_s").alias("_climb"), F.stddev_pop("altitude_m").alias("_spread"), half("altitude_m").alias("_mid"))
    around = onto.join(mean.select(*place, "_mid"), place).groupBy(*place).agg(F.sqrt(F.avg(F.pow(F.col("altitude_m") - F.col("_mid"), F.lit(2.0)))).alias("_around"))
    t = Q.Ordered(trail, "grid_index")
    shape = F.coalesce(F.sum(F.col("_q") * F.abs(F.col("_q")) * step).over(t.rows(Window.unboundedPreceding, -1)), F.lit(0.0))
    profile = mean.withColumn("_shape", shape)
    level = onto.join(profile.select(*place, "_shape"), place).groupBy(trail).agg(half(F.col("altitude_m") - F.col("_shape")).alias("_level"))
    profile = profile.join(level, trail).join(around, place).select(trail, "grid_index", "distance_m", (F.col("_shape") + F.col("_level")).alias("shape"), "_climb", "_spread", "_around")

    def kernel(own: pd.DataFrame) -> pd.DataFrame:
        d, climb = own["distance_m"].to_numpy(), own["_climb"].to_numpy()
        height, sigma = dsp.gaussian_process(d, own["shape"].to_numpy())
        width = min(21, len(climb) - 1 | 1)
        if 3 <= width < len(climb):
            climb = dsp.local_polynomial(climb, width, 2)
        sure = np.sqrt(sigma**2 + own["_spread"].to_numpy() ** 2 + own["_around"].to_numpy() ** 2)
        grade = np.gradient(height, step) if len(d) > 1 else np.zeros(len(d))
        return pd.DataFrame({trail: own[trail].to_numpy(), "distance_m": d, "altitude_m": height, "vz_m_s": climb, "grade": grade, "sigma_m": sigma, "confidence_m": sure, "reliability": 1 / (1 + sure), "low_m": height - 1.96 * sure, "high_m": height + 1.96 * sure})

    names = ["altitude_m", "vz_m_s", "grade", "sigma_m", "confidence_m", "reliability", "low_m", "high_m"]
    smooth = dsp.per_run(profile, trail, ["grid_index"], kernel, f"{trail} long, distance_m double, " + ", ".join(f"{n} double" for n in names))
    return times.join(smooth, [trail, "distance_m"])


def _warped(rows: DataFrame, trail: str, by: str) -> DataFrame:
    """rows (trail, by, grid_index, distance_m, altitude_m, vz_m_s) with altitudes and climbs of each run warped onto its trail's first run: a task holds two runs at a time."""
    first = rows.groupBy(trail).agg(F.min(by).alias("_first"))
    base = rows.join(first, trail).where(F.col(by) == F.col("_first")).select(trail, "grid_index", F.col("vz_m_s").alias("_base"))
    both = rows.join(base, [trail, "grid_index"]).join(first, trail)

    def kernel(own: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        if own[by][0] == own["_first"][0]:
            return {c: own[c] for c in names}
        base, v, h = (own[c] for c in ("_base", "vz_m_s", "altitude_m"))
        height, climb = dsp.warp_all(base, v, [h, v])
        return {c: own[c] for c in names} | {"altitude_m": height, "vz_m_s": climb}

    names = [trail, by, "grid_index", "distance_m", "altitude_m", "vz_m_s"]
    return dsp.per_run_arrays(both, by, ["grid_index"], kernel, f"{trail} long, {by} long, grid_index long, distance_m double, altitude_m double, vz_m_s double")
