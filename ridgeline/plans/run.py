"""From streams to a processed run: common clock, places, altitude, speed, motion. Runs are rows of one table, dealt by run_id.

All streams meet the clock in one pass; rates, levelling and densities are windows over the same dealing; the recursive filters
are one kernel over a run's rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import dsp
from ridgeline.functions import scalar as S
from ridgeline.operators import aggregates as A
from ridgeline.operators import generators as G
from ridgeline.operators import joins as J
from ridgeline.operators import sequences as Q
from ridgeline.plans import features
from ridgeline.sources.shared import written

STEP_NS, TOLERANCE_NS = 10_000_000, 50_000_000
O = Q.Ordered("run_id", "unix_ns")  # noqa: E741
TRIPLES = ("acc", "gravity", "total_acc", "gyro", "acc_uncal", "gyro_uncal")
# Cutoff in Hz and order of each triple's filter.
FILTERS = {"acc": (10.0, 4), "gravity": (3.0, 4), "total_acc": (4.0, 2)}


def on_clock(baro: DataFrame, gps: DataFrame, motion: DataFrame | None = None, step_ns: int = STEP_NS) -> DataFrame:
    """A clock of step_ns over each run's barometer, with the nearest barometer and motion rows and interpolated places, in one pass.

    motion: long rows (run_id, unix_ns, stream, x, y, z); streams that aren't there give null columns."""
    span = baro.groupBy("run_id").agg(F.min("unix_ns").alias("a"), F.max("unix_ns").alias("b"))
    grid = G.clock(span, ["run_id"], "a", "b", step_ns)
    ordered = Q.Ordered("run_id", ["unix_ns", *[c for c in gps.columns if c not in ("run_id", "unix_ns")]])  # of one time in any order of the rows the same
    good = Q.drop_step_outliers(Q.drop_inaccurate(gps, "horizontal_accuracy_m", ordered), ordered)
    places = ["latitude", "longitude", "speed_m_s", "gps_altitude_m"]
    streams = [J.Stream(baro, {c: F.col(c) for c in baro.columns if c not in ("run_id", "unix_ns")}, TOLERANCE_NS)]
    if motion is not None:
        streams += [J.Stream(motion, {f"{t}_{a}": F.col(a) for a in "xyz"}, TOLERANCE_NS, where=F.col("stream") == t, ties="last") for t in TRIPLES]
    return J.on_grid(grid, [*streams, J.Stream(good, {c: F.col(c) for c in places}, interpolated=True, ties="first")], ["run_id"], "unix_ns")


def level(rows: DataFrame, rate: str = "rate") -> DataFrame:
    """Turn all motion triples so that the mean gravity of the first two seconds is upright; runs without enough gravity stay. Adds virtual_level_applied."""
    present = [t for t in TRIPLES if f"{t}_x" in rows.columns]
    if "gravity" not in present:
        return rows.withColumn("virtual_level_applied", F.lit(False))
    rows = rows.withColumn("_first", O.number() <= F.greatest(F.lit(3), F.round(2 * F.col(rate))))
    mean = {f"_g{a}": F.avg(F.when(F.col("_first"), F.col(f"gravity_{a}"))).over(O.all) for a in "xyz"}
    rows = rows.withColumns(mean | {"_n": F.count_if(F.col("_first")).over(O.all)})
    x, y, z = (F.col(f"_g{a}") for a in "xyz")
    able = F.coalesce((F.col("_n") >= 3) & (S.magnitude(x, y, z) >= 2), F.lit(False))
    rows = rows.withColumn("virtual_level_applied", able).withColumn("_r", F.when(able, S.levelling_matrix(x, y, z)))
    turned = {}
    for t in present:
        axes = [F.col(f"{t}_{a}") for a in "xyz"]
        known = F.coalesce(*axes).isNotNull()
        turned |= {f"{t}_{a}": F.when(F.col("_r").isNotNull() & known, v).otherwise(c) for a, v, c in zip("xyz", S.rotate(*axes, F.col("_r")), axes)}
    return rows.withColumns(turned).drop("_first", "_n", "_gx", "_gy", "_gz", "_r")


def _signals(own: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Altitude, climb and filtered motion of one run in time order."""
    own, numbers = dict(own), lambda c: np.asarray(own[c], float)
    rate, n = float(own["rate"][0]), len(own["rate"])
    t = (own["unix_ns"] - own["unix_ns"][0]) * 1e-9
    pressure, raw = numbers("altitude_corrected_m"), numbers("altitude_m")
    altitude = np.where(np.isfinite(pressure), pressure, raw)
    gps = numbers("gps_altitude_m")
    measured = np.isfinite(gps).any()
    residual = gps - pd.Series(altitude).ffill().bfill().to_numpy() if measured else np.full(n, np.nan)
    own["gps_wgs84_residual_m"] = residual
    own["altitude_m"] = altitude + (dsp.drift(residual, rate) if measured else np.zeros(n))
    own["altitude_filt_m"] = dsp.low_pass(own["altitude_m"], rate, 4.0, 2)
    own["altitude_smooth_m"] = dsp.spline_gaps(t, dsp.smooth(own["altitude_filt_m"], rate))
    climb = dsp.vertical_velocity(dsp.smooth(dsp.low_pass(raw, rate, 4.0, 2), rate), t)
    own["vz_m_s"] = dsp.smooth(climb, rate, 0.55, 2)
    own["vz_smooth_m_s"] = dsp.smooth(dsp.low_pass(own["vz_m_s"], rate, 0.5, 4), rate, 1.5, 2)
    for name, (cutoff, order) in FILTERS.items():
        for a in "xyz":
            own[f"{name}_{a}_filt"] = dsp.low_pass(numbers(f"{name}_{a}"), rate, cutoff, order)
    total = np.sqrt(sum(numbers(f"total_acc_{a}") ** 2 for a in "xyz")) / S.GRAVITY_M_S2
    own["mtb_raw_total_g"] = total
    own["mtb_total_accel_g"] = np.sqrt(sum(own[f"total_acc_{a}_filt"] ** 2 for a in "xyz")) / S.GRAVITY_M_S2
    own["flight_g"] = dsp.low_pass(np.where(np.isfinite(total), total, 1.0), rate, 10.0, 2)
    own["sustained_g"] = pd.Series(own["flight_g"]).rolling(max(1, round(0.1 * rate)), center=True, min_periods=1).mean().to_numpy()
    apart = max(1, int(0.06 * rate))
    felt = np.where(numbers("speed_m_s") > 0.5, own["sustained_g"], 0.0)
    hits = dsp.peaks(felt, features.LANDING_G, apart, 0.35, max(5, min(n - 1, 3 * apart)))
    own["landing_peak_g"] = np.full(n, float(felt[hits].max()) if len(hits) else 0.0)
    return own


_ADDED = ["gps_wgs84_residual_m", "altitude_filt_m", "altitude_smooth_m", "vz_m_s", "vz_smooth_m_s", *[f"{t}_{a}_filt" for t in FILTERS for a in "xyz"], "mtb_raw_total_g", "mtb_total_accel_g", "flight_g", "sustained_g", "landing_peak_g"]


def process(rows: DataFrame, step_ns: int = STEP_NS) -> DataFrame:
    """Rows on a clock of step_ns (see on_clock) to processed rows: altitude, climb, distance, time, motion, braking over half a second."""
    numbers = ["latitude", "longitude", "speed_m_s", "gps_altitude_m", "pressure_mbar", "altitude_m", *[f"{t}_{a}" for t in TRIPLES for a in "xyz"]]
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in numbers if c not in rows.columns})
    rows = rows.withColumn("_dt", (F.col("unix_ns") - O.lag("unix_ns")) * 1e-9)
    rate = 1 / F.percentile(F.when(F.col("_dt") > 0, F.col("_dt")), F.lit(0.5)).over(O.all)
    rows = level(rows.withColumn("rate", F.coalesce(rate, F.lit(25.0))).drop("_dt"))
    hypso = S.hypsometric_m(F.col("pressure_mbar"))
    density = S.air_density(F.avg(hypso).over(O.all))
    corrected = F.col("pressure_mbar") + S.dynamic_pressure_mbar(density, F.col("speed_m_s"))
    rows = rows.withColumn("pressure_mbar_bernoulli_corrected", corrected).withColumn("altitude_corrected_m", F.col("altitude_m") + S.hypsometric_m(F.col("pressure_mbar_bernoulli_corrected")) - hypso)
    if "relative_altitude_app_m" in rows.columns:
        rows = rows.withColumn("sanity_pressure_minus_app_m", hypso - F.col("relative_altitude_app_m"))
    kept = [f"`{c}` {t}" for c, t in rows.dtypes]
    rows = dsp.per_run_arrays(rows, "run_id", ["unix_ns"], _signals, ", ".join([*kept, *[f"{c} double" for c in _ADDED]]))
    rows = Q.with_elapsed(Q.with_distance(rows, O), O).drop("step_m")
    still = F.percentile("gravity_x_filt", F.lit(0.5)).over(O.all)
    rows = rows.withColumn("mtb_lean_deg", S.lean_deg(F.col("gravity_x_filt"), F.col("gravity_z_filt"), still))
    return features.braking_columns(rows, "acc_y_filt", O, max(3, round(0.5e9 / step_ns)))


def run_stats(rows: DataFrame) -> DataFrame:
    """A row for each processed run; the rows are written first, as several branches read them. Without an accepted flight the greatest landing is the highest peak of the sustained acceleration in motion."""
    rows = written(rows, "processed")
    found = features.flights(rows, O, "rate", "flight_g", "mtb_raw_total_g", "sustained_g", "vz_m_s", F.col("speed_m_s") > 0.5)
    base = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("sample_count"), F.max("distance_m").alias("distance_m"), F.max("time_s").alias("duration_s"), A.smoothness("vz_m_s").alias("smoothness_score"), A.half_span("vz_m_s").alias("vz_half_span"), A.capped_percentile("mtb_lean_deg", 0.992, 62.0).alias("lean_deg"), F.max("rate").alias("sample_rate_hz"), F.max("landing_peak_g").alias("_peak"))
    return base.join(features.airtime(found, ["run_id"]), "run_id", "left").withColumn("max_landing_g", F.coalesce("max_landing_g", "_peak")).drop("_peak").withColumns({"airtime_s": F.coalesce("airtime_s", F.lit(0.0)), **{c: F.coalesce(c, F.lit(0)) for c in ("jumps", "drops", "witnessed_drops")}})
