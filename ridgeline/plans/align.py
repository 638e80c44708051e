"""Aligning two runs: the corridor they share, where their altitudes agree, the lag between their climbs, gates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import dsp
from ridgeline.functions import scalar as S
from ridgeline.operators import generators as G
from ridgeline.operators import joins as J
from ridgeline.operators import sequences as Q
from ridgeline.plans import compare, features
from ridgeline.sources import readers
from ridgeline.sources.shared import written

RADIUS_M, SPAN_M, FORWARD_M, ONWARD_M, BACK_M = 12.0, 50.0, 35.0, 140.0, 8.0


def shared_corridor(a: DataFrame, b: DataFrame, by: list[str], radius: float = RADIUS_M) -> DataFrame:
    """For each pair the longest stretch on which b keeps beside a in the same direction: first and last bin of both, matches, and the median and 95th percentile of the distance.

    Both runs are binned by metres; bins within the radius match; a jump ahead or back ends a stretch; both spans must be long enough."""
    o = Q.Ordered(by, "unix_ns")
    bins = [Q.first_of_bin(d, "distance_m", 1.0, o).select(*by, "bin", "latitude", "longitude") for d in (a, b)]
    centre = bins[0].unionByName(bins[1]).groupBy(*by).agg(F.percentile("latitude", F.lit(0.5)).alias("_la"), F.percentile("longitude", F.lit(0.5)).alias("_lo"))

    def flat(d: DataFrame, name: str) -> DataFrame:
        x, y = S.local_xy(F.col("latitude"), F.col("longitude"), F.col("_la"), F.col("_lo"))
        return d.join(centre, by).select(*by, F.col("bin").alias(name), x.alias("x"), y.alias("y"))

    near = J.nearest_in_cells(flat(bins[0], "a"), flat(bins[1], "b"), radius, by, "a", "b")
    w = Q.Ordered(by, ["a", "b"])
    da, db = F.col("a") - w.lag("a"), F.col("b") - w.lag("b")
    groups = Q.sessions(near, (da > FORWARD_M) | (db < -max(BACK_M, radius)) | (db > ONWARD_M), w, "stretch")
    found = groups.groupBy(*by, "stretch").agg(F.min("a").alias("a_start"), F.max("a").alias("a_end"), F.min_by("b", "a").alias("b_start"), F.max_by("b", "a").alias("b_end"), F.count(F.lit(1)).alias("n_matches"), F.percentile("distance", F.lit(0.5)).alias("median_m"), F.percentile("distance", F.lit(0.95)).alias("p95_m"))
    found = found.where((F.col("n_matches") >= 2) & (F.col("a_end") - F.col("a_start") >= SPAN_M) & (F.col("b_end") - F.col("b_start") >= SPAN_M))
    best = Window.partitionBy(*by).orderBy(F.desc(F.col("a_end") - F.col("a_start")), "stretch")
    return found.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "stretch")


# Why a pair is or isn't cut where its altitudes begin to agree.
MISSING, SHORT, FEW, AGREES, LITTLE, TRIMMED = "missing_altitude", "overlap_too_short", "not_enough_altitude", "already_agrees", "trim_would_leave_too_little", "leading_altitude_disagreement"


def altitude_agreement(a: DataFrame, b: DataFrame, by: list[str], altitude: str | None = None, step: float = 1.0, within: float = 5.0, sustained_m: float = 35.0, width_m: float = 25.0, least: float = 80.0) -> DataFrame:
    """by, trim_m, reason, stable_offset_m, initial_residual_m, residual_at_start_m: from where on the two altitudes agree, but for a constant, over a sustained stretch.

    The constant is the median difference over the last 55 % of the shared grid, whose last place is the last one up to half a step
    beyond the shared distance. altitude: a column of both, by default the first of ALTITUDES that each has. Pairs of which a run has
    no altitude or under four rows, share too little, or have under four finite altitudes are not cut; nor are those whose altitudes
    agree from the start on or nowhere, or which would be too short then."""
    names = [altitude or next((c for c in ALTITUDES if c in d.columns), None) for d in (a, b)]
    sides = [d.withColumn("_h", S.finite(F.col(n).cast("double")) if n else F.lit(None).cast("double")) for d, n in zip((a, b), names)]
    sizes = [d.groupBy(*by).agg(F.count(F.lit(1)).alias(f"_n{k}"), F.count_if(F.col("_h").isNotNull() & F.col("distance_m").isNotNull()).alias(f"_f{k}"), F.max("distance_m").alias(f"_d{k}")) for k, d in enumerate(sides)]
    pairs = sizes[0].join(sizes[1], by).withColumn("_most", F.least("_d0", "_d1"))
    reason = F.when(F.lit(None in names) | (F.least("_n0", "_n1") < 4), MISSING).when(F.col("_most").isNull() | (F.col("_most") < max(least, sustained_m + width_m)), SHORT).when(F.least("_f0", "_f1") < 4, FEW)
    pairs = written(pairs.select(*by, "_most", reason.alias("_why")), "pairs")
    grid = written(G.distance_grid(pairs.where("_why is null").withColumn("_end", F.col("_most") + step / 2), by, "_end", step), "grid")
    heights = [compare.time_on_grid(d.where("_h is not null and distance_m is not null"), grid, by, time="_h") for d in sides]
    both = heights[0].join(heights[1].select(*by, "grid_index", F.col("_h").alias("_other")), [*by, "grid_index"]).withColumn("diff", F.col("_h") - F.col("_other"))
    o = Q.Ordered(by, "grid_index")
    offset = F.percentile(F.when(F.col("grid_index") >= F.floor(0.45 * F.count(F.lit(1)).over(o.all)), F.col("diff")), F.lit(0.5)).over(o.all)
    rows = both.withColumn("_offset", offset).withColumn("_r", F.abs(F.col("diff") - F.col("_offset")))
    rows = Q.with_rolling_median(rows.select(*by, "grid_index", "distance_m", "_offset", "_r"), "_r", o, max(3, round(width_m / step)), "_m")
    rows = written(rows, "residuals")
    first = Q.first_sustained(rows, F.col("_m") <= within, o, max(3, round(sustained_m / step)), "grid_index")
    found = rows.join(first, by).groupBy(*by).agg(
        F.max("_offset").alias("stable_offset_m"), F.max(F.when(F.col("grid_index") == 0, F.col("_m"))).alias("initial_residual_m"),
        *[F.max(F.when(F.col("grid_index") == F.col("first_grid_index"), F.col(c))).alias(n) for c, n in (("distance_m", "_at"), ("_m", "residual_at_start_m"))],
    )
    out = pairs.join(found, by, "left")
    why = F.coalesce("_why", F.when(F.coalesce("_at", F.lit(0.0)) <= 0, AGREES).when(F.col("_most") - F.col("_at") < least, LITTLE).otherwise(TRIMMED))
    out = out.withColumn("reason", why)
    cut = F.col("reason") == TRIMMED
    return out.select(*by, F.when(cut, F.col("_at")).otherwise(0.0).alias("trim_m"), "reason", "stable_offset_m", "initial_residual_m", F.when(cut, F.col("residual_at_start_m")).alias("residual_at_start_m"))


def climb_lag(a: DataFrame, b: DataFrame, by: str, vz: str = "vz_m_s", most_m: float | None = 100.0, least: int = 32) -> DataFrame:
    """by, lag_s, lag_samples, peak, n_samples, median_dt_s: samples are paired by index; within most_m of a's start if that leaves `least`."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in (by, "lag_s", "lag_samples", "peak", "n_samples", "median_dt_s")})
        left, right = left.sort_values("unix_ns"), right.sort_values("unix_ns")
        n = min(len(left), len(right))
        x, y = left[vz].to_numpy(float)[:n], right[vz].to_numpy(float)[:n]
        if most_m is not None and (own := left["distance_m"].to_numpy()[:n] <= most_m).sum() >= least:
            x, y = x[own], y[own]
        gaps = np.diff(right["unix_ns"].to_numpy()) * 1e-9
        step = float(np.median(gaps[gaps > 0])) if (gaps > 0).any() else 0.04
        lag, peak = dsp.best_lag(np.nan_to_num(x), np.nan_to_num(y), step)
        return pd.DataFrame({by: [left[by].iloc[0]], "lag_s": [lag], "lag_samples": [round(lag / max(step, 1 / 500))], "peak": [peak], "n_samples": [len(x)], "median_dt_s": [step]})

    cut = lambda d: d.select(*[F.col(c).alias(c) for c in (by, "unix_ns", "distance_m", vz)])
    return cut(a).groupBy(by).cogroup(cut(b).groupBy(by)).applyInPandas(kernel, f"{by} long, lag_s double, lag_samples long, peak double, n_samples long, median_dt_s double")


ALTITUDES = ("altitude_smooth_m", "altitude_m", "relative_altitude_app_m")


def altitude_column(rows: DataFrame) -> str:
    """The altitude that alignment goes by; an error if there is none."""
    if name := next((c for c in ALTITUDES if c in rows.columns), None):
        return name
    raise ValueError(f"none of {', '.join(ALTITUDES)} is there")


def with_climb(rows: DataFrame, by: str, some: bool = False) -> DataFrame:
    """rows with vz_m_s, worked out from the altitude where the column is missing: the smoothed gradient over time.

    some: the column may be there and empty in some runs; these get theirs from the first altitude that they have."""
    if "vz_m_s" in rows.columns and not some:
        return rows
    names = [c for c in ALTITUDES if c in rows.columns] if some else [altitude_column(rows)]
    rows = rows if "vz_m_s" in rows.columns else rows.withColumn("vz_m_s", F.lit(None).cast("double"))

    def kernel(own: pd.DataFrame) -> pd.DataFrame:
        name = next((c for c in names if own[c].notna().any()), None)
        if own["vz_m_s"].notna().any() or name is None:
            return own
        t = (own["unix_ns"].to_numpy() - own["unix_ns"].iloc[0]) * 1e-9
        gaps = np.diff(t)
        rate = 1 / float(np.median(gaps[gaps > 0])) if (gaps > 0).any() else 25.0
        return own.assign(vz_m_s=dsp.smooth(dsp.vertical_velocity(own[name].to_numpy(float), t), rate, 0.55, 2))

    return dsp.per_run(rows, by, ["unix_ns"], kernel, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes))


def runs_of_payloads(df: DataFrame, payload: str, by: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON payloads that alignment can take, a run for each payload, climbs worked out where they are missing; and what was left out (see readers.read_payloads)."""
    rows, bad = readers.read_payloads(df, payload, [by], climb="required")
    return with_climb(rows.drop("extra"), by, some=True), bad


def with_known_distance(rows: DataFrame, by: str) -> DataFrame:
    """rows with distance_m: as it is in runs that have any finite one, else summed up from the places."""
    o = Q.Ordered(by, "unix_ns")
    known = rows if "distance_m" in rows.columns else rows.withColumn("distance_m", F.lit(None).cast("double"))
    step = F.coalesce(S.haversine_m(o.lag("latitude"), o.lag("longitude"), F.col("latitude"), F.col("longitude")), F.lit(0.0))
    some = F.count_if(F.col("distance_m").isNotNull() & ~F.isnan("distance_m")).over(o.all) > 0
    summed = known.withColumn("_step", step).withColumn("_sum", F.sum("_step").over(o.past))
    return summed.withColumn("distance_m", F.when(some, F.col("distance_m")).otherwise(F.col("_sum"))).drop("_step", "_sum")


def ready(rows: DataFrame, by: str) -> DataFrame:
    """rows with what alignment needs and payloads may lack: distance_m (also where a run has none), time_s, vz_m_s from the altitude."""
    rows = with_known_distance(rows, by)
    return with_climb(rows if "time_s" in rows.columns else Q.with_elapsed(rows, Q.Ordered(by, "unix_ns")), by)


def rezero(rows: DataFrame, o: Q.Ordered) -> DataFrame:
    return rows.withColumns({c: F.col(c) - F.min(c).over(o.all) for c in ("distance_m", "time_s")})


def gate_rows(rows: DataFrame, by: str, lat: float, lon: float, radius: float) -> DataFrame:
    """by, gate_row (from 1), inside: each run's first row within the radius of the gate, else its nearest row."""
    numbered = rows.withColumn("_rn", Q.Ordered(by, "unix_ns").number())
    d = S.haversine_m(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude"))
    return J.first_or_nearest(numbered, d, radius, [by], "_rn").select(by, F.col("_rn").alias("gate_row"), "inside")


def from_row(rows: DataFrame, gates: DataFrame, by: str) -> DataFrame:
    """Each run from its gate row to its end, from zero again."""
    o = Q.Ordered(by, "unix_ns")
    gate = gates.select(F.col(by).alias("_by"), F.col("gate_row").alias("_gate"))
    numbered = rows.withColumn("_rn", o.number())
    return rezero(numbered.join(gate, F.col(by) == F.col("_by")).where(F.col("_rn") >= F.col("_gate")).drop("_rn", "_by", "_gate"), o)


def gate_line(rows: DataFrame, gates: DataFrame, by: str, half_width: float = 12.0) -> DataFrame:
    """by, gate_row, latitude, longitude, bearing_deg and the ends of a line across the way of travel at each run's gate row: left and right of it.

    Travel is towards the next row, at the last row from the one before. Runs of one row have no bearing."""
    o = Q.Ordered(by, "unix_ns")
    e, n = F.col("_e"), F.col("_n")
    step = lambda c: F.coalesce(o.lead(c) - F.col(c), F.col(c) - o.lag(c))
    middle = F.coalesce((o.lead("latitude") + F.col("latitude")) / 2, (o.lag("latitude") + F.col("latitude")) / 2)
    moves = rows.withColumns({"_rn": o.number(), "_e": F.radians(step("longitude")) * F.cos(F.radians(middle)) * S.EARTH_RADIUS_M, "_n": F.radians(step("latitude")) * S.EARTH_RADIUS_M})
    size = F.sqrt(e * e + n * n) + 1e-9
    at = moves.join(gates.select(F.col(by).alias("_by"), "gate_row"), (F.col(by) == F.col("_by")) & (F.col("_rn") == F.col("gate_row")))
    end = lambda sign: S.offset_position(F.col("latitude"), F.col("longitude"), -n / size * sign * half_width, e / size * sign * half_width)
    (lat_a, lon_a), (lat_b, lon_b) = end(-1.0), end(1.0)
    return at.select(by, "gate_row", "latitude", "longitude", F.degrees(F.atan2(e, n)).alias("bearing_deg"), lat_a.alias("gate_lat_a"), lon_a.alias("gate_lon_a"), lat_b.alias("gate_lat_b"), lon_b.alias("gate_lon_b"))


def gate_of(meta: DataFrame, by: str) -> DataFrame:
    """The gate lines that there are in rows about alignments: by, and an array of its two ends (longitude, latitude)."""
    ends = F.array(*[F.struct(F.col(f"gate_lon_{s}").alias("longitude"), F.col(f"gate_lat_{s}").alias("latitude")) for s in "ab"])
    return meta.where("gate_lon_a is not null and gate_lon_b is not null").select(by, ends.alias("gate_line"))


def equal_length(a: DataFrame, b: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both runs of each pair, cut to the shorter one's rows."""
    o = Q.Ordered(by, "unix_ns")
    n = a.groupBy(*by).count().withColumnRenamed("count", "_a").join(b.groupBy(*by).count().withColumnRenamed("count", "_b"), by).select(*by, F.least("_a", "_b").alias("_most"))
    return tuple(d.withColumn("_rn", o.number()).join(n, by).where(F.col("_rn") <= F.col("_most")).drop("_rn", "_most") for d in (a, b))


def shared_distance(a: DataFrame, b: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Both runs up to the lesser of their greatest distances; pairs without a common distance have no rows."""
    most = compare.overlap(a, b, [by]).where("shared_m > 0")
    return tuple(d.join(most, by).where(F.col("distance_m") <= F.col("shared_m")).drop("shared_m") for d in (a, b))


def _finish(a: DataFrame, b: DataFrame, by: str, moves: float) -> tuple[DataFrame, DataFrame]:
    """From the first to the last climb or descent, up to the shared distance, braking worked out anew."""
    o = Q.Ordered(by, "unix_ns")
    a, b = shared_distance(*(rezero(Q.edge_trim(d, F.abs("vz_m_s") > moves, o), o) for d in (a, b)), by)
    anew = lambda d: features.braking_at_rate(d, "acc_y_filt", o) if "acc_y_filt" in d.columns else d
    return anew(a), anew(b)


def align_gate(a: DataFrame, b: DataFrame, by: str, lat: float, lon: float, radius: float = 20.0, moves: float = 0.03, most_m: float = 100.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both runs from a gate on, cut to one length, from their first to their last climb or descent, up to the distance that they share; with a row on the alignment for each pair.

    The row has the gate rows and places of both, the gate line across a's way, the rows after the cut, and climb_lag's columns."""
    a, b = ready(a, by), ready(b, by)
    gates = [gate_rows(d, by, lat, lon, radius) for d in (a, b)]
    line = gate_line(a, gates[0], by).withColumnsRenamed({"gate_row": "gate_row_a", "latitude": "gate_latitude_a", "longitude": "gate_longitude_a"})
    other = gate_line(b, gates[1], by).select(by, F.col("gate_row").alias("gate_row_b"), F.col("latitude").alias("gate_latitude_b"), F.col("longitude").alias("gate_longitude_b"))
    a, b = (written(d, "runs") for d in equal_length(from_row(a, gates[0], by), from_row(b, gates[1], by), [by]))
    lags = climb_lag(a, b, by, most_m=most_m)
    cropped = a.groupBy(by).agg(F.count(F.lit(1)).alias("cropped_rows"))
    a, b = _finish(a, b, by, moves)
    return a, b, lags.join(line, by, "left").join(other, by, "left").join(cropped, by, "left").withColumn("quality", S.sync_label(F.col("peak")))


def align_auto(a: DataFrame, b: DataFrame, by: str, moves: float = 0.03, most_m: float = 100.0, least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both runs over the corridor that they share, from where their altitudes agree, cut to one length and to the distance that they share; with a row on the alignment for each pair.

    Pairs of which fewer than `least` rows are left have the reason too_few_rows, and no rows."""
    o = Q.Ordered(by, "unix_ns")
    a, b = ready(a, by), ready(b, by)
    found = written(shared_corridor(a, b, [by]), "corridor")
    cut = lambda d, s: rezero(d.join(found.select(by, F.col(f"{s}_start").alias("_lo"), F.col(f"{s}_end").alias("_hi")), by).where(F.floor("distance_m").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi"), o)
    a, b = written(cut(a, "a"), "runs"), written(cut(b, "b"), "runs")
    agreed = written(altitude_agreement(a, b, [by]), "agreement")
    tail = lambda d: rezero(d.join(agreed.select(by, "trim_m"), by).where(F.col("distance_m") >= F.col("trim_m")).drop("trim_m"), o)
    a, b = (written(d, "runs") for d in equal_length(tail(a), tail(b), [by]))
    cropped = a.groupBy(by).agg(F.count(F.lit(1)).alias("cropped_rows"))
    few = F.coalesce("cropped_rows", F.lit(0)) < least
    a, b = (d.join(cropped.where(~few).select(by), by, "left_semi") for d in (a, b))
    first = a.select(by, F.lit(1).alias("gate_row")).distinct()
    line = gate_line(a, first, by).drop("gate_row").withColumnsRenamed({"latitude": "gate_latitude_a", "longitude": "gate_longitude_a"})
    lags = climb_lag(a, b, by, most_m=most_m)
    a, b = _finish(a, b, by, moves)
    meta = found.join(agreed, by).join(cropped, by, "left").withColumn("reason", F.when(few, "too_few_rows").otherwise(F.col("reason")))
    return a, b, meta.join(lags, by, "left").join(line, by, "left").withColumn("quality", S.sync_label(F.col("peak")))
