"""Payloads and exports: columns as arrays, JSON without what JSON lacks, full-rate files."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The telemetry's columns in the order of the payload.
TELEMETRY_COLUMNS = ["unix_ns", "latitude", "longitude", "speed_m_s", "gps_altitude_m", "altitude_m", "altitude_smooth_m", "distance_m", "time_s", "vz_m_s", "vz_smooth_m_s", "gps_wgs84_residual_m", "sanity_pressure_minus_app_m", "mtb_raw_total_g", "mtb_total_accel_g", "mtb_lean_deg", "mtb_braking_active", "mtb_braking_intensity"]


def json_safe(df: DataFrame) -> DataFrame:
    """Numbers that JSON can't hold become null."""
    return df.select(*[F.when(~F.isnan(n) & (F.abs(n) != float("inf")), F.col(n)).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])


def export_columns(df: DataFrame, also: list[str] | None = None) -> DataFrame:
    return df.select(*(also or []), *[c for c in TELEMETRY_COLUMNS if c in df.columns])


def columns_of(df: DataFrame, by: list[str], order: str, names: list[str]) -> DataFrame:
    """A row for each run with an array for each column, in order. A run's rows come together: decimate first."""
    rows = json_safe(df.select(*by, F.col(order).alias("_order"), *[F.col(n).alias(f"c_{n}") for n in names]))
    packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_order", *[f"c_{n}" for n in names]))).alias("_rows"))
    pick = lambda n: F.transform("_rows", lambda r: r[f"c_{n}"]).alias(n)
    return packed.select(*by, *[pick(n) for n in names])


def run_payload(runs: DataFrame, stats: DataFrame, by: str = "run_id", order: str = "unix_ns") -> DataFrame:
    """by, payload: JSON of a run's telemetry, altitude against distance, and stats."""
    names = [c for c in TELEMETRY_COLUMNS if c in runs.columns]
    telemetry = columns_of(runs, [by], order, names)
    profile = F.struct(*[F.col(n).alias(m) for n, m in (("distance_m", "distance_m"), ("altitude_smooth_m", "altitude_m")) if n in names])
    own = [c for c in stats.columns if c != by]
    body = F.struct(F.struct(*names).alias("telemetry"), profile.alias("altitude_vs_distance"), *own)
    return telemetry.join(stats, by, "left").select(by, F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


OFF = ("0", "false", "no", "off")
_SAYS = """Calculated runs at their full rate.
runs/run=<id>/*.csv   all columns of a run
meta/*.json           a line for each run: rows, columns, and its figures
"""


def export_runs(runs: DataFrame, meta: DataFrame, root: str, tag: str = "session", by: str = "run_id", enabled: str | Column | None = "1") -> str | None:
    """Full-rate CSV files by run, a JSON line for each and a note on what they are, in a folder of its own below root: <UTC time>_<tag>_<hex>. Its path; None if switched off by 0, false, no or off."""
    if str(enabled).strip().lower() in OFF:
        return None
    stamp, safe = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ"), re.sub(r"[^\w\-.]+", "_", tag)[:64]
    path = f"{root.rstrip('/')}/{stamp}_{safe}_{uuid.uuid4().hex[:6]}"
    json_safe(runs).withColumn("run", F.col(by)).write.partitionBy("run").option("header", True).csv(f"{path}/runs")
    counts = runs.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("columns", F.array(*map(F.lit, runs.columns)))
    counts.join(meta.drop("n_rows", "columns"), by, "left").write.json(f"{path}/meta")
    runs.sparkSession.createDataFrame([(_SAYS.strip(),)], "value string").coalesce(1).write.option("lineSep", "\n").text(f"{path}/README")
    return path


def folder_summary(runs: DataFrame, by: str = "run_id") -> DataFrame:
    """One row: run_count, points of the first run, and the names of its columns in order, as JSON (summary)."""
    sizes = runs.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.agg(F.count(F.lit(1)).alias("run_count"), F.coalesce(F.min_by("n", by), F.lit(0)).alias("points"))
    return first.withColumn("sample_keys", F.array(*map(F.lit, sorted(c for c in runs.columns if c != by)))).select(F.to_json(F.struct("run_count", "points", "sample_keys")).alias("summary"))
