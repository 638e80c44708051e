"""Streaming forms of the sequence operators, on sensor events that may come late. Extensions: batch runs need none of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.scalar import EARTH_RADIUS_M


def windowed(events: DataFrame, by: str, ts: str, value: str, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and means by window and key; events later than `late` are left out."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = events.withWatermark(ts, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return out.select(by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean")


def sessions(events: DataFrame, by: str, ts: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Rides: stretches of a key's events without a gap."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def running_distance(fixes: DataFrame, by: str, ts: str = "ts") -> DataFrame:
    """by, n, distance_m after each batch: the last place and the distance so far are state. Fixes older than the last one of their key are passed over."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("unix_us", kind="stable").drop_duplicates("unix_us")
        n, total = 0, 0.0
        if state.exists:
            t, lat, lon, n, total = state.get
            rows = pd.concat([pd.DataFrame({"unix_us": [t], "latitude": [lat], "longitude": [lon]}), rows[rows["unix_us"] > t]])
        lat, lon = np.radians(rows["latitude"].to_numpy()), np.radians(rows["longitude"].to_numpy())
        a = np.sin(np.diff(lat) / 2) ** 2 + np.cos(lat[:-1]) * np.cos(lat[1:]) * np.sin(np.diff(lon) / 2) ** 2
        total += float((2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(1 - a, 0.0)))).sum())
        n += len(rows) - state.exists
        last = (int(rows["unix_us"].iloc[-1]), float(rows["latitude"].iloc[-1]), float(rows["longitude"].iloc[-1]))
        state.update((*last, n, total))
        yield pd.DataFrame({by: [key[0]], "n": [n], "distance_m": [total]})

    rows = fixes.select(by, F.unix_micros(F.col(ts).cast("timestamp")).alias("unix_us"), "latitude", "longitude")
    return rows.groupBy(by).applyInPandasWithState(update, f"{by} long, n long, distance_m double", "t long, lat double, lon double, n long, total double", "update", GroupStateTimeout.NoTimeout)
