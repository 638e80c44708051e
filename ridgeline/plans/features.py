"""Events of a ride: braking, flights and landings, by islands and windows. Signals come filtered (see plans.run)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators import joins as J
from ridgeline.operators import sequences as Q

BRAKING_M_S2, FLIGHT_G, STRICT_G, LANDING_G, TAKEOFF_G = -3.0, 0.55, 0.33, 1.3, 1.15
LEAST_FLIGHT_S, TAKEOFF_S, LANDING_S = 0.20, 0.2, 0.5
FAST_DESCENT, WITNESSED_DESCENT = -5.0, -1.5


def braking_columns(df: DataFrame, acc: str, o: Q.Ordered, width: int) -> DataFrame:
    """Adds mtb_braking_ma_ms2, mtb_braking_active, mtb_braking_intensity from a centred mean of the forward acceleration."""
    rows = df.withColumn("mtb_braking_ma_ms2", Q.rolling_mean(acc, o, width))
    return rows.withColumns({"mtb_braking_active": F.coalesce(F.col("mtb_braking_ma_ms2") < BRAKING_M_S2, F.lit(False)), "mtb_braking_intensity": F.coalesce(F.abs(F.least("mtb_braking_ma_ms2", F.lit(0.0))), F.lit(0.0))})


def braking_at_rate(df: DataFrame, acc: str, o: Q.Ordered, ns: str = "unix_ns") -> DataFrame:
    """braking_columns with a window of half a second: rows from the half second's rows before to those after, by time."""
    keys = ", ".join(f"`{k}`" for k in o.by)
    at = f"over (partition by {keys} order by `{ns}` range between 250000000 preceding and 249999999 following)"
    rows = df.withColumn("mtb_braking_ma_ms2", F.expr(f"avg(`{acc}`) {at}"))
    return rows.withColumns({"mtb_braking_active": F.coalesce(F.col("mtb_braking_ma_ms2") < BRAKING_M_S2, F.lit(False)), "mtb_braking_intensity": F.coalesce(F.abs(F.least("mtb_braking_ma_ms2", F.lit(0.0))), F.lit(0.0))})


def braking(df: DataFrame, acc: str, o: Q.Ordered, width: int, distance: str = "distance_m") -> DataFrame:
    """Braking intervals: by, island, start_m, end_m, intensity (the greatest)."""
    rows = braking_columns(df, acc, o, width)
    rows = rows.withColumn("_new", (F.col("mtb_braking_active") & ~F.coalesce(o.lag("mtb_braking_active"), F.lit(False))).cast("int")).withColumn("island", F.sum("_new").over(o.past))
    return rows.where("mtb_braking_active").groupBy(*o.by, "island").agg(F.min(distance).alias("start_m"), F.max(distance).alias("end_m"), F.max("mtb_braking_intensity").alias("intensity"))


def flights(df: DataFrame, o: Q.Ordered, rate: str, flight: str, raw: str, sustained: str, vz: str, moving: Column) -> DataFrame:
    """Candidate flights, accepted or not: by, island, first_row, last_row, n_rows, start_row, duration_s, takeoff_g, landing_g, kind.

    A candidate is an island of low total acceleration in motion. It must last, keep below the (in a fast descent stricter)
    limit for a while without a break, and end in a landing; it is a jump after a take-off, else a drop, and a drop is
    witnessed by the barometer if it sinks. Rejected ones have the reason as their kind. rate: a column with the samples a second."""
    n = lambda seconds: F.round(F.col(rate) * seconds).cast("long")
    least = F.greatest(F.lit(3), F.ceil(F.col(rate) * LEAST_FLIGHT_S)).cast("long")
    rows = df.withColumn("_i", o.number().cast("long")).withColumn("_on", F.coalesce((F.coalesce(F.col(flight), F.lit(1.0)) < FLIGHT_G) & moving, F.lit(False)))
    rows = rows.withColumn("_new", (F.col("_on") & ~F.coalesce(o.lag("_on"), F.lit(False))).cast("int")).withColumn("island", F.sum("_new").over(o.past))
    held = rows.where("_on")
    own = [*o.by, "island"]
    sizes = held.groupBy(*own, rate).agg(F.min("_i").alias("first_row"), F.max("_i").alias("last_row"), F.count(F.lit(1)).alias("n_rows"), F.percentile(vz, F.lit(0.5)).alias("median_vz"))
    sizes = sizes.withColumn("least_rows", least).withColumn("limit", F.when(F.col("median_vz") < FAST_DESCENT, STRICT_G).otherwise(FLIGHT_G))
    inner = held.select(*own, "_i", F.col(flight).alias("_f")).join(sizes.select(*own, "limit", "least_rows"), own)
    w = Window.partitionBy(*own).orderBy("_i")
    low = inner.withColumn("_low", F.coalesce(F.col("_f") < F.col("limit"), F.lit(False)))
    low = low.withColumn("_cut", (F.col("_low") & ~F.coalesce(F.lag("_low").over(w), F.lit(False))).cast("int")).withColumn("part", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = low.where("_low").groupBy(*own, "part", "least_rows").agg(F.min("_i").alias("start_row"), F.max("_i").alias("end_row"), F.count(F.lit(1)).alias("part_rows")).where("part_rows >= least_rows")
    best = parts.groupBy(*own).agg(F.min(F.struct((-F.col("part_rows")).alias("a"), "start_row", "end_row")).alias("b")).select(*own, "b.start_row", "b.end_row")
    found = sizes.join(best, own, "left")
    around = found.select(*own, "start_row", "end_row", (F.col("start_row") - n(TAKEOFF_S)).alias("_from"), (F.col("end_row") + n(LANDING_S)).alias("_to")).where("start_row is not null")
    signals = rows.select(*o.by, "_i", F.col(raw).alias("_raw"), F.col(sustained).alias("_land"))
    near = J.in_intervals(signals, around, "_i", "_from", "_to", o.by)
    peaks = near.groupBy(*own).agg(F.max(F.when(F.col("_i") < F.col("start_row"), F.col("_raw"))).alias("takeoff_g"), F.max(F.when(F.col("_i") > F.col("end_row"), F.col("_land"))).alias("landing_g"))
    found = found.join(peaks, own, "left")
    kind = (
        F.when(F.col("n_rows") < F.col("least_rows"), "candidate_too_short").when(F.col("start_row").isNull(), "refine_duration").when(~F.coalesce(F.col("landing_g") >= LANDING_G, F.lit(False)), "landing_peak")
        .when((F.col("start_row") > 1) & (F.col("takeoff_g") >= TAKEOFF_G), "jump").when(F.col("median_vz") < WITNESSED_DESCENT, "witnessed_drop").otherwise("drop")
    )
    return found.withColumn("kind", kind).withColumn("duration_s", (F.col("end_row") - F.col("start_row") + 1) / F.col(rate)).drop("least_rows", "limit")


ACCEPTED = ("jump", "drop", "witnessed_drop")


def airtime(found: DataFrame, by: list[str]) -> DataFrame:
    """by, airtime_s, jumps, drops, witnessed_drops, max_landing_g of accepted flights."""
    ok = F.col("kind").isin(*ACCEPTED)
    return found.groupBy(*by).agg(F.coalesce(F.sum(F.when(ok, F.col("duration_s"))), F.lit(0.0)).alias("airtime_s"), F.count_if(F.col("kind") == "jump").alias("jumps"), F.count_if(F.col("kind").isin("drop", "witnessed_drop")).alias("drops"), F.count_if(F.col("kind") == "witnessed_drop").alias("witnessed_drops"), F.max(F.when(ok, F.col("landing_g"))).alias("max_landing_g"))


def almost(found: DataFrame, by: list[str], most: int = 25) -> DataFrame:
    """Rejected candidates of runs without airtime, at most so many for each: a debug list."""
    none = airtime(found, by).where("airtime_s = 0").select(*by)
    w = Window.partitionBy(*by).orderBy("first_row")
    return found.where(~F.col("kind").isin(*ACCEPTED)).join(none, by, "left_semi").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def simple_airtime(df: DataFrame, by: list[str], raw: str, moving: Column, rate: str, limit: float = FLIGHT_G) -> DataFrame:
    """by, simple_airtime_s: samples of low total acceleration in motion, over the samples a second."""
    low = (F.col(raw) < limit) & ~F.isnan(raw) & moving
    return df.groupBy(*by).agg((F.count_if(low) / F.max(rate)).alias("simple_airtime_s"))
