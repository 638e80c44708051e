"""Comparing runs: time against distance, sectors, stretches of high difference, pace against a reference. Rows, not arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators import aggregates as A
from ridgeline.operators import generators as G
from ridgeline.operators import joins as J
from ridgeline.operators import sequences as Q


def time_on_grid(runs: DataFrame, grid: DataFrame, by: list[str], distance: str = "distance_m", time: str = "time_s") -> DataFrame:
    """A run's time at each grid distance; of equal distances the latest time counts, beyond the ends the end's."""
    last = runs.groupBy(*by, distance).agg(F.max(time).alias(time))
    return J.interpolate(grid, last, by, distance, [time])


def overlap(a: DataFrame, b: DataFrame, by: list[str], distance: str = "distance_m") -> DataFrame:
    """For each pair the lesser of its runs' greatest distances."""
    most = lambda d, n: d.groupBy(*by).agg(F.max(distance).alias(n))
    return most(a, "_a").join(most(b, "_b"), by).select(*by, F.least("_a", "_b").alias("shared_m"))


def delta_t(a: DataFrame, b: DataFrame, by: list[str], step: float, distance: str = "distance_m", time: str = "time_s") -> DataFrame:
    """by, grid_index, distance_m, t_a_s, t_b_s, delta_t_s on 0, step, ... below the pair's shared distance."""
    grid = G.distance_grid(overlap(a, b, by, distance), by, "shared_m", step, distance)
    on_a = time_on_grid(a, grid, by, distance, time).withColumnRenamed(time, "t_a_s")
    on_b = time_on_grid(b, grid, by, distance, time).select(*by, "grid_index", F.col(time).alias("t_b_s"))
    return on_a.join(on_b, [*by, "grid_index"]).withColumn("delta_t_s", F.col("t_b_s") - F.col("t_a_s"))


def pace(runs: DataFrame, reference: DataFrame, by: list[str], distance: str = "distance_m", time: str = "time_s", cell: float = 256.0) -> DataFrame:
    """Runs against a reference (distance, time), at the reference's places from 0 to the overlap: t_run_s, t_reference_s, delta_t_s. Overlaps of one place are left out.

    Runs ask for the cells of places that they reach, and meet the reference there."""
    limits = runs.groupBy(*by).agg(F.max(distance).alias("_most")).where("_most >= 0")
    reached = limits.withColumn("_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_most") / cell))))
    places = reference.where(F.col(distance) >= 0).select(distance, F.col(time).alias("t_reference_s"), F.floor(F.col(distance) / cell).alias("_cell"))
    held = reached.join(places, "_cell").where(F.col(distance) <= F.col("_most")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where("_n >= 2").drop("_n", "_most", "_cell")
    return time_on_grid(runs, held, by, distance, time).withColumnRenamed(time, "t_run_s").withColumn("delta_t_s", F.col("t_run_s") - F.col("t_reference_s"))


def pins(deltas: DataFrame, by: list[str], n: int = 8, least: float = 0.02, distance: str = "distance_m") -> DataFrame:
    """The greatest losses of each run: rank, distance, delta."""
    w = Window.partitionBy(*by).orderBy(F.desc("delta_t_s"), distance)
    return deltas.where(F.col("delta_t_s") > least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*by, "rank", distance, "delta_t_s")


def high_delta(deltas: DataFrame, by: list[str], width: int = 21, factor: float = 2.0, order: str = "grid_index") -> DataFrame:
    """Adds high: the boxed magnitude of the gradient exceeds median + factor * MAD; false on shorter series."""
    o = Q.Ordered(by, order)
    inner = (o.lead("delta_t_s") - o.lag("delta_t_s")) / 2
    slope = F.coalesce(inner, o.lead("delta_t_s") - F.col("delta_t_s"), F.col("delta_t_s") - o.lag("delta_t_s"), F.lit(0.0))
    rows = deltas.withColumn("_slope", F.abs(slope)).withColumn("_box", Q.box("_slope", o, width)).withColumn("_n", F.count(F.lit(1)).over(o.all))
    half = lambda c: F.percentile(c, F.lit(0.5)).over(o.all)  # noqa: E731  all windows share one dealing of the rows
    rows = rows.withColumn("_median", half("_box")).withColumn("_mad", half(F.abs(F.col("_box") - F.col("_median"))))
    return rows.withColumn("high", (F.col("_n") >= width) & (F.col("_box") > F.col("_median") + factor * (F.col("_mad") + 1e-9))).drop("_slope", "_box", "_n", "_median", "_mad")


def sector_table(samples: DataFrame, sectors: DataFrame, by: list[str], distance: str = "distance_m", time: str = "time_s", speed: str = "vz_m_s") -> DataFrame:
    """For each run and sector: the time from the last sample at or before its start to that at or before its end (the first sample if there is none), and the mean speed inside.

    Times at the edges come by an as-of join; samples go to the sectors that hold them, not to all of their run."""
    edges = sectors.select(*by, F.explode(F.array("d0", "d1")).alias(distance)).distinct()
    known = samples.where(F.col(distance).isNotNull()).select(*by, distance, time)
    at = J.asof(edges, known, by, distance, [time], direction="backward")
    first = known.groupBy(*by).agg(F.min(F.struct(distance, time)).alias("_first")).select(*by, F.col(f"_first.{time}").alias("_first"))
    at = at.join(first, by).select(*by, F.col(distance).alias("_d"), F.coalesce(time, "_first").alias("_t"))
    edge = lambda d, t: at.select(*by, F.col("_d").alias(d), F.col("_t").alias(t))
    timed = sectors.join(edge("d0", "_t0"), [*by, "d0"]).join(edge("d1", "_t1"), [*by, "d1"]).select(*by, "id", "d0", "d1", (F.col("_t1") - F.col("_t0")).alias("sector_s"))
    inside = J.in_intervals(samples.select(*by, distance, speed), sectors.select(*by, "id", "d0", "d1"), distance, "d0", "d1", by)
    means = inside.groupBy(*by, "id").agg(F.avg(speed).alias("mean_speed"), F.count(F.lit(1)).alias("n_samples"))
    return timed.join(means, [*by, "id"], "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))


def sector_deltas(runs: DataFrame, reference: DataFrame, by: list[str], sectors: DataFrame, distance: str = "distance_m", time: str = "time_s", speed: str = "vz_m_s") -> DataFrame:
    """by, id, d0, d1, reference_s, reference_speed, delta_s, delta_speed: each run's time and mean speed in each sector against the reference's.

    Times at a sector's ends lie on the line between samples; delta_s is the run's time less the reference's, delta_speed the reference's
    mean speed less the run's, null where either has no sample inside. sectors: id, d0, d1, the same for all runs; reference: distance, time, speed."""
    everywhere = F.lit(0).alias("_all")
    edges = sectors.select(everywhere, F.explode(F.array("d0", "d1")).alias(distance)).distinct()
    keys = runs.select(*by).distinct()
    asked = keys.crossJoin(F.broadcast(edges.drop("_all")))  # some sectors' ends for each run
    at = {"run": time_on_grid(runs, asked, by, distance, time), "reference": time_on_grid(reference.withColumn("_all", F.lit(0)), edges, ["_all"], distance, time)}
    edge = lambda who, d, t: at[who].select(*(by if who == "run" else []), F.col(distance).alias(d), F.col(time).alias(t))
    out = keys.crossJoin(F.broadcast(sectors.select("id", "d0", "d1")))
    out = out.join(edge("run", "d0", "_r0"), [*by, "d0"]).join(edge("run", "d1", "_r1"), [*by, "d1"]).join(F.broadcast(edge("reference", "d0", "_f0")), "d0").join(F.broadcast(edge("reference", "d1", "_f1")), "d1")
    known = F.col(speed).isNotNull() & ~F.isnan(speed) & (F.abs(speed) != float("inf"))
    inside = lambda rows, own: J.in_intervals(rows.where(known).select(*own, distance, speed), sectors.select("id", "d0", "d1"), distance, "d0", "d1").groupBy(*own, "id").agg(F.avg(speed).alias("_v"))
    out = out.join(inside(runs, by).withColumnRenamed("_v", "_run_v"), [*by, "id"], "left").join(F.broadcast(inside(reference, []).withColumnRenamed("_v", "reference_speed")), "id", "left")
    reference_s = F.col("_f1") - F.col("_f0")
    return out.select(*by, "id", "d0", "d1", reference_s.alias("reference_s"), "reference_speed", (F.col("_r1") - F.col("_r0") - reference_s).alias("delta_s"), (F.col("reference_speed") - F.col("_run_v")).alias("delta_speed"))


def comparison(a: DataFrame, b: DataFrame, by: list[str], step: float = 1.0, altitude: str = "altitude_smooth_m") -> DataFrame:
    """Two aligned runs as rows of a common grid: delta_t's columns, high, and both altitudes there."""
    rows = high_delta(delta_t(a, b, by, step), by)
    grid = rows.select(*by, "grid_index", "distance_m")
    for runs, name in ((a, "altitude_a_m"), (b, "altitude_b_m")):
        on = J.interpolate(grid, runs.groupBy(*by, "distance_m").agg(F.max(altitude).alias(name)), by, "distance_m", [name])
        rows = rows.join(on.drop("distance_m"), [*by, "grid_index"])
    return rows


def against_reference(runs: DataFrame, reference: DataFrame, by: list[str], altitude: str = "altitude_smooth_m", width: int = 21) -> DataFrame:
    """pace's rows of each run with the reference's altitude and time sigma at the place, the run's own altitude, and high.

    reference: distance_m, time_s, altitude_m, time_sigma_s (null counts as 0)."""
    paced = pace(runs, reference, by)
    places = reference.groupBy("distance_m").agg(F.min("altitude_m").alias("reference_altitude_m"), F.coalesce(F.min("time_sigma_s"), F.lit(0.0)).alias("t_reference_sigma_s"))
    rows = paced.join(places, "distance_m").withColumn("grid_index", F.row_number().over(Window.partitionBy(*by).orderBy("distance_m")) - 1)
    own = runs.groupBy(*by, "distance_m").agg(F.max(altitude).alias("altitude_m"))
    on = J.interpolate(rows.select(*by, "grid_index", "distance_m"), own, by, "distance_m", ["altitude_m"]).drop("distance_m")
    return high_delta(rows.join(on, [*by, "grid_index"]), by, width)


def compact_reference(reference: DataFrame) -> DataFrame:
    """A reference's places with finite distance, time and altitude; a sigma that is not finite counts as 0."""
    kept = Q.aligned(reference, ["distance_m", "time_s", "altitude_m"])
    sigma = F.col("time_sigma_s")
    return kept.withColumn("time_sigma_s", F.when(sigma.isNull() | F.isnan(sigma) | (F.abs(sigma) == float("inf")), 0.0).otherwise(sigma))


def against_baseline(runs: DataFrame, baseline: DataFrame, by: list[str], columns: list[str], distance: str = "distance_m", default: float = 0.0) -> DataFrame:
    """Every sample of the runs with the difference of each column from the baseline's at the same distance, as delta_<column>.

    baseline: by, distance and the columns; it is interpolated linearly and constant beyond its ends. Where either is missing the difference is the default."""
    line = baseline.where(F.col(distance).isNotNull()).groupBy(*by, distance).agg(*[F.max(c).alias(f"_b_{c}") for c in columns])
    held = J.interpolate(runs, line, by, distance, [f"_b_{c}" for c in columns])
    return held.withColumns({f"delta_{c}": F.coalesce(F.col(c) - F.col(f"_b_{c}"), F.lit(default)) for c in columns}).drop(*[f"_b_{c}" for c in columns])


def pin_rows(samples: DataFrame, found: DataFrame, by: list[str], order: str, distance: str = "distance_m") -> DataFrame:
    """For each pin (by, rank, distance) the nearest sample's order value, the first on ties, by an as-of join."""
    near = J.asof(found.select(*by, "rank", distance), samples.groupBy(*by, distance).agg(F.min(order).alias(order)), by, distance, [order])
    return near.select(*by, "rank", distance, order)
