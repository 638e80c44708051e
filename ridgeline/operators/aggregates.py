"""Aggregates over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import scalar as S
from ridgeline.operators.sequences import Ordered
from ridgeline.sources.shared import written


def _intervals_s(df: DataFrame, o: Ordered, ns: str) -> DataFrame:
    return df.withColumn("_dt", (F.col(ns) - o.lag(ns)) * 1e-9)


def median_interval(df: DataFrame, o: Ordered, ns: str = "unix_ns", default: float = 1.0) -> DataFrame:
    """Median seconds between rows of each run."""
    return _intervals_s(df, o, ns).groupBy(*o.by).agg(F.coalesce(F.percentile("_dt", F.lit(0.5)), F.lit(default)).alias("median_dt_s"))


def sample_rate(df: DataFrame, o: Ordered, ns: str = "unix_ns", default: float = 25.0) -> DataFrame:
    """One over the median of the positive intervals."""
    positive = F.when(F.col("_dt") > 0, F.col("_dt"))
    return _intervals_s(df, o, ns).groupBy(*o.by).agg(F.coalesce(1 / F.percentile(positive, F.lit(0.5)), F.lit(default)).alias("sample_rate_hz"))


def smoothness(v: str) -> Column:
    return 1 / (F.stddev_pop(v) + 1e-6)


def half_span(v: str, share: float = 0.99, low: float = 2.0, high: float = 45.0) -> Column:
    """A symmetric axis's half span: 1.12 times a percentile of the magnitude, within bounds."""
    return F.least(F.greatest(1.12 * F.percentile(F.abs(v), F.lit(share)), F.lit(low)), F.lit(high))


def capped_percentile(v: str, share: float, most: float) -> Column:
    return F.least(F.percentile(v, F.lit(share)), F.lit(most))


def nearest_rank(v: str, share: float) -> Column:
    """The value of rank ceil(share * n)."""
    return F.expr(f"percentile_disc({share}) within group (order by `{v}`)")


# Fixed values of a tight view in degrees: the least span, the margin as a share of the span and of the least span, the bounds of width over height.
VIEW_SPAN, VIEW_PAD, VIEW_LEAST_PAD, VIEW_ASPECT = 0.00035, 0.12, 0.45, (0.35, 2.85)


def tight_view(df: DataFrame, by: list[str], lat: str, lon: str) -> DataFrame:
    """by, min and max of latitude and longitude with margins, aspect (width over height as it looks on the ground, within bounds) and lon_lat_ratio. Over finite places."""
    box = df.groupBy(*by).agg(*[f(S.finite(F.col(c))).alias(f"{n}_{c}") for c in (lat, lon) for n, f in (("min", F.min), ("max", F.max))]).where(F.col(f"min_{lat}").isNotNull() & F.col(f"min_{lon}").isNotNull())
    for c in (lat, lon):
        pad = F.greatest(F.greatest(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(VIEW_SPAN)) * VIEW_PAD, F.lit(VIEW_SPAN * VIEW_LEAST_PAD))
        box = box.withColumn("_p", pad).withColumns({f"min_{c}": F.col(f"min_{c}") - F.col("_p"), f"max_{c}": F.col(f"max_{c}") + F.col("_p")}).drop("_p")
    middle = F.cos(F.radians((F.col(f"min_{lat}") + F.col(f"max_{lat}")) / 2))
    shape = (F.col(f"max_{lon}") - F.col(f"min_{lon}")) * middle / F.greatest(F.col(f"max_{lat}") - F.col(f"min_{lat}"), F.lit(1e-9))
    return box.withColumns({"aspect": S.clamp(shape, *VIEW_ASPECT), "lon_lat_ratio": 1 / F.greatest(middle, F.lit(0.2))})


#: Ranks are sought among at most so many values of a group at a time; targets are sent to all tasks up to this number.
CELL, TARGETS_SENT = 100_000, 1_000_000
_CELLS = 4096


def floor_percentiles(df: DataFrame, by: list[str], v: str, shares: dict[str, float], cell: int | None = None) -> DataFrame:
    """by, and for each name the finite value of index floor(share * n) in rising order, or the last one. Groups without any are left out.

    By counting: values fall into cells between a group's least and greatest one, a rank's cell is the next range to look into, and so
    on until its values are few or all alike; then those are put in order. Rounds count in steps of the size and of its logarithm
    in turn, so neither one far value nor values of very different sizes make many rounds. No group comes together in a task."""
    cell = CELL if cell is None else cell
    rows = _finite(df, v).select(*by, F.col(v).cast("double").alias("_v"))
    named = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("share")) for n, s in shares.items()])
    first = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).select("*", F.explode(named).alias("_p"))
    rank = F.least(F.floor(F.col("_p.share") * F.col("_n")).cast("long"), F.col("_n") - 1)
    targets = written(first.select(*by, F.col("_p.name").alias("_name"), rank.alias("_rank"), "_n", "_lo", "_hi"), "ranks")
    of = [F.col(c).alias(f"_of_{c}") for c in by]
    meet = lambda t: [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] + [F.col("_v").between(F.col("_lo"), F.col("_hi"))]
    sent = lambda t: F.broadcast(t) if t.count() <= TARGETS_SENT else t
    far, turn = (F.col("_n") > cell) & (F.col("_lo") < F.col("_hi")), 0
    while not targets.where(far).isEmpty():
        way = (lambda c: F.signum(c) * F.log1p(F.abs(c))) if turn % 2 else (lambda c: c)
        share = (way(F.col("_v")) - way(F.col("_lo"))) / F.nullif(way(F.col("_hi")) - way(F.col("_lo")), F.lit(0.0))
        at = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * _CELLS), F.lit(_CELLS - 1)).cast("int")
        wide = targets.where(far)
        met = rows.join(sent(wide.select(*of, "_name", "_rank", "_lo", "_hi")), meet(wide)).groupBy(*by, "_name", "_rank", at.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_n").over(Window.partitionBy(*by, "_name").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))  # _CELLS rows at most
        found = met.withColumn("_upto", upto).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
        found = found.select(*by, "_name", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), "_n", "_lo", "_hi")
        targets, turn = written(targets.where(~far).unionByName(found), "ranks"), turn + 1
    counts = rows.join(sent(targets.select(*of, "_name", "_rank", "_lo", "_hi")), meet(targets)).groupBy(*by, "_name", "_rank", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("_upto", upto).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in shares])


def robust_range(df: DataFrame, by: list[str], v: str, low: float = 0.02, high: float = 0.98, pad: float = 0.08, least_span: float = 0.0, most: float | None = None, least: float | None = None) -> DataFrame:
    """An axis's ends from nearest-rank percentiles, widened by a share of the span, kept within the data and the bounds, and at least so wide.

    Groups of fewer than four finite values, or whose bounds leave nothing, get no range."""
    own = _finite(df, v).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), nearest_rank(v, low).alias("_a"), nearest_rank(v, high).alias("_b"), F.min(v).alias("_min"), F.max(v).alias("_max")).where("_n >= 4")
    middle = (F.col("_a") + F.col("_b")) / 2
    eps = F.greatest(F.lit(1e-6), 1e-4 * F.abs(middle))
    own = own.withColumn("_e", F.when(F.col("_b") - F.col("_a") < eps, eps).otherwise(0.0)).withColumn("_a", F.col("_a") - F.col("_e")).withColumn("_b", F.col("_b") + F.col("_e"))
    own = own.withColumn("_w", (F.col("_b") - F.col("_a")) * pad).withColumn("_a", F.greatest(F.col("_a") - F.col("_w"), F.col("_min") - F.col("_w"))).withColumn("_b", F.least(F.col("_b") + F.col("_w"), F.col("_max") + F.col("_w")))
    bound = lambda d: d.withColumns({"_a": F.greatest("_a", F.lit(least)) if least is not None else F.col("_a"), "_b": F.least("_b", F.lit(most)) if most is not None else F.col("_b")})
    own = bound(own)
    own = own.withColumn("_s", F.greatest(least_span - (F.col("_b") - F.col("_a")), F.lit(0.0)) / 2).withColumns({"_a": F.col("_a") - F.col("_s"), "_b": F.col("_b") + F.col("_s")})
    return bound(own).where("_b > _a").select(*by, F.col("_a").alias("low"), F.col("_b").alias("high"))


def robust_symmetric(df: DataFrame, by: list[str], v: str, high: float = 0.98, pad: float = 0.06, least_span: float = 0.0, most: float | None = None) -> DataFrame:
    """An axis around 0 from a nearest-rank percentile of the magnitude, widened by a share, within a bound and at least so wide."""
    own = _finite(df, v).withColumn("_v", F.abs(v)).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), nearest_rank("_v", high).alias("_h")).where("_n >= 4")
    half = F.col("_h") * (1 + pad) if most is None else F.least(F.col("_h") * (1 + pad), F.lit(most))
    own = own.withColumn("_h", half).where("_h > 0").withColumn("high", F.greatest(2 * F.col("_h"), F.lit(least_span)) / 2)
    return own.select(*by, (-F.col("high")).alias("low"), "high")


def _finite(df: DataFrame, v: str) -> DataFrame:
    return df.where(F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def median_and_mad(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """by, median, mad: the median of the distances from the median."""
    medians = df.groupBy(*by).agg(F.percentile(v, F.lit(0.5)).alias("median"))
    return df.join(medians, by).groupBy(*by, "median").agg(F.percentile(F.abs(F.col(v) - F.col("median")), F.lit(0.5)).alias("mad"))


def dispersion(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """Across runs: median, population sigma, dispersion around the median, confidence, reliability and a 95 % band."""
    medians = df.groupBy(*by).agg(F.percentile(v, F.lit(0.5)).alias("median"), F.stddev_pop(v).alias("sigma"), F.count(F.lit(1)).alias("n"))
    spread = df.join(medians, by).groupBy(*by, "median", "sigma", "n").agg(F.sqrt(F.avg(F.pow(F.col(v) - F.col("median"), F.lit(2.0)))).alias("dispersion"))
    spread = spread.withColumn("confidence", F.sqrt(F.col("sigma") * F.col("sigma") + F.col("dispersion") * F.col("dispersion")))
    return spread.withColumns({"reliability": 1 / (1 + F.col("confidence")), "low": F.col("median") - 1.96 * F.col("confidence"), "high": F.col("median") + 1.96 * F.col("confidence")})


def run_durations(df: DataFrame, o: Ordered, time: str) -> DataFrame:
    return df.groupBy(*o.by).agg((F.max(time) - F.min(time)).alias("duration_s"))


def slowest(durations: DataFrame, key: str) -> DataFrame:
    """The run of greatest duration, the least key on ties: the default baseline."""
    return durations.groupBy().agg(F.min(F.struct((-F.col("duration_s")).alias("d"), key)).alias("b")).select(f"b.{key}", (-F.col("b.d")).alias("duration_s"))


def bounds(df: DataFrame, by: list[str], lat: str, lon: str, pad: float = 0.05) -> DataFrame:
    """Geographic bounds with a margin, and width over height."""
    box = df.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in (lat, lon) for n, f in (("min", F.min), ("max", F.max))])
    for c in (lat, lon):
        margin = (F.col(f"max_{c}") - F.col(f"min_{c}")) * pad
        box = box.withColumn("_m", margin).withColumn(f"min_{c}", F.col(f"min_{c}") - F.col("_m")).withColumn(f"max_{c}", F.col(f"max_{c}") + F.col("_m")).drop("_m")
    return box.withColumn("aspect", (F.col(f"max_{lon}") - F.col(f"min_{lon}")) * F.cos(F.radians((F.col(f"max_{lat}") + F.col(f"min_{lat}")) / 2)) / F.nullif(F.col(f"max_{lat}") - F.col(f"min_{lat}"), F.lit(0.0)))


def symmetric_range(df: DataFrame, by: list[str], v: str, least: float = 0.75) -> DataFrame:
    """by, low, high: an axis around 0, of 1.2 times the magnitude of index floor(0.98 n), at least so much. Over the finite values of a group."""
    sizes = df.select(*by, F.abs(v).alias("_size"))
    bound = F.greatest(1.2 * F.col("_at"), F.lit(least))
    return floor_percentiles(sizes, by, "_size", {"_at": 0.98}).select(*by, (-bound).alias("low"), bound.alias("high"))


def axis_range(v: str, least_pad: float = 1.0) -> tuple[Column, Column]:
    """Least and greatest finite value, widened by 12 % of the span or so much at least; a single value by 1."""
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), F.col(v))
    low, high = F.min(finite), F.max(finite)
    pad = F.when(low == high, 1.0).otherwise(F.greatest((high - low) * 0.12, F.lit(least_pad)))
    return low - pad, high + pad


def finite_summary(df: DataFrame, by: list[str], v: str, order: str) -> DataFrame:
    """by, low, high, last: least, greatest and latest of the finite values."""
    finite = F.when(F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.col(v))
    return df.groupBy(*by).agg(F.min(finite).alias("low"), F.max(finite).alias("high"), F.max(F.when(finite.isNotNull(), F.struct(order, v))).alias("_l")).select(*by, "low", "high", F.col(f"_l.{v}").alias("last"))


def total_distance(df: DataFrame, o: Ordered, distance: str = "distance_m") -> DataFrame:
    """One row: the greatest of the runs' last distances, 0 without any."""
    last = df.groupBy(*o.by).agg(F.max(F.struct(*o.order, distance)).alias("_l"))
    return last.agg(F.greatest(F.coalesce(F.max(f"_l.{distance}"), F.lit(0.0)), F.lit(0.0)).alias("total_m"))
