"""Operators on ordered sequences: one sequence for each run, in the order of a unique key. All but the rolling median are window expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions.scalar import haversine_m


class Ordered:
    """The windows of rows `by` a run, in `order`."""

    def __init__(self, by: str | list[str], order: str | list[str]):
        self.by = [by] if isinstance(by, str) else by
        self.order = [order] if isinstance(order, str) else order

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    @property
    def all(self) -> WindowSpec:
        return Window.partitionBy(*self.by)

    @property
    def past(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def future(self) -> WindowSpec:
        """Rows from this one on, in reversed order: a frame that grows by a row is one pass, a frame that shrinks is worked out anew for each row."""
        return Window.partitionBy(*self.by).orderBy(*[F.desc_nulls_last(c) for c in self.order]).rowsBetween(Window.unboundedPreceding, 0)

    def rows(self, a: int, b: int) -> WindowSpec:
        return self.w.rowsBetween(a, b)

    def number(self) -> Column:
        return F.row_number().over(self.w)

    def lag(self, c: str | Column, n: int = 1) -> Column:
        return F.lag(c, n).over(self.w)

    def lead(self, c: str | Column, n: int = 1) -> Column:
        return F.lead(c, n).over(self.w)


def dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """df by keys, in as many parts as the session has for shuffles: adaptive execution joins parts by what is shuffled, which is a small part of
    what windows over exploded rows hold. What is dealt by these keys already is left as it is, so deal rows before their first window."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(k) for k in by])


def with_steps(df: DataFrame, o: Ordered, lat: str = "latitude", lon: str = "longitude", out: str = "step_m") -> DataFrame:
    """Distance from the row before; 0 at the first."""
    return df.withColumn(out, F.coalesce(haversine_m(o.lag(lat), o.lag(lon), F.col(lat), F.col(lon)), F.lit(0.0)))


def with_distance(df: DataFrame, o: Ordered, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """step_m, and distance_m summed up from the start of the run."""
    return with_steps(df, o, lat, lon).withColumn("distance_m", F.sum("step_m").over(o.past))


def with_elapsed(df: DataFrame, o: Ordered, ns: str = "unix_ns", out: str = "time_s") -> DataFrame:
    """Seconds since the run's first row; nanoseconds are subtracted as whole numbers."""
    return df.withColumn(out, (F.col(ns) - F.min(ns).over(o.all)) * 1e-9)


def fill_both(c: str, o: Ordered) -> Column:
    """The last value before or at a row, else the first after it."""
    return F.coalesce(F.last(c, ignorenulls=True).over(o.past), F.last(c, ignorenulls=True).over(o.future))


def fill_linear(df: DataFrame, c: str, o: Ordered, out: str, default: float = 0.0, x: str | None = None) -> DataFrame:
    """Gaps filled linearly between their neighbours by row number (or by x); constant at the ends; default where all is null."""
    at = F.col(x) if x else o.number()
    df = df.withColumn("_x", at.cast("double"))
    known = F.when(F.col(c).isNotNull(), F.struct(F.col("_x").alias("x"), F.col(c).alias("y")))
    df = df.withColumn("_a", F.last(known, ignorenulls=True).over(o.past)).withColumn("_b", F.last(known, ignorenulls=True).over(o.future))
    line = F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * (F.col("_x") - F.col("_a.x")) / F.nullif(F.col("_b.x") - F.col("_a.x"), F.lit(0.0))
    return df.withColumn(out, F.coalesce(F.col(c), line, F.col("_a.y"), F.col("_b.y"), F.lit(default))).drop("_x", "_a", "_b")


def rolling_mean(c: str, o: Ordered, width: int) -> Column:
    """Centred mean over what there is; an even width leans back."""
    return F.avg(c).over(o.rows(-(width // 2), width - 1 - width // 2))


def with_rolling_median(df: DataFrame, c: str, o: Ordered, width: int, out: str) -> DataFrame:
    """Adds the median over width // 2 rows on either side, or what there is of them; nulls and NaN count as missing.

    A sliding order statistic: runs are dealt and sorted by Spark and pass through a task as a stream, of which it holds a
    batch and a window; a row costs the logarithm of the width."""
    half, by = width // 2, o.by

    def medians(values: pa.ChunkedArray) -> np.ndarray:
        series = pd.Series(values.cast(pa.float64()).to_numpy())
        return series.rolling(2 * half + 1, center=True, min_periods=1).median().to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, 0  # rows of the last run that are still needed, and how many of them are done

        def done(rows: pa.Table, first: int, end: int) -> Iterator[pa.RecordBatch]:
            """Rows of one run, from `first` up to `end`."""
            if first < end:
                values = pa.array(medians(rows.column(c))[first:end], from_pandas=True)
                yield from rows.slice(first, end - first).append_column(out, values).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            rows = new if held is None else pa.concat_tables([held, new])
            keys = [rows.column(k).to_pandas() for k in by]
            same = np.logical_and.reduce([(k[1:].to_numpy() == k[:-1].to_numpy()) | (k[1:].isna().to_numpy() & k[:-1].isna().to_numpy()) for k in keys]) if len(rows) > 1 else np.zeros(0, bool)
            cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(rows)]
            for a, b in zip(cuts[:-2], cuts[1:-1]):
                yield from done(rows.slice(a, b - a), seen, b - a)
                seen = 0
            last = rows.slice(cuts[-2])
            ready = max(seen, len(last) - half)
            yield from done(last, seen, ready)
            start = max(0, ready - half)
            held, seen = last.slice(start).combine_chunks(), ready - start
        if held is not None:
            yield from done(held, seen, len(held))

    dealt = df.repartition(*[F.col(k) for k in by]).sortWithinPartitions(*by, *o.order)
    return dealt.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def box(c: str | Column, o: Ordered, width: int) -> Column:
    """Convolution with a box of the same size as the series: the divisor stays, so the ends are drawn to 0."""
    return F.sum(c).over(o.rows(-(width // 2), width // 2)) / width


def gradient(y: str, x: str, o: Ordered) -> Column:
    """dy/dx by central differences of unequal spacing; one-sided at the ends."""
    before, after = F.col(x) - o.lag(x), o.lead(x) - F.col(x)
    down, up = F.col(y) - o.lag(y), o.lead(y) - F.col(y)
    inner = (before / after * up + after / before * down) / (before + after)
    return F.coalesce(inner, up / after, down / before)


def islands(df: DataFrame, flag: Column, o: Ordered, first: str, last: str | None = None) -> DataFrame:
    """Runs of rows on which flag holds: by, island, n_rows, <first>_start, <first>_end (of the row's `first` and `last`)."""
    rows = df.withColumn("_on", F.coalesce(flag, F.lit(False)))
    rows = rows.withColumn("_new", (F.col("_on") & ~F.coalesce(o.lag("_on"), F.lit(False))).cast("int")).withColumn("island", F.sum("_new").over(o.past))
    return rows.where("_on").groupBy(*o.by, "island").agg(F.count(F.lit(1)).alias("n_rows"), F.min(first).alias(f"{first}_start"), F.max(last or first).alias(f"{last or first}_end"))


def longest_island(df: DataFrame, flag: Column, o: Ordered, first: str, least: int = 1) -> DataFrame:
    """The longest of each run's islands of at least so many rows; the first on ties."""
    found = islands(df, flag, o, first).where(F.col("n_rows") >= least)
    return found.withColumn("_k", F.row_number().over(Window.partitionBy(*o.by).orderBy(F.desc("n_rows"), "island"))).where("_k = 1").drop("_k")


def sessions(df: DataFrame, cut: Column, o: Ordered, out: str = "session") -> DataFrame:
    """Number the stretches between rows at which cut holds (it may use o.lag)."""
    return df.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn(out, F.sum("_cut").over(o.past)).drop("_cut")


def first_sustained(df: DataFrame, flag: Column, o: Ordered, n: int, value: str) -> DataFrame:
    """For each run the value at the first row from which flag holds on n rows in a row; null if there is none."""
    rows = df.withColumn("_ok", F.coalesce(flag, F.lit(False)).cast("int"))
    rows = rows.withColumn("_all", (F.min("_ok").over(o.rows(0, n - 1)) == 1) & (F.count("_ok").over(o.rows(0, n - 1)) == n))
    return rows.groupBy(*o.by).agg(F.min(F.when(F.col("_all"), F.col(value))).alias(f"first_{value}"))


#: Sums are exact in steps of 2^-20 for values under 10^20, which are whole numbers of steps from 2^40 on; what is left of smaller ones, and larger values, are summed as doubles.
_STEP, _LARGE, _LARGEST = float(1 << 20), float(1 << 40), 1e20


def with_range_mean(df: DataFrame, y: str, x: str, by: str | list[str], half: float, out: str) -> DataFrame:
    """Adds the mean of y over rows within half of x on either side, both ends included; null where x is, or where no y is known.

    By prefix sums: each row asks for the sums up to x + half and before x - half; rows and questions are one table, dealt by
    key and sorted once, with one running sum, and come back to their rows by key and x. Time does not depend on the width.
    A NaN makes the mean NaN where it lies within, and nowhere else."""
    keys = [by] if isinstance(by, str) else by
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    rows = dealt(rows, [f"_k{i}" for i in range(len(keys))])  # three rows for each one, with their sums, take far more than what is shuffled tells
    rows = rows.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_kind")).withColumn("_at", F.col("_x") + F.col("_kind") * F.lit(float(half)))
    own = F.col("_kind") == 0
    known = own & F.col("_x").isNotNull() & F.col("_y").isNotNull()
    number = known & ~F.isnan("_y")
    small, size = F.abs("_y") < _LARGE, F.abs("_y") < _LARGEST
    steps = F.when(number & small, F.floor(F.col("_y") * _STEP)).otherwise(0)
    whole = F.when(number & ~small & size, (F.col("_y") * _STEP).cast("decimal(28,0)")).otherwise(steps.cast("decimal(28,0)"))
    rest = F.when(number & small, F.col("_y") - steps.cast("double") / _STEP).when(number & ~size, F.col("_y")).otherwise(0.0)
    k = [f"_k{i}" for i in range(len(keys))]
    rows = rows.select(F.when(own, F.col("_row")).alias("_row"), *k, "_x", "_at", "_kind", known.cast("long").alias("_n"), (known & F.isnan("_y")).cast("long").alias("_nan"), whole.alias("_w"), rest.alias("_f"))
    upto = Window.partitionBy(*k).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    sums = F.struct(*[F.sum(c).over(upto).alias(c) for c in ("_n", "_nan", "_w", "_f")])
    rows = rows.withColumn("_s", sums).select("_row", *k, "_x", "_kind", "_s")
    met = Window.partitionBy(*k, "_x")
    side = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("_s"))).over(met)
    rows = rows.withColumn("_low", side(-1)).withColumn("_high", side(1)).where(own)
    part = lambda c: F.col(f"_high.{c}") - F.col(f"_low.{c}")
    mean = (part("_w").cast("double") / _STEP + part("_f")) / F.nullif(part("_n"), F.lit(0)).cast("double")
    value = F.when(F.col("_x").isNotNull(), F.when(part("_nan") > 0, F.lit(float("nan"))).otherwise(mean))
    return rows.select("_row.*", value.alias(out))


def bands(df: DataFrame, level: Column, o: Ordered, x: str) -> DataFrame:
    """Run-length encoding of a level: by, band, level, <x>_start, <x>_end, n_rows."""
    rows = df.withColumn("level", level).withColumn("_prev", o.lag("level"))
    rows = rows.withColumn("_new", (~F.col("level").eqNullSafe(F.col("_prev")) | (o.number() == 1)).cast("int")).withColumn("band", F.sum("_new").over(o.past))
    return rows.groupBy(*o.by, "band", "level").agg(F.min(x).alias(f"{x}_start"), F.max(x).alias(f"{x}_end"), F.count(F.lit(1)).alias("n_rows"))


def with_slope(df: DataFrame, y: str, step: str, o: Ordered, out: str) -> DataFrame:
    """Adds the change of y over a row's step; where there is none, as on a step of 0, that of the row before, 0 at first."""
    rows = df.withColumn("_slope", (F.col(y) - o.lag(y)) / F.nullif(F.col(step), F.lit(0.0)))
    return rows.withColumn(out, F.coalesce(F.last("_slope", ignorenulls=True).over(o.past), F.lit(0.0))).drop("_slope")


def slope_bin(slope: Column, steps: list[float]) -> Column:
    """How many of the rising limits the slope reaches."""
    return sum(((slope >= s).cast("int") for s in steps[1:]), (slope >= steps[0]).cast("int"))


def ar1(df: DataFrame, r: str, o: Ordered, most: float = 0.98) -> DataFrame:
    """The lag-1 coefficient of each run's residual r."""
    rows = df.withColumn("_next", o.lead(r))
    held = rows.where(F.col("_next").isNotNull())
    phi = F.sum(F.col(r) * F.col("_next")) / (F.sum(F.col(r) * F.col(r)) + 1e-12)
    return held.groupBy(*o.by).agg(F.greatest(F.least(phi, F.lit(most)), F.lit(-most)).alias("phi"))


def whiten(df: DataFrame, r: str, phi: str, o: Ordered, out: str) -> DataFrame:
    return df.withColumn(out, F.coalesce(F.col(r) - F.col(phi) * o.lag(r), F.col(r)))


def from_first(c: str, o: Ordered) -> Column:
    return F.col(c) - F.first(c).over(o.past)


def z_score(c: str, o: Ordered) -> Column:
    """0 where the run's values don't differ."""
    sigma = F.stddev_pop(c).over(o.all)
    return F.when(sigma < 1e-9, 0.0).otherwise((F.col(c) - F.avg(c).over(o.all)) / sigma)


def srvf(slope: Column) -> Column:
    return F.signum(slope) * F.sqrt(F.abs(slope) + 1e-12)


def from_srvf(q: str, h0: Column, ds: Column, o: Ordered) -> Column:
    return h0 + F.sum(F.col(q) * F.abs(F.col(q)) * ds).over(o.past)


def fir(c: str, o: Ordered, weights: list[float]) -> Column:
    """Weights over a centred window of rows; null where the window leaves the run."""
    half = len(weights) // 2
    total = None
    for i, w in enumerate(weights):
        k = i - half
        at = F.col(c) if k == 0 else o.lag(c, -k) if k < 0 else o.lead(c, k)
        total = at * w if total is None else total + at * w
    return total


# Choice of rows ------------------------------------------------------------------------------------------------------


def first_of_bin(df: DataFrame, x: str, step: float, o: Ordered) -> DataFrame:
    """The first row of each bin of x (from 0) in every run; adds bin."""
    rows = df.where(F.col(x) >= 0).withColumn("bin", F.floor(F.col(x) / step).cast("long"))
    w = Window.partitionBy(*o.by, "bin").orderBy(*o.order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def first_of_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def decimate(df: DataFrame, o: Ordered, rate: str, most: float = 8.0) -> DataFrame:
    """Every k-th row of a run, k = rate / most rounded half to even; all rows at rates up to most."""
    k = F.when(F.col(rate) > most, F.greatest(F.bround(F.col(rate) / most), F.lit(1.0))).otherwise(1.0).cast("long")
    return df.withColumn("_n", o.number() - 1).where(F.col("_n") % k == 0).drop("_n")


def stride(df: DataFrame, o: Ordered, most: int | Column) -> DataFrame:
    """At most about so many rows of a run, evenly, the last one among them."""
    rows = df.withColumn("_i", o.number() - 1).withColumn("_n", F.count(F.lit(1)).over(o.all))
    k = F.greatest(F.ceil(F.col("_n") / most), F.lit(1))
    return rows.where((F.col("_i") % k == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def point_budget(span_km: Column, low: int = 2000, high: int = 24000) -> Column:
    return F.greatest(F.least(F.floor(750_000 / F.greatest(span_km, F.lit(1e-6))), F.lit(high)), F.lit(low)).cast("long")


def edge_trim(df: DataFrame, moves: Column, o: Ordered) -> DataFrame:
    """Rows from a run's first to its last that moves; runs that never move stay whole."""
    rows = df.withColumn("_i", o.number()).withColumn("_m", F.when(moves, F.col("_i")))
    low, high = F.min("_m").over(o.all), F.max("_m").over(o.all)
    return rows.withColumn("_a", low).withColumn("_b", high).where(F.col("_a").isNull() | F.col("_i").between(F.col("_a"), F.col("_b"))).drop("_i", "_m", "_a", "_b")


def drop_step_outliers(df: DataFrame, o: Ordered, lat: str = "latitude", lon: str = "longitude", most: float = 3.0) -> DataFrame:
    """Rows whose step lies at most so many standard deviations off the run's mean step; the first row, runs of two rows and even steps stay."""
    step = haversine_m(o.lag(lat), o.lag(lon), F.col(lat), F.col(lon))
    rows = df.withColumn("_step", step)
    sigma = F.stddev_pop("_step").over(o.all)
    z = F.abs(F.col("_step") - F.avg("_step").over(o.all)) / sigma
    keep = F.col("_step").isNull() | (F.count(F.lit(1)).over(o.all) < 3) | (sigma <= 1e-6) | (z <= most)
    return rows.withColumn("_keep", keep).where("_keep").drop("_step", "_keep")


def drop_inaccurate(df: DataFrame, accuracy: str, o: Ordered, most: float = 75.0) -> DataFrame:
    """Rows of known accuracy beyond the bound go, where at least two rows of the run would stay."""
    good = F.col(accuracy).isNull() | (F.col(accuracy) <= most)
    return df.withColumn("_n", F.count_if(good).over(o.all)).where(good | (F.col("_n") < 2)).drop("_n")


def chunks(df: DataFrame, o: Ordered, parts: int, out: str = "chunk") -> DataFrame:
    """Each run in about so many stretches of equal length that share their end rows: a row at a border stands in both."""
    rows = df.withColumn("_i", o.number() - 1).withColumn("_n", F.count(F.lit(1)).over(o.all))
    step = F.greatest(F.lit(2), F.floor(F.col("_n") / parts)).cast("int")
    at = F.floor(F.col("_i") / step).cast("long")
    border = (F.col("_i") % step == 0) & (F.col("_i") > 0)
    rows = rows.withColumn(out, F.explode(F.when(border, F.array(at - 1, at)).otherwise(F.array(at))))
    last = F.floor((F.col("_n") - 2) / step).cast("long")  # a stretch of a border row alone is none
    return rows.where((F.col(out) <= last) | (F.col("_n") < 2)).drop("_i", "_n")


def padded(low: float, high: float, share: float = 0.04) -> tuple[float, float]:
    """A box's side, wider by a share at either end."""
    return low - (high - low) * share, high + (high - low) * share


def viewport(df: DataFrame, o: Ordered, lat: tuple[float, float], lon: tuple[float, float], most: int | Column, least: int = 2, pad: float = 0.0) -> DataFrame:
    """Rows of each run inside a box, wider by a share `pad` at either side, both ends included, thinned to about `most` (see point_budget); of runs with too few rows inside all rows."""
    inside = F.coalesce(F.col("latitude").between(*padded(*lat, pad)) & F.col("longitude").between(*padded(*lon, pad)), F.lit(False))
    rows = df.withColumn("_in", inside).withColumn("_n", F.count_if("_in").over(o.all))
    return stride(rows.where(F.col("_in") | (F.col("_n") < least)).drop("_in", "_n"), o, most)


def aligned(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which every one of the columns has a finite value."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return df.where(ok)
