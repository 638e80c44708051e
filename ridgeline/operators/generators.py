"""Rows out of nothing: grids, clocks and sectors. Whole numbers are generated and multiplied, so steps don't drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance_grid(limits: DataFrame, by: list[str], end: str, step: float, out: str = "distance_m") -> DataFrame:
    """0, step, ... below each run's end."""
    n = F.ceil(F.col(end) / step).cast("long")
    return limits.where(F.col(end) > 0).select(*by, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("grid_index")).withColumn(out, F.col("grid_index") * step)


def clock(limits: DataFrame, by: list[str], start: str, end: str, step_ns: int, out: str = "unix_ns") -> DataFrame:
    """start, start + step, ... up to the first tick at or after the end."""
    n = F.ceil((F.col(end) - F.col(start)) / step_ns).cast("long")
    return limits.select(*by, start, F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("tick")).select(*by, (F.col(start) + F.col("tick") * step_ns).alias(out))


def sectors(limits: DataFrame, by: list[str], span: str, most: int, width: float = 120.0) -> DataFrame:
    """Equal parts of each run's span, about `width` long, three at least and `most` at most: by, id (from 1), d0, d1, label."""
    n = F.least(F.greatest(F.floor(F.col(span) / width), F.lit(3)), F.lit(most)).cast("long")
    rows = limits.where(F.col(span) > 0).select(*by, span, n.alias("_n"), F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("id"))
    edge = lambda i: F.col(span) * i / F.col("_n")
    return rows.select(*by, "id", edge(F.col("id") - 1).alias("d0"), edge(F.col("id")).alias("d1"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("label"))


def nearest_label(names: list[str], share: Column) -> Column:
    """Of names spaced evenly over 0 to 1 the nearest to a share."""
    at = F.round(share * (len(names) - 1)).cast("int")
    return F.element_at(F.array(*map(F.lit, names)), F.least(F.greatest(at, F.lit(0)), F.lit(len(names) - 1)) + 1)


def of_n(df: DataFrame, names: str, key: str) -> DataFrame:
    """Each name of a list with its place: key, name, label `i of n`."""
    rows = df.select(key, F.size(names).alias("_n"), F.posexplode_outer(names).alias("_i", "name"))
    return rows.select(key, "name", F.concat((F.col("_i") + 1).cast("string"), F.lit(" of "), F.col("_n").cast("string")).alias("label"))
