"""Readers of single CSV files and of telemetry JSON. Archives and folders of sensor files: see archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.sources.shared import written


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, with source_file."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


# The telemetry's columns, and those that a payload must have.
TELEMETRY = "unix_ns bigint, latitude double, longitude double, speed_m_s double, gps_altitude_m double, altitude_m double, altitude_smooth_m double, distance_m double, time_s double, vz_m_s double, vz_smooth_m_s double"


NEEDED = ["unix_ns", "latitude", "longitude"]
#: Heights that a missing climb is made from, in the order of preference.
HEIGHTS = ["altitude_smooth_m", "altitude_m", "relative_altitude_app_m"]


def _given(payload: Column) -> Column:
    """The payload without the numbers that JSON lacks, which writers put in all the same: they become null."""
    return F.try_parse_json(F.regexp_replace(payload, r"(?<=[\[,:\s])(-?Infinity|NaN)(?=[\],}\s])", "null"))


def _typed(v: Column, names: list[str]) -> list[Column]:
    kinds = dict(f.split() for f in TELEMETRY.split(", ")) | {"relative_altitude_app_m": "double"}
    return [F.try_variant_get(v, f"$.{n}", kinds[n]).alias(n) for n in names]


def payload_columns(df: DataFrame, payload: str) -> DataFrame:
    """One row: the types of what payloads of either shape hold, whatever their columns (records, columns: a VARIANT schema as text)."""
    v = _given(F.col(payload))
    kind = F.schema_of_variant(v)
    return df.select(v.alias("_v"), kind.alias("_k")).agg(*[F.schema_of_variant_agg(F.when(F.col("_k").startswith(k), F.col("_v"))).alias(n) for n, k in (("records", "ARRAY"), ("columns", "OBJECT"))])


def read_payloads(df: DataFrame, payload: str, by: list[str], climb: str = "optional") -> tuple[DataFrame, DataFrame]:
    """Rows of JSON payloads, which are lists of records or objects of columns, and what could not be read.

    Rows: by, the telemetry's columns, relative_altitude_app_m, and `extra`, the record itself as a variant with all its
    other columns. Left out: by, place (of a record in its payload, from 0; null for a whole payload), reason. A payload is left out
    whole that is no JSON (`not_json`), neither list nor object (`not_telemetry`), empty (`empty`), lacks a column that it
    needs (`missing_unix_ns`, ...), or has columns of different lengths (`uneven_columns`); a record is left out whose time or
    place is null or no number (`bad_unix_ns`, ...) or that is no object (`not_a_record`).

    climb: "optional"; "required": payloads must have vz_m_s or a height to make it of (`missing_vz_m_s`), see align.with_climb."""
    key = [F.col(c) for c in by]
    text = F.col(payload)
    whole = df.select(*key, F.coalesce(_given(text), F.lit(None).cast("variant")).alias("_v")).withColumn("_type", F.schema_of_variant("_v"))
    whole = whole.withColumn("_list", F.coalesce(F.col("_type").startswith("ARRAY"), F.lit(False))).withColumn("_object", F.coalesce(F.col("_type").startswith("OBJECT"), F.lit(False)))
    items = F.try_variant_get("_v", "$", "array<variant>")
    fields = F.try_variant_get("_v", "$", "map<string, variant>")
    whole = whole.withColumn("_items", F.when(F.col("_list"), items)).withColumn("_fields", F.when(F.col("_object"), fields))
    # A column's values, and the names that a payload has: of a list those of its records.
    whole = whole.withColumn("_columns", F.transform_values("_fields", lambda _, v: F.try_variant_get(v, "$", "array<variant>")))
    names = F.when(F.col("_object"), F.map_keys("_fields")).otherwise(F.array_distinct(F.flatten(F.transform("_items", lambda r: F.coalesce(F.map_keys(F.try_variant_get(r, "$", "map<string, variant>")), F.array().cast("array<string>"))))))
    whole = whole.withColumn("_names", names)
    sizes = F.array_distinct(F.transform(F.map_values("_columns"), lambda v: F.coalesce(F.size(v), F.lit(-1))))
    reason = F.when(F.col("_v").isNull(), "not_json").when(~F.col("_list") & ~F.col("_object"), "not_telemetry")
    reason = reason.when(F.coalesce(F.size("_items"), F.size("_fields"), F.lit(0)) == 0, "empty")
    for n in NEEDED:
        reason = reason.when(~F.array_contains("_names", n), f"missing_{n}")
    reason = reason.when(F.col("_object") & ((F.size(sizes) > 1) | (F.element_at(sizes, 1) < 0)), "uneven_columns").when(F.col("_object") & (F.element_at(sizes, 1) == 0), "empty")
    if climb == "required":
        reason = reason.when(~F.arrays_overlap("_names", F.array(*map(F.lit, ["vz_m_s", *HEIGHTS]))), "missing_vz_m_s")
    # Written, so that a payload is parsed once: the conditions below would else hold all that they are worked out from, many times over.
    whole = written(whole.select(*by, "_v", "_list", "_object", reason.alias("_reason")), "payloads").withColumn("_items", F.when(F.col("_list"), items)).withColumn("_fields", F.when(F.col("_object"), fields))
    whole = whole.withColumn("_columns", F.transform_values("_fields", lambda _, v: F.try_variant_get(v, "$", "array<variant>")))
    bad = whole.where("_reason is not null").select(*by, F.lit(None).cast("int").alias("place"), F.col("_reason").alias("reason"))
    good = whole.where("_reason is null")
    wanted = [f.split()[0] for f in TELEMETRY.split(", ")] + ["relative_altitude_app_m"]
    records = good.where("_list").select(*by, F.posexplode("_items").alias("place", "extra")).select(*by, "place", "extra", *_typed(F.col("extra"), wanted), F.coalesce(~F.schema_of_variant("extra").startswith("OBJECT"), F.lit(True)).alias("_odd"))
    at = lambda c: F.get(F.element_at("_columns", c), F.col("place"))
    row = good.where("_object").withColumn("place", F.explode(F.sequence(F.lit(0), F.size(F.element_at("_columns", "unix_ns")) - 1)))
    kinds = dict(f.split() for f in TELEMETRY.split(", ")) | {"relative_altitude_app_m": "double"}
    extra = F.parse_json(F.to_json(F.transform_values("_columns", lambda _, v: F.get(v, F.col("place")))))
    columns = row.select(*by, "place", extra.alias("extra"), *[F.try_variant_get(at(n), "$", kinds[n]).alias(n) for n in wanted], F.lit(False).alias("_odd"))
    rows = records.unionByName(columns)
    fault = F.when(F.col("_odd"), "not_a_record")
    for n in NEEDED:
        fault = fault.when(F.col(n).isNull(), f"bad_{n}")
    rows = rows.withColumn("_fault", fault)
    bad = bad.unionByName(rows.where("_fault is not null").select(*by, "place", F.col("_fault").alias("reason")))
    return rows.where("_fault is null").select(*by, *wanted, "extra"), bad


def read_telemetry_json(df: DataFrame, payload: str, by: list[str]) -> DataFrame:
    """The rows of read_payloads with the telemetry's columns alone."""
    return read_payloads(df, payload, by)[0].select(*by, *[f.split()[0] for f in TELEMETRY.split(", ")])
