"""Queries of the sources: exports that Spark derives from `events`, as files, archives and payloads, read back by the library."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.plans import align
from ridgeline.plans.queries import query, r6, track
from ridgeline.plans.sql import TRACK
from ridgeline.sources import archives, readers
from ridgeline.sources.shared import new_folder, small_batches


#: Records of one file at most: a task holds a whole file, so longer recordings go on in further files.
RECORDS = 100_000


@query(f"WITH {TRACK} SELECT 'gps' AS kind, (unix_ns // 1000000) * 1000000 AS unix_ns, round(latitude,6) AS latitude, round(longitude,6) AS longitude, round(speed_m_s,6) AS speed_m_s, round(accuracy,6) AS horizontal_accuracy_m FROM track")
def member_files(spark, sf_dir):
    """A folder of CSV files, written by Spark, through the source of sensor members."""
    path = new_folder(spark, "members")
    rows = track(spark, sf_dir).select(F.expr("unix_ns div 1000000").alias("Timestamp"), F.col("latitude").alias("LAT"), F.col("longitude").alias("lng"), F.col("speed_m_s").alias("velocity"), F.col("accuracy").alias("h_acc"))
    rows.repartitionByRange(8, "Timestamp").sortWithinPartitions("Timestamp").write.options(header=True, maxRecordsPerFile=RECORDS).csv(path)
    got = archives.read_members(spark, path)
    return got.select("kind", "unix_ns", r6("latitude"), r6("longitude"), r6("speed_m_s"), r6("horizontal_accuracy_m"))


def _zips(tables: DataFrame) -> DataFrame:
    """path, content: an archive for each row (run_id and the texts of its members), a handful of files of one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != "run_id"]
            paths, contents = [], []
            for row in batch.to_pylist():
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                    for n in names:
                        if row[n] is not None:
                            z.writestr(f"export/{n}.csv", row[n])
                paths.append(f"/rides/{row['run_id']}.zip")
                contents.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], ["path", "content"])

    small_batches(tables.sparkSession)
    return tables.mapInArrow(run, "path string, content binary")


_AXIS = "sin(event_id::DOUBLE)"


@query(f"""WITH {TRACK}, a AS (SELECT *, run_id::VARCHAR AS archive, CASE WHEN run_id % 2 = 0 THEN (event_id % 170)*1.0 ELSE (event_id % 30)*1e-1 END AS angle FROM track), m AS (SELECT run_id, max(abs(angle)) AS widest FROM a GROUP BY run_id)
SELECT archive, 'Location.csv' AS source_file, 'gps' AS kind, NULL AS stream, unix_ns, round(latitude,6) AS a, round(longitude,6) AS b, round(speed_m_s,6) AS c FROM a WHERE event_id % 11 > 0 UNION ALL
SELECT archive, 'pressures.csv', 'baro', NULL, (unix_ns // 1000000) * 1000000, round(pressure_mbar,6), round(44330.0*(1-power(pressure_mbar/1013.25,0.1903)),6), NULL FROM a UNION ALL
SELECT archive, 'Gyroscope Uncalibrated.csv', 'aux', 'gyro_uncal', unix_ns, round({_AXIS},6), round({_AXIS} / 2,6), round(CASE WHEN widest > 3.6 THEN radians(angle) ELSE angle END,6) FROM a JOIN m USING (run_id) UNION ALL
SELECT DISTINCT archive, 'Metadata.csv', 'metadata', 'no_sensor', NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM a""")
def archive_members(spark, sf_dir):
    """An archive for each run, with places (some of them missing), pressures in pascals or millibars, motion and no sensor at all: members by kind, units and aliases."""
    t = track(spark, sf_dir).withColumn("angle", F.when(F.col("run_id") % 2 == 0, (F.col("event_id") % 170) * 1.0).otherwise((F.col("event_id") % 30) * 1e-1))
    lines = lambda head, *cells: F.concat(F.lit(head + "\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("unix_ns", "event_id", *[c.alias(f"c{i}") for i, c in enumerate(cells)]))), lambda r: F.concat_ws(",", *[F.coalesce(r[f"c{i}"].cast("string"), F.lit("")) for i in range(len(cells))])), "\n"))
    sin = F.sin(F.col("event_id").cast("double"))
    place = F.when(F.col("event_id") % 11 > 0, F.col("latitude"))
    unit = F.when(F.col("run_id") % 2 == 0, F.col("pressure_mbar") * 100).otherwise(F.col("pressure_mbar"))
    tables = t.groupBy("run_id").agg(
        lines("time_ns,Latitude,lon,gps_speed", F.col("unix_ns"), place, F.col("longitude"), F.col("speed_m_s")).alias("Location"),
        lines("epoch,timestamp,pres", F.lit("x"), F.expr("unix_ns div 1000000"), unit).alias("pressures"),
        lines("unix_ns,Acceleration X (rad),acceleration  y,az,heading", F.col("unix_ns"), sin, sin / 2, F.lit(1), F.col("angle")).alias("Gyroscope Uncalibrated"),
        F.lit("device,x\nphone,1\n").alias("Metadata"),
    )
    got = archives.members_of(_zips(tables))
    pick = lambda gps, baro, aux: F.when(F.col("kind") == "gps", F.col(gps)).when(F.col("kind") == "baro", F.col(baro)).otherwise(F.col(aux))
    return got.select("archive", "source_file", "kind", F.coalesce("stream", "reason").alias("stream"), "unix_ns", r6(pick("latitude", "pressure_mbar", "x"), "a"), r6(pick("longitude", "altitude_m", "y"), "b"), r6(F.when(F.col("kind") == "gps", F.col("speed_m_s")).otherwise(F.col("yaw_rad")), "c"))


def payloads(spark, sf_dir) -> DataFrame:
    """run_id, payload: runs as lists of records or as columns, each sixth one torn; records of each seventh event have no latitude."""
    t = track(spark, sf_dir).withColumn("lat", F.when((F.col("event_id") % 7 > 0) | (F.col("run_id") % 3 == 1), F.col("latitude")))
    rows = t.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("unix_ns", "event_id", F.col("lat").alias("latitude"), "longitude", "speed_m_s", "pressure_mbar"))).alias("r"))
    columns = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("unix_ns", "event_id", "latitude", "longitude", "speed_m_s", "pressure_mbar")])
    said = F.when(F.col("run_id") % 3 == 1, F.to_json(columns)).otherwise(F.to_json("r"))
    return rows.select("run_id", F.when(F.col("run_id") % 6 == 5, F.concat(F.lit("["), said)).otherwise(said).alias("payload"))


@query(f"WITH {TRACK} SELECT run_id, unix_ns, round(latitude,6) AS latitude, round(longitude,6) AS longitude, round(speed_m_s,6) AS speed_m_s, event_id, round(pressure_mbar,6) AS pressure_mbar FROM track WHERE run_id % 6 <> 5 AND (event_id % 7 > 0 OR run_id % 3 = 1)")
def payload_rows(spark, sf_dir):
    """Payloads of both shapes, with columns that no schema knows."""
    rows, _ = readers.read_payloads(payloads(spark, sf_dir), "payload", ["run_id"])
    more = lambda c, t: F.variant_get("extra", f"$.{c}", t)
    return rows.select("run_id", "unix_ns", r6("latitude"), r6("longitude"), r6("speed_m_s"), more("event_id", "long").alias("event_id"), r6(more("pressure_mbar", "double"), "pressure_mbar"))


@query(f"""WITH {TRACK}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY unix_ns, event_id) - 1 AS k FROM track)
SELECT DISTINCT run_id, NULL::INT AS place, 'not_json' AS reason FROM r WHERE run_id % 6 = 5 UNION ALL SELECT run_id, k::INT, 'bad_latitude' FROM r WHERE run_id % 6 <> 5 AND event_id % 7 = 0 AND run_id % 3 <> 1""")
def payload_faults(spark, sf_dir):
    """What of the payloads could not be read, and why."""
    return readers.read_payloads(payloads(spark, sf_dir), "payload", ["run_id"])[1]


@query(f"WITH {TRACK} SELECT DISTINCT run_id, CASE WHEN run_id % 6 = 5 THEN 'not_json' ELSE 'missing_vz_m_s' END AS reason FROM track WHERE run_id % 3 = 1 OR run_id % 6 = 5 OR run_id % 3 <> 1")
def payloads_without_climb(spark, sf_dir):
    """The form that requires a climb, or a height to make it of: none of these payloads has either."""
    _, bad = align.runs_of_payloads(payloads(spark, sf_dir), "payload", "run_id")
    return bad.select("run_id", "reason")
