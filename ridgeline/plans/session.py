"""Whole sessions: archives or folders of sensor files to processed runs.

With one GPS file all barometer files make one run; with as many GPS as barometer files they are paired by name; other
mixes are left out, with the reason. Motion files belong to all runs of their archive. Uploads, jobs and their polling
are a service's business; here a session is a folder that Spark reads."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import scalar as S
from ridgeline.plans import payload, run
from ridgeline.sources import archives as M
from ridgeline.sources.shared import written


def inside(root: str, sub: str) -> str:
    """The path of a folder below a root; leaving the root is an error."""
    path = posixpath.normpath(posixpath.join(root, sub))
    if path != root.rstrip("/") and not path.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{sub} leaves the data folder")
    return path


def pair_files(kinds: DataFrame) -> DataFrame:
    """archive, source_file, kind, run: which run of its archive a GPS or barometer file belongs to (from 1); null where files can't be paired."""
    w = Window.partitionBy("archive", "kind").orderBy(F.lower("source_file"), "source_file")
    all_files = Window.partitionBy("archive")
    n = lambda k: F.count_if(F.col("kind") == k).over(all_files)
    rows = kinds.where(F.col("kind").isin("gps", "baro", "aux")).withColumns({"_k": F.row_number().over(w), "_g": n("gps"), "_b": n("baro")})
    number = F.when(F.col("kind") == "aux", None).when((F.col("_g") == 1) & (F.col("_b") >= 1), 1).when(F.col("_g") == F.col("_b"), F.col("_k"))
    return rows.select("archive", "source_file", "kind", number.cast("int").alias("run"))


def _kinds(members: DataFrame) -> DataFrame:
    """A row for each file that has rows."""
    return members.where("reason is null").select(F.coalesce("archive", F.lit("")).alias("archive"), "source_file", "kind").distinct()


def streams(members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """GPS, barometer and motion rows with run_id (a hash of archive and run), of members' typed rows (see archives)."""
    members = written(members, "members")  # parsed once
    files = pair_files(_kinds(members)).withColumnsRenamed({"archive": "_archive", "source_file": "_file", "kind": "_kind"})
    named = members.where("reason is null").withColumn("archive", F.coalesce("archive", F.lit("")))
    runs = files.where("run is not null").select("_archive", "_file", "_kind", F.xxhash64("_archive", "run").alias("run_id"))
    own = lambda kind: named.where(F.col("kind") == kind).join(runs.where(F.col("_kind") == kind), (F.col("archive") == F.col("_archive")) & (F.col("source_file") == F.col("_file")))
    gps = own("gps").select("run_id", "unix_ns", *M.PLACES)
    # Of several barometer files the first by name that has a value at a time.
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("source_file", "line", c)))[c].alias(c)
    baro = own("baro").groupBy("run_id", "unix_ns").agg(*[first(c) for c in M.HEIGHTS])
    of = runs.select("_archive", "run_id").distinct()
    motion = named.where("kind = 'aux'").join(of, F.col("archive") == F.col("_archive")).select("run_id", "unix_ns", "stream", "x", "y", "z")
    return gps, baro, motion


def run_names(members: DataFrame) -> DataFrame:
    """run_id, source_name (the archive, or the files' names where there is none), label (First run, ...; by source and run)."""
    files = pair_files(_kinds(members)).where("run is not null")
    rows = files.groupBy("archive", "run").agg(F.array_join(F.array_sort(F.collect_set("source_file")), ", ").alias("_files"))
    rows = rows.select(F.xxhash64("archive", "run").alias("run_id"), F.when(F.col("archive") == "", F.col("_files")).otherwise(F.col("archive")).alias("source_name"), "archive", "run")
    return rows.withColumn("label", S.ordinal_label(F.row_number().over(Window.orderBy("archive", "run")))).drop("archive", "run")  # a row for each run


def left_out(members: DataFrame) -> DataFrame:
    """archive, source_file, kind, reason: files without rows that can be used, and those that no run can have."""
    files = pair_files(_kinds(members)).where("run is null and kind <> 'aux'").select(F.nullif("archive", F.lit("")).alias("archive"), "source_file", "kind", F.lit("unpaired").alias("reason"))
    return M.unusable(members).unionByName(files)


def process_members(members: DataFrame) -> DataFrame:
    gps, baro, motion = streams(members)
    return run.process(run.on_clock(baro, gps, motion))


def process_zips(spark: SparkSession, path: str) -> DataFrame:
    """Processed runs of all ZIP archives of a folder, each a session of its own."""
    return process_members(M.read_members(spark, path).where("archive is not null"))


def process_zips_together(spark: SparkSession, path: str) -> DataFrame:
    """Processed runs of all ZIP archives of a folder as one session."""
    return process_members(M.as_one_session(M.read_members(spark, path).where("archive is not null")))


def process_blobs(blobs: DataFrame, files: DataFrame) -> DataFrame:
    """Runs of a session, worked out again from its stored archives. blobs: sha256, content; files: blob_sha256, original_filename."""
    held = blobs.join(files, F.col("sha256") == F.col("blob_sha256")).select(F.col("original_filename").alias("path"), "content")
    return process_members(M.as_one_session(M.members_of(held)))


def session_result(spark: SparkSession, session: DataFrame, files: DataFrame, blobs: DataFrame) -> DataFrame | None:
    """A stored session's payloads by run: worked out again from its archives where there are any, else as they were kept at its result_json_path; None where neither is there.

    session: its row; files: blob_sha256, original_filename; blobs: sha256, content."""
    held = files.join(blobs.select("sha256"), F.col("blob_sha256") == F.col("sha256"), "left").select("sha256").collect()  # a session's handful of archives
    if held:
        if any(r.sha256 is None for r in held):
            return None
        rows = process_blobs(blobs, files)
        return payload.run_payload(rows, run.run_stats(rows))
    path = session.select("result_json_path").head()
    if path is None or not path[0]:
        return None
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path[0])
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.text(path[0], wholetext=True).select(F.lit(None).cast("long").alias("run_id"), F.col("value").alias("payload"))


def process_folder(spark: SparkSession, root: str, sub: str = "") -> DataFrame:
    """Processed runs of a folder of CSV files below a root."""
    return process_members(M.read_members(spark, inside(root, sub)).where("archive is null"))


def process_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Processed runs of CSV files that are named one by one; of several GPS files the last one counts."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    members = M.members_of(files)
    last = members.where("kind = 'gps' and reason is null").agg(F.max_by("source_file", F.array_position(F.array(*[F.lit(posixpath.basename(p)) for p in paths]), F.col("source_file"))).alias("_last"))
    return process_members(members.join(F.broadcast(last), how="cross").where("kind <> 'gps' or source_file = _last").drop("_last"))
