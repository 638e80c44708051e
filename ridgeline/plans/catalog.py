"""The catalog of trails, sessions and files, as DataFrames. Keys are kept by anti-joins; counters are aggregates, not updates; what is kept is kept by commits (see Store)."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.operators import joins as J

SCHEMAS = {
    "trails": "id string, name string, location string, description string, run_count long, session_count long, total_distance_m double, elevation_min_m double, elevation_max_m double, created_at double, updated_at double",
    "upload_sessions": "id string, trail_id string, status string, source_names_json string, run_count long, comparison_ready long, alignment_method string, shared_distance_m double, result_json_path string, error string, created_at double, updated_at double",
    "runs": "id string, session_id string, trail_id string, label string, source_name string, color string, duration_s double, distance_m double, sample_count long, created_at double",
    "upload_files": "id string, session_id string, trail_id string, original_filename string, stem string, content_type string, size_bytes long, sha256 string, blob_path string, created_at double",
    "file_blobs": "sha256 string, blob_path string, size_bytes long, content_type string, first_original_filename string, created_at double",
    "session_files": "id string, session_id string, blob_sha256 string, original_filename string, stem string, created_at double",
}


def list_trails(trails: DataFrame) -> DataFrame:
    return trails.orderBy(F.desc("updated_at"), F.lower("name"), "id")


def find_trail(trails: DataFrame, name: str) -> DataFrame:
    """By name, whatever the case and the blanks around it."""
    return trails.where(F.lower(F.trim("name")) == name.strip().lower())


def create_trails(trails: DataFrame, new: DataFrame) -> DataFrame:
    """The trails with new ones whose trimmed name none has yet; blank names are left out."""
    named = new.withColumn("name", F.trim("name")).where("name <> ''").withColumn("_key", F.lower("name"))
    return J.insert_or_ignore(trails.withColumn("_key", F.lower(F.trim("name"))), named, ["_key"]).drop("_key")


def list_sessions(sessions: DataFrame, files: DataFrame, blobs: DataFrame, session: str, blob: str, size: str, order: list[Column], limit: int = 25, where: Column | None = None) -> DataFrame:
    """Sessions with the number of their files and bytes, in order, 1 to 200 of them. session and blob: the keys that the tables share."""
    own = (sessions if where is None else sessions.where(where)).orderBy(*order).limit(max(1, min(limit, 200)))  # first the page, then its files alone
    paged = files.join(F.broadcast(own.select(session)), session, "left_semi")
    sums = paged.join(blobs.select(blob, size), blob, "left").groupBy(session).agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"))
    rows = own.join(sums, session, "left").withColumns({"file_count": F.coalesce("file_count", F.lit(0)), "total_bytes": F.coalesce("total_bytes", F.lit(0))})
    return rows.orderBy(*order)


def get_trail(trails: DataFrame, trail: str) -> DataFrame:
    """The row of one trail, or none."""
    return trails.where(F.col("id") == trail).limit(1)


def list_files(files: DataFrame, blobs: DataFrame, sessions: DataFrame, session: str, blob: str) -> DataFrame:
    """The files of sessions with their blobs, by session and name."""
    return files.join(blobs, blob).join(sessions, session).orderBy(session, *[F.lower(c) for c in ("original_filename",) if c in files.columns], blob)


def find_duplicate(files: DataFrame, sessions: DataFrame, hashes: list[str], trail: str | None = None) -> DataFrame:
    """The newest session whose set of file hashes is exactly this one."""
    hits = J.same_sets(files, "session_id", "blob_sha256", hashes).join(sessions.withColumnRenamed("id", "session_id"), "session_id")
    hits = hits if trail is None else hits.where(F.col("trail_id") == trail)
    return hits.orderBy(F.desc("created_at"), "session_id").limit(1)


def with_counters(trails: DataFrame, sessions: DataFrame, runs: DataFrame) -> DataFrame:
    """run_count, session_count, total_distance_m of each trail, from what there is."""
    n = sessions.groupBy(F.col("trail_id").alias("id")).agg(F.count(F.lit(1)).alias("session_count"))
    m = runs.groupBy(F.col("trail_id").alias("id")).agg(F.count(F.lit(1)).alias("run_count"), F.sum("distance_m").alias("total_distance_m"))
    rest = trails.drop("session_count", "run_count", "total_distance_m")
    return rest.join(n, "id", "left").join(m, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("session_count", "run_count", "total_distance_m")})


def blob_rows(files: DataFrame, content: str = "content", name: str = "path") -> DataFrame:
    """sha256, blob_path (its first two characters, then all), size_bytes, first_original_filename of each different content."""
    rows = files.select(F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("size_bytes"), F.element_at(F.split(name, "/"), -1).alias("_name"))
    once = rows.groupBy("sha256", "size_bytes").agg(F.min("_name").alias("first_original_filename"))
    ending = F.lower(F.regexp_extract("first_original_filename", r"(\.[^.]+)$", 1))
    return once.withColumn("blob_path", F.concat(F.substring("sha256", 1, 2), F.lit("/"), F.col("sha256"), ending))


#: What rows that an earlier schema wrote get in columns that they lack; columns that aren't named here are null.
BACKFILL: dict[str, dict[str, object]] = {
    "trails": {"run_count": 0, "session_count": 0, "total_distance_m": 0.0},
    "upload_sessions": {"source_names_json": "[]", "run_count": 0, "comparison_ready": 0},
}
KEYS = {"trails": ["id"], "upload_sessions": ["id"], "runs": ["id"], "upload_files": ["id"], "file_blobs": ["sha256"], "session_files": ["session_id", "blob_sha256"], "blobs": ["sha256"]}


class Store:
    """The catalog's tables below a root, changed by commits over several of them.

    A commit writes the new rows of its tables to folders of their own, which nobody reads yet, and then makes one marker
    that names them: the next number in a row, which the file system lets one writer make. So a commit that breaks off leaves
    nothing to be seen, a commit of an id that is there already adds nothing, and of two writers at a time the second one
    looks again at what the first has added, and takes the next number. Rows whose key a table has already are not added.
    Folders keep the columns that they were written with; older ones are read with today's, see BACKFILL."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def commits(self) -> list[dict]:
        """number, id, folders {table: folder} of all commits in order: a row for each commit."""
        fs, at = self._path("_commits")
        if not fs.exists(at):
            return []
        rows = self.spark.read.schema("id string, folders map<string, string>").json(f"{self.root}/_commits").select("*", F.col("_metadata.file_name").alias("_file")).where("id is not null").collect()
        return sorted(({"number": int(r["_file"].split(".")[0]), "id": r["id"], "folders": r["folders"]} for r in rows), key=lambda c: c["number"])

    def read(self, name: str, commits: list[dict] | None = None) -> DataFrame | None:
        """A table as all commits left it; None if no commit has named it and it has no schema."""
        found = self.commits() if commits is None else commits
        folders = [f"{self.root}/{name}/{c['folders'][name]}" for c in found if name in c["folders"]]
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name]) if name in SCHEMAS else None
        rows = self.spark.read.option("mergeSchema", "true").parquet(*folders)
        if name in SCHEMAS:
            today = dict(f.split() for f in SCHEMAS[name].split(", "))
            for c, kind in today.items():
                value = F.lit(BACKFILL.get(name, {}).get(c)).cast(kind)
                rows = rows.withColumn(c, value if c not in rows.columns else F.coalesce(F.col(c), value) if c in BACKFILL.get(name, {}) else F.col(c))
            rows = rows.select(*today, *[c for c in rows.columns if c not in today])
        return rows

    def commit(self, id: str, rows: dict[str, DataFrame]) -> bool:
        """Add rows to tables, all or none; False if a commit of this id is there already. Of new rows with one key one is added."""
        while True:
            known = self.commits()
            if any(c["id"] == id for c in known):
                return False
            folders = {}
            for name, new in rows.items():
                keys, folder = KEYS[name], uuid.uuid4().hex
                new, old = new.dropDuplicates(keys), self.read(name, known)
                if old is not None:
                    held = old.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
                    new = new.join(held, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left_anti")
                new.write.parquet(f"{self.root}/{name}/{folder}")
                folders[name] = folder
            if self._mark(known[-1]["number"] + 1 if known else 1, {"id": id, "folders": folders}):
                return True
            for name, folder in folders.items():  # another writer took the number: once more, with what it has added
                fs, at = self._path(name, folder)
                fs.delete(at, True)

    def _mark(self, number: int, content: dict) -> bool:
        """Make the marker of a number; False if there is one."""
        fs, at = self._path("_commits", f"{number:012d}.json")
        if fs.exists(at):
            return False
        try:
            out = fs.create(at, False)  # fails if it was made in between
        except Py4JJavaError:
            return False
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return True

    def sweep(self) -> int:
        """Remove folders that no marker names, of commits that broke off; how many. While no commit is on its way."""
        named, gone = {(n, f) for c in self.commits() for n, f in c["folders"].items()}, 0
        for name in KEYS:
            fs, at = self._path(name)
            for entry in fs.listStatus(at) if fs.exists(at) else []:
                if (name, entry.getPath().getName()) not in named:
                    gone += bool(fs.delete(entry.getPath(), True))
        return gone


def store_blobs(spark: SparkSession, root: str, files: DataFrame, content: str = "content", name: str = "path") -> DataFrame:
    """Keep each different content once below a root: sha256, blob_path, size_bytes, first_original_filename, content."""
    rows = blob_rows(files, content, name)
    held = files.select(F.sha2(content, 256).alias("_sha"), F.col(content).alias("content")).dropDuplicates(["_sha"])
    store = Store(spark, root)
    store.commit(uuid.uuid4().hex, {"blobs": rows.join(held, F.col("sha256") == F.col("_sha")).drop("_sha")})
    return store.read("blobs")


def store_session(spark: SparkSession, root: str, id: str, session: DataFrame, runs: DataFrame, files: DataFrame, blobs: DataFrame | None = None) -> bool:
    """Keep a session's row, its runs', its files' and their blobs' in one commit; rows that are there already stay. False if the session is there."""
    tables = {"upload_sessions": session, "runs": runs, "session_files": files} | ({} if blobs is None else {"file_blobs": blobs})
    return Store(spark, root).commit(f"session-{id}", tables)


def backfill_files(spark: SparkSession, root: str) -> bool:
    """Blobs and the sessions' files from the older table of uploads, the earliest of each key; once."""
    store = Store(spark, root)
    old = store.read("upload_files")
    first = lambda keys: old.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("created_at", "id"))).where("_k = 1")
    blobs = first(["sha256"]).select("sha256", "blob_path", "size_bytes", "content_type", F.col("original_filename").alias("first_original_filename"), "created_at")
    files = first(["session_id", "sha256"]).select("id", "session_id", F.col("sha256").alias("blob_sha256"), "original_filename", "stem", "created_at")
    return store.commit("backfill-upload-files", {"file_blobs": blobs, "session_files": files})
