"""Members of ZIP archives and folders as typed rows: a Python data source, and the same reading of contents that a table holds.

    register(spark)
    spark.read.format("sensor_members").load("/data/rides")              # *.zip and *.csv below a folder
    spark.read.format("sensor_members").option("kind", "gps").load(...)

A partition is a member: archives are listed by their central directories, so a large archive is read by many tasks, and
each of them reads its own member alone. A task parses its member once, finds the columns by their aliases, tells the kind
of the file (name first, then columns and the usual interval), and gives rows of one schema in the units of the library;
what a file lacks is null. What can't be used is a row too, with the reason and without values. Paths may be of any
file system that pyarrow opens. A member is a recording of one sensor, whose rows a task holds at once."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ridgeline.functions import scalar as S
from ridgeline.sources.shared import small_batches

# Names under which exports hold a column, in the order of preference.
TIME = ["unix_ns", "time_ns", "timestamp_ns", "timestamp", "time", "epoch_ns", "datetime"]
LATITUDE = ["latitude", "lat"]
LONGITUDE = ["longitude", "lon", "lng"]
SPEED = ["speed", "gps_speed", "velocity", "speed_m_s"]
ACCURACY = ["horizontal_accuracy", "horizontalAccuracy", "accuracy", "h_acc", "gps_accuracy"]
GPS_ALTITUDE = ["altitude", "gps_altitude"]
PRESSURE = ["pressure", "barometric_pressure", "pres", "pressure_mbar"]
RELATIVE = ["relativeAltitude", "relative_altitude", "barometric_altitude"]
ANGLES = {f"{a}_rad": [a, f"orientation_{a}", f"orientation{a.capitalize()}", *(["heading"] if a == "yaw" else [])] for a in ("roll", "pitch", "yaw")}
AXES = {a: [f"acceleration_{a}", f"accel_{a}", f"a{a}", f"Acceleration {a.upper()}", f"acceleration {a}", f"linear_acceleration_{a}", f"linearAcceleration{a.upper()}", f"Acc{a.upper()}"] for a in "xyz"}

PLACES = ["latitude", "longitude", "speed_m_s", "horizontal_accuracy_m", "gps_altitude_m"]
HEIGHTS = ["pressure_mbar", "relative_altitude_app_m", "altitude_from_pressure_m", "altitude_m"]
MOTIONS = ["x", "y", "z", *ANGLES]
SCHEMA = "archive string, source_file string, kind string, reason string, line long, unix_ns long, stream string, " + ", ".join(f"{c} double" for c in (*PLACES, *HEIGHTS, *MOTIONS))
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[t]) for n, t in (f.split() for f in SCHEMA.split(", "))])


def find_column(columns: list[str], aliases: list[str]) -> str | None:
    """The first alias that is there, each as it is written or else in any case (of columns that differ by case alone the last)."""
    lower = {c.lower(): c for c in columns}
    return next((a if a in columns else lower[a.lower()] for a in aliases if a in columns or a.lower() in lower), None)


def axis_name(name: str) -> str:
    """Any spelling that begins with acceleration and an axis as the first alias of that axis; other names as they are."""
    return next((f"acceleration_{a}" for a in "xyz" if re.match(rf"acceleration\s*{a}\b", name, re.IGNORECASE)), name)


def _number(values: pd.Series) -> np.ndarray:
    """Doubles; what isn't a finite number is nan."""
    out = pd.to_numeric(values, errors="coerce").to_numpy(float)
    return np.where(np.isfinite(out), out, np.nan)


def bare_stem(name: str) -> str:
    """S.bare_stem of a name."""
    stem = re.sub(r"\.[^.]*$", "", re.sub(r"^.*[/\\]", "", name.lower()))
    return re.sub(r"[\s\-_]", "", re.sub(r"^z\d+_", "", stem))


def stream_of(name: str) -> str | None:
    """S.stream_prefix of a name."""
    stem = bare_stem(name)
    if stem == S.NO_STREAM[0] or stem.startswith(S.NO_STREAM[1]) or S.NO_STREAM[2] in stem:
        return None
    return next((prefix for part, prefix in S.STREAM_STEMS if (stem.startswith(part) if prefix == "gyro" else part in stem)), "acc")


class Table:
    """A CSV file's columns by name; rows that are too short have nulls."""

    def __init__(self, data: bytes):
        lines = csv.reader(io.StringIO(data.decode("utf-8-sig")))
        self.columns, self.n = [axis_name(h) for h in next(lines, [])], 0
        held: list[list[str | None]] = [[] for _ in self.columns]
        for row in lines:  # not held as rows beside the columns
            self.n += 1
            for i, column in enumerate(held):
                column.append(row[i] if i < len(row) else None)
        self.held = {h: pd.Series(column, dtype=object) for h, column in zip(self.columns, held)}

    def has(self, aliases: list[str]) -> bool:
        return find_column(self.columns, aliases) is not None

    def value(self, aliases: list[str]) -> np.ndarray:
        name = find_column(self.columns, aliases)
        return np.full(self.n, np.nan) if name is None else _number(self.held[name])

    def times(self) -> tuple[np.ndarray, np.ndarray]:
        """Nanoseconds, and which are known: of the first of the time's columns that has one in a row; dates and times as text count in whole seconds.

        Epochs below 1e12, by the largest, are seconds, below 1e15 milliseconds, else nanoseconds. Whole numbers keep all their digits."""
        present = [c for a in TIME if (c := find_column(self.columns, [a]))]
        t, whole, known = np.full(self.n, np.nan), np.zeros(self.n, np.int64), np.zeros(self.n, bool)
        for c in present:
            v, text = _number(self.held[c]), self.held[c].fillna("").astype(str).str.strip()
            exact = text.str.fullmatch(r"[+-]?\d{1,18}|[1-8]\d{18}").to_numpy(bool)
            new = ~known & ~np.isnan(v)
            t[new], whole[new & exact] = v[new], text[new & exact].astype("int64")
            whole[new & ~exact] = -1
            known |= new
        for c in present:
            if not known.all():
                dated = pd.to_datetime(self.held[c], errors="coerce", utc=True, format="ISO8601")
                new = ~known & ~dated.isna().to_numpy()
                t[new] = whole[new] = dated[new].to_numpy("datetime64[s]").astype(np.int64) * 1_000_000_000
                known |= new
        largest = t[known].max() if known.any() else 0.0
        scale = 10**9 if largest < 1e12 else 10**6 if largest < 1e15 else 1
        with np.errstate(all="ignore"):
            return np.where(whole >= 0, whole * scale, (np.where(known, t, 0.0) * scale).astype(np.int64)), known


def kind_of(name: str, table: Table, ns: np.ndarray) -> str:
    """metadata, gps, baro, aux or unknown, by name, then columns and the usual interval of the known times."""
    stem = bare_stem(name)
    placed, baro = table.has(LATITUDE) and table.has(LONGITUDE), table.has(PRESSURE) or table.has(RELATIVE)
    moves = all(table.has([a]) for a in "xyz") or any(table.has(n) for n in (*AXES.values(), *ANGLES.values()))
    if stem == "metadata":
        return "metadata"
    if stem.startswith("location") and placed:
        return "gps"
    if "barometer" in stem and baro:
        return "baro"
    if not len(ns):
        return "unknown"
    usual = float(np.median(np.diff(ns))) * 1e-9 if len(ns) > 1 else 1.0
    motion = any(s in stem for s, _ in S.STREAM_STEMS) or "orientation" in stem
    if motion and moves and not baro and not placed:
        return "aux"
    if placed and usual > 0.35:
        return "gps"
    return "baro" if baro else "aux" if moves else "gps" if placed else "unknown"


def _hypsometric(p: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        out = 44330.0 * (1 - np.power(p / S.SEA_LEVEL_MBAR, 0.1903))
    return np.where(np.isfinite(out), out, np.nan)


def _first(*values: np.ndarray) -> np.ndarray:
    out = values[0]
    for v in values[1:]:
        out = np.where(np.isnan(out), v, out)
    return out


def tidy(archive: str | None, name: str, data: bytes | None) -> pa.RecordBatch:
    """A member's rows. Without a place, height or motion, or a time, a row is left out; a file without any rows left is one row with the reason."""

    def only(kind: str | None, reason: str) -> pa.RecordBatch:
        row = {"archive": archive, "source_file": name, "kind": kind, "reason": reason}
        return pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in _ARROW], schema=_ARROW)

    if data is None:
        return only(None, "unreadable")
    try:
        table = Table(data)
    except (UnicodeDecodeError, csv.Error):
        return only(None, "not_csv")
    ns, known = table.times()
    kind = kind_of(name, table, ns[known])
    if kind in ("metadata", "unknown") or not table.n:
        return only(kind, "no_rows" if not table.n else "no_sensor")
    got: dict[str, np.ndarray] = {}
    if kind == "gps":
        got = {"latitude": table.value(LATITUDE), "longitude": table.value(LONGITUDE), "speed_m_s": table.value(SPEED), "horizontal_accuracy_m": table.value(ACCURACY), "gps_altitude_m": table.value(GPS_ALTITUDE)}
        keep = ~np.isnan(got["latitude"]) & ~np.isnan(got["longitude"])
    elif kind == "baro":
        p = table.value(PRESSURE)
        used = known & ~np.isnan(p)
        p = p / 100 if used.any() and np.median(p[used]) > 2000 else p
        height, relative = _hypsometric(p), table.value(RELATIVE)
        got = {"pressure_mbar": p, "relative_altitude_app_m": relative, "altitude_from_pressure_m": height, "altitude_m": _first(height, relative, table.value(GPS_ALTITUDE))}
        keep = np.ones(table.n, bool)
    else:
        got = {a: _first(table.value([a]), table.value(AXES[a])) for a in "xyz"}
        for c, aliases in ANGLES.items():
            v = table.value(aliases)
            size = np.abs(v[known])
            got[c] = np.radians(v) if np.isfinite(size).any() and np.nanmax(size) > 3.6 else v
        keep = np.any([~np.isnan(v) for v in got.values()], axis=0)
    keep &= known
    if not keep.any():
        return only(kind, "no_values")
    n, stream = int(keep.sum()), stream_of(name) or "acc"
    fixed = {"archive": archive, "source_file": name, "kind": kind, "stream": stream if kind == "aux" else None}
    columns = []
    for f in _ARROW:
        if f.name in got:
            columns.append(pa.array(got[f.name][keep], f.type, from_pandas=True))
        elif f.name == "line":
            columns.append(pa.array(np.flatnonzero(keep), f.type))
        elif f.name == "unix_ns":
            columns.append(pa.array(ns[keep], f.type))
        else:
            columns.append(pa.array([fixed.get(f.name)] * n, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _stem(path: str) -> str:
    return posixpath.basename(path).rsplit(".", 1)[0]


def _wanted(member: str) -> bool:
    name = posixpath.basename(member)
    return name.lower().endswith(".csv") and not name.startswith("._")


def _read(z: zipfile.ZipFile, member: str) -> bytes | None:
    try:
        return z.read(member)
    except (zipfile.BadZipFile, RuntimeError, OSError, NotImplementedError, KeyError):
        return None


class Member(InputPartition):
    def __init__(self, path: str, member: str | None):
        self.path, self.member = path, member


class MemberReader(DataSourceReader):
    def __init__(self, path: str, kind: str | None):
        self.path, self.kind = path, kind

    def partitions(self) -> list[Member]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        info = files.get_file_info(root)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        out: list[Member] = []
        for f in sorted((f for f in found if f.is_file), key=lambda f: f.path):
            if f.path.lower().endswith(".csv"):
                out.append(Member(f.path, None))
            elif f.path.lower().endswith(".zip"):
                try:
                    with files.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as z:  # the central directory alone
                        out += [Member(f.path, m.filename) for m in z.infolist() if _wanted(m.filename)]
                except zipfile.BadZipFile:
                    out.append(Member(f.path, ""))
        return out or [Member("", None)]

    def read(self, part: Member) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if not part.path:
            return
        files, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with files.open_input_file(part.path) as raw:
            if part.member is None:
                batch = tidy(None, posixpath.basename(part.path), raw.read())
            elif not part.member:
                batch = tidy(_stem(part.path), posixpath.basename(part.path), None)
            else:
                with zipfile.ZipFile(raw) as z:
                    batch = tidy(_stem(part.path), posixpath.basename(part.member), _read(z, part.member))
        if self.kind is None or batch.column("kind")[0].as_py() == self.kind:
            yield batch


class SensorMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sensor_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MemberReader:
        return MemberReader(self.options["path"], self.options.get("kind"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SensorMembers)


def read_members(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Rows of SCHEMA of all archives and CSV files below a path."""
    register(spark)
    reader = spark.read.format("sensor_members")
    return (reader if kind is None else reader.option("kind", kind)).load(path)


def members_of(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Rows of SCHEMA of files whose contents a table holds: archives by their ending, all else as CSV."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py() or b""
                if not name.lower().endswith(".zip"):
                    yield tidy(None, posixpath.basename(name), data)
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for m in z.infolist():
                            if _wanted(m.filename):
                                yield tidy(_stem(name), posixpath.basename(m.filename), _read(z, m.filename))
                except zipfile.BadZipFile:
                    yield tidy(_stem(name), posixpath.basename(name), None)

    small_batches(files.sparkSession)
    return files.select(F.col(path), F.col(content)).mapInArrow(run, SCHEMA)


def as_one_session(rows: DataFrame, session: str = "session") -> DataFrame:
    """Members of several archives as if they came from one: files are called z<i>_<name>, i being the archive's number by name.

    The numbers come from the archives' names alone, a row for each archive, joined back by Spark."""
    from pyspark.sql import Window

    numbers = rows.where("archive is not null").select(F.col("archive").alias("_a")).distinct().withColumn("_i", F.row_number().over(Window.orderBy("_a")) - 1)
    both = rows.join(numbers, F.col("archive") == F.col("_a"), "left")
    named = F.concat(F.lit("z"), F.coalesce("_i", F.lit(0)).cast("string"), F.lit("_"), F.col("source_file"))
    return both.withColumns({"archive": F.lit(session), "source_file": named}).select(*_NAMES)


def unusable(rows: DataFrame) -> DataFrame:
    """archive, source_file, kind, reason of the members that gave no rows."""
    return rows.where("reason is not null").select("archive", "source_file", "kind", "reason")
