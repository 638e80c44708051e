"""Readers, run processing, features and alignment on small made-up inputs."""

import io
import json
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import scalar as S
from ridgeline.operators import joins as J
from ridgeline.operators import sequences as Q
from ridgeline.plans import align, catalog, features, payload
from ridgeline.sources import archives, readers

O = Q.Ordered("run_id", "unix_ns")  # noqa: E741


def test_asof_edges(spark):
    left = spark.createDataFrame([(1, t) for t in (0, 5, 10, 20, 29, 41)], "k int, t long")
    right = spark.createDataFrame([(1, 0, 1.0), (1, 10, 2.0), (1, 10, 3.0), (1, 30, 4.0), (2, 41, 9.0)], "k int, t long, v double")
    got = {r.t: r.v for r in J.asof(left, right, ["k"], "t", ["v"], 10).collect()}
    assert got == {0: 1.0, 5: 1.0, 10: 3.0, 20: 3.0, 29: 4.0, 41: None}


def test_streams_on_a_grid_like_a_chain(spark):
    """One pass over all streams gives what two-sided joins in turn give, with ties, gaps, nulls and keys without rows."""
    rng = random.Random(11)
    grid = spark.createDataFrame([(k, t * 10, "g") for k in (1, 2, 3) for t in range(40)], "k int, t long, own string")
    some = lambda n, keys: [(rng.choice(keys), rng.randrange(400), float(rng.randrange(9)), rng.choice([None, 1.5]), rng.choice("ab")) for _ in range(n)]
    one, two = (spark.createDataFrame(some(n, keys), "k int, t long, v double, w double, kind string") for n, keys in ((60, (1, 2)), (90, (1, 3))))
    streams = [J.Stream(one, {"v1": F.col("v"), "w1": F.col("w")}, 7), *[J.Stream(two, {f"v_{x}": F.col("v")}, 20, where=F.col("kind") == x, ties="last") for x in "ab"], J.Stream(one, {"line": F.col("v")}, interpolated=True, ties="first")]
    got = {(r.k, r.t): tuple(r) for r in J.on_grid(grid, streams, ["k"], "t").select("k", "t", "own", "v1", "w1", "v_a", "v_b", "line").collect()}
    want = J.asof(grid, one.select("k", "t", F.col("v").alias("v1"), F.col("w").alias("w1")), ["k"], "t", ["v1", "w1"], 7)
    for x in "ab":
        want = J.asof(want, two.where(F.col("kind") == x).groupBy("k", "t").agg(F.max("v").alias(f"v_{x}")), ["k"], "t", [f"v_{x}"], 20)
    want = J.interpolate(want, one.groupBy("k", "t").agg(F.min("v").alias("line")), ["k"], "t", ["line"])
    want = {(r.k, r.t): tuple(r) for r in want.select("k", "t", "own", "v1", "w1", "v_a", "v_b", "line").collect()}
    near = lambda row: tuple(round(v, 9) if isinstance(v, float) else v for v in row)
    odd = [(v, want[k]) for k, v in got.items() if near(v) != near(want[k])]
    assert len(got) == 120 and not odd, repr([(list(a), list(b)) for a, b in odd]) + repr(sorted(r for r in one.collect() if r.k == 2 and r.t > 330))
    # Where a column comes again the later stream wins; a stream without rows leaves what there is.
    again = J.asof_attach(grid.withColumn("v", F.lit(-1.0)), [one.select("k", "t", "v"), two.select("k", "t", "v", "w")], ["k"], "t", 7)
    chain = J.asof(J.asof(grid, one.select("k", "t", F.col("v").alias("a")), ["k"], "t", ["a"], 7), two.select("k", "t", F.col("v").alias("b"), "w"), ["k"], "t", ["b", "w"], 7).select("k", "t", F.coalesce("b", "a", F.lit(-1.0)).alias("v"), "w")
    assert again.columns == ["k", "t", "own", "v", "w"] and sorted(map(str, again.select("k", "t", "v", "w").collect())) == sorted(map(str, chain.collect()))


def test_runs_are_processed_in_one_pass(spark):
    """One dealing, one sort each way and one kernel for all streams of a run; ties of places don't depend on the order of rows."""
    from ridgeline.plans import run

    t = spark.range(50).select(F.lit(1).cast("long").alias("run_id"), (F.col("id") * 40_000_000).alias("unix_ns"), "id")
    baro = t.select("run_id", "unix_ns", (900 + F.col("id") * 0.01).alias("pressure_mbar"), F.lit(100.0).alias("altitude_m"))
    gps = t.where("id % 10 = 0").select("run_id", "unix_ns", (46 + F.col("id") * 1e-6).alias("latitude"), F.lit(7.0).alias("longitude"), F.lit(3.0).alias("speed_m_s"), F.lit(None).cast("double").alias("horizontal_accuracy_m"), F.lit(5.0).alias("gps_altitude_m"))
    twice = gps.unionByName(gps.withColumn("latitude", F.col("latitude") + 1e-7))
    motion = t.select("run_id", "unix_ns", F.lit("gravity").alias("stream"), F.lit(0.5).alias("x"), F.lit(0.0).alias("y"), F.lit(9.7).alias("z"))
    rows = run.process(run.on_clock(baro, twice, motion))
    before = rows._jdf.queryExecution().sparkPlan().toString().split("MapInPandas")
    assert len(before) == 2
    plan = rows._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[-1]
    assert plan.count("Sort [") <= 4
    one, other = (run.on_clock(baro, g, motion).orderBy("unix_ns").select("latitude").collect() for g in (twice, twice.orderBy(F.desc("latitude"))))
    assert one == other
    (stats,) = run.run_stats(rows).collect()
    assert stats.sample_count == 197 and stats.sample_rate_hz == pytest.approx(100)


def test_interpolation_clamps(spark):
    left = spark.createDataFrame([(1, t) for t in (-5, 0, 5, 10, 99)], "k int, t long")
    right = spark.createDataFrame([(1, 0, 0.0), (1, 10, 20.0)], "k int, t long, v double")
    assert {r.t: r.v for r in J.interpolate(left, right, ["k"], "t", ["v"]).collect()} == {-5: 0.0, 0: 0.0, 5: 10.0, 10: 20.0, 99: 20.0}


def test_outer_coalesce_first_wins(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, None)], "t int, v string"), spark.createDataFrame([(1, "b"), (2, "b"), (3, "b")], "t int, v string")
    assert sorted(tuple(r) for r in J.outer_coalesce([a, b], ["t"]).collect()) == [(1, "a"), (2, "b"), (3, "b")]


def test_levelling_keeps_length(spark):
    rows = spark.createDataFrame([(3.0, -4.0, 8.0), (1.0, 2.0, -9.0), (0.0, 0.0, 9.8)], "x double, y double, z double")
    r = S.levelling_matrix(F.col("x"), F.col("y"), F.col("z"))
    for g in rows.withColumn("r", r).select("x", "y", "z", *[c.alias(n) for n, c in zip("abc", S.rotate(F.col("x"), F.col("y"), F.col("z"), F.col("r")))]).collect():
        assert abs(g.a) < 1e-9 and abs(g.b) < 1e-9 and abs(abs(g.c) - math.hypot(g.x, g.y, g.z)) < 1e-9 and g.c * g.z > 0


def test_zip_and_folder(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a/b/Location.csv", "time,latitude,longitude,speed\n1700000000,46.0,7.0,3\n1700000001,46.1,,4\n1700000002,46.2,7.2,x\n")
        z.writestr("Barometer.CSV", "time,pressure\n1700000000,101325\n1700000001,101325\n")
        z.writestr("Gyroscope.csv", "time,x,y,z\n1700000000,1,2,3\n")
        z.writestr("Metadata.csv", "device,x\nphone,1\n")
        z.writestr("broken.csv", b"\xff\xfe\x00\x01")
        z.writestr("readme.txt", "no")
    (tmp_path / "ride.zip").write_bytes(data.getvalue())
    (tmp_path / "torn.zip").write_bytes(data.getvalue()[:100])
    rows = archives.read_members(spark, f"file://{tmp_path}")
    kinds = {(r.source_file, r.kind, r.reason) for r in rows.select("source_file", "kind", "reason").distinct().collect()}
    assert kinds == {("Location.csv", "gps", None), ("Barometer.CSV", "baro", None), ("Gyroscope.csv", "aux", None), ("Metadata.csv", "metadata", "no_sensor"), ("broken.csv", None, "not_csv"), ("torn.zip", None, "unreadable")}
    gps = rows.where("kind = 'gps'").orderBy("unix_ns").collect()
    assert [(r.archive, r.line, r.unix_ns, r.latitude, r.speed_m_s) for r in gps] == [("ride", 0, 1700000000 * 10**9, 46.0, 3.0), ("ride", 2, 1700000002 * 10**9, 46.2, None)]
    baro = archives.read_members(spark, str(tmp_path), "baro").collect()
    assert len(baro) == 2 and all(abs(r.altitude_m) < 1e-6 and r.pressure_mbar == 1013.25 for r in baro)
    motion = rows.where("kind = 'aux'").collect()
    assert [(r.stream, r.x, r.z, r.latitude) for r in motion] == [("gyro", 1.0, 3.0, None)]
    assert {(r.source_file, r.reason) for r in archives.unusable(rows).collect()} == {("Metadata.csv", "no_sensor"), ("broken.csv", "not_csv"), ("torn.zip", "unreadable")}
    same = archives.members_of(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content"))
    assert sorted(map(str, same.collect())) == sorted(map(str, rows.collect()))
    (tmp_path / "Location.csv").write_text("time,latitude,longitude\n1,2,3\n")
    rows = archives.read_members(spark, f"file://{tmp_path}").where("archive is null")
    assert [(r.kind, r.unix_ns) for r in rows.collect()] == [("gps", 10**9)]
    assert rows.rdd.getNumPartitions() == 7  # a partition for each member and file
    (tmp_path / "none").mkdir()
    assert archives.read_members(spark, str(tmp_path / "none")).collect() == []


def test_telemetry_json_both_shapes(spark):
    rows = [{"unix_ns": 2, "latitude": 46.0, "longitude": 7.0, "vz_m_s": 1.5}, {"unix_ns": 1, "latitude": None, "longitude": 7.0}]
    columns = {"unix_ns": [2, 3], "latitude": [46.0, 46.5], "longitude": [7.0, 7.5], "vz_m_s": [None, 2.0]}
    df = spark.createDataFrame([("r", json.dumps(rows)), ("c", json.dumps(columns))], "k string, p string")
    got = sorted((r.k, r.unix_ns, r.vz_m_s) for r in readers.read_telemetry_json(df, "p", ["k"]).collect())
    assert got == [("c", 2, None), ("c", 3, 2.0), ("r", 2, 1.5)]


def test_payloads_and_what_is_left_out(spark):
    at = {"unix_ns": 1, "latitude": 46.0, "longitude": 7.0}
    columns = {"unix_ns": [5, 6], "latitude": [1.0, 2.0], "longitude": [3, 4], "heart_rate": [99, None], "altitude_m": [10.0, 11.0]}
    data = {
        "list": json.dumps([at | {"heart_rate": 120, "tags": ["a"]}, at | {"unix_ns": 2, "latitude": "x"}, 7, at | {"unix_ns": None}]), "columns": json.dumps(columns), "nan": '[{"unix_ns": 3, "latitude": 1, "longitude": 2, "vz_m_s": NaN, "altitude_m": -Infinity}]',
        "torn": "[{", "null": None, "number": "5", "empty": "[]", "none": "{}", "no rows": json.dumps({k: [] for k in at}), "no place": json.dumps([{"unix_ns": 1, "longitude": 2}]), "no time": json.dumps({"latitude": [1], "longitude": [1]}), "uneven": json.dumps(columns | {"latitude": [1]}), "scalar": json.dumps(columns | {"latitude": 3}),
    }
    df = spark.createDataFrame(list(data.items()), "k string, p string")
    rows, bad = readers.read_payloads(df, "p", ["k"])
    got = {(r.k, r.unix_ns): r for r in rows.select("*", F.try_variant_get("extra", "$.heart_rate", "int").alias("beats"), F.to_json("extra").alias("whole")).collect()}
    assert set(got) == {("list", 1), ("columns", 5), ("columns", 6), ("nan", 3)}
    assert [got[k].beats for k in (("list", 1), ("columns", 5), ("columns", 6))] == [120, 99, None]
    assert json.loads(got["list", 1].whole)["tags"] == ["a"] and got["nan", 3].vz_m_s is None and got["columns", 6].altitude_m == 11.0
    assert sorted((r.k, r.place, r.reason) for r in bad.where("place is not null").collect()) == [("list", 1, "bad_latitude"), ("list", 2, "not_a_record"), ("list", 3, "bad_unix_ns")]
    whole = {r.k: r.reason for r in bad.where("place is null").collect()}
    assert whole == {"torn": "not_json", "null": "not_json", "number": "not_telemetry", "empty": "empty", "none": "empty", "no rows": "empty", "no place": "missing_latitude", "no time": "missing_unix_ns", "uneven": "uneven_columns", "scalar": "uneven_columns"}
    kinds = readers.payload_columns(df.where("k in ('list', 'columns')"), "p").first()
    assert "heart_rate: ARRAY<BIGINT>" in kinds.columns and "VARIANT" in kinds.records
    needs = {r.k for r in readers.read_payloads(df, "p", ["k"], climb="required")[1].where("reason = 'missing_vz_m_s'").collect()}
    assert needs == {"list"}
    runs, left = align.runs_of_payloads(df.where("k in ('columns', 'list')"), "p", "k")
    assert {(r.k, r.vz_m_s) for r in runs.collect()} == {("columns", 50.0)} and left.count() == 1


def flight(run, g, rate=100, vz=0.0):
    return [(run, i * 10_000_000, float(x), float(x), float(x), vz, float(rate), float(i)) for i, x in enumerate(g)]


def test_flights(spark):
    jump = [1.0] * 50 + [1.3] * 10 + [0.1] * 30 + [2.0] * 20 + [1.0] * 50
    drop = [1.0] * 60 + [0.1] * 30 + [2.0] * 20 + [1.0] * 50
    short = [1.0] * 60 + [0.1] * 10 + [2.0] * 20
    soft = [1.0] * 60 + [0.1] * 30 + [1.0] * 50
    end = [1.0] * 60 + [0.1] * 30
    strict = [1.0] * 60 + [0.5] * 30 + [2.0] * 20
    data = flight(1, jump) + flight(2, drop) + flight(3, short) + flight(4, soft) + flight(5, end) + flight(6, strict, vz=-6.0) + flight(7, drop, vz=-2.0) + flight(8, [1.0] * 40)
    rows = spark.createDataFrame(data, "run_id int, unix_ns long, flight double, raw double, sustained double, vz double, rate double, distance_m double")
    found = features.flights(rows, O, "rate", "flight", "raw", "sustained", "vz", F.lit(True)).cache()
    assert {r.run_id: r.kind for r in found.collect()} == {1: "jump", 2: "drop", 3: "candidate_too_short", 4: "landing_peak", 5: "landing_peak", 6: "refine_duration", 7: "witnessed_drop"}
    assert {r.run_id: r.airtime_s for r in features.airtime(found, ["run_id"]).collect()}[1] == pytest.approx(0.3)
    assert {r.run_id for r in features.almost(found, ["run_id"]).collect()} == {3, 4, 5, 6}


def line_run(spark, run, reverse=False, off=0.0, start=0, n=300):
    rows = [(run, i * 10**9, 46.0 + (start + (n - 1 - i if reverse else i)) * 1e-5, 7.0 + off, 500.0 - i * 0.1, math.sin(i / 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "run_id long, unix_ns long, latitude double, longitude double, altitude_smooth_m double, vz_m_s double")
    return Q.with_elapsed(Q.with_distance(df, O), O).withColumn("pair", F.lit(1).cast("long"))


def test_corridor(spark):
    a, b = line_run(spark, 1), line_run(spark, 2, off=5e-5, start=50)
    (found,) = align.shared_corridor(a, b, ["pair"]).collect()
    assert found.a_start >= 40 and found.a_end - found.a_start > 200 and found.median_m < 5
    assert align.shared_corridor(a, line_run(spark, 2, reverse=True), ["pair"]).collect() == []
    assert align.shared_corridor(a, line_run(spark, 2, off=1e-3), ["pair"]).collect() == []
    _, _, meta = align.align_auto(a, b, "pair")
    assert meta.collect()[0].reason == "already_agrees"
    x, y, lag = align.align_gate(a, b, "pair", 46.001, 7.0)
    row = lag.collect()[0]
    assert x.count() > 100 and row.gate_row_a == 84 and row.gate_row_b == 34 and row.n_samples >= 32
    assert abs(row.bearing_deg) < 1e-6 and row.gate_lon_a > row.gate_longitude_a > row.gate_lon_b and row.gate_lat_a == pytest.approx(row.gate_latitude_a)
    assert max(r.distance_m for r in x.collect()) == pytest.approx(max(r.distance_m for r in y.collect()), abs=1.5)
    assert align.gate_of(lag, "pair").collect()[0].gate_line[0].longitude == row.gate_lon_a
    _, _, few = align.align_auto(a.where("distance_m < 400"), b, "pair", least=10_000)
    assert few.collect()[0].reason == "too_few_rows"


def test_catalog(spark):
    trails = spark.createDataFrame([("1", "Black"), ("2", "Blue")], "id string, name string")
    new = spark.createDataFrame([("3", " black "), ("4", "Red"), ("5", "RED"), ("6", " ")], "id string, name string")
    assert sorted(r.name for r in catalog.create_trails(trails, new).collect()) == ["Black", "Blue", "Red"]
    assert catalog.find_trail(trails, "  BLUE").count() == 1
    files = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "a"), ("s2", "b"), ("s2", "b"), ("s3", "a"), ("s4", "a"), ("s4", "b"), ("s4", "c")], "session_id string, blob_sha256 string")
    sessions = spark.createDataFrame([(f"s{i}", "t", float(i)) for i in range(1, 5)], "id string, trail_id string, created_at double")
    assert [r.session_id for r in catalog.find_duplicate(files, sessions, ["b", "a"]).collect()] == ["s2"]
    assert catalog.find_duplicate(files, sessions, ["a", "b"], trail="other").collect() == []


def test_payload_and_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 46.0, float("nan")), (1, 1, 45.0, 3.0)], "run_id int, unix_ns long, latitude double, vz_m_s double")
    stats = spark.createDataFrame([(1, 2)], "run_id int, sample_count int")
    got = json.loads(payload.run_payload(rows, stats).collect()[0].payload)
    assert got["telemetry"] == {"unix_ns": [1, 2], "latitude": [45.0, 46.0], "vz_m_s": [3.0, None]} and got["sample_count"] == 2
    path = payload.export_runs(rows, stats, str(tmp_path), "my ride/1")
    assert "_my_ride_1_" in path and payload.export_runs(rows, stats, str(tmp_path), enabled="off") is None
    got = spark.read.option("header", True).csv(f"{path}/runs").drop("run")
    assert got.count() == 2 and got.columns == rows.columns
    (meta,) = spark.read.json(f"{path}/meta").collect()
    assert (meta.run_id, meta.n_rows, meta.sample_count, meta["columns"]) == (1, 2, 2, rows.columns) and spark.read.text(f"{path}/README").count() == 3
    assert json.loads(payload.folder_summary(rows).first().summary) == {"run_count": 1, "points": 2, "sample_keys": ["latitude", "unix_ns", "vz_m_s"]}


def test_stored_results(spark, tmp_path):
    from ridgeline.plans import session

    (tmp_path / "kept.json").write_text('{"runs": []}')
    row = lambda path: spark.createDataFrame([("s", path)], "id string, result_json_path string")
    files, blobs = spark.createDataFrame([], "blob_sha256 string, original_filename string"), spark.createDataFrame([], "sha256 string, content binary")
    kept = lambda path: session.session_result(spark, row(path), files, blobs)
    assert kept(f"file://{tmp_path}/kept.json").first().payload == '{"runs": []}'
    assert kept(None) is None and kept(f"file://{tmp_path}/none.json") is None
    gone = spark.createDataFrame([("h", "a.zip")], "blob_sha256 string, original_filename string")
    assert session.session_result(spark, row(None), gone, blobs) is None


def test_interval_join_like_a_product(spark):
    """Intervals of very different lengths, points among them, with and without a key; both ends count."""
    rng = random.Random(3)
    points = [(float(rng.randrange(-40, 90)), rng.randrange(2)) for _ in range(120)]
    spans = [(i, low, low + rng.choice([0.0, 0.25, 3.0, 100.0, 7000.0]), rng.randrange(2)) for i, low in enumerate([float(rng.randrange(-90, 90)) for _ in range(40)])] + [(99, 5.0, 4.0, 0)]
    rows, intervals = spark.createDataFrame(points, "d double, k int"), spark.createDataFrame(spans, "id int, low double, high double, k int")
    got = sorted((r.d, r.id) for r in J.in_intervals(rows.drop("k"), intervals.drop("k"), "d", "low", "high", slack=0.5).collect())
    assert got == sorted((d, i) for d, _ in points for i, a, b, _ in spans if a <= b and a - 0.5 <= d <= b + 0.5)
    got = sorted((r.d, r.id, r.k) for r in J.in_intervals(rows, intervals, "d", "low", "high", ["k"]).collect())
    assert got == sorted((d, i, k) for d, k in points for i, a, b, q in spans if a <= d <= b and k == q)


def test_zip_to_processed_run(spark, tmp_path):
    from ridgeline.plans import run, session

    start = 1_700_000_000_000_000_000
    table = lambda head, rows: head + "\n" + "\n".join(",".join(map(str, r)) for r in rows)
    gps = table("time,latitude,longitude,speed", [(start + i * 10**9, 46 + i * 1e-5, 7.0, 4.0) for i in range(13)])
    baro = table("time,pressure", [(start + i * 40_000_000, 900 + i * 0.01) for i in range(300)])
    gravity = table("time,x,y,z", [(start + i * 20_000_000, 0.5, 0.0, 9.7) for i in range(600)])
    with zipfile.ZipFile(tmp_path / "ride.zip", "w") as z:
        z.writestr("Location.csv", gps)
        z.writestr("Barometer.csv", baro)
        z.writestr("Gravity.csv", gravity)
    rows = session.process_zips(spark, f"file://{tmp_path}").cache()
    assert rows.count() in (1197, 1198)
    (stats,) = run.run_stats(rows).collect()
    assert stats.distance_m == pytest.approx(13.3, abs=0.3) and stats.duration_s == pytest.approx(11.96)
    assert stats.sample_rate_hz == pytest.approx(100)
    level = rows.select(F.max(F.abs("gravity_x")), F.min("gravity_z"), F.min("vz_m_s")).first()
    assert level[0] < 1e-9 and level[1] > 9.7 and level[2] < -1
    with pytest.raises(ValueError):
        session.inside("/data", "../etc")


def test_missing_climb_and_distance(spark):
    rows = line_run(spark, 1).drop("vz_m_s", "distance_m", "time_s", "step_m")
    got = align.with_known_distance(align.with_climb(rows, "run_id"), "run_id").orderBy("unix_ns").collect()
    assert all(r.vz_m_s == pytest.approx(-0.1) for r in got[2:-2]) and got[-1].distance_m == pytest.approx(299 * 1.11195, rel=1e-4)
    assert align.with_known_distance(rows.withColumn("distance_m", F.col("unix_ns") * 1e-9), "run_id").agg(F.max("distance_m")).first()[0] == pytest.approx(299.0)
    with pytest.raises(ValueError):
        align.with_climb(rows.drop("altitude_smooth_m"), "run_id")


def test_session_of_several_archives_and_stored_blobs(spark, tmp_path):
    import io
    import zipfile

    from ridgeline.plans import session

    start = 1_700_000_000

    def archive(stamp, axis):
        gps = "datetime,Latitude,lat,longitude\n" + "\n".join(f"{stamp(i)},{46 + i * 1e-5},0,7.0" for i in range(20))
        baro = "time,pressure\n" + "\n".join(f"{start + i * 0.1},{950 + i * 0.01}" for i in range(190))
        acc = f"time,{axis} X (m/s2),{axis} y,{axis}  Z\n" + "\n".join(f"{start + i * 0.1},{i},1,2" for i in range(190))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in (("Location.csv", gps), ("Barometer.csv", baro), ("TotalAcceleration.csv", acc)):
                z.writestr(f"x/{name}", text)
        return out.getvalue()

    import datetime

    stamp = lambda i: datetime.datetime.fromtimestamp(start + i, datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    for name in ("b.zip", "a.zip"):
        (tmp_path / name).write_bytes(archive(stamp, "Acceleration"))
    cells = archives.as_one_session(archives.read_members(spark, str(tmp_path)))
    assert {r[0] for r in cells.select("source_file").distinct().collect()} == {f"z{i}_{n}.csv" for i in (0, 1) for n in ("Location", "Barometer", "TotalAcceleration")}
    names = session.run_names(cells).collect()
    assert sorted(r.label for r in names) == ["First run", "Second run"] and {r.source_name for r in names} == {"session"}
    gps, _, motion = session.streams(cells)
    first = gps.orderBy("unix_ns").first()
    assert first.unix_ns == start * 10**9 and first.latitude == 46.0
    assert {(r.x, r.y, r.z) for r in motion.where(F.col("unix_ns") == start * 10**9).collect()} == {(0.0, 1.0, 2.0)}
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    root = f"file://{tmp_path}/store"
    assert catalog.store_blobs(spark, root, files).count() == 1 == catalog.store_blobs(spark, root, files).count()
    blobs = catalog.Store(spark, root).read("blobs")
    own = blobs.select(F.col("sha256").alias("blob_sha256"), F.lit("a.zip").alias("original_filename"))
    assert session.process_blobs(blobs, own).select("run_id").distinct().count() == 1


def session_tables(spark, id="s1"):
    row = lambda schema, *values: spark.createDataFrame([values], schema)
    return row("id string, trail_id string, status string, created_at double", id, "t", "done", 1.0), row("id string, session_id string, label string", f"{id}-r", id, "First run"), row("session_id string, blob_sha256 string, original_filename string", id, "h", "a.zip")


def test_commits_over_several_tables(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    store = catalog.Store(spark, root)
    assert store.read("runs").collect() == [] and store.read("runs").columns == [f.split()[0] for f in catalog.SCHEMAS["runs"].split(", ")]
    # A writer that dies between its tables, or before its marker, leaves nothing to be seen.
    session, runs, files = session_tables(spark)
    with pytest.raises(Exception):
        store.commit("session-s1", {"upload_sessions": session, "runs": runs.withColumn("id", F.raise_error("killed"))})
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(catalog.Store, "_mark", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        catalog.store_session(spark, root, "s1", session, runs, files)
    assert all(store.read(n).count() == 0 for n in ("upload_sessions", "runs", "session_files"))
    # Once more, and twice: each row is there once, with today's columns.
    assert catalog.store_session(spark, root, "s1", session, runs, files)
    assert not catalog.store_session(spark, root, "s1", session, runs, files)
    (row,) = store.read("upload_sessions").collect()
    assert (row.id, row.comparison_ready, row.source_names_json, row.error) == ("s1", 0, "[]", None)
    assert store.sweep() >= 3 and store.read("runs").count() == 1
    # Another writer gets in between what is staged and the marker: its rows are not added again.
    mark, first = catalog.Store._mark, []
    def late(self, number, content):
        if not first:
            first.append(1)
            assert catalog.Store(spark, root).commit("other", {"runs": session_tables(spark, "s2")[1]})
        return mark(self, number, content)

    monkeypatch.setattr(catalog.Store, "_mark", late)
    assert store.commit("mine", {"runs": session_tables(spark, "s2")[1].unionByName(session_tables(spark, "s3")[1])})
    assert [c["id"] for c in store.commits()] == ["session-s1", "other", "mine"] and [c["number"] for c in store.commits()] == [1, 2, 3]
    assert sorted(r.id for r in store.read("runs").collect()) == ["s1-r", "s2-r", "s3-r"]


def test_backfill_of_older_uploads(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    old = [("f1", "s1", "a.zip", "a", 5, "h1", "p1", 2.0), ("f2", "s1", "b.zip", "b", 5, "h1", "p1", 1.0), ("f3", "s2", "c.zip", "c", 5, "h1", "p1", 3.0)]
    rows = spark.createDataFrame(old, "id string, session_id string, original_filename string, stem string, size_bytes long, sha256 string, blob_path string, created_at double")
    store = catalog.Store(spark, root)
    store.commit("old", {"upload_files": rows})
    assert catalog.backfill_files(spark, root) and not catalog.backfill_files(spark, root)
    assert [(r.sha256, r.first_original_filename, r.content_type) for r in store.read("file_blobs").collect()] == [("h1", "b.zip", None)]
    assert sorted((r.id, r.session_id) for r in store.read("session_files").collect()) == [("f2", "s1"), ("f3", "s2")]


def test_peak_of_landing_without_flights(spark):
    from ridgeline.functions import dsp

    y = np.zeros(300)
    y[100], y[150], y[151] = 2.0, 1.6, 1.5
    assert dsp.peaks(y, 1.3, 6, 0.35, 18).tolist() == [100, 150]


def test_reasons_of_altitude_agreement(spark):
    """Every reason, the offset, and the place from which altitudes agree."""
    def side(pair, n, height, step=1.0):
        return [(pair, i * 10**9, i * step, height(i)) for i in range(n)]

    down = lambda i: 500 - i * 0.1
    off = lambda far: lambda i: 500 - i * 0.1 + 7 + (30.0 if i < far else 0.0)
    a = side(1, 300, down) + side(2, 300, down) + side(3, 60, down) + side(4, 3, down) + side(5, 300, lambda i: None if i > 2 else 1.0) + side(6, 220, down) + side(7, 300, down)
    b = side(1, 300, off(0)) + side(2, 301, off(100)) + side(3, 300, down) + side(4, 300, down) + side(5, 300, down) + side(6, 220, off(150)) + side(7, 300, lambda i: float(i % 60 * 9))
    kind = "pair long, unix_ns long, distance_m double, altitude_m double"
    left, right = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind).withColumnRenamed("altitude_m", "altitude_smooth_m")
    got = {r.pair: r for r in align.altitude_agreement(left, right, ["pair"]).collect()}
    assert {k: r.reason for k, r in got.items()} == {1: "already_agrees", 2: "leading_altitude_disagreement", 3: "overlap_too_short", 4: "missing_altitude", 5: "not_enough_altitude", 6: "trim_would_leave_too_little", 7: "already_agrees"}
    assert got[2].trim_m == 100.0 and got[2].stable_offset_m == pytest.approx(-7) and got[2].initial_residual_m == pytest.approx(30) and got[2].residual_at_start_m == pytest.approx(0, abs=1e-9)
    assert all(r.trim_m == 0 for k, r in got.items() if k != 2)
    assert {r.reason for r in align.altitude_agreement(left.drop("altitude_m"), right, ["pair"]).collect()} == {"missing_altitude"}


def test_runs_without_climb_and_distance_align(spark):
    a, b = (line_run(spark, k, off=k * 1e-5).drop("vz_m_s", "distance_m", "time_s", "step_m") for k in (1, 2))
    x, y, meta = align.align_auto(a, b, "pair")
    row = meta.collect()[0]
    assert row.reason == "already_agrees" and row.n_samples >= 32 and x.count() > 200 and y.count() > 200
    _, _, lag = align.align_gate(a, b, "pair", 46.001, 7.0)
    assert lag.collect()[0].gate_row_a > 50


def test_prepared_runs(spark):
    """Altitude and vertical acceleration from what a run has, in the order of preference."""
    from ridgeline.plans import canonical

    rows = spark.createDataFrame([(1, i, 900.0, 3.0, 1.0, 2.0, 0.0, 0.0, 9.8, 0.0, 0.0, 10.8, 0.5) for i in range(5)], "run_id int, unix_ns long, pressure_mbar double, speed_m_s double, altitude_from_pressure_m double, altitude_smooth_m double, gravity_x_filt double, gravity_y_filt double, gravity_z_filt double, total_acc_x_filt double, total_acc_y_filt double, total_acc_z_filt double, acc_z_filt double")
    high = 44330 * (1 - (900 / 1013.25) ** 0.1903)
    want = 44330 * (1 - ((900 + 0.5 * 1.225 * math.exp(-high / 8500) * 9 / 100) / 1013.25) ** 0.1903)
    height = lambda d: canonical.corrected_altitude(d, "run_id").first().altitude_m
    push = lambda d: canonical.vertical_acceleration(d, "run_id").first().vertical_acc
    assert height(rows) == pytest.approx(want) and height(rows.drop("pressure_mbar")) == 1.0 and height(rows.drop("pressure_mbar", "altitude_from_pressure_m")) == 2.0
    with pytest.raises(ValueError):
        height(rows.select("run_id", "unix_ns"))
    assert push(rows) == pytest.approx(S.GRAVITY_M_S2 - 10.8)
    assert push(rows.drop("gravity_x_filt")) == 0.0 and push(rows.select("run_id", "unix_ns")) == 0.0
    acc = rows.withColumns({f"acc_{a}_filt": F.lit(1.0) for a in "xyz"}).drop("total_acc_x_filt")
    assert push(acc) == pytest.approx(-1.0)


def test_written_tables_are_as_large_as_their_rows(spark):
    """Even series compress well; a join with such a table must not be planned as a broadcast of all its rows."""
    from ridgeline.sources.shared import written

    rows = written(spark.range(2_000_000).select((F.col("id") % 100).alias("k"), F.lit(1.5).alias("v")), "even")
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size >= 16 * 2_000_000
    other = rows.withColumnRenamed("v", "w").unionByName(spark.createDataFrame([(1, 2.0)], "k long, w double"))
    assert "BroadcastHashJoin" not in rows.join(other, "k")._jdf.queryExecution().executedPlan().toString()


def test_payloads_are_parsed_once(spark):
    """What is left out and what is read come from one table: conditions must not hold the parsing of the payload."""
    docs = spark.createDataFrame([(1, '[{"unix_ns": 1, "latitude": 2, "longitude": 3}, {"unix_ns": 1}]'), (2, "{")], "run_id long, payload string")
    rows, bad = readers.read_payloads(docs, "payload", ["run_id"])
    assert "parse_json" not in bad._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in bad.collect()} == {(1, 1, "bad_latitude"), (2, None, "not_json")} and rows.count() == 1


def test_long_recordings_go_on_in_further_files(spark, tmp_path, monkeypatch):
    """A task holds a whole file, so files are bounded, and what is read from them stays the same."""
    from ridgeline.plans import source_queries

    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, source_queries.member_files(spark, sf).collect()))
    monkeypatch.setattr(source_queries, "RECORDS", 20)
    monkeypatch.setattr(source_queries, "new_folder", lambda _, what: str(tmp_path / what))
    got = source_queries.member_files(spark, sf)
    assert sorted(map(tuple, got.collect())) == want
    files = list((tmp_path / "members").glob("*.csv"))
    assert len(files) >= len(want) / 20 and max(len(f.read_text().splitlines()) for f in files) <= 21
