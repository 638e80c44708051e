"""Streaming forms against the same sums over the whole table."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import scalar as S
from ridgeline.operators import sequences as Q
from ridgeline.streaming import sensors

START = datetime(2024, 1, 1)


@pytest.fixture
def events(spark, tmp_path):
    """Events of three keys in three files, the last ones late and out of order."""
    rows = [(k, START + timedelta(seconds=(37 * i + 11 * k) % 900 + 3600 * (i % 2)), float(i % 7), 46 + (i * 13 % 50) * 1e-4, 7 + (i * 7 % 40) * 1e-4) for k in range(3) for i in range(60)]
    table = spark.createDataFrame(rows, "k long, ts timestamp, v double, latitude double, longitude double")
    for i in range(3):
        table.where(F.pmod(F.hash("v", "ts"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    return table, stream, tmp_path


def last(stream, at, mode):
    """All that the stream gave, in the order of its batches."""
    def keep(rows, batch):
        rows.write.mode("overwrite").parquet(f"file://{at}/out/batch={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"file://{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"file://{at}/out").withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"batch=(\d+)", 1).cast("int")).orderBy("batch").collect()


def test_windows(spark, events):
    table, stream, at = events
    got = {(r.k, r.start): (r.n, r.mean) for r in last(sensors.windowed(stream, "k", "ts", "v", late="2 hours"), at, "update")}
    want = {(r.k, r.w.start): (r.n, r.mean) for r in table.groupBy("k", F.window("ts", "5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")).collect()}
    assert got == want


def test_sessions(spark, events):
    """An event of the next day closes all sessions before it."""
    table, stream, at = events
    later = table.limit(1).withColumn("k", F.lit(9).cast("long")).withColumn("ts", F.col("ts") + F.expr("interval 1 day"))
    later.coalesce(1).write.mode("append").parquet(f"file://{at}/in")
    got = {(r.k, r.start, r.end, r.n) for r in last(sensors.sessions(stream, "k", "ts", "10 minutes", late="2 hours"), at, "append")}
    want = table.groupBy("k", F.session_window("ts", "10 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    assert got == {(r.k, r.w.start, r.w.end, r.n) for r in want.collect()} and len(got) > 3


def test_running_distance(spark, events):
    """Fixes in order: the state's distance is that of the whole run."""
    table, _, at = events
    ordered = table.withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("v") / 100))
    for i in range(3):
        low, high = START + timedelta(minutes=40 * i), START + timedelta(minutes=40 * (i + 1))
        ordered.where((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.parquet(f"file://{at}/b{i}/part")
    want = {}
    rows = ordered.select("k", F.unix_micros("ts").alias("t"), "latitude", "longitude").dropDuplicates(["k", "t"])
    o = Q.Ordered("k", "t")
    step = S.haversine_m(o.lag("latitude"), o.lag("longitude"), F.col("latitude"), F.col("longitude"))
    for r in rows.withColumn("step", step).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("d")).collect():
        want[r.k] = (r.n, r.d)
    stream = spark.readStream.schema(ordered.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{at}/b*/part")
    got = {}
    for r in last(sensors.running_distance(stream, "k"), at, "update"):
        got[r.k] = max(got.get(r.k, (0, 0.0)), (r.n, r.distance_m))
    assert {k: n for k, (n, _) in got.items()}.keys() == want.keys() and all(got[k][0] <= want[k][0] for k in want)
    one = spark.readStream.schema(ordered.schema).parquet(f"file://{at}/b*/part")
    (at / "again").mkdir()
    whole = {r.k: (r.n, r.distance_m) for r in last(sensors.running_distance(one, "k"), at / "again", "update")}
    assert {k: n for k, (n, _) in whole.items()} == {k: n for k, (n, _) in want.items()} and all(whole[k][1] == pytest.approx(want[k][1]) for k in want)
