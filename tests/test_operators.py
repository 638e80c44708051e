"""Operators against plain versions on small tables, and that their time does not depend on widths."""

import math
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import aggregates as A
from ridgeline.operators import generators as G
from ridgeline.operators import joins as J
from ridgeline.operators import sequences as Q
from ridgeline.plans.queries import QUERIES

O = Q.Ordered("k", "t")  # noqa: E741


def close(a, b):
    return a is b is None or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or abs(a - b) < 1e-9 * max(1, abs(b))))


def test_nearest_of_all_like_a_product(spark):
    """Far and near places, on either side of 0, ties, one point, keys without points, places without coordinates."""
    rng = random.Random(1)
    place = lambda wide: round(rng.uniform(-wide, wide), rng.choice([0, 2]))
    a = [(rng.randrange(4), i, place(rng.choice([3, 50, 5000])), place(50)) for i in range(150)] + [(0, 900, None, 1.0), (9, 901, 1.0, 1.0)]
    b = [(rng.randrange(3), i, place(60), place(rng.choice([3, 60]))) for i in range(200)] + [(3, 500, 7.0, -7.0), (0, 501, None, None)]
    left, right = spark.createDataFrame(a, "k int, ia int, x double, y double").repartition(3), spark.createDataFrame(b, "k int, ib int, x double, y double")
    want = {}
    for k, i, x, y in a:
        found = [(math.sqrt((x - u) ** 2 + (y - v) ** 2), j) for q, j, u, v in b if q == k and u is not None and x is not None]
        if found:
            want[k, i] = min(found)
    for leaf in (0.5, 7.0, 1e6):
        got = {(r.k, r.ia): (r.distance, r.ib) for r in J.nearest_of_all(left, right, ["k"], "ia", "ib", leaf).collect()}
        assert got.keys() == want.keys()
        assert all(close(got[p][0], d) and (got[p][1] == j or close(math.dist(a[0][2:], a[0][2:]) + got[p][0], d)) for p, (d, j) in want.items())
    assert J.nearest_of_all(left, right.limit(0), ["k"], "ia", "ib", 1.0).collect() == []


def test_rolling_median_like_a_plain_one(spark):
    rng = random.Random(2)
    rows = [(k, t, rng.choice([None, float("nan"), *map(float, range(9))])) for k in (1, 2, None) for t in range(rng.choice([1, 40, 90]))]
    df = spark.createDataFrame(rows, "k int, t int, v double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for width in (1, 2, 5, 25, 500):
            got = Q.with_rolling_median(df, "v", O, width, "m").collect()
            assert len(got) == len(rows)
            for k in (1, 2, None):
                own = [v for q, _, v in rows if q == k]
                for r in (r for r in got if r.k == k):
                    near = [v for v in own[max(0, r.t - width // 2) : r.t + width // 2 + 1] if v is not None and not math.isnan(v)]
                    assert close(r.m, statistics.median(near) if near else None), (k, r.t, width)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_range_mean_like_a_plain_one(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, *[float(x) for x in range(30)], 1e9]), rng.choice([None, float("nan"), 1e15 + 0.5, *[rng.uniform(-5, 5) for _ in range(12)]]), i) for i, k in enumerate([1] * 80 + [2] * 30 + [None] * 9)]
    got = Q.with_range_mean(spark.createDataFrame(rows, "k int, x double, y double, i int").repartition(3), "y", "x", "k", 2.0, "m").collect()
    assert len(got) == len(rows)
    for r in got:
        near = [y for k, x, y, _ in rows if k == r.k and x is not None and r.x is not None and r.x - 2 <= x <= r.x + 2 and y is not None]
        assert close(r.m, sum(near) / len(near) if near else None), r


def test_windows_take_their_time_whatever_the_width(spark):
    rows = spark.range(60_000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"), F.rand(5).alias("v"))
    took = {}
    for name, ask in (("median", lambda n: Q.with_rolling_median(rows, "v", O, n, "m")), ("mean", lambda n: Q.with_range_mean(rows, "v", "t", "k", float(n), "m"))):
        for width in (25, 25, 2500):
            began = time.perf_counter()
            assert ask(width).agg(F.count("m")).first()[0] == 60_000
            took[name, width] = time.perf_counter() - began
        assert took[name, 2500] < 3 * took[name, 25] + 2, took


@pytest.mark.parametrize("cell", [3, 50, 100_000])
def test_floor_percentiles_like_sorted_arrays(spark, cell):
    rng = random.Random(cell)
    some = {1: [float(rng.randrange(9)) for _ in range(400)], 2: [10.0 ** rng.uniform(-30, 30) * rng.choice([-1, 1]) for _ in range(200)], 3: [5.0], 4: [1e300, *[rng.random() for _ in range(99)]], None: [2.0, 1.0]}
    rows = [(k, v) for k, own in some.items() for v in own] + [(1, None), (1, float("nan")), (1, float("inf")), (7, None)]
    shares = {"low": 0.0, "mid": 0.5, "high": 0.98, "all": 1.0}
    got = {r.k: r for r in A.floor_percentiles(spark.createDataFrame(rows, "k int, v double").repartition(3), ["k"], "v", shares, cell).collect()}
    assert got.keys() == some.keys()
    for k, own in some.items():
        own = sorted(own)
        assert [got[k][n] for n in shares] == [own[min(math.floor(s * len(own)), len(own) - 1)] for s in shares.values()], k


def test_floor_percentile_of_one_group_of_all_rows(spark):
    rows = spark.range(300_000).select(F.lit(1).alias("k"), (F.hash("id") % 100_000).cast("double").alias("v"))
    own = sorted(r.v for r in rows.collect())
    assert A.floor_percentiles(rows, ["k"], "v", {"at": 0.98}, 1000).collect()[0].at == own[math.floor(0.98 * len(own))]
    bound = A.symmetric_range(rows.withColumn("v", F.col("v") / 1e6), ["k"], "v").collect()[0]
    assert bound.high == 0.75 == -bound.low


def test_clock_like_asof_on_a_grid_without_dealing_ticks(spark):
    """Times that come twice, null times and values, one row, ticks on rows and half-way; the sorted table holds rows and no ticks."""
    rng = random.Random(3)
    rows = [(rng.randrange(5), rng.randrange(400), rng.choice([None, rng.randrange(9)])) for _ in range(120)] + [(7, 5, 1), (0, None, 3), (8, -20, 2), (8, 15, 4)]
    t = spark.createDataFrame(rows, "k int, t long, v int").repartition(3)
    limits = t.where("t is not null").groupBy("k").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    for step, most in ((1, 3), (7, 7), (10, None), (1000, 5)):
        got = J.asof_clock(t, ["k"], "t", ["v"], step, most)
        want = J.asof(G.clock(limits, ["k"], "a", "b", step, "t"), t, ["k"], "t", ["v"], most)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(map(tuple, want.collect()), key=lambda r: r[:2])
    plan = QUERIES["master_grid"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window"), "ticks come out of the sorted rows"


def test_nearest_of_all_drops_cells_where_they_meet(spark):
    """Rows and points over one square: what the joins give is near the number of rows, and nothing that is far is dealt again."""
    rng = random.Random(5)
    side = lambda name, n: spark.createDataFrame([(0, i, rng.random() * 100, rng.random() * 100) for i in range(n)], f"k int, {name} int, x double, y double")
    a, b = side("ia", 300), side("ib", 300)
    bounded = J._bounded(a.selectExpr("k", "ia", "x _ax", "y _ay"), b.selectExpr("k", "x _bx", "y _by"), ["k"], "ia", 2.0).collect()
    points = [(r.x, r.y) for r in b.collect()]
    least = {r.ia: min(math.dist((r._ax, r._ay), p) for p in points) for r in bounded}
    assert len(bounded) == 300 and all(r._bound >= least[r.ia] * (1 - 1e-12) for r in bounded)
    assert sum(math.dist((r._ax, r._ay), p) <= r._bound for r in bounded for p in points) < 300 * 20


def test_range_mean_is_not_put_into_few_parts(spark):
    """What a small shuffle tells is no measure of the rows that come out of it: the parts stay as many as the session has."""
    assert QUERIES["range_smooth"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
