"""Queries that apply the operators to the driver's tables, with the SQL that must give the same rows.

A track is read from `events`: a run for each user, a place, speed, pressure and accuracy from the event's numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import scalar as S
from ridgeline.operators import aggregates as A
from ridgeline.operators import generators as G
from ridgeline.operators import joins as J
from ridgeline.operators import sequences as Q
from ridgeline.plans import catalog, compare
from ridgeline.plans.sql import DIST, TRACK, W, hav
from ridgeline.sources.shared import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RUN = Q.Ordered("run_id", ["unix_ns", "event_id"])
#: Of runs on a clock of their own, where no time comes twice.
EVEN = Q.Ordered("run_id", "unix_ns")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("run_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("unix_ns"), (46 + (F.col("event_id") % 997) * 1e-5).alias("latitude"), (7 + ((F.col("event_id") * 31) % 991) * 1e-5).alias("longitude"),
        (F.col("value") / 20).alias("speed_m_s"), (850 + (F.col("event_id") % 500) * 1e-1).alias("pressure_mbar"), F.get_json_object("props", "$.k").try_cast("double").alias("accuracy"), "event_type",
    )


def dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.with_elapsed(Q.with_distance(track(spark, sf_dir), RUN), RUN)


def r6(c: str | Column, name: str | None = None) -> Column:
    out = F.round(c, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


# Runs ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {DIST} SELECT run_id, count(*) AS n_samples, round(max(distance_m),4) AS distance_m, round(max(time_s),6) AS duration_s, round(avg(speed_m_s),6) AS mean_speed_m_s FROM dist GROUP BY run_id")
def track_distance(spark, sf_dir):
    return dist(spark, sf_dir).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.max("distance_m"), 4).alias("distance_m"), r6(F.max("time_s"), "duration_s"), r6(F.avg("speed_m_s"), "mean_speed_m_s"))


_DT = f"WITH {TRACK}, d AS (SELECT run_id, (unix_ns - lag(unix_ns) OVER {W})*1e-9 AS dt FROM track)"


@query(_DT + " SELECT run_id, round(coalesce(median(dt),1.0),6) AS median_dt_s FROM d GROUP BY run_id")
def median_dt(spark, sf_dir):
    return A.median_interval(track(spark, sf_dir), RUN).select("run_id", r6("median_dt_s"))


@query(_DT + " SELECT run_id, round(coalesce(1/(median(dt) FILTER (dt > 0)),25.0),9) AS sample_rate_hz FROM d GROUP BY run_id")
def sample_rate(spark, sf_dir):
    return A.sample_rate(track(spark, sf_dir), RUN).select("run_id", F.round("sample_rate_hz", 9).alias("sample_rate_hz"))


@query(f"WITH {TRACK} SELECT run_id, round(1/(stddev_pop(speed_m_s)+1e-6),6) AS smoothness, round(least(greatest(1.12*quantile_cont(abs(speed_m_s),0.99),2.0),45.0),6) AS half_span, round(least(quantile_cont(speed_m_s,0.992),20.0),6) AS capped FROM track GROUP BY run_id")
def run_scales(spark, sf_dir):
    return track(spark, sf_dir).groupBy("run_id").agg(r6(A.smoothness("speed_m_s"), "smoothness"), r6(A.half_span("speed_m_s"), "half_span"), r6(A.capped_percentile("speed_m_s", 0.992, 20.0), "capped"))


@query(f"""WITH {DIST}, d AS (SELECT run_id, max(time_s) - min(time_s) AS duration_s FROM dist GROUP BY run_id), b AS (SELECT * FROM d ORDER BY duration_s DESC, run_id LIMIT 1)
SELECT d.run_id, round(d.duration_s,6) AS duration_s, round(d.duration_s - b.duration_s,6) AS against_baseline_s, d.run_id = b.run_id AS is_baseline FROM d, b""")
def baseline_run(spark, sf_dir):
    d = A.run_durations(dist(spark, sf_dir), RUN, "time_s")
    b = A.slowest(d, "run_id").select(F.col("run_id").alias("_run"), F.col("duration_s").alias("_most"))
    return d.join(F.broadcast(b)).select("run_id", r6("duration_s"), r6(F.col("duration_s") - F.col("_most"), "against_baseline_s"), (F.col("run_id") == F.col("_run")).alias("is_baseline"))


# Units and labels ----------------------------------------------------------------------------------------------------


@query(f"""WITH {TRACK}, raw AS (SELECT run_id, event_id, CASE WHEN run_id % 3 = 0 THEN floor(unix_ns/1e9) WHEN run_id % 3 = 1 THEN floor(unix_ns/1e6) ELSE unix_ns::DOUBLE END AS t,
 CASE WHEN run_id % 2 = 0 THEN pressure_mbar*100 ELSE pressure_mbar END AS p, CASE WHEN run_id % 2 = 0 THEN (event_id % 170)*1.0 ELSE (event_id % 30)*1e-1 END AS a FROM track),
m AS (SELECT run_id, max(t) AS mt, median(p) AS mp, max(abs(a)) AS ma FROM raw GROUP BY run_id)
SELECT raw.run_id, event_id, (t * CASE WHEN mt < 1e12 THEN 1e9 WHEN mt < 1e15 THEN 1e6 ELSE 1.0 END)::BIGINT AS unix_ns, round(CASE WHEN mp > 2000 THEN p/100 ELSE p END,6) AS pressure_mbar,
 round(CASE WHEN ma > 3.6 THEN radians(a) ELSE a END,6) AS angle_rad FROM raw JOIN m USING (run_id)""")
def unit_detect(spark, sf_dir):
    mod = lambda n: F.col("run_id") % n
    raw = track(spark, sf_dir).select(
        "run_id", "event_id", F.when(mod(3) == 0, F.floor(F.col("unix_ns") / 1e9)).when(mod(3) == 1, F.floor(F.col("unix_ns") / 1e6)).otherwise(F.col("unix_ns")).cast("double").alias("t"),
        F.when(mod(2) == 0, F.col("pressure_mbar") * 100).otherwise(F.col("pressure_mbar")).alias("p"), F.when(mod(2) == 0, (F.col("event_id") % 170) * 1.0).otherwise((F.col("event_id") % 30) * 1e-1).alias("a"),
    )
    scales = raw.groupBy("run_id").agg(F.max("t").alias("mt"), F.percentile("p", F.lit(0.5)).alias("mp"), F.max(F.abs("a")).alias("ma"))
    return raw.join(scales, "run_id").select("run_id", "event_id", S.epoch_to_ns(F.col("t"), F.col("mt")).alias("unix_ns"), r6(S.pressure_to_mbar(F.col("p"), F.col("mp")), "pressure_mbar"), r6(S.angle_to_radians(F.col("a"), F.col("ma")), "angle_rad"))


@query("SELECT doc_id, TRY_CAST(substr(source, 4) AS DOUBLE) AS coerced, left(regexp_replace(source || ' ' || text, '[^\\p{L}\\p{N}\\p{M}_\\-.]+', '_', 'g'), 64) AS stem FROM documents")
def safe_stem(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr("substring(source, 4)").try_cast("double").alias("coerced"), S.safe_stem(F.concat("source", F.lit(" "), "text")).alias("stem"))


_ORD = ", ".join(f"'{x}'" for x in S.ORDINALS)


@query(f"""SELECT c_custkey, CASE WHEN c_custkey BETWEEN 1 AND 10 THEN list_element([{_ORD}], c_custkey::INT) || ' run' ELSE c_custkey::VARCHAR || CASE WHEN c_custkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN c_custkey % 10 = 1 THEN 'st'
 WHEN c_custkey % 10 = 2 THEN 'nd' WHEN c_custkey % 10 = 3 THEN 'rd' ELSE 'th' END || ' run' END AS label FROM customer""")
def ordinal_label(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.ordinal_label(F.col("c_custkey")).alias("label"))


@query("""WITH c AS (SELECT event_id, event_id * 37 % 100000 AS cents, event_id * 997 % 2500000 * 2 + 1 AS n, value FROM events)
SELECT event_id, (cents // 6000)::VARCHAR || ':' || lpad((cents // 100 % 60)::VARCHAR, 2, '0') || '.' || lpad((cents % 100)::VARCHAR, 2, '0') AS duration,
 CASE WHEN n < 1024 THEN n::VARCHAR || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n/1024.0) ELSE printf('%.1f MB', n/1048576.0) END AS bytes,
 CASE WHEN n >= 100 THEN printf('%.2f km', n/100.0) ELSE printf('%.0f m', (n*10)::DOUBLE) END AS distance,
 CASE WHEN value > 300 THEN 'good' WHEN value >= 150 THEN 'fair' ELSE 'poor' END AS sync FROM c""")
def format_labels(spark, sf_dir):
    c = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 37 % 100000).alias("cents"), (F.col("event_id") * 997 % 2500000 * 2 + 1).alias("n"), "value")
    return c.select("event_id", S.duration_label(F.col("cents") / 100.0).alias("duration"), S.bytes_label(F.col("n")).alias("bytes"), S.distance_label(F.col("n") * F.lit(10.0)).alias("distance"), S.sync_label(F.when(F.col("value") > 300, 0.61).when(F.col("value") >= 150, 0.3).otherwise(0.1)).alias("sync"))


_STEMS = ["Gyroscope.csv", "z0_Gyroscope.csv", "dir/GyroscopeUncalibrated.CSV", "z12_Total Acceleration.csv", "Gravity.csv", "accelerometer-uncalibrated.csv", "Accelerometer_2.csv", "Orientation.csv", "Location.csv", "Metadata.csv", "my gravity.csv", "old_Accelerometer.csv", "Barometer.csv"]


@query(f"""WITH n AS (SELECT event_id, list_element([{", ".join(f"'{s}'" for s in _STEMS)}], (event_id % 13)::INT + 1) AS name FROM events),
b AS (SELECT event_id, name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '^.*[/\\\\]', ''), '\\.[^.]*$', ''), '^z\\d+_', ''), '[\\s\\-_]', '', 'g') AS s FROM n)
SELECT event_id, name, CASE WHEN s = 'metadata' OR starts_with(s,'location') OR contains(s,'barometer') THEN NULL WHEN contains(s,'gyroscopeuncalibrated') THEN 'gyro_uncal' WHEN starts_with(s,'gyroscope') THEN 'gyro' WHEN contains(s,'accelerometeruncalibrated') THEN 'acc_uncal'
 WHEN contains(s,'totalacceleration') THEN 'total_acc' WHEN contains(s,'gravity') THEN 'gravity' ELSE 'acc' END AS prefix,
 contains(s,'gyroscope') OR contains(s,'accelerometer') OR contains(s,'totalacceleration') OR contains(s,'gravity') OR contains(s,'orientation') AS is_motion FROM b""")
def stream_prefix(spark, sf_dir):
    names = F.array(*map(F.lit, _STEMS))
    rows = table(spark, sf_dir, "events").select("event_id", F.element_at(names, (F.col("event_id") % 13 + 1).cast("int")).alias("name"))
    return rows.select("event_id", "name", S.stream_prefix(F.col("name")).alias("prefix"), S.is_motion_sensor(F.col("name")).alias("is_motion"))


# Scalars ------------------------------------------------------------------------------------------------------------

_ALT = "44330.0*(1-power(pressure_mbar/1013.25,0.1903))"


@query(f"""WITH {TRACK} SELECT event_id, round({_ALT},6) AS altitude_m, round(1.225*exp(-({_ALT})/8500.0),9) AS density, round(0.5*1.225*exp(-({_ALT})/8500.0)*speed_m_s*speed_m_s/100,6) AS dynamic_mbar,
 round(44330.0*(1-power((pressure_mbar + 0.5*1.225*exp(-({_ALT})/8500.0)*speed_m_s*speed_m_s/100)/1013.25,0.1903)),6) AS corrected_m FROM track""")
def bernoulli(spark, sf_dir):
    alt = S.hypsometric_m(F.col("pressure_mbar"))
    q = S.dynamic_pressure_mbar(S.air_density(alt), F.col("speed_m_s"))
    return track(spark, sf_dir).select("event_id", r6(alt, "altitude_m"), F.round(S.air_density(alt), 9).alias("density"), r6(q, "dynamic_mbar"), r6(S.hypsometric_m(F.col("pressure_mbar") + q), "corrected_m"))


_GX, _GY, _GZ = "((event_id % 21)-10)*1.0", "((event_id % 13)-6)*1.0", "((event_id % 17)-8)*1.0"


@query(f"""WITH v AS (SELECT event_id, {_GX} AS x, {_GY} AS y, {_GZ} AS z FROM events)
SELECT event_id, round(sqrt(x*x+y*y+z*z)/9.80665,6) AS magnitude_g, round(least(greatest(abs(degrees(atan2(x-1.5, sign(z)*greatest(abs(z),0.35*9.80665)))),0.0),62.0),6) AS lean_deg,
 round(coalesce(CASE WHEN sqrt(x*x+y*y+z*z) > 1e-6 THEN (x+2*y+3*z)/sqrt(x*x+y*y+z*z) END, 3.0),6) AS vertical FROM v""")
def motion_scalars(spark, sf_dir):
    e = F.col("event_id")
    v = table(spark, sf_dir, "events").select("event_id", ((e % 21 - 10) * 1.0).alias("x"), ((e % 13 - 6) * 1.0).alias("y"), ((e % 17 - 8) * 1.0).alias("z"))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    vertical = S.vertical_acceleration(F.lit(1.0), F.lit(2.0), F.lit(3.0), x, y, z)
    return v.select("event_id", r6(S.magnitude(x, y, z) / S.GRAVITY_M_S2, "magnitude_g"), r6(S.lean_deg(x, z, F.lit(1.5)), "lean_deg"), r6(vertical, "vertical"))


@query(f"""WITH {TRACK}, m AS (SELECT run_id, avg(speed_m_s) AS gx, avg(accuracy) AS gy, avg(pressure_mbar) - 860 AS gz FROM track GROUP BY run_id),
u AS (SELECT *, gx/sqrt(gx*gx+gy*gy+gz*gz) AS x, gy/sqrt(gx*gx+gy*gy+gz*gz) AS y, gz/sqrt(gx*gx+gy*gy+gz*gz) AS z FROM m), s AS (SELECT *, CASE WHEN z < 0 THEN -1.0 ELSE 1.0 END AS s FROM u)
SELECT run_id, round(0.0,6)::DOUBLE AS level_x, round(0.0,6)::DOUBLE AS level_y, round((s*sqrt(gx*gx+gy*gy+gz*gz))::DOUBLE,6) AS level_z FROM s""")
def virtual_level(spark, sf_dir):
    """The levelling rotation takes the mean vector onto the z axis, with its length."""
    m = track(spark, sf_dir).groupBy("run_id").agg(F.avg("speed_m_s").alias("gx"), F.avg("accuracy").alias("gy"), (F.avg("pressure_mbar") - 860).alias("gz"))
    x, y, z = F.col("gx"), F.col("gy"), F.col("gz")
    turned = S.rotate(x, y, z, F.col("r"))
    clean = lambda c, n: (F.round(c, 6) + 0.0).alias(n)
    return m.withColumn("r", S.levelling_matrix(x, y, z)).select("run_id", clean(turned[0], "level_x"), clean(turned[1], "level_y"), clean(turned[2], "level_z"))


@query(f"""WITH {TRACK}, n AS (SELECT *, lead(latitude) OVER {W} AS la1, lead(longitude) OVER {W} AS lo1, lag(latitude) OVER {W} AS la0, lag(longitude) OVER {W} AS lo0 FROM track),
v AS (SELECT *, radians(coalesce(lo1,longitude)-coalesce(lo0,longitude))*cos(radians(latitude))*6371000.0 AS e, radians(coalesce(la1,latitude)-coalesce(la0,latitude))*6371000.0 AS n FROM n)
SELECT event_id, round(CASE WHEN degrees(atan2(e,n)) < 0 THEN degrees(atan2(e,n))+360 ELSE degrees(atan2(e,n)) END,6) AS bearing_deg,
 round(latitude + degrees((-e/nullif(sqrt(e*e+n*n),0))*10/6371000.0),9) AS gate_lat, round(longitude + degrees((n/nullif(sqrt(e*e+n*n),0))*10/(6371000.0*cos(radians(latitude)))),9) AS gate_lon FROM v""")
def gate_bearing(spark, sf_dir):
    """Bearing of travel, and one end of a gate of 10 m to the right of it."""
    at = lambda c, n: F.coalesce(RUN.lead(c) if n > 0 else RUN.lag(c), F.col(c))
    rows = track(spark, sf_dir).withColumns({"la1": at("latitude", 1), "lo1": at("longitude", 1), "la0": at("latitude", -1), "lo0": at("longitude", -1)})
    e, n = F.radians(F.col("lo1") - F.col("lo0")) * F.cos(F.radians("latitude")) * S.EARTH_RADIUS_M, F.radians(F.col("la1") - F.col("la0")) * S.EARTH_RADIUS_M
    size = F.nullif(F.sqrt(e * e + n * n), F.lit(0.0))
    lat, lon = S.offset_position(F.col("latitude"), F.col("longitude"), n / size * 10, -e / size * 10)
    return rows.select("event_id", r6(S.heading(e, n), "bearing_deg"), F.round(lat, 9).alias("gate_lat"), F.round(lon, 9).alias("gate_lon"))


# Filters ------------------------------------------------------------------------------------------------------------


@query(f"WITH {TRACK}, n AS (SELECT *, count(*) FILTER (accuracy IS NULL OR accuracy <= 40) OVER (PARTITION BY run_id) AS good FROM track) SELECT run_id, event_id FROM n WHERE accuracy IS NULL OR accuracy <= 40 OR good < 2")
def gps_accuracy_filter(spark, sf_dir):
    return Q.drop_inaccurate(track(spark, sf_dir), "accuracy", RUN, 40.0).select("run_id", "event_id")


@query(f"""WITH {DIST}, s AS (SELECT *, CASE WHEN rn > 1 THEN step_m END AS st FROM dist), z AS (SELECT *, avg(st) OVER p AS m, stddev_pop(st) OVER p AS sd, count(*) OVER p AS n FROM s WINDOW p AS (PARTITION BY run_id))
SELECT run_id, event_id FROM z WHERE st IS NULL OR n < 3 OR sd <= 1e-6 OR abs(st-m)/sd <= 1.6""")
def gps_outliers(spark, sf_dir):
    return Q.drop_step_outliers(track(spark, sf_dir), RUN, most=1.6).select("run_id", "event_id")


@query(f"WITH {TRACK} SELECT run_id, count(*) AS n FROM track WHERE latitude BETWEEN 46.002 AND 46.006 AND longitude BETWEEN 7.001 AND 7.007 AND speed_m_s > 0.5 GROUP BY run_id")
def bbox_filter(spark, sf_dir):
    box = F.col("latitude").between(46.002, 46.006) & F.col("longitude").between(7.001, 7.007)
    return track(spark, sf_dir).where(box & (F.col("speed_m_s") > 0.5)).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DIST}, s AS (SELECT *, min(rn) FILTER (speed_m_s > 15) OVER p AS a, max(rn) FILTER (speed_m_s > 15) OVER p AS b FROM dist WINDOW p AS (PARTITION BY run_id)), t AS (SELECT * FROM s WHERE a IS NULL OR rn BETWEEN a AND b) SELECT run_id, event_id, round(distance_m - min(distance_m) OVER p,4) AS distance_m, round(time_s - min(time_s) OVER p,6) AS time_s FROM t WINDOW p AS (PARTITION BY run_id)")
def edge_trim(spark, sf_dir):
    rows = Q.edge_trim(dist(spark, sf_dir), F.col("speed_m_s") > 15, RUN)
    return rows.select("run_id", "event_id", F.round(F.col("distance_m") - F.min("distance_m").over(RUN.all), 4).alias("distance_m"), r6(F.col("time_s") - F.min("time_s").over(RUN.all), "time_s"))


_PAIR = f"{DIST}, a AS (SELECT * FROM dist WHERE run_id % 2 = 0), b AS (SELECT *, run_id - 1 AS pair FROM dist WHERE run_id % 2 = 1)"


def _pairs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Runs 2k and 2k + 1 are a pair."""
    d = dist(spark, sf_dir).withColumn("pair", F.col("run_id") - F.col("run_id") % 2)
    return d.where("run_id % 2 = 0"), d.where("run_id % 2 = 1")


@query(f"WITH {_PAIR}, m AS (SELECT x.run_id AS pair, least(x.d, y.d) AS shared FROM (SELECT run_id, max(distance_m) AS d FROM a GROUP BY run_id) x JOIN (SELECT pair, max(distance_m) AS d FROM b GROUP BY pair) y ON x.run_id = y.pair) SELECT pair, round(shared,4) AS shared_m, (SELECT count(*) FROM a WHERE a.run_id = m.pair AND a.distance_m <= shared) AS n_a, (SELECT count(*) FROM b WHERE b.pair = m.pair AND b.distance_m <= shared) AS n_b FROM m")
def overlap_trim(spark, sf_dir):
    a, b = _pairs(spark, sf_dir)
    shared = compare.overlap(a, b, ["pair"])
    n = lambda d, c: d.join(shared, "pair").where(F.col("distance_m") <= F.col("shared_m")).groupBy("pair").agg(F.count(F.lit(1)).alias(c))
    return shared.join(n(a, "n_a"), "pair").join(n(b, "n_b"), "pair").select("pair", F.round("shared_m", 4).alias("shared_m"), "n_a", "n_b")


# Joins --------------------------------------------------------------------------------------------------------------

_SIDES = f"{TRACK}, l AS (SELECT run_id, event_id, unix_ns FROM track WHERE event_type = 'view'), r AS (SELECT run_id, unix_ns, speed_m_s FROM track WHERE event_type = 'click')"
HOURS6 = 6 * 3_600_000_000_000


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = track(spark, sf_dir)
    return t.where("event_type = 'view'").select("run_id", "event_id", "unix_ns"), t.where("event_type = 'click'").select("run_id", "unix_ns", "speed_m_s")


@query(f"""WITH {_SIDES}, b AS (SELECT l.*, r.unix_ns AS bt, r.speed_m_s AS bv FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.unix_ns >= r.unix_ns), f AS (SELECT l.event_id, r.unix_ns AS ft, r.speed_m_s AS fv FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.unix_ns <= r.unix_ns)
SELECT b.event_id, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR unix_ns - bt <= ft - unix_ns) THEN CASE WHEN unix_ns - bt <= {HOURS6} THEN bv END ELSE CASE WHEN ft - unix_ns <= {HOURS6} THEN fv END END AS speed_m_s FROM b JOIN f USING (event_id)""")
def asof_nearest_tol(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return J.asof(left, right, ["run_id"], "unix_ns", ["speed_m_s"], HOURS6).select("event_id", "speed_m_s")


@query(f"WITH {_SIDES} SELECT l.event_id, r.speed_m_s FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.unix_ns >= r.unix_ns")
def asof_backward(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return J.asof(left, right, ["run_id"], "unix_ns", ["speed_m_s"], direction="backward").select("event_id", "speed_m_s")


@query(f"""WITH {_SIDES}, b AS (SELECT l.*, r.unix_ns AS bt, r.speed_m_s AS bv FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.unix_ns >= r.unix_ns), f AS (SELECT l.event_id, r.unix_ns AS ft, r.speed_m_s AS fv FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.unix_ns <= r.unix_ns)
SELECT b.event_id, round(CASE WHEN bt IS NULL THEN fv WHEN ft IS NULL OR ft = bt THEN bv ELSE bv + (fv-bv)*((unix_ns-bt)::DOUBLE/(ft-bt)::DOUBLE) END,6) AS speed_m_s FROM b JOIN f USING (event_id)""")
def interp_to_clock(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return J.interpolate(left, right, ["run_id"], "unix_ns", ["speed_m_s"]).select("event_id", r6("speed_m_s"))


@query("""WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_totalprice) AS v, min(o_totalprice) AS w FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v, a.n AS n, b.w AS w FROM a FULL OUTER JOIN b ON a.k = b.k""")
def baro_outer_coalesce(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    a = o.where("o_orderkey % 2 = 0").groupBy("k").agg(F.max("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))
    b = o.where("o_orderkey % 2 = 1").groupBy("k").agg(F.max("o_totalprice").alias("v"), F.min("o_totalprice").alias("w"))
    return J.outer_coalesce([a, b], ["k"]).select("k", "v", "n", "w")


HOUR = 3_600_000_000_000


@query(f"""WITH {TRACK}, s AS (SELECT run_id, min(unix_ns) AS a, max(unix_ns) AS b FROM track GROUP BY run_id), g AS (SELECT run_id, a + unnest(generate_series(0, ceil((b-a)/{HOUR}.0)::BIGINT))*{HOUR} AS unix_ns FROM s),
p AS (SELECT g.*, t.unix_ns AS bt, t.pressure_mbar AS bv FROM g ASOF LEFT JOIN track t ON g.run_id = t.run_id AND g.unix_ns >= t.unix_ns), f AS (SELECT g.*, t.unix_ns AS ft, t.pressure_mbar AS fv FROM g ASOF LEFT JOIN track t ON g.run_id = t.run_id AND g.unix_ns <= t.unix_ns)
SELECT run_id, count(*) AS n_ticks, count(v) AS n_matched, round(sum(v),4) AS total FROM (SELECT p.run_id, CASE WHEN ft IS NULL OR p.unix_ns - bt <= ft - p.unix_ns THEN CASE WHEN p.unix_ns - bt <= {HOUR} THEN bv END ELSE CASE WHEN ft - p.unix_ns <= {HOUR} THEN fv END END AS v FROM p JOIN f ON p.run_id = f.run_id AND p.unix_ns = f.unix_ns) GROUP BY run_id""")
def master_grid(spark, sf_dir):
    """A clock of hours over each run, with the nearest pressure within an hour."""
    t = track(spark, sf_dir).select("run_id", "unix_ns", "pressure_mbar")
    got = J.asof_clock(t, ["run_id"], "unix_ns", ["pressure_mbar"], HOUR, HOUR)
    return got.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_ticks"), F.count("pressure_mbar").alias("n_matched"), F.round(F.sum("pressure_mbar"), 4).alias("total"))


@query(f"""WITH {DIST}, a AS (SELECT run_id AS pair, event_id AS ia, radians(longitude-7.005)*cos(radians(46.005))*6371000.0 AS x, radians(latitude-46.005)*6371000.0 AS y FROM dist WHERE run_id % 2 = 0),
b AS (SELECT run_id - 1 AS pair, event_id AS ib, radians(longitude-7.005)*cos(radians(46.005))*6371000.0 AS x, radians(latitude-46.005)*6371000.0 AS y FROM dist WHERE run_id % 2 = 1),
c AS (SELECT a.pair, ia, ib, sqrt(power(a.x-b.x,2)+power(a.y-b.y,2)) AS d FROM a JOIN b ON a.pair = b.pair)
SELECT pair, ia, ib, round(d,4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY pair, ia ORDER BY d, ib) AS k FROM c WHERE d <= 60) WHERE k = 1""")
def spatial_nn(spark, sf_dir):
    def side(d: DataFrame, name: str) -> DataFrame:
        x, y = S.local_xy(F.col("latitude"), F.col("longitude"), F.lit(46.005), F.lit(7.005))
        return d.select("pair", F.col("event_id").alias(name), x.alias("x"), y.alias("y"))

    a, b = _pairs(spark, sf_dir)
    return J.nearest_in_cells(side(a, "ia"), side(b, "ib"), 60.0, ["pair"], "ia", "ib").select("pair", "ia", "ib", F.round("distance", 4).alias("distance"))


@query(f"""WITH {DIST}, a AS (SELECT run_id AS pair, event_id AS ia, longitude AS x, latitude AS y FROM dist WHERE run_id % 2 = 0), b AS (SELECT run_id - 1 AS pair, event_id AS ib, longitude AS x, latitude AS y FROM dist WHERE run_id % 2 = 1)
SELECT pair, ia, ib, round(d * 1e6, 3) AS micro_degrees FROM (SELECT a.pair, ia, ib, sqrt(power(a.x-b.x,2)+power(a.y-b.y,2)) AS d, row_number() OVER (PARTITION BY a.pair, ia ORDER BY sqrt(power(a.x-b.x,2)+power(a.y-b.y,2)), ib) AS k FROM a JOIN b ON a.pair = b.pair) WHERE k = 1""")
def nearest_trail_point(spark, sf_dir):
    """The nearest point of the other run's trail, in degrees and however far."""
    a, b = _pairs(spark, sf_dir)
    side = lambda d, name: d.select("pair", F.col("event_id").alias(name), F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    got = J.nearest_of_all(side(a, "ia"), side(b, "ib"), ["pair"], "ia", "ib", 2e-4)
    return got.select("pair", "ia", "ib", F.round(F.col("distance") * 1e6, 3).alias("micro_degrees"))


_GATE = hav("46.005", "7.005", "latitude", "longitude")


@query(f"WITH {DIST}, d AS (SELECT *, {_GATE} AS d FROM dist) SELECT run_id, coalesce(min(rn) FILTER (d <= 150), min_by(rn, d)) AS gate_row, coalesce(bool_or(d <= 150), false) AS inside FROM d GROUP BY run_id")
def gate_index(spark, sf_dir):
    rows = dist(spark, sf_dir).withColumn("rn", RUN.number())
    d = S.haversine_m(F.lit(46.005), F.lit(7.005), F.col("latitude"), F.col("longitude"))
    return J.first_or_nearest(rows, d, 150.0, ["run_id"], "rn").select("run_id", F.col("rn").cast("long").alias("gate_row"), "inside")


@query(f"WITH {DIST} SELECT run_id, rn AS sample, round(distance_m,4) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY abs(distance_m-5000.0), rn) AS k FROM dist) WHERE k = 1")
def nearest_index(spark, sf_dir):
    rows = dist(spark, sf_dir).withColumn("rn", RUN.number())
    return J.nearest_row(rows, "distance_m", F.lit(5000.0), ["run_id"], "rn").select("run_id", F.col("rn").cast("long").alias("sample"), F.round("distance_m", 4).alias("distance_m"))


@query(f"""WITH {DIST}, q AS (SELECT run_id, time_s, speed_m_s, round(distance_m,3) AS distance_m FROM dist), s AS (SELECT run_id, max(distance_m) AS span FROM q GROUP BY run_id HAVING max(distance_m) > 0), n AS (SELECT *, least(greatest(floor(span/5000.0),3),8)::BIGINT AS n FROM s),
x AS (SELECT run_id, span, n, unnest(generate_series(1,n)) AS id FROM n), e AS (SELECT run_id, id, span*(id-1)/n AS d0, span*id/n AS d1 FROM x)
SELECT e.run_id, id, round(coalesce(max_by(time_s,distance_m) FILTER (distance_m <= d1), min_by(time_s,distance_m)) - coalesce(max_by(time_s,distance_m) FILTER (distance_m <= d0), min_by(time_s,distance_m)),6) AS sector_s,
 round(avg(speed_m_s) FILTER (distance_m BETWEEN d0 AND d1),6) AS mean_speed, count(*) FILTER (distance_m BETWEEN d0 AND d1) AS n_samples FROM e JOIN q USING (run_id) GROUP BY e.run_id, id, d0, d1""")
def sector_stats(spark, sf_dir):
    d = dist(spark, sf_dir).withColumn("distance_m", F.round("distance_m", 3))
    sectors = G.sectors(d.groupBy("run_id").agg(F.max("distance_m").alias("span")), ["run_id"], "span", 8, 5000.0)
    return compare.sector_table(d, sectors, ["run_id"], speed="speed_m_s").select("run_id", "id", r6("sector_s"), r6("mean_speed"), "n_samples")


@query(f"WITH {DIST}, i AS (SELECT g AS id, g*2000.0 AS low, g*2000.0 + 1999.0 AS high FROM generate_series(0, 30) t(g)) SELECT id, count(*) AS n, round(avg(speed_m_s),6) AS mean_speed FROM dist JOIN i ON distance_m BETWEEN low - 0.5 AND high + 0.5 GROUP BY id")
def interval_join(spark, sf_dir):
    i = spark.range(31).select("id", (F.col("id") * 2000.0).alias("low"), (F.col("id") * 2000.0 + 1999.0).alias("high"))
    return J.in_intervals(dist(spark, sf_dir), i, "distance_m", "low", "high", slack=0.5).groupBy("id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("speed_m_s"), "mean_speed"))


# Sequences ----------------------------------------------------------------------------------------------------------

_GAPS = f"{TRACK}, g AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN speed_m_s END AS v, row_number() OVER {W} AS rn FROM track)"


def _gaps(spark, sf_dir):
    return track(spark, sf_dir).withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("speed_m_s")))


@query(f"WITH {_GAPS} SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY unix_ns ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY unix_ns ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM g")
def ffill_bfill(spark, sf_dir):
    return _gaps(spark, sf_dir).select("event_id", Q.fill_both("v", RUN).alias("v"))


@query(f"""WITH {_GAPS}, k AS (SELECT *, CASE WHEN v IS NOT NULL THEN rn END AS kr FROM g), p AS (SELECT *, last_value(kr IGNORE NULLS) OVER b AS ra, last_value(v IGNORE NULLS) OVER b AS va, first_value(kr IGNORE NULLS) OVER f AS rb, first_value(v IGNORE NULLS) OVER f AS vb FROM k
 WINDOW b AS (PARTITION BY run_id ORDER BY unix_ns ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY run_id ORDER BY unix_ns ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(v, va + (vb-va)*(rn-ra)/nullif(rb-ra,0), va, vb, 0.0),9) AS v FROM p""")
def gap_fill_linear(spark, sf_dir):
    return Q.fill_linear(_gaps(spark, sf_dir), "v", RUN, "filled").select("event_id", F.round("filled", 9).alias("v"))


@query(f"WITH {TRACK} SELECT event_id, round(avg(speed_m_s) OVER (PARTITION BY run_id ORDER BY unix_ns ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING),6) AS mean4, round(avg(speed_m_s) OVER (PARTITION BY run_id ORDER BY unix_ns ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),6) AS mean5, round(sum(speed_m_s) OVER (PARTITION BY run_id ORDER BY unix_ns ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)/21,6) AS box21 FROM track")
def rolling_mean_centered(spark, sf_dir):
    return track(spark, sf_dir).select("event_id", r6(Q.rolling_mean("speed_m_s", RUN, 4), "mean4"), r6(Q.rolling_mean("speed_m_s", RUN, 5), "mean5"), r6(Q.box("speed_m_s", RUN, 21), "box21"))


@query(f"WITH {TRACK} SELECT event_id, round(median(speed_m_s) OVER (PARTITION BY run_id ORDER BY unix_ns ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING),6) AS median25 FROM track")
def rolling_median(spark, sf_dir):
    return Q.with_rolling_median(track(spark, sf_dir), "speed_m_s", RUN, 25, "median").select("event_id", r6("median", "median25"))


@query(f"""WITH {DIST}, n AS (SELECT event_id, pressure_mbar y, lag(pressure_mbar) OVER w y0, lead(pressure_mbar) OVER w y1, time_s t, lag(time_s) OVER w t0, lead(time_s) OVER w t1 FROM dist WINDOW w AS {W})
SELECT event_id, round(coalesce(((t-t0)/(t1-t)*(y1-y) + (t1-t)/(t-t0)*(y-y0))/((t-t0)+(t1-t)), (y1-y)/(t1-t), (y-y0)/(t-t0)),9) AS slope FROM n""")
def gradient_irregular(spark, sf_dir):
    return dist(spark, sf_dir).select("event_id", F.round(Q.gradient("pressure_mbar", "time_s", RUN), 9).alias("slope"))


_ISLANDS = f"{DIST}, f AS (SELECT *, speed_m_s > 8 AS on_ FROM dist), s AS (SELECT *, (on_ AND NOT coalesce(lag(on_) OVER {W}, false))::INT AS new_ FROM f), i AS (SELECT *, sum(new_) OVER (PARTITION BY run_id ORDER BY unix_ns ROWS UNBOUNDED PRECEDING) AS island FROM s), isl AS (SELECT run_id, island::BIGINT AS island, count(*) AS n_rows, min(distance_m) AS a, max(distance_m) AS b FROM i WHERE on_ GROUP BY run_id, island)"


@query(f"WITH {_ISLANDS} SELECT run_id, island, n_rows, round(a,4) AS start_m, round(b,4) AS end_m FROM isl")
def islands(spark, sf_dir):
    return Q.islands(dist(spark, sf_dir), F.col("speed_m_s") > 8, RUN, "distance_m").select("run_id", "island", "n_rows", F.round("distance_m_start", 4).alias("start_m"), F.round("distance_m_end", 4).alias("end_m"))


@query(f"WITH {_ISLANDS.replace('> 8', '> 2')} SELECT run_id, island, n_rows, round(a,4) AS start_m FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n_rows DESC, island) AS k FROM isl WHERE n_rows >= 3) WHERE k = 1")
def longest_subrun(spark, sf_dir):
    return Q.longest_island(dist(spark, sf_dir), F.col("speed_m_s") > 2, RUN, "distance_m", 3).select("run_id", "island", "n_rows", F.round("distance_m_start", 4).alias("start_m"))


@query(f"""WITH {DIST}, c AS (SELECT *, (unix_ns - lag(unix_ns) OVER {W} > {12 * HOUR}) AS cut FROM dist), s AS (SELECT *, sum(coalesce(cut,false)::INT) OVER (PARTITION BY run_id ORDER BY unix_ns ROWS UNBOUNDED PRECEDING) AS session FROM c),
g AS (SELECT run_id, session::BIGINT AS session, count(*) AS n_rows, max(distance_m)-min(distance_m) AS span FROM s GROUP BY 1,2 HAVING count(*) >= 2 AND max(distance_m)-min(distance_m) >= 50)
SELECT run_id, session, n_rows, round(span,4) AS span_m FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(span,6) DESC, session) AS k FROM g) WHERE k = 1""")
def session_groups(spark, sf_dir):
    """The longest stretch without a gap of over 12 hours, of at least two rows and 50 m."""
    rows = Q.sessions(dist(spark, sf_dir), F.col("unix_ns") - RUN.lag("unix_ns") > 12 * HOUR, RUN)
    groups = rows.groupBy("run_id", "session").agg(F.count(F.lit(1)).alias("n_rows"), (F.max("distance_m") - F.min("distance_m")).alias("span")).where("n_rows >= 2 and span >= 50")
    w = Window.partitionBy("run_id").orderBy(F.round("span", 6).desc(), "session")
    return groups.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("run_id", "session", "n_rows", F.round("span", 4).alias("span_m"))


@query(f"WITH {DIST}, o AS (SELECT *, min((speed_m_s < 18)::INT) OVER n AS a, count(*) OVER n AS c FROM dist WINDOW n AS (PARTITION BY run_id ORDER BY unix_ns ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT run_id, round(min(distance_m) FILTER (a = 1 AND c = 5),4) AS first_m FROM o GROUP BY run_id")
def first_sustained(spark, sf_dir):
    return Q.first_sustained(dist(spark, sf_dir), F.col("speed_m_s") < 18, RUN, 5, "distance_m").select("run_id", F.round("first_distance_m", 4).alias("first_m"))


@query(f"WITH {TRACK} SELECT event_id, max(speed_m_s) OVER (PARTITION BY run_id ORDER BY unix_ns ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before, max(speed_m_s) OVER (PARTITION BY run_id ORDER BY unix_ns ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS after FROM track")
def lookaround_max(spark, sf_dir):
    return track(spark, sf_dir).select("event_id", F.max("speed_m_s").over(RUN.rows(-3, -1)).alias("before"), F.max("speed_m_s").over(RUN.rows(1, 3)).alias("after"))


@query(f"WITH {DIST}, q AS (SELECT *, round(distance_m,3) AS d FROM dist) SELECT event_id, round(avg(speed_m_s) OVER r,9) AS smooth, round(speed_m_s - avg(speed_m_s) OVER r,9) AS detail FROM q WINDOW r AS (PARTITION BY run_id ORDER BY d RANGE BETWEEN 1000.0005 PRECEDING AND 1000.0005 FOLLOWING)")
def range_smooth(spark, sf_dir):
    rows = Q.with_distance(Q.dealt(track(spark, sf_dir), ["run_id"]), RUN)
    d = rows.select("event_id", "run_id", "speed_m_s", F.round("distance_m", 3).alias("d"))
    rows = Q.with_range_mean(d, "speed_m_s", "d", "run_id", 1000.0005, "mean")
    return rows.select("event_id", F.round("mean", 9).alias("smooth"), F.round(F.col("speed_m_s") - F.col("mean"), 9).alias("detail"))


_BANDS = f"{DIST}, l AS (SELECT *, CASE WHEN speed_m_s > 18 THEN 2 WHEN speed_m_s > 8 THEN 1 ELSE 0 END AS level, lag(CASE WHEN speed_m_s > 18 THEN 2 WHEN speed_m_s > 8 THEN 1 ELSE 0 END) OVER {W} AS prev FROM dist), b AS (SELECT *, sum((prev IS NULL OR prev <> level)::INT) OVER (PARTITION BY run_id ORDER BY unix_ns ROWS UNBOUNDED PRECEDING) AS band FROM l)"


@query(f"WITH {_BANDS} SELECT run_id, band::BIGINT AS band, level, round(min(distance_m),4) AS start_m, round(max(distance_m),4) AS end_m FROM b GROUP BY run_id, band, level HAVING max(distance_m)-min(distance_m) >= 6")
def severity_bands(spark, sf_dir):
    v = F.col("speed_m_s")
    found = Q.bands(dist(spark, sf_dir), F.when(v > 18, 2).when(v > 8, 1).otherwise(0), RUN, "distance_m")
    return found.where("distance_m_end - distance_m_start >= 6").select("run_id", "band", "level", F.round("distance_m_start", 4).alias("start_m"), F.round("distance_m_end", 4).alias("end_m"))


@query(f"WITH {DIST}, s AS (SELECT *, (speed_m_s - lag(speed_m_s) OVER {W})/nullif(step_m,0) AS slope FROM dist) SELECT event_id, (coalesce(slope,0) >= -1e-2)::INT + (coalesce(slope,0) >= -1e-3)::INT + (coalesce(slope,0) >= 0)::INT + (coalesce(slope,0) >= 1e-3)::INT + (coalesce(slope,0) >= 1e-2)::INT AS bin FROM s")
def slope_bins(spark, sf_dir):
    slope = F.coalesce((F.col("speed_m_s") - RUN.lag("speed_m_s")) / F.nullif(F.col("step_m"), F.lit(0.0)), F.lit(0.0))
    return dist(spark, sf_dir).select("event_id", Q.slope_bin(slope, [-1e-2, -1e-3, 0.0, 1e-3, 1e-2]).alias("bin"))


@query(f"WITH {TRACK}, m AS (SELECT *, speed_m_s - avg(speed_m_s) OVER (PARTITION BY run_id) AS r FROM track), n AS (SELECT run_id, r, lead(r) OVER {W} AS r1 FROM m) SELECT run_id, round(greatest(least(sum(r*r1)/(sum(r*r)+1e-12),0.98),-0.98),6) AS phi FROM n WHERE r1 IS NOT NULL GROUP BY run_id")
def ar1_phi(spark, sf_dir):
    rows = track(spark, sf_dir).withColumn("r", F.col("speed_m_s") - F.avg("speed_m_s").over(RUN.all))
    return Q.ar1(rows, "r", RUN).select("run_id", r6("phi"))


@query(f"WITH {TRACK} SELECT event_id, round(speed_m_s - first_value(speed_m_s) OVER {W},6) AS from_first, round(CASE WHEN stddev_pop(speed_m_s) OVER p < 1e-9 THEN 0.0 ELSE (speed_m_s - avg(speed_m_s) OVER p)/stddev_pop(speed_m_s) OVER p END,6) AS z FROM track WINDOW p AS (PARTITION BY run_id)")
def normalize_first(spark, sf_dir):
    return track(spark, sf_dir).select("event_id", r6(Q.from_first("speed_m_s", RUN), "from_first"), r6(Q.z_score("speed_m_s", RUN), "z"))


@query(f"WITH {TRACK}, q AS (SELECT *, coalesce((lead(pressure_mbar) OVER w - lag(pressure_mbar) OVER w)/2, lead(pressure_mbar) OVER w - pressure_mbar, pressure_mbar - lag(pressure_mbar) OVER w, 0.0) AS s FROM track WINDOW w AS {W}), v AS (SELECT *, sign(s)*sqrt(abs(s)+1e-12) AS q FROM q) SELECT event_id, round(q,6) AS q, round(first_value(pressure_mbar) OVER {W} + sum(q*abs(q)) OVER (PARTITION BY run_id ORDER BY unix_ns ROWS UNBOUNDED PRECEDING),5) AS back FROM v")
def srvf(spark, sf_dir):
    p = "pressure_mbar"
    slope = F.coalesce((RUN.lead(p) - RUN.lag(p)) / 2, RUN.lead(p) - F.col(p), F.col(p) - RUN.lag(p), F.lit(0.0))
    rows = track(spark, sf_dir).withColumn("q", Q.srvf(slope)).withColumn("h0", F.first(p).over(RUN.past))
    return rows.select("event_id", r6("q"), F.round(Q.from_srvf("q", F.col("h0"), F.lit(1.0), RUN), 5).alias("back"))


_SG5 = [-3 / 35, 12 / 35, 17 / 35, 12 / 35, -3 / 35]


@query(f"WITH {TRACK} SELECT event_id, round((-3*lag(speed_m_s,2) OVER w + 12*lag(speed_m_s,1) OVER w + 17*speed_m_s + 12*lead(speed_m_s,1) OVER w - 3*lead(speed_m_s,2) OVER w)/35,6) AS smooth FROM track WINDOW w AS {W}")
def savgol_interior(spark, sf_dir):
    from ridgeline.functions.dsp import polynomial_weights

    return track(spark, sf_dir).select("event_id", r6(Q.fir("speed_m_s", RUN, polynomial_weights(5, 2).tolist()), "smooth"))


# Choice of rows -----------------------------------------------------------------------------------------------------


@query(f"WITH {DIST} SELECT run_id, bin, event_id FROM (SELECT *, floor(distance_m/500)::BIGINT AS bin, row_number() OVER (PARTITION BY run_id, floor(distance_m/500) ORDER BY unix_ns) AS k FROM dist WHERE distance_m >= 0) WHERE k = 1")
def bin_first(spark, sf_dir):
    return Q.first_of_bin(dist(spark, sf_dir), "distance_m", 500.0, RUN).select("run_id", "bin", "event_id")


@query(f"WITH {DIST} SELECT event_id FROM dist WHERE (rn-1) % 3 = 0")
def decimate(spark, sf_dir):
    return Q.decimate(track(spark, sf_dir).withColumn("rate", F.lit(25.0)), RUN, "rate").select("event_id")


@query(f"WITH {DIST}, n AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM dist) SELECT run_id, event_id FROM n WHERE (rn-1) % greatest(ceil(n/10.0),1)::BIGINT = 0 OR rn = n")
def stride_keep_last(spark, sf_dir):
    return Q.stride(track(spark, sf_dir), RUN, 10).select("run_id", "event_id")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1")
def dedup_keep_first(spark, sf_dir):
    return Q.first_of_key(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_linenumber")


# Comparison ---------------------------------------------------------------------------------------------------------

_GRID = f"""{DIST}, u AS (SELECT run_id - run_id % 2 AS pair, run_id % 2 AS side, distance_m AS x, max(time_s) AS t FROM dist GROUP BY 1,2,3),
m AS (SELECT pair, least(max(x) FILTER (side = 0), max(x) FILTER (side = 1)) AS shared FROM u GROUP BY pair HAVING count(DISTINCT side) = 2),
g AS (SELECT pair, unnest(generate_series(0, ceil(shared/500.0)::BIGINT - 1)) AS grid_index FROM m WHERE shared > 0), gd AS (SELECT *, grid_index*500.0::DOUBLE AS d FROM g),
s AS (SELECT gd.*, side FROM gd, (SELECT unnest([0,1]) AS side)),
lo AS (SELECT s.*, u.x AS x0, u.t AS t0 FROM s ASOF LEFT JOIN u ON s.pair = u.pair AND s.side = u.side AND s.d >= u.x),
hi AS (SELECT s.*, u.x AS x1, u.t AS t1 FROM s ASOF LEFT JOIN u ON s.pair = u.pair AND s.side = u.side AND s.d <= u.x),
tt AS (SELECT lo.pair, lo.grid_index, lo.d, lo.side, CASE WHEN x0 IS NULL THEN t1 WHEN x1 IS NULL OR x1 = x0 THEN t0 ELSE t0 + (t1-t0)*((lo.d-x0)/(x1-x0)) END AS t FROM lo JOIN hi ON lo.pair = hi.pair AND lo.grid_index = hi.grid_index AND lo.side = hi.side),
dt AS (SELECT pair, grid_index, d AS distance_m, max(t) FILTER (side = 0) AS t_a_s, max(t) FILTER (side = 1) AS t_b_s, max(t) FILTER (side = 1) - max(t) FILTER (side = 0) AS delta_t_s FROM tt GROUP BY 1,2,3)"""


@query(f"WITH {_GRID} SELECT pair, grid_index, distance_m, round(t_a_s,4) AS t_a_s, round(t_b_s,4) AS t_b_s, round(delta_t_s,4) AS delta_t_s FROM dt")
def delta_t_grid(spark, sf_dir):
    d = compare.delta_t(*_pairs(spark, sf_dir), ["pair"], 500.0)
    return d.select("pair", "grid_index", "distance_m", *[F.round(c, 4).alias(c) for c in ("t_a_s", "t_b_s", "delta_t_s")])


@query(f"WITH {_GRID} SELECT pair, rank, distance_m, round(delta_t_s,4) AS delta_t_s FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY delta_t_s DESC, distance_m) AS rank FROM dt WHERE delta_t_s > 0.02) WHERE rank <= 8")
def topk_pins(spark, sf_dir):
    d = compare.pins(compare.delta_t(*_pairs(spark, sf_dir), ["pair"], 500.0), ["pair"])
    return d.select("pair", F.col("rank").cast("long").alias("rank"), "distance_m", F.round("delta_t_s", 4).alias("delta_t_s"))


@query(f"""WITH {_GRID}, sl AS (SELECT *, abs(coalesce((lead(delta_t_s) OVER w - lag(delta_t_s) OVER w)/2, lead(delta_t_s) OVER w - delta_t_s, delta_t_s - lag(delta_t_s) OVER w, 0.0)) AS s, count(*) OVER (PARTITION BY pair) AS n FROM dt WINDOW w AS (PARTITION BY pair ORDER BY grid_index)),
bx AS (SELECT *, sum(s) OVER (PARTITION BY pair ORDER BY grid_index ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)/21 AS b FROM sl), md AS (SELECT pair, median(b) AS m FROM bx GROUP BY pair), ma AS (SELECT pair, m, median(abs(b-m)) AS mad FROM bx JOIN md USING (pair) GROUP BY pair, m)
SELECT pair, grid_index, n >= 21 AND b > m + 2*(mad+1e-9) AS high FROM bx JOIN ma USING (pair)""")
def high_delta_mask(spark, sf_dir):
    return compare.high_delta(compare.delta_t(*_pairs(spark, sf_dir), ["pair"], 500.0), ["pair"]).select("pair", "grid_index", "high")


@query(f"""WITH {DIST}, u AS (SELECT run_id, distance_m AS x, max(time_s) AS t FROM dist GROUP BY 1,2), m AS (SELECT run_id, max(x) AS most FROM u GROUP BY 1), r AS (SELECT g*700.0::DOUBLE AS d, g*9000.0::DOUBLE AS t_ref FROM generate_series(0,40) t(g)),
h AS (SELECT run_id, d, t_ref FROM m JOIN r ON d <= most), n AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS c FROM h), k AS (SELECT * FROM n WHERE c >= 2),
lo AS (SELECT k.*, u.x AS x0, u.t AS t0 FROM k ASOF LEFT JOIN u ON k.run_id = u.run_id AND k.d >= u.x), hi AS (SELECT k.run_id, k.d, u.x AS x1, u.t AS t1 FROM k ASOF LEFT JOIN u ON k.run_id = u.run_id AND k.d <= u.x)
SELECT lo.run_id, lo.d AS distance_m, round(CASE WHEN x0 IS NULL THEN t1 WHEN x1 IS NULL OR x1 = x0 THEN t0 ELSE t0 + (t1-t0)*((lo.d-x0)/(x1-x0)) END - t_ref,4) AS delta_t_s FROM lo JOIN hi ON lo.run_id = hi.run_id AND lo.d = hi.d""")
def pace_vs_ref(spark, sf_dir):
    reference = spark.range(41).select((F.col("id") * 700.0).alias("distance_m"), (F.col("id") * 9000.0).alias("time_s"))
    return compare.pace(dist(spark, sf_dir), reference, ["run_id"]).select("run_id", "distance_m", F.round("delta_t_s", 4).alias("delta_t_s"))


@query(f"""WITH {TRACK}, b AS (SELECT event_id % 50 AS place, run_id, avg(speed_m_s) AS v FROM track GROUP BY 1,2), m AS (SELECT place, median(v) AS med, stddev_pop(v) AS sigma, count(*) AS n FROM b GROUP BY 1),
s AS (SELECT place, med, sigma, n, sqrt(avg(power(v-med,2))) AS disp FROM b JOIN m USING (place) GROUP BY 1,2,3,4) SELECT place, n, round(med,6) AS median, round(sigma,6) AS sigma, round(sqrt(sigma*sigma+disp*disp),6) AS confidence, round(1/(1+sqrt(sigma*sigma+disp*disp)),6) AS reliability FROM s""")
def dispersion_band(spark, sf_dir):
    b = track(spark, sf_dir).groupBy((F.col("event_id") % 50).alias("place"), "run_id").agg(F.avg("speed_m_s").alias("v"))
    return A.dispersion(b, ["place"], "v").select("place", "n", r6("median"), r6("sigma"), r6("confidence"), r6("reliability"))


@query(f"WITH {TRACK}, m AS (SELECT run_id, median(speed_m_s) AS median FROM track GROUP BY 1) SELECT run_id, round(median,6) AS median, round(median(abs(speed_m_s-median)),6) AS mad FROM track JOIN m USING (run_id) GROUP BY run_id, median")
def mad_scale(spark, sf_dir):
    return A.median_and_mad(track(spark, sf_dir), ["run_id"], "speed_m_s").select("run_id", r6("median"), r6("mad"))


@query(f"""WITH {TRACK}, q AS (SELECT run_id, count(*) AS n, quantile_disc(speed_m_s,0.02) AS a, quantile_disc(speed_m_s,0.98) AS b, min(speed_m_s) AS lo, max(speed_m_s) AS hi FROM track GROUP BY 1 HAVING count(*) >= 4),
e AS (SELECT *, CASE WHEN b-a < greatest(1e-6,1e-4*abs((a+b)/2)) THEN greatest(1e-6,1e-4*abs((a+b)/2)) ELSE 0.0 END AS e FROM q), w AS (SELECT *, (b+e-(a-e))*0.08 AS w FROM e),
c AS (SELECT run_id, greatest(a-e-w, lo-w) AS x, least(b+e+w, hi+w) AS y FROM w) SELECT run_id, round(x - greatest(30.0-(y-x),0.0)/2,6) AS low, round(y + greatest(30.0-(y-x),0.0)/2,6) AS high FROM c""")
def robust_band(spark, sf_dir):
    return A.robust_range(track(spark, sf_dir), ["run_id"], "speed_m_s", least_span=30.0).select("run_id", r6("low"), r6("high"))


@query(f"WITH {TRACK}, l AS (SELECT run_id, list_sort(list(speed_m_s)) AS v FROM track GROUP BY 1) SELECT run_id, v[least(floor(0.98*len(v))::INT+1, len(v))] AS at98 FROM l")
def floor_percentile(spark, sf_dir):
    return A.floor_percentiles(track(spark, sf_dir), ["run_id"], "speed_m_s", {"at98": 0.98})


@query(f"WITH {TRACK}, b AS (SELECT run_id, min(latitude) a, max(latitude) b, min(longitude) c, max(longitude) d FROM track GROUP BY 1) SELECT run_id, round(a-(b-a)*5e-2,9) AS min_latitude, round(b+(b-a)*5e-2,9) AS max_latitude, round(c-(d-c)*5e-2,9) AS min_longitude, round(d+(d-c)*5e-2,9) AS max_longitude FROM b")
def geo_bounds(spark, sf_dir):
    names = ["min_latitude", "max_latitude", "min_longitude", "max_longitude"]
    return A.bounds(track(spark, sf_dir), ["run_id"], "latitude", "longitude").select("run_id", *[F.round(c, 9).alias(c) for c in names])


@query(f"WITH {DIST}, m AS (SELECT *, avg(speed_m_s - 12) OVER (PARTITION BY run_id ORDER BY unix_ns ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS ma FROM dist), f AS (SELECT *, ma < -3 AS on_ FROM m), s AS (SELECT *, (on_ AND NOT coalesce(lag(on_) OVER {W}, false))::INT AS n FROM f), i AS (SELECT *, sum(n) OVER (PARTITION BY run_id ORDER BY unix_ns ROWS UNBOUNDED PRECEDING) AS island FROM s) SELECT run_id, island::BIGINT AS island, round(min(distance_m),4) AS start_m, round(max(distance_m),4) AS end_m, round(max(abs(least(ma,0.0))),6) AS intensity FROM i WHERE on_ GROUP BY 1,2")
def braking_intervals(spark, sf_dir):
    from ridgeline.plans.features import braking

    rows = dist(spark, sf_dir).withColumn("a", F.col("speed_m_s") - 12)
    return braking(rows, "a", RUN, 5).select("run_id", "island", F.round("start_m", 4).alias("start_m"), F.round("end_m", 4).alias("end_m"), r6("intensity"))


@query(f"""WITH {DIST}, z AS (SELECT run_id - run_id % 2 AS pair, run_id % 2 AS side, rn, unix_ns, speed_m_s, (unix_ns - lag(unix_ns) OVER {W})*1e-9 AS gap FROM dist),
n AS (SELECT pair, least(count(*) FILTER (side=0), count(*) FILTER (side=1)) AS n, coalesce(median(gap) FILTER (side = 1 AND gap > 0), 0.04) AS dt FROM z GROUP BY pair HAVING count(DISTINCT side) = 2),
d AS (SELECT z.pair, side, rn, n, dt, speed_m_s - avg(speed_m_s) OVER p AS v, stddev_pop(speed_m_s) OVER p AS sd FROM z JOIN n ON z.pair = n.pair WHERE rn <= n WINDOW p AS (PARTITION BY z.pair, side)),
c AS (SELECT a.pair, a.rn - b.rn AS lag, sum(a.v*b.v) AS c, any_value(a.n) AS n, any_value(a.dt) AS dt, any_value(a.sd*b.sd) AS s FROM d a JOIN d b ON a.pair = b.pair AND a.side = 0 AND b.side = 1 GROUP BY 1,2)
SELECT pair, CASE WHEN n < 8 THEN 0 ELSE lag END AS lag, round(CASE WHEN n < 8 THEN 0.0 ELSE c/(n*(s+1e-12)) END,6) AS peak, n AS n_samples, round(dt,3) AS median_dt_s FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(c,6) DESC, lag) AS k FROM c) WHERE k = 1""")
def lag_xcorr(spark, sf_dir):
    """The lag of the greatest cross-correlation of the pairs' speeds, over whole runs cut to the shorter one's length."""
    from ridgeline.plans.align import climb_lag

    a, b = (d.select("pair", "unix_ns", "distance_m", "speed_m_s") for d in _pairs(spark, sf_dir))
    return climb_lag(a, b, "pair", "speed_m_s", most_m=None).select("pair", F.col("lag_samples").alias("lag"), r6("peak"), "n_samples", F.round("median_dt_s", 3).alias("median_dt_s"))


# Catalog ------------------------------------------------------------------------------------------------------------


@query("""SELECT o.o_orderkey, o.o_custkey, coalesce(n,0)::BIGINT AS file_count, coalesce(b,0)::BIGINT AS total_bytes FROM orders o LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n, sum(p_size)::BIGINT AS b FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1) s ON o.o_orderkey = s.k ORDER BY o_orderdate DESC, o_orderkey LIMIT 200""")
def cat_sessions(spark, sf_dir):
    o, files, blobs = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "part"))
    got = catalog.list_sessions(o, files.withColumnRenamed("l_orderkey", "o_orderkey").withColumnRenamed("l_partkey", "p_partkey"), blobs.withColumn("p_size", F.col("p_size").cast("long")), "o_orderkey", "p_partkey", "p_size", [F.desc("o_orderdate"), F.asc("o_orderkey")], 500)
    return got.select("o_orderkey", "o_custkey", "file_count", "total_bytes")


@query("SELECT o_orderkey, l_linenumber, p_name, o_orderstatus FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey")
def cat_files(spark, sf_dir):
    o, files, blobs = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "part"))
    files = files.withColumnRenamed("l_orderkey", "o_orderkey").withColumnRenamed("l_partkey", "p_partkey")
    return catalog.list_files(files, blobs, o, "o_orderkey", "p_partkey").select("o_orderkey", "l_linenumber", "p_name", "o_orderstatus")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus || l_returnflag) = 2 AND count(DISTINCT l_linestatus || l_returnflag) FILTER (l_linestatus || l_returnflag IN ('OA','FN')) = 2")
def cat_set_equality(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").withColumn("value", F.concat("l_linestatus", "l_returnflag"))
    return J.same_sets(members, "l_orderkey", "value", ["OA", "FN", "OA"])


@query("SELECT p_partkey AS k, 'old' AS origin FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT DISTINCT l_partkey, 'new' FROM lineitem WHERE l_partkey % 3 <> 0 OR l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)")
def insert_or_ignore(spark, sf_dir):
    old = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("k"), F.lit("old").alias("origin"))
    return J.insert_or_ignore(old, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.lit("new").alias("origin")), ["k"])


@query("SELECT sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size_bytes, min(source) AS first_original_filename FROM documents GROUP BY 1, 2")
def sha256_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("content"), F.col("source").alias("path"))
    return catalog.blob_rows(docs).select("sha256", "size_bytes", "first_original_filename")


@query(f"WITH {DIST} SELECT run_id, to_json(list(event_id ORDER BY unix_ns))::VARCHAR AS event_ids, count(*) AS n FROM dist WHERE (rn-1) % 3 = 0 GROUP BY run_id")
def columnar_payload(spark, sf_dir):
    from ridgeline.plans.payload import columns_of

    rows = Q.decimate(track(spark, sf_dir).withColumn("rate", F.lit(25.0)), RUN, "rate")
    got = columns_of(rows, ["run_id"], "unix_ns", ["event_id"])
    return got.select("run_id", F.to_json("event_id").alias("event_ids"), F.size("event_id").cast("long").alias("n"))


@query("SELECT conv_id, role AS name, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text))::VARCHAR || ' of ' || (count(*) OVER (PARTITION BY conv_id))::VARCHAR AS label FROM conversations")
def source_of_n(spark, sf_dir):
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda s: s["role"]).alias("names"))
    return G.of_n(lists, "names", "conv_id")


# Views of runs ------------------------------------------------------------------------------------------------------


@query(f"""WITH {DIST}, n AS (SELECT *, rn-1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM dist), s AS (SELECT *, greatest(2, floor(n/12.0)::INT) AS step FROM n),
c AS (SELECT *, (i // step) AS chunk FROM s UNION ALL SELECT *, (i // step) - 1 FROM s WHERE i % step = 0 AND i > 0)
SELECT run_id, chunk, count(*) AS n_rows, round(avg(speed_m_s),6) AS mean_speed FROM c WHERE chunk <= (n-2) // step OR n < 2 GROUP BY run_id, chunk""")
def overview_segments(spark, sf_dir):
    return Q.chunks(dist(spark, sf_dir), RUN, 12).groupBy("run_id", "chunk").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.avg("speed_m_s"), "mean_speed"))


@query(f"""WITH {TRACK}, n AS (SELECT *, latitude BETWEEN 46.002 AND 46.008 AND longitude BETWEEN 7.002 AND 7.008 AS ok, count(*) FILTER (latitude BETWEEN 46.002 AND 46.008 AND longitude BETWEEN 7.002 AND 7.008) OVER (PARTITION BY run_id) AS k FROM track),
v AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY run_id) AS c FROM n WHERE ok OR k < 2 WINDOW w AS {W}) SELECT run_id, event_id FROM v WHERE i % greatest(ceil(c/6.0),1)::BIGINT = 0 OR i = c-1""")
def viewport_pick(spark, sf_dir):
    return Q.viewport(track(spark, sf_dir), RUN, (46.002, 46.008), (7.002, 7.008), 6).select("run_id", "event_id")


@query(f"WITH {DIST} SELECT run_id, round(avg(speed_m_s),6) AS mean, min(speed_m_s) AS low, max(speed_m_s) AS high, round(avg(speed_m_s) - 12.5,6) AS against_baseline FROM dist WHERE distance_m BETWEEN 2000.5 AND 9000.5 GROUP BY run_id")
def section_stats(spark, sf_dir):
    own = dist(spark, sf_dir).where(F.col("distance_m").between(2000.5, 9000.5))
    return own.groupBy("run_id").agg(r6(F.avg("speed_m_s"), "mean"), F.min("speed_m_s").alias("low"), F.max("speed_m_s").alias("high"), r6(F.avg("speed_m_s") - 12.5, "against_baseline"))


@query(f"""WITH {DIST}, a AS (SELECT run_id AS pair, rn AS ia, radians(longitude-7.005)*cos(radians(46.005))*6371000.0 AS x, radians(latitude-46.005)*6371000.0 AS y FROM dist WHERE run_id % 2 = 0),
b AS (SELECT run_id - 1 AS pair, rn AS ib, radians(longitude-7.005)*cos(radians(46.005))*6371000.0 AS x, radians(latitude-46.005)*6371000.0 AS y FROM dist WHERE run_id % 2 = 1),
c AS (SELECT a.pair, ia, ib, sqrt(power(a.x-b.x,2)+power(a.y-b.y,2)) AS d FROM a JOIN b ON a.pair = b.pair)
SELECT pair, ia, ib, round(d,4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ia, d, ib) AS k FROM c WHERE d <= 60) WHERE k = 1""")
def first_near(spark, sf_dir):
    def side(d: DataFrame, name: str) -> DataFrame:
        x, y = S.local_xy(F.col("latitude"), F.col("longitude"), F.lit(46.005), F.lit(7.005))
        return d.select("pair", RUN.number().cast("long").alias(name), x.alias("x"), y.alias("y"))

    a, b = _pairs(spark, sf_dir)
    return J.first_near(side(a, "ia"), side(b, "ib"), 60.0, ["pair"], "ia", "ib").select("pair", "ia", "ib", F.round("distance", 4).alias("distance"))


@query(f"WITH {DIST}, i AS (SELECT g AS id, g*1000.0 AS low, g*1000.0 + 1000.0 AS high FROM generate_series(0, 200) t(g)) SELECT event_id, min(id) AS sector FROM dist JOIN i ON distance_m BETWEEN low - 0.5 AND high + 0.5 GROUP BY event_id")
def active_sector(spark, sf_dir):
    i = spark.range(201).select("id", (F.col("id") * 1000.0).alias("low"), (F.col("id") * 1000.0 + 1000.0).alias("high"))
    return J.active_interval(dist(spark, sf_dir), i, "distance_m", "low", "high", "event_id", "id").select("event_id", F.col("id").alias("sector"))


@query("SELECT event_id, ts FROM events WHERE value IS NOT NULL AND isfinite(value) AND TRY_CAST(json_extract_string(props,'$.k') AS DOUBLE) IS NOT NULL AND value > 250")
def null_aligned(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("double"))
    return Q.aligned(e, ["value", "k"]).where("value > 250").select("event_id", "ts")


@query("SELECT event_id, 'rgb(' || round(0 + 213*((tanh((value-245)/100)+1)/2))::INT || ',' || round(114 + (94-114)*((tanh((value-245)/100)+1)/2))::INT || ',' || round(178 + (0-178)*((tanh((value-245)/100)+1)/2))::INT || ')' AS colour, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events")
def colour_and_stamp(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", S.rgb_mix(F.col("value") - 245, F.lit(100.0)).alias("colour"), F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'").alias("stamp"))


@query("SELECT c_custkey, c_name FROM customer WHERE lower(trim(c_name)) IN (SELECT lower(trim(c_name)) FROM customer WHERE c_custkey <= 5)")
def find_by_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    wanted = c.where("c_custkey <= 5").select(F.lower(F.trim("c_name")).alias("_key")).distinct()
    return c.join(wanted, F.lower(F.trim("c_name")) == F.col("_key"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS session_count, coalesce((SELECT round(sum(o_totalprice),2) FROM orders WHERE o_custkey = c_custkey),0.0) AS total FROM customer")
def trail_counters(spark, sf_dir):
    trails = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trail_id"), F.col("o_totalprice").alias("distance_m"))
    return catalog.with_counters(trails, o, o).select(F.col("id").alias("c_custkey"), "session_count", F.round("total_distance_m", 2).alias("total"))


# Against a baseline: the even run of each pair -----------------------------------------------------------------------

_LINE = f"""{_PAIR}, u AS (SELECT run_id AS pair, distance_m AS x, max(speed_m_s) AS v, max(pressure_mbar) AS p FROM a GROUP BY 1,2), s AS (SELECT b.*, rn - 1 AS i FROM b),
lo AS (SELECT s.*, u.x AS x0, u.v AS v0, u.p AS p0 FROM s ASOF LEFT JOIN u ON s.pair = u.pair AND s.distance_m >= u.x), hi AS (SELECT s.event_id, u.x AS x1, u.v AS v1, u.p AS p1 FROM s ASOF LEFT JOIN u ON s.pair = u.pair AND s.distance_m <= u.x),
bl AS (SELECT lo.*, x1, CASE WHEN x0 IS NULL THEN v1 WHEN x1 IS NULL OR x1 = x0 THEN v0 ELSE v0 + (v1-v0)*((distance_m-x0)/(x1-x0)) END AS bv, CASE WHEN x0 IS NULL THEN p1 WHEN x1 IS NULL OR x1 = x0 THEN p0 ELSE p0 + (p1-p0)*((distance_m-x0)/(x1-x0)) END AS bp FROM lo JOIN hi USING (event_id)),
dl AS (SELECT pair, event_id, i, distance_m, coalesce(speed_m_s - bv, 0.0) AS dv, coalesce(pressure_mbar - bp, 0.0) AS dp FROM bl)"""


def _deltas(spark, sf_dir) -> DataFrame:
    a, b = _pairs(spark, sf_dir)
    return compare.against_baseline(b.withColumn("rn", RUN.number()), a, ["pair"], ["speed_m_s", "pressure_mbar"])


@query(f"WITH {_LINE} SELECT pair, event_id, round(dv,6) AS delta_speed, round(dp,6) AS delta_pressure FROM dl")
def baseline_difference(spark, sf_dir):
    return _deltas(spark, sf_dir).select("pair", "event_id", r6("delta_speed_m_s", "delta_speed"), r6("delta_pressure_mbar", "delta_pressure"))


@query(f"WITH {_LINE} SELECT pair, round(avg(dv),6) AS mean, round(min(dv),6) AS low, round(max(dv),6) AS high FROM dl WHERE distance_m BETWEEN 2000.5 AND 9000.5 GROUP BY pair")
def section_delta(spark, sf_dir):
    own = _deltas(spark, sf_dir).where(F.col("distance_m").between(2000.5, 9000.5))
    return own.groupBy("pair").agg(r6(F.avg("delta_speed_m_s"), "mean"), r6(F.min("delta_speed_m_s"), "low"), r6(F.max("delta_speed_m_s"), "high"))


@query(f"""WITH {_LINE}, n AS (SELECT *, greatest(2, floor(count(*) OVER (PARTITION BY pair)/12.0)::INT) AS step, count(*) OVER (PARTITION BY pair) AS n FROM dl), c AS (SELECT *, (i // step) AS chunk FROM n UNION ALL SELECT *, (i // step) - 1 FROM n WHERE i % step = 0 AND i > 0),
m AS (SELECT pair, chunk, count(*) AS n_rows, avg(dv) AS d FROM c WHERE chunk <= (n-2) // step OR n < 2 GROUP BY pair, chunk)
SELECT pair, chunk, n_rows, round(d,6) AS mean_delta, 'rgb(' || round(0 + 213*((tanh(d/1.0)+1)/2))::INT || ',' || round(114 + (94-114)*((tanh(d/1.0)+1)/2))::INT || ',' || round(178 + (0-178)*((tanh(d/1.0)+1)/2))::INT || ')' AS colour FROM m""")
def overview_delta(spark, sf_dir):
    """Chunks of each run with the mean difference from the baseline and its colour."""
    parts = Q.chunks(_deltas(spark, sf_dir), Q.Ordered("pair", "rn"), 12).groupBy("pair", "chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("delta_speed_m_s").alias("d"))
    return parts.select("pair", "chunk", "n_rows", r6("d", "mean_delta"), S.rgb_mix(F.col("d"), F.lit(1.0)).alias("colour"))


@query(f"""WITH {_LINE}, q AS (SELECT pair, quantile_disc(abs(dv),0.95) AS h, count(*) AS n, min(dv) AS lo, max(dv) AS hi, list_sort(list(abs(dv))) AS l FROM dl GROUP BY pair HAVING count(*) >= 4)
SELECT pair, round(greatest(2*least(h,10.0),1.0)/2,6) AS heat, round(greatest(1.2*l[least(floor(0.98*len(l))::INT+1, len(l))],0.75),6) AS bound, round(CASE WHEN lo = hi THEN lo-1 ELSE lo - greatest((hi-lo)*0.12,1.0) END,6) AS axis_low, round(CASE WHEN lo = hi THEN hi+1 ELSE hi + greatest((hi-lo)*0.12,1.0) END,6) AS axis_high FROM q""")
def delta_ranges(spark, sf_dir):
    """Ranges of colours and axes for the differences."""
    d = _deltas(spark, sf_dir)
    heat = A.robust_symmetric(d, ["pair"], "delta_speed_m_s", 0.95, 0.0, 1.0, 10.0).select("pair", F.col("high").alias("heat"))
    low, high = A.axis_range("delta_speed_m_s")
    axes = d.groupBy("pair").agg(low.alias("axis_low"), high.alias("axis_high"))
    bound = A.symmetric_range(d, ["pair"], "delta_speed_m_s").select("pair", F.col("high").alias("bound"))
    return heat.join(axes, "pair").join(bound, "pair").select("pair", r6("heat"), r6("bound"), r6("axis_low"), r6("axis_high"))


@query(f"""WITH {_GRID}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY delta_t_s DESC, distance_m) AS rank FROM dt WHERE delta_t_s > 0.02) WHERE rank <= 8), b AS (SELECT run_id - 1 AS pair, distance_m AS x, min(event_id) AS event_id FROM dist WHERE run_id % 2 = 1 GROUP BY 1,2)
SELECT pair, rank, event_id FROM (SELECT p.pair, rank, b.event_id, row_number() OVER (PARTITION BY p.pair, rank ORDER BY abs(x - p.distance_m), x) AS k FROM p JOIN b ON p.pair = b.pair) WHERE k = 1""")
def pin_samples(spark, sf_dir):
    """The sample of the slower run that is nearest to each of the pins."""
    a, b = _pairs(spark, sf_dir)
    found = compare.pins(compare.delta_t(a, b, ["pair"], 500.0), ["pair"])
    return compare.pin_rows(b, found, ["pair"], "event_id").select("pair", F.col("rank").cast("long").alias("rank"), "event_id")


@query(f"""WITH {DIST}, u AS (SELECT run_id, distance_m AS x, max(time_s) AS t, max(pressure_mbar) AS p FROM dist GROUP BY 1,2), m AS (SELECT run_id, max(x) AS most FROM u GROUP BY 1), r AS (SELECT g*700.0::DOUBLE AS d, g*9000.0::DOUBLE AS t_ref, g*3.0::DOUBLE AS alt, CASE WHEN g % 4 = 0 THEN 0.0 ELSE g*0.5 END::DOUBLE AS sig FROM generate_series(0,40) t(g)),
h AS (SELECT run_id, d, t_ref, alt, sig FROM m JOIN r ON d <= most), n AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS c FROM h), k AS (SELECT * FROM n WHERE c >= 2),
lo AS (SELECT k.*, u.x AS x0, u.t AS t0, u.p AS p0 FROM k ASOF LEFT JOIN u ON k.run_id = u.run_id AND k.d >= u.x), hi AS (SELECT k.run_id, k.d, u.x AS x1, u.t AS t1, u.p AS p1 FROM k ASOF LEFT JOIN u ON k.run_id = u.run_id AND k.d <= u.x)
SELECT lo.run_id, lo.d AS distance_m, round(CASE WHEN x0 IS NULL THEN t1 WHEN x1 IS NULL OR x1 = x0 THEN t0 ELSE t0 + (t1-t0)*((lo.d-x0)/(x1-x0)) END - t_ref,4) AS delta_t_s, alt AS reference_altitude_m, sig AS t_reference_sigma_s, round(CASE WHEN x0 IS NULL THEN p1 WHEN x1 IS NULL OR x1 = x0 THEN p0 ELSE p0 + (p1-p0)*((lo.d-x0)/(x1-x0)) END,6) AS altitude_m FROM lo JOIN hi ON lo.run_id = hi.run_id AND lo.d = hi.d""")
def pace_payload(spark, sf_dir):
    """Every run against a reference: time lost, the reference's altitude and sigma at the place, the run's own altitude."""
    g = F.col("id")
    reference = spark.range(41).select((g * 700.0).alias("distance_m"), (g * 9000.0).alias("time_s"), (g * 3.0).alias("altitude_m"), F.when(g % 4 != 0, g * 0.5).alias("time_sigma_s"))
    rows = compare.against_reference(dist(spark, sf_dir), compare.compact_reference(reference), ["run_id"], "pressure_mbar")
    return rows.select("run_id", "distance_m", F.round("delta_t_s", 4).alias("delta_t_s"), "reference_altitude_m", "t_reference_sigma_s", r6("altitude_m"))


@query(f"WITH {_GRID}, x AS (SELECT run_id - run_id % 2 AS pair, run_id % 2 AS side, distance_m AS x, max(pressure_mbar) AS p FROM dist GROUP BY 1,2,3), lo2 AS (SELECT s.*, x.x AS x0, x.p AS p0 FROM s ASOF LEFT JOIN x ON s.pair = x.pair AND s.side = x.side AND s.d >= x.x), hi2 AS (SELECT s.*, x.x AS x1, x.p AS p1 FROM s ASOF LEFT JOIN x ON s.pair = x.pair AND s.side = x.side AND s.d <= x.x), pp AS (SELECT lo2.pair, lo2.grid_index, lo2.side, CASE WHEN x0 IS NULL THEN p1 WHEN x1 IS NULL OR x1 = x0 THEN p0 ELSE p0 + (p1-p0)*((lo2.d-x0)/(x1-x0)) END AS p FROM lo2 JOIN hi2 ON lo2.pair = hi2.pair AND lo2.grid_index = hi2.grid_index AND lo2.side = hi2.side) SELECT dt.pair, dt.grid_index, round(delta_t_s,4) AS delta_t_s, round(max(p) FILTER (side = 0),6) AS altitude_a_m, round(max(p) FILTER (side = 1),6) AS altitude_b_m FROM dt JOIN pp ON dt.pair = pp.pair AND dt.grid_index = pp.grid_index GROUP BY 1,2,3")
def comparison_rows(spark, sf_dir):
    rows = compare.comparison(*_pairs(spark, sf_dir), ["pair"], 500.0, "pressure_mbar")
    return rows.select("pair", "grid_index", F.round("delta_t_s", 4).alias("delta_t_s"), r6("altitude_a_m"), r6("altitude_b_m"))


@query(f"""WITH {TRACK}, r AS (SELECT run_id, 1/(median(dt) FILTER (dt > 0)) AS rate FROM (SELECT run_id, (unix_ns - lag(unix_ns) OVER {W})*1e-9 AS dt FROM track) GROUP BY run_id)
SELECT run_id, round((count(*) FILTER (speed_m_s/24 < 0.55 AND accuracy > 10))/coalesce(max(rate),25.0),3) AS simple_airtime_s FROM track JOIN r USING (run_id) GROUP BY run_id""")
def simple_airtime(spark, sf_dir):
    from ridgeline.plans.features import simple_airtime as airtime

    t = track(spark, sf_dir)
    rows = t.join(A.sample_rate(t, RUN), "run_id").withColumn("g", F.col("speed_m_s") / 24)
    return airtime(rows, ["run_id"], "g", F.coalesce(F.col("accuracy") > 10, F.lit(False)), "sample_rate_hz").select("run_id", F.round("simple_airtime_s", 3).alias("simple_airtime_s"))


@query(f"WITH {DIST}, l AS (SELECT run_id, max_by(distance_m, unix_ns) AS d, min(speed_m_s) AS low, max(speed_m_s) AS high, max_by(speed_m_s, unix_ns) AS last FROM dist GROUP BY run_id) SELECT run_id, low, high, last, round((SELECT max(d) FROM l),4) AS total_m FROM l")
def finite_summary(spark, sf_dir):
    """Least, greatest and latest speed of each run; beside them the greatest last distance of all runs."""
    d = dist(spark, sf_dir)
    return A.finite_summary(d, ["run_id"], "speed_m_s", "unix_ns").crossJoin(F.broadcast(A.total_distance(d, RUN))).select("run_id", "low", "high", "last", F.round("total_m", 4).alias("total_m"))


@query(f"""WITH {DIST}, t AS (SELECT run_id, max(distance_m)/1000 AS km, avg(speed_m_s)*9 AS lo, avg(accuracy) AS hi FROM dist GROUP BY run_id), p AS (SELECT *, least(greatest(round(lo),0.0),98.0) AS a, least(greatest(round(hi),2.0),100.0) AS b FROM t),
q AS (SELECT *, CASE WHEN b-a < 2 THEN least(100.0, a+2) ELSE b END AS up FROM p)
SELECT run_id, CASE WHEN up-a < 2 THEN greatest(0.0, up-2) ELSE a END AS low, up AS high, round(CASE WHEN km <= 0.2 THEN 0.0 ELSE greatest(0.0, least(km*0.9 - 0.1, km - 0.2)) END,6) AS from_km, round(CASE WHEN km >= 1.25 THEN 1.0 ELSE greatest(0.0, km*0.35) END,6) AS first_km, round(CASE WHEN km >= 1.25 THEN 1.2 ELSE greatest(greatest(0.0, km*0.35)+0.05, km*0.55) END,6) AS last_km FROM q""")
def view_settings(spark, sf_dir):
    """Percentile pairs, a section near the end and the default section of each run."""
    t = dist(spark, sf_dir).groupBy("run_id").agg((F.max("distance_m") / 1000).alias("km"), (F.avg("speed_m_s") * 9).alias("lo"), F.avg("accuracy").alias("hi"))
    low, high = S.percentile_pair(F.col("lo"), F.col("hi"))
    first, last = S.default_section(F.col("km"))
    return t.select("run_id", low.alias("low"), high.alias("high"), r6(S.section_around(F.col("km") * 0.9, F.col("km"))[0], "from_km"), r6(first, "first_km"), r6(last, "last_km"))


# Extensions and kernels ---------------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY CUBE (user_id, event_type)")
def cube_totals(spark, sf_dir):
    return table(spark, sf_dir, "events").cube("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 100000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_operations(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.where("o_totalprice > 100000").select(F.col("o_custkey").alias("k")).intersect(c.where("c_acctbal > 0").select("c_custkey"))


def uniform(spark, sf_dir) -> DataFrame:
    """Each run's speeds as an even series at 25 Hz, as a barometer with pressures and places."""
    t = track(spark, sf_dir)
    return t.withColumn("i", RUN.number()).withColumn("unix_ns", F.lit(1_700_000_000_000_000_000) + F.col("i").cast("long") * 40_000_000).drop("event_id")


@query()
def processed_runs(spark, sf_dir):
    """Streams of every run through the whole processing, to a row of stats for each."""
    from ridgeline.plans import run

    u = uniform(spark, sf_dir)
    baro = u.select("run_id", "unix_ns", "pressure_mbar", S.hypsometric_m(F.col("pressure_mbar")).alias("altitude_m"), F.lit(None).cast("double").alias("relative_altitude_app_m"))
    gps = u.select("run_id", "unix_ns", "latitude", "longitude", "speed_m_s", F.lit(None).cast("double").alias("horizontal_accuracy_m"), F.lit(None).cast("double").alias("gps_altitude_m"))
    g = F.when(F.col("i") % 40 < 8, 1.0).when(F.col("i") % 40 < 12, 15.0).otherwise(9.8)
    motion = u.select("run_id", "unix_ns", F.lit("total_acc").alias("stream"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), g.alias("z"))
    return run.run_stats(run.process(run.on_clock(baro, gps, motion)))


@query()
def canonical_reference(spark, sf_dir):
    """A reference from all runs of each of five trails, over their whole lengths."""
    from ridgeline.plans import canonical

    u = Q.with_elapsed(Q.with_distance(uniform(spark, sf_dir).withColumn("latitude", 46 + F.col("i") * 1e-5 + F.col("run_id") * 1e-9).withColumn("longitude", F.lit(7.0)), EVEN), EVEN)
    return canonical.synthesise(u.withColumn("trail", F.col("run_id") % 5).withColumn("altitude_m", S.hypsometric_m(F.col("pressure_mbar"))), "trail")


@query()
def aligned_pairs(spark, sf_dir):
    """Pairs of runs over one line of places: shared corridor, agreement of altitudes, lag of climbs."""
    from ridgeline.plans import align

    u = uniform(spark, sf_dir).withColumn("latitude", 46 + F.col("i") * 2e-5).withColumn("longitude", 7 + F.col("run_id") % 2 * 1e-5)
    rows = Q.with_elapsed(Q.with_distance(u, EVEN), EVEN).withColumns({"altitude_smooth_m": 500 - F.col("distance_m") * 0.1, "vz_m_s": F.sin(F.col("i") / 5.0), "pair": F.col("run_id") - F.col("run_id") % 2})
    _, _, meta = align.align_auto(rows.where("run_id % 2 = 0"), rows.where("run_id % 2 = 1"), "pair")
    return meta.select("pair", "n_matches", F.round("median_m", 3).alias("median_m"), "reason", "lag_s", F.round("peak", 4).alias("peak"), "quality")


@query(f"WITH {DIST} SELECT run_id, count(*) AS n, round(max(distance_m),3) AS distance_m FROM dist GROUP BY run_id")
def stream_distance(spark, sf_dir):
    """The stateful stream's last word on each run, read from the events as a stream."""
    import uuid

    from ridgeline.streaming.sensors import running_distance

    source = table(spark, sf_dir, "events")
    events = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if not _is_folder(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet")
    fixes = events.select(F.col("user_id").alias("run_id"), "ts", (46 + (F.col("event_id") % 997) * 1e-5).alias("latitude"), (7 + ((F.col("event_id") * 31) % 991) * 1e-5).alias("longitude"))
    name = f"distance_{uuid.uuid4().hex}"
    shared = f"{shared_dir(spark)}/{name}"
    keep = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{shared}/rows/batch={batch}")  # noqa: E731  a batch that runs again writes over itself
    q = running_distance(fixes, "run_id").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{shared}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema("run_id long, n long, distance_m double").parquet(f"{shared}/rows").groupBy("run_id").agg(F.max("n").alias("n"), F.max("distance_m").alias("distance_m"))
    return got.select("run_id", "n", F.round("distance_m", 3).alias("distance_m"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


from ridgeline.plans import signal_queries as _signals  # noqa: E402, F401  both register their queries
from ridgeline.plans import source_queries as _sources  # noqa: E402, F401
