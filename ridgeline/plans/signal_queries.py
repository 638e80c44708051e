"""Queries of the kernels and of the views, with SQL that recurs over a run's rows where the kernel does."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions import dsp
from ridgeline.functions import scalar as S
from ridgeline.operators import aggregates as A
from ridgeline.operators import generators as G
from ridgeline.operators import sequences as Q
from ridgeline.plans import align, compare, features
from ridgeline.plans.queries import RUN, _pairs, dist, query, r6, table, track, uniform
from ridgeline.plans.sql import DIST, TRACK, W

# The even series of a run: speeds at 25 Hz.
_U = f"{TRACK}, u AS (SELECT run_id, row_number() OVER {W} AS i, speed_m_s AS y FROM track), l AS (SELECT run_id, count(*)::INT AS n, list(y ORDER BY i) AS y FROM u GROUP BY run_id)"
_B, _A = dsp.butterworth(2, 4.0 / 12.5)
_Z = dsp.settled_state(_B, _A)


def _once(x: str) -> str:
    """One pass of a filter of order 2 over a list, from the state that its first value would settle in; the first two of the outcome are the last state."""
    b0, b1, b2, a1, a2 = (repr(float(v)) for v in (*_B, *_A[1:]))
    out = f"({b0}*v[1] + s[1])"
    step = f"lambda s, v: list_concat([{b1}*v[1] - {a1}*{out} + s[2], {b2}*v[1] - {a2}*{out}], list_append(s[3:], {out}))"
    start = f"[{float(_Z[0])!r}*{x}[1], {float(_Z[1])!r}*{x}[1]]"
    return f"list_reduce(list_concat([{start}], list_transform({x}, lambda e: [e])), {step})[3:]"


@query(f"""WITH {_U}, p AS (SELECT *, least(9, n - 1) AS pad FROM l WHERE n >= 8), w AS (SELECT *, list_concat(list_transform(generate_series(pad, 1, -1), lambda k: 2*y[1] - y[k+1]), y, list_transform(generate_series(1, pad), lambda k: 2*y[n] - y[n-k])) AS x FROM p),
f AS (SELECT run_id, n, pad, list_reverse({_once("x")}) AS x FROM w), b AS (SELECT run_id, n, list_reverse({_once("x")})[pad+1:pad+n] AS smooth FROM f)
SELECT run_id, unnest(generate_series(1, n)) AS i, round(unnest(smooth), 6) AS smooth FROM b UNION ALL SELECT run_id, unnest(generate_series(1, n)), round(unnest(y), 6) FROM l WHERE n < 8""")
def butterworth_filtfilt(spark, sf_dir):
    """A zero-phase filter over every run's speeds, by blocks; the SQL goes from row to row."""

    def kernel(own):
        return own[["run_id", "i"]].assign(smooth=dsp.low_pass(own["speed_m_s"].to_numpy(), 25.0, 4.0, 2))

    return dsp.per_run(uniform(spark, sf_dir).select("run_id", F.col("i").cast("long").alias("i"), "speed_m_s"), "run_id", ["i"], kernel, "run_id long, i long, smooth double").select("run_id", "i", r6("smooth"))


@query(f"""WITH {_U}, c AS (SELECT *, lag(y) OVER w AS y0, lead(y) OVER w AS y1 FROM u WINDOW w AS (PARTITION BY run_id ORDER BY i)), m AS (SELECT run_id, i, y FROM c WHERE y > y0 AND y >= y1 AND y >= 12.0),
q AS (SELECT run_id, list([i] ORDER BY y DESC, i) AS c FROM m GROUP BY run_id),
k AS (SELECT run_id, unnest(list_reduce(c, lambda s, v: CASE WHEN len(list_filter(s, lambda e: abs(e - v[1]) < 6)) = 0 THEN list_concat(s, v) ELSE s END)) AS i FROM q),
p AS (SELECT k.run_id, k.i, u.y FROM k JOIN u USING (run_id, i)), near AS (SELECT p.run_id, p.i, p.y, u.i - p.i AS d, u.y AS v FROM p JOIN u ON u.run_id = p.run_id AND u.i BETWEEN p.i - 9 AND p.i + 9),
reach AS (SELECT run_id, i, y, coalesce(max(d) FILTER (d < 0 AND v > y), -10) AS a, coalesce(min(d) FILTER (d > 0 AND v > y), 10) AS b FROM near GROUP BY ALL),
foot AS (SELECT r.run_id AS run_id, r.i AS i, r.y AS y, coalesce(min(v) FILTER (d < 0 AND d > a), r.y) AS f, coalesce(min(v) FILTER (d > 0 AND d < b), r.y) AS g FROM reach r JOIN near n USING (run_id, i) GROUP BY r.run_id, r.i, r.y)
SELECT run_id, i FROM foot WHERE y - greatest(f, g) >= 3.0""")
def prominent_peaks(spark, sf_dir):
    """Peaks of a least height, six rows apart, that stand out by three within nine rows on either side."""

    def kernel(own):
        return own.iloc[dsp.peaks(own["speed_m_s"].to_numpy(), 12.0, 6, 3.0, 18)][["run_id", "i"]]

    return dsp.per_run(uniform(spark, sf_dir).select("run_id", F.col("i").cast("long").alias("i"), "speed_m_s"), "run_id", ["i"], kernel, "run_id long, i long")


_STEP, _WITHIN = 500.0, 40.0


@query(f"""WITH {DIST}, u AS (SELECT run_id - run_id % 2 AS pair, run_id % 2 AS side, distance_m AS x, max(pressure_mbar) AS h FROM dist GROUP BY 1,2,3), n AS (SELECT run_id - run_id % 2 AS pair, run_id % 2 AS side, count(*) AS n, max(distance_m) AS d FROM dist GROUP BY 1,2),
m AS (SELECT pair, min(d) AS most, min(n) AS least FROM n GROUP BY pair HAVING count(*) = 2), g AS (SELECT pair, unnest(generate_series(0, ceil((most + 250.0)/500.0)::BIGINT - 1)) AS k, most FROM m WHERE most >= 12500.0 AND least >= 4),
s AS (SELECT pair, k, k*500.0::DOUBLE AS d, side FROM g, (SELECT unnest([0,1]) AS side)), lo AS (SELECT s.*, u.x AS x0, u.h AS h0 FROM s ASOF LEFT JOIN u ON s.pair = u.pair AND s.side = u.side AND s.d >= u.x), hi AS (SELECT s.*, u.x AS x1, u.h AS h1 FROM s ASOF LEFT JOIN u ON s.pair = u.pair AND s.side = u.side AND s.d <= u.x),
t AS (SELECT pair, k, d, side, CASE WHEN x0 IS NULL THEN h1 WHEN x1 IS NULL OR x1 = x0 THEN h0 ELSE h0 + (h1-h0)*((d-x0)/(x1-x0)) END AS h FROM lo JOIN hi USING (pair, k, d, side)),
df AS (SELECT pair, k, d, max(h) FILTER (side = 0) - max(h) FILTER (side = 1) AS diff, count(*) OVER (PARTITION BY pair) AS n FROM t GROUP BY pair, k, d), o AS (SELECT pair, median(diff) FILTER (k >= floor(0.45*n)) AS stable FROM df GROUP BY pair),
r AS (SELECT df.*, stable, median(abs(diff - stable)) OVER (PARTITION BY pair ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS res FROM df JOIN o USING (pair)),
w AS (SELECT *, min((res <= {_WITHIN})::INT) OVER f = 1 AND count(*) OVER f = 4 AS good FROM r WINDOW f AS (PARTITION BY pair ORDER BY k ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
a AS (SELECT pair, min(k) FILTER (good) AS k0, any_value(stable) AS stable, max(res) FILTER (k = 0) AS first_res FROM w GROUP BY pair), b AS (SELECT m.pair, CASE WHEN least < 4 THEN '{align.MISSING}' WHEN most < 12500.0 THEN '{align.SHORT}' WHEN coalesce(k0, 0) = 0 THEN '{align.AGREES}' WHEN most - k0*500.0 < 12500.0 THEN '{align.LITTLE}' ELSE '{align.TRIMMED}' END AS reason, k0, stable, first_res FROM m LEFT JOIN a USING (pair))
SELECT pair, reason, CASE WHEN reason = '{align.TRIMMED}' THEN k0*500.0 ELSE 0.0 END::DOUBLE AS trim_m, round(stable, 6) AS stable_offset_m, round(first_res, 6) AS initial_residual_m FROM b""")
def altitude_agreement(spark, sf_dir):
    """From where on the pressures of pairs of runs agree, on a grid of 500 metres."""
    a, b = _pairs(spark, sf_dir)
    got = align.altitude_agreement(a, b, ["pair"], "pressure_mbar", _STEP, _WITHIN, 4 * _STEP, 5 * _STEP, 12500.0)
    return got.select("pair", "reason", "trim_m", r6("stable_offset_m"), r6("initial_residual_m"))


@query(f"""WITH {TRACK}, m AS (SELECT *, speed_m_s - avg(speed_m_s) OVER (PARTITION BY run_id) AS r FROM track), n AS (SELECT *, lead(r) OVER {W} AS r1, lag(r) OVER {W} AS r0 FROM m), p AS (SELECT run_id, greatest(least(sum(r*r1) FILTER (r1 IS NOT NULL)/(sum(r*r) FILTER (r1 IS NOT NULL)+1e-12),0.98),-0.98) AS phi FROM n GROUP BY run_id HAVING count(r1) > 0)
SELECT event_id, round(coalesce(r - phi*r0, r),6) AS white FROM n JOIN p USING (run_id)""")
def whitened(spark, sf_dir):
    """What the row before does not foretell of each speed."""
    rows = track(spark, sf_dir).withColumn("r", F.col("speed_m_s") - F.avg("speed_m_s").over(RUN.all))
    return Q.whiten(rows.join(Q.ar1(rows, "r", RUN), "run_id"), "r", "phi", RUN, "white").select("event_id", r6("white"))


@query("""WITH e AS (SELECT event_id, value, value - 200 AS d FROM events) SELECT event_id, printf('%+.2f s', d) AS signed, round(CASE WHEN d > 0 THEN d*3.6 ELSE 0.0 END,6) AS kmh, round(CASE WHEN event_id % 3 = 0 OR abs(d) <= 1e-5 THEN value ELSE d END,6) AS smooth_or_raw,
 list_element(['cold','cool','mild','warm','hot'], least(greatest(round(((event_id % 101)/100.0::DOUBLE)*4)::INT,0),4) + 1) AS label, strftime(to_timestamp(1700000000 + event_id*60) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS date FROM e""")
def telemetry_labels(spark, sf_dir):
    """Signed seconds, speeds in km/h, the smooth value or else the raw one, the nearest of five names, dates."""
    e = table(spark, sf_dir, "events").select("event_id", "value", (F.col("value") - 200).alias("d"))
    smooth = F.when(F.col("event_id") % 3 > 0, F.col("d"))
    stamp = F.date_format(F.timestamp_seconds(1_700_000_000 + F.col("event_id") * 60), "yyyy-MM-dd HH:mm")
    return e.select("event_id", S.signed_label(F.col("d")).alias("signed"), r6(S.speed_kmh(F.col("d")), "kmh"), r6(S.smooth_or_raw(smooth, F.col("value"), 1e-5), "smooth_or_raw"), G.nearest_label(["cold", "cool", "mild", "warm", "hot"], (F.col("event_id") % 101) / F.lit(100.0)).alias("label"), stamp.alias("date"))


@query(f"""WITH {DIST}, s AS (SELECT run_id, max(distance_m)*1e-3 AS km FROM dist GROUP BY run_id), b AS (SELECT run_id, greatest(least(floor(750000/greatest(km,1e-6)),24000),2000)::BIGINT AS budget FROM s),
n AS (SELECT *, latitude BETWEEN 46.002 - 6e-3*4e-2 AND 46.008 + 6e-3*4e-2 AND longitude BETWEEN 7.002 - 6e-3*4e-2 AND 7.008 + 6e-3*4e-2 AS ok FROM dist), k AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY run_id) AS k FROM n),
v AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY run_id) AS c FROM k WHERE ok OR k < 2 WINDOW w AS {W}) SELECT run_id, event_id, budget FROM v JOIN b USING (run_id) WHERE i % greatest(ceil(c/(budget/250.0)),1)::BIGINT = 0 OR i = c-1""")
def viewport_budget(spark, sf_dir):
    """Rows in a padded view, thinned by a budget of points that falls with a run's length (a 250th of it here, as runs are short)."""
    rows = dist(spark, sf_dir).withColumn("budget", Q.point_budget(F.max("distance_m").over(RUN.all) * 1e-3))
    return Q.viewport(rows, RUN, (46.002, 46.008), (7.002, 7.008), F.col("budget") / 250.0, pad=0.04).select("run_id", "event_id", "budget")


_EDGES = [(1, 0.0, 5000.0), (2, 5000.0, 10000.0), (3, 10000.0, 20000.0)]


@query(f"""WITH {DIST}, b AS (SELECT run_id FROM dist GROUP BY run_id ORDER BY max(time_s) DESC, run_id LIMIT 1), u AS (SELECT run_id, distance_m AS x, max(time_s) AS t FROM dist GROUP BY 1,2), s AS (SELECT * FROM (VALUES {", ".join(f"({i}, {a}::DOUBLE, {z}::DOUBLE)" for i, a, z in _EDGES)}) AS s(id, d0, d1)),
e AS (SELECT DISTINCT run_id, d FROM (SELECT run_id FROM dist GROUP BY 1), (SELECT unnest([d0, d1]) AS d FROM s)), lo AS (SELECT e.*, u.x AS x0, u.t AS t0 FROM e ASOF LEFT JOIN u ON e.run_id = u.run_id AND e.d >= u.x), hi AS (SELECT e.*, u.x AS x1, u.t AS t1 FROM e ASOF LEFT JOIN u ON e.run_id = u.run_id AND e.d <= u.x),
t AS (SELECT lo.run_id, lo.d, CASE WHEN x0 IS NULL THEN t1 WHEN x1 IS NULL OR x1 = x0 THEN t0 ELSE t0 + (t1-t0)*((lo.d-x0)/(x1-x0)) END AS t FROM lo JOIN hi ON lo.run_id = hi.run_id AND lo.d = hi.d),
o AS (SELECT a.run_id, s.*, z.t - a.t AS sec FROM s JOIN t a ON a.d = s.d0 JOIN t z ON z.d = s.d1 AND z.run_id = a.run_id), v AS (SELECT run_id, id, avg(speed_m_s) AS v FROM dist JOIN s ON distance_m BETWEEN d0 AND d1 GROUP BY 1,2)
SELECT o.run_id, o.id, round(f.sec,6) AS reference_s, round(fv.v,9) AS reference_speed, round(o.sec - f.sec,6) AS delta_s, round(fv.v - ov.v,9) AS delta_speed FROM o JOIN b ON true JOIN o f ON f.run_id = b.run_id AND f.id = o.id LEFT JOIN v ov ON ov.run_id = o.run_id AND ov.id = o.id LEFT JOIN v fv ON fv.run_id = b.run_id AND fv.id = o.id""")
def sectors_against_reference(spark, sf_dir):
    """Times and speeds of all runs in three sectors against the slowest run's."""
    rows = dist(spark, sf_dir)
    b = A.slowest(A.run_durations(rows, RUN, "time_s"), "run_id").select("run_id")
    sectors = spark.createDataFrame(_EDGES, "id int, d0 double, d1 double")
    got = compare.sector_deltas(rows, rows.join(F.broadcast(b), "run_id", "left_semi"), ["run_id"], sectors, speed="speed_m_s")
    return got.select("run_id", "id", r6("reference_s"), r6("delta_s"), F.round("reference_speed", 9).alias("reference_speed"), F.round("delta_speed", 9).alias("delta_speed"))


@query(f"""WITH {DIST}, s AS (SELECT run_id, rn AS i, CASE WHEN rn % 23 BETWEEN 5 AND 5 + run_id % 6 THEN 0.2 + 5e-2*((rn*7) % 5) ELSE 1.0 END AS f, 1.0 + (event_id % 5)*1e-1 AS raw, 1.0 + (event_id % 7)*1e-1 AS land, speed_m_s - 12 AS vz, speed_m_s > 0.5 AS moves FROM dist),
o AS (SELECT *, f < 0.55 AND moves AS low, lag(f < 0.55 AND moves) OVER (PARTITION BY run_id ORDER BY i) AS was FROM s), p AS (SELECT *, sum((low AND NOT coalesce(was, false))::INT) OVER (PARTITION BY run_id ORDER BY i) AS island FROM o),
z AS (SELECT run_id, island, min(i) AS first_row, max(i) AS last_row, count(*) AS n_rows, median(vz) AS median_vz FROM p WHERE low GROUP BY ALL), l AS (SELECT *, CASE WHEN median_vz < -5.0 THEN 0.33 ELSE 0.55 END AS lim FROM z),
h AS (SELECT p.run_id, p.island, i, f < lim AS strict, lag(f < lim) OVER (PARTITION BY p.run_id, p.island ORDER BY i) AS was2 FROM p JOIN l USING (run_id, island) WHERE low), g AS (SELECT *, sum((strict AND NOT coalesce(was2, false))::INT) OVER (PARTITION BY run_id, island ORDER BY i) AS part FROM h),
q AS (SELECT run_id, island, part, min(i) AS a, max(i) AS b, count(*) AS n FROM g WHERE strict GROUP BY ALL HAVING count(*) >= 3), best AS (SELECT run_id, island, a, b FROM q QUALIFY row_number() OVER (PARTITION BY run_id, island ORDER BY n DESC, a) = 1),
k AS (SELECT b.run_id, b.island, max(raw) FILTER (s.i < b.a) AS takeoff_g, max(land) FILTER (s.i > b.b) AS landing_g FROM best b JOIN s ON s.run_id = b.run_id AND s.i BETWEEN b.a - 2 AND b.b + 5 GROUP BY ALL)
SELECT l.run_id, l.island::BIGINT AS island, first_row, last_row, n_rows, a AS start_row, round((b - a + 1)/10.0,6) AS duration_s, round(takeoff_g,6) AS takeoff_g, round(landing_g,6) AS landing_g,
 CASE WHEN n_rows < 3 THEN 'candidate_too_short' WHEN a IS NULL THEN 'refine_duration' WHEN NOT coalesce(landing_g >= 1.3, false) THEN 'landing_peak' WHEN a > 1 AND takeoff_g >= 1.15 THEN 'jump' WHEN median_vz < -1.5 THEN 'witnessed_drop' ELSE 'drop' END AS kind
FROM l LEFT JOIN best USING (run_id, island) LEFT JOIN k USING (run_id, island)""")
def flights(spark, sf_dir):
    """Candidate flights of all runs, accepted or not, with the reason."""
    rows = dist(spark, sf_dir).withColumn("rn", RUN.number().cast("long")).withColumn("rate", F.lit(10.0))
    low = (F.col("rn") % 23).between(5, 5 + F.col("run_id") % 6)
    rows = rows.withColumns({"f": F.when(low, 0.2 + 5e-2 * (F.col("rn") * 7 % 5)).otherwise(1.0), "raw": 1.0 + (F.col("event_id") % 5) * 1e-1, "land": 1.0 + (F.col("event_id") % 7) * 1e-1, "vz": F.col("speed_m_s") - 12})
    got = features.flights(rows, RUN, "rate", "f", "raw", "land", "vz", F.col("speed_m_s") > 0.5)
    return got.select("run_id", F.col("island").cast("long").alias("island"), "first_row", "last_row", "n_rows", "start_row", r6("duration_s"), r6("takeoff_g"), r6("landing_g"), "kind")


_SPEED_STEPS = [-1e-2, -1e-3, 0.0, 1e-3, 1e-2]


@query(f"""WITH {DIST}, s AS (SELECT *, (speed_m_s - lag(speed_m_s) OVER {W})/nullif(step_m,0) AS slope FROM dist), f AS (SELECT *, coalesce(last_value(slope IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY unix_ns, event_id ROWS UNBOUNDED PRECEDING), 0.0) AS filled FROM s),
b AS (SELECT *, {" + ".join(f"(filled >= {s!r})::INT" for s in _SPEED_STEPS)} AS bin FROM f), c AS (SELECT *, lag(bin) OVER {W} AS before FROM b), r AS (SELECT *, sum((before IS NULL OR before <> bin)::INT) OVER {W} AS piece FROM c)
SELECT run_id, piece::BIGINT AS piece, bin, count(*) AS n_rows, round(min(distance_m),4) AS from_m, round(max(distance_m),4) AS to_m FROM r GROUP BY run_id, piece, bin""")
def slope_pieces(spark, sf_dir):
    """Stretches of a run whose slopes fall into one bin; a row without a slope keeps the one before."""
    rows = Q.with_slope(dist(spark, sf_dir), "speed_m_s", "step_m", RUN, "slope")
    got = Q.bands(rows, Q.slope_bin(F.col("slope"), _SPEED_STEPS), RUN, "distance_m")
    return got.select("run_id", F.col("band").cast("long").alias("piece"), F.col("level").alias("bin"), "n_rows", F.round("distance_m_start", 4).alias("from_m"), F.round("distance_m_end", 4).alias("to_m"))


@query(f"""WITH {TRACK}, b AS (SELECT run_id, min(latitude) AS a, max(latitude) AS b, min(longitude) AS c, max(longitude) AS d FROM track GROUP BY run_id), p AS (SELECT *, greatest(greatest(b-a, 35e-5)*0.12, 35e-5*0.45) AS y, greatest(greatest(d-c, 35e-5)*0.12, 35e-5*0.45) AS x FROM b)
SELECT run_id, round(a-y,9) AS min_latitude, round(b+y,9) AS max_latitude, round(c-x,9) AS min_longitude, round(d+x,9) AS max_longitude, round(least(greatest((d-c+2*x)*cos(radians((a+b)/2))/greatest(b-a+2*y,1e-9),0.35),2.85),6) AS aspect, round(1/greatest(cos(radians((a+b)/2)),0.2),6) AS lon_lat_ratio FROM p""")
def tight_view(spark, sf_dir):
    got = A.tight_view(track(spark, sf_dir), ["run_id"], "latitude", "longitude")
    return got.select("run_id", *[F.round(c, 9).alias(c) for c in ("min_latitude", "max_latitude", "min_longitude", "max_longitude")], r6("aspect"), r6("lon_lat_ratio"))
