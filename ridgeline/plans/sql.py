"""Pieces of SQL that the oracles share."""

R = "6371000.0"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(power(sin(radians({lat2}-{lat1})/2),2) + cos(radians({lat1}))*cos(radians({lat2}))*power(sin(radians({lon2}-{lon1})/2),2))"
    return f"(2*{R}*atan2(sqrt({a}), sqrt(greatest(1-{a},0.0))))"


TRACK = """track AS (SELECT user_id AS run_id, event_id, epoch_us(ts)*1000 AS unix_ns, 46 + (event_id % 997)*1e-5 AS latitude,
 7 + ((event_id*31) % 991)*1e-5 AS longitude, value/20 AS speed_m_s, 850 + (event_id % 500)*1e-1 AS pressure_mbar,
 CAST(json_extract_string(props,'$.k') AS DOUBLE) AS accuracy, event_type FROM events)"""
W = "(PARTITION BY run_id ORDER BY unix_ns, event_id)"
DIST = f"""{TRACK}, stepped AS (SELECT *, coalesce({hav("lag(latitude) OVER w", "lag(longitude) OVER w", "latitude", "longitude")}, 0.0) AS step_m,
 row_number() OVER w AS rn FROM track WINDOW w AS {W}),
dist AS (SELECT *, sum(step_m) OVER (PARTITION BY run_id ORDER BY unix_ns, event_id ROWS UNBOUNDED PRECEDING) AS distance_m,
 (unix_ns - min(unix_ns) OVER (PARTITION BY run_id))*1e-9 AS time_s FROM stepped)"""
