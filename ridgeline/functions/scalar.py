"""Scalar column functions: geodesy, barometry, motion, units and labels. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6_371_000.0
SEA_LEVEL_MBAR = 1013.25
GRAVITY_M_S2 = 9.80665
METRES_PER_DEGREE = math.pi * EARTH_RADIUS_M / 180.0


def number(c: Column | str) -> Column:
    """A double; what isn't a finite number is null."""
    value = F.expr(f"try_cast(`{c}` as double)") if isinstance(c, str) else c.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, low if isinstance(low, Column) else F.lit(low)), high if isinstance(high, Column) else F.lit(high))


# Geodesy ------------------------------------------------------------------------------------------------------------


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), F.lit(2.0))
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def local_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of a centre, on the tangent plane."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * EARTH_RADIUS_M, F.radians(lat - lat0) * EARTH_RADIUS_M


def offset_position(lat: Column, lon: Column, east: Column, north: Column) -> tuple[Column, Column]:
    return lat + F.degrees(north / EARTH_RADIUS_M), lon + F.degrees(east / (EARTH_RADIUS_M * F.cos(F.radians(lat))))


def heading(east: Column, north: Column) -> Column:
    """Compass bearing in degrees, [0, 360)."""
    turned = F.degrees(F.atan2(east, north))
    return F.when(turned < 0, turned + 360).otherwise(turned)


# Barometry ----------------------------------------------------------------------------------------------------------


def hypsometric_m(pressure_mbar: Column) -> Column:
    return 44330.0 * (1 - F.pow(pressure_mbar / SEA_LEVEL_MBAR, F.lit(0.1903)))


def air_density(altitude_m: Column) -> Column:
    return 1.225 * F.exp(-altitude_m / 8500.0)


def dynamic_pressure_mbar(density: Column, speed_m_s: Column) -> Column:
    speed = F.coalesce(finite(speed_m_s), F.lit(0.0))
    return 0.5 * density * speed * speed / 100.0


# Motion -------------------------------------------------------------------------------------------------------------


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def rotate(x: Column, y: Column, z: Column, r: Column) -> list[Column]:
    """Rows of a 3 x 3 matrix (array of arrays) times a vector; a missing axis counts as 0."""
    v = [F.coalesce(c, F.lit(0.0)) for c in (x, y, z)]
    return [sum((r[i][j] * v[j] for j in range(1, 3)), r[i][0] * v[0]) for i in range(3)]


def levelling_matrix(gx: Column, gy: Column, gz: Column) -> Column:
    """The least rotation that takes the mean gravity onto the z axis, up or down by the sign of gz (unit vectors are made here)."""
    size = magnitude(gx, gy, gz)
    x, y, z = gx / size, gy / size, gz / size
    s = F.when(z < 0, -1.0).otherwise(1.0)
    c = F.abs(z)
    k = 1.0 / (1.0 + c)
    # v = u x (0, 0, s) = (s y, -s x, 0); R = I + [v] + [v]^2 k
    vx, vy = s * y, -s * x
    row = lambda *cells: F.array(*[F.lit(v) if not isinstance(v, Column) else v for v in cells])
    return F.array(row(1 - vy * vy * k, vx * vy * k, vy), row(vx * vy * k, 1 - vx * vx * k, -vx), row(-vy, vx, 1 - (vx * vx + vy * vy) * k))


def lean_deg(gx: Column, gz: Column, gx_level: Column, most: float = 62.0) -> Column:
    floor = 0.35 * GRAVITY_M_S2
    down = F.signum(gz) * F.greatest(F.abs(gz), F.lit(floor))
    return clamp(F.abs(F.degrees(F.atan2(gx - gx_level, down))), 0.0, most)


def vertical_acceleration(ax: Column, ay: Column, az: Column, gx: Column, gy: Column, gz: Column) -> Column:
    """Acceleration along the gravity vector; without gravity the z axis, without that 0."""
    size = magnitude(gx, gy, gz)
    return F.coalesce(F.when(size > 1e-6, (ax * gx + ay * gy + az * gz) / size), az, F.lit(0.0))


# Units --------------------------------------------------------------------------------------------------------------


def epoch_to_ns(t: Column, largest: Column, microseconds: bool = False) -> Column:
    """Epochs to nanoseconds by the column's largest value: below 1e12 seconds, below 1e15 milliseconds, else nanoseconds.

    Microseconds fall into the last branch unless asked for (then 1e15 to 1e17)."""
    scale = F.when(largest < 1e12, 1e9).when(largest < 1e15, 1e6)
    scale = scale.when(largest < 1e17, 1e3) if microseconds else scale
    return (t * scale.otherwise(1.0)).cast("long")


def pressure_to_mbar(p: Column, median: Column) -> Column:
    return F.when(median > 2000, p / 100).otherwise(p)


def angle_to_radians(a: Column, largest: Column) -> Column:
    return F.when(largest > 3.6, F.radians(a)).otherwise(a)


def speed_kmh(v: Column) -> Column:
    return F.when(v > 0, v * 3.6).otherwise(0.0)


# Labels -------------------------------------------------------------------------------------------------------------

# Names of the first ten ordinals.
ORDINALS = ["First", "Second", "Third", "Fourth", "Fifth", "Sixth", "Seventh", "Eighth", "Ninth", "Tenth"]


def ordinal_label(n: Column) -> Column:
    """First run to Tenth run, then 11th run, 21st run, 22nd run and so on, of a number from 1."""
    last = F.pmod(n, F.lit(10))
    teen = F.pmod(n, F.lit(100)).between(11, 13)
    ending = F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.when(n.between(1, 10), F.concat(F.element_at(F.array(*map(F.lit, ORDINALS)), clamp(n, 1, 10).cast("int")), F.lit(" run"))).otherwise(F.concat(n.cast("string"), ending, F.lit(" run")))


def safe_stem(name: Column, most: int = 64) -> Column:
    """Runs of signs become one _; letters and digits of any script stay."""
    return F.substring(F.regexp_replace(name, r"[^\p{L}\p{N}\p{M}_\-.]+", "_"), 1, most)


def duration_label(seconds: Column) -> Column:
    """m:ss.cc"""
    cents = F.round(seconds * 100).cast("long")
    part = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat(F.floor(cents / 6000).cast("string"), F.lit(":"), part(F.floor(cents / 100) % 60, 2), F.lit("."), part(cents % 100, 2))


def distance_label(metres: Column) -> Column:
    return F.when(metres >= 1000, F.format_string("%.2f km", metres / 1000)).otherwise(F.format_string("%.0f m", metres))


def bytes_label(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / 1048576.0))


def signed_label(x: Column, unit: str = "s") -> Column:
    return F.format_string(f"%+.2f {unit}", x)


def sync_label(peak: Column) -> Column:
    return F.when(peak.isNull(), "unknown").when(peak > 0.6, "good").when(peak >= 0.3, "fair").otherwise("poor")


def rgb_mix(x: Column, scale: Column, cold: tuple[int, int, int] = (0, 114, 178), warm: tuple[int, int, int] = (213, 94, 0)) -> Column:
    """A colour between two by tanh(x / scale)."""
    share = (F.tanh(x / scale) + 1) / 2
    return F.concat(F.lit("rgb("), F.concat_ws(",", *[F.round(a + (b - a) * share).cast("int").cast("string") for a, b in zip(cold, warm)]), F.lit(")"))


# Sensor files. Stems of the sensors' files, in the order in which they are tried; those of gyroscopes must begin the name.
STREAM_STEMS = [("gyroscopeuncalibrated", "gyro_uncal"), ("gyroscope", "gyro"), ("accelerometeruncalibrated", "acc_uncal"), ("totalacceleration", "total_acc"), ("gravity", "gravity"), ("accelerometer", "acc")]
NO_STREAM = ["metadata", "location", "barometer"]


def bare_stem(name: Column) -> Column:
    """Lower-case stem of a file name without the folder, the prefix z<i>_ of one of several archives, spaces, - and _."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(name), r"^.*[/\\]", ""), r"\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(stem, r"^z\d+_", ""), r"[\s\-_]", "")


def stream_prefix(name: Column) -> Column:
    """The columns' prefix of a motion file; acc where no stem is known, null for files of other kinds."""
    stem, out = bare_stem(name), F.lit("acc")
    for part, prefix in reversed(STREAM_STEMS):
        out = F.when(stem.startswith(part) if prefix == "gyro" else stem.contains(part), prefix).otherwise(out)
    other = (stem == NO_STREAM[0]) | stem.startswith(NO_STREAM[1]) | stem.contains(NO_STREAM[2])
    return F.when(~other, out)


def is_motion_sensor(name: Column) -> Column:
    stem = bare_stem(name)
    return F.greatest(*[stem.contains(s) for s, _ in STREAM_STEMS], stem.contains("orientation"))


# Views --------------------------------------------------------------------------------------------------------------


def percentile_pair(low: Column, high: Column) -> tuple[Column, Column]:
    """Whole percentiles within 0 to 98 and 2 to 100, at least two apart; 2 and 98 where there are none."""
    lo = clamp(F.round(F.coalesce(low, F.lit(2.0))), 0.0, 98.0)
    hi = clamp(F.round(F.coalesce(high, F.lit(98.0))), 2.0, 100.0)
    up = F.when(hi - lo < 2, F.least(F.lit(100.0), lo + 2)).otherwise(hi)
    return F.when(up - lo < 2, F.greatest(F.lit(0.0), up - 2)).otherwise(lo), up


def section_around(centre: Column, total: Column, width: float = 0.2) -> tuple[Column, Column]:
    """A section of a width around a place, kept inside the total; all of a shorter total."""
    start = F.greatest(F.lit(0.0), F.least(centre - width / 2, total - width))
    return F.when(total <= width, 0.0).otherwise(start), F.when(total <= width, F.greatest(total, F.lit(0.05))).otherwise(start + width)


def default_section(total: Column) -> tuple[Column, Column]:
    """1 to 1.2 of at least 1.25, else the stretch from 35 to 55 %, of 0.05 at least."""
    start = F.greatest(F.lit(0.0), total * 0.35)
    return F.when(total >= 1.25, 1.0).otherwise(start), F.when(total >= 1.25, 1.2).otherwise(F.greatest(start + 0.05, total * 0.55))


def smooth_or_raw(smooth: Column, raw: Column, least: float = 0.0) -> Column:
    """The smooth value where it is finite and more than `least` in size, else the raw one, else 0."""
    good = smooth.isNotNull() & ~F.isnan(smooth) & (F.abs(smooth) != float("inf")) & (F.abs(smooth) > least)
    return F.coalesce(F.when(good, smooth), raw, F.lit(0.0))
