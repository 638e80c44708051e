"""Joins that ordered and spatial data need, as plans of shuffles and windows.

As-of and interpolation joins put both sides into one table, dealt by key, and look back and ahead with window functions:
one shuffle, a sort for each direction, no product of the sides. Spatial joins meet in grid cells of the radius.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.sources.shared import written

LEFT, RIGHT = 1, 0


def _union(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str]) -> DataFrame:
    """Rows of both sides: by, on, _side, _left (struct of the left's columns), _right (struct of on and values)."""
    a = left.select(*by, F.col(on), F.lit(LEFT).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).alias("_right"))
    b = right.select(*by, F.col(on), F.lit(RIGHT).alias("_side"), F.lit(None).alias("_left"), F.struct(F.col(on).alias("_on"), *values).alias("_right"))
    a = a.withColumn("_right", F.lit(None).cast(b.schema["_right"].dataType))
    b = b.withColumn("_left", F.lit(None).cast(a.schema["_left"].dataType))
    return a.unionByName(b)


def _around(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], ties: list[str]) -> DataFrame:
    """Left rows with _before (the last right row at or before them) and _after (the first at or after them)."""
    both = _union(left, right.where(F.col(on).isNotNull()), by, on, values)
    tie = [F.col(f"_right.{t}") for t in ties]
    back = Window.partitionBy(*by).orderBy(on, "_side", *tie).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.desc(on), "_side", *[t.desc() for t in tie]).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_before", F.last("_right", ignorenulls=True).over(back)).withColumn("_after", F.last("_right", ignorenulls=True).over(ahead))
    return both.where(F.col("_side") == LEFT).select("_left.*", "_before", "_after")


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], tolerance: int | float | None = None, direction: str = "nearest", ties: list[str] | None = None, suffix: str = "") -> DataFrame:
    """Every left row with the values of the right row that is nearest in `on`, within the tolerance (its bound counts).

    Equally near: the one before. Of right rows with one time the last by `ties` (default: the values) is taken from before, the first from ahead."""
    rows = _around(left, right, by, on, values, ties or values)
    back, ahead = F.col(on) - F.col("_before._on"), F.col("_after._on") - F.col(on)
    if direction == "backward":
        best = F.col("_before")
    elif direction == "forward":
        best = F.col("_after")
    else:
        best = F.when(F.col("_after").isNull() | (back <= ahead), F.col("_before")).otherwise(F.col("_after"))
        best = F.when(F.col("_before").isNull(), F.col("_after")).otherwise(best)
    rows = rows.withColumn("_best", best)
    hit = F.lit(True) if tolerance is None else F.abs(F.col("_best._on") - F.col(on)) <= tolerance
    own = [c for c in left.columns if c not in values or suffix]
    return rows.select(*own, *[F.when(hit, F.col(f"_best.{v}")).alias(v + suffix) for v in values])


def asof_clock(rows: DataFrame, by: list[str], on: str, values: list[str], step: int, tolerance: int | None = None, ties: list[str] | None = None) -> DataFrame:
    """asof of generators.clock over each run's own rows: the ticks of `step` from a run's first row to the first at or after its last, with the values of the nearest row.

    The ticks between a row and the next one have these two around them, so they come out of the row once it is sorted, and no
    tick is dealt or sorted. Rows come out dealt by `by`."""
    w = Window.partitionBy(*by).orderBy(on, *(ties or values))
    taken = rows.where(F.col(on).isNotNull()).select(*by, on, *values)
    start, after = F.first(on).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lead(F.struct(F.col(on).alias("_on"), *values)).over(w)
    around = taken.select("*", start.alias("_start"), after.alias("_after"))
    index = lambda at: F.expr(f"({at} - _start + {step - 1}) div {step}")  # noqa: E731  of the first tick at or after
    # The last row has the one tick at or after it.
    own = F.when(F.col("_after").isNull(), F.array(index(on))).when(index("_after._on") > index(on), F.sequence(index(on), index("_after._on") - 1))
    ticks = around.select("*", F.explode(own).alias("_tick")).select(*by, (F.col("_start") + F.col("_tick") * step).alias("_at"), F.struct(F.col(on).alias("_on"), *values).alias("_before"), "_after")
    back, ahead = F.col("_at") - F.col("_before._on"), F.col("_after._on") - F.col("_at")
    best = F.when(F.col("_after").isNull() | (back <= ahead), F.col("_before")).otherwise(F.col("_after"))
    near = ticks.select(*by, F.col("_at").alias(on), best.alias("_best"))
    hit = F.lit(True) if tolerance is None else F.abs(F.col("_best._on") - F.col(on)) <= tolerance
    return near.select(*by, on, *[F.when(hit, F.col(f"_best.{v}")).alias(v) for v in values])


@dataclass
class Stream:
    """Rows that on_grid takes values from: those of `rows` where `where` holds, under the names of `values`.

    tolerance: the nearest row's values, within it (its bound counts; None: however far); interpolated: values on the line
    between the rows around, constant beyond the ends. Of rows with one time, `ties` takes the greatest ("last") or least ("first")
    by the values, or of those before the greatest and of those ahead the least ("near")."""

    rows: DataFrame
    values: dict[str, Column]
    tolerance: int | float | None = None
    interpolated: bool = False
    where: Column | None = None
    ties: str = "near"


def on_grid(grid: DataFrame, streams: list[Stream], by: list[str], on: str) -> DataFrame:
    """Every row of the grid with the values of all streams, in one pass: grid and streams are one table, dealt by key once
    and sorted once each way; a window keeps the last known row of each stream.

    Streams of one table with conditions, which must exclude each other, are read at once. The grid's rows come out sorted by `on` within their key."""
    own = [c for c in grid.columns if c not in (*by, on)]
    names = [f"_s{k}" for k in range(len(streams))]
    kinds = [s.rows.select(F.struct(F.col(on).alias("_on"), *[v.alias(n) for n, v in s.values.items()]).alias("s")).schema["s"].dataType for s in streams]
    held = F.struct(*own) if own else F.lit(None).cast("struct<_none:int>")
    none = {n: F.lit(None).cast(k) for n, k in zip(names, kinds)}
    rows = grid.select(*by, on, F.lit(LEFT).alias("_side"), held.alias("_grid"), *[v.alias(n) for n, v in none.items()])
    kind = rows.schema["_grid"].dataType
    tables: list[tuple[DataFrame, list[int]]] = []
    for k, s in enumerate(streams):
        same = next((members for t, members in tables if t is s.rows and s.where is not None and streams[members[0]].where is not None), None)
        if same is None:
            tables.append((s.rows, [k]))
        else:
            same.append(k)
    for table, members in tables:
        taken = {}
        for k in members:
            value = F.struct(F.col(on).alias("_on"), *[v.alias(n) for n, v in streams[k].values.items()])
            taken[names[k]] = value if streams[k].where is None else F.when(streams[k].where, value)
        part = table.where(F.col(on).isNotNull()).select(*by, on, F.lit(RIGHT).alias("_side"), F.lit(None).cast(kind).alias("_grid"), *[taken.get(n, none[n]).alias(n) for n in names])
        rows = rows.union(part)
    way = lambda stream, name, ahead: F.col(name).asc() if stream.ties == "last" or stream.ties == "near" and not ahead else F.col(name).desc()
    known = lambda ahead: Window.partitionBy(*by).orderBy(F.desc(on) if ahead else F.asc(on), "_side", *[way(s, n, ahead) for s, n in zip(streams, names)]).rowsBetween(Window.unboundedPreceding, 0)
    for c, ahead in (("_a", True), ("_b", False)):  # back last, so that rows stay in that order
        window = known(ahead)
        rows = rows.select("*", *[F.last(n, ignorenulls=True).over(window).alias(f"{c}{k}") for k, n in enumerate(names)])
    out = []
    for k, s in enumerate(streams):
        before, after = F.col(f"_b{k}._on"), F.col(f"_a{k}._on")
        share = (F.col(on) - before).cast("double") / F.nullif((after - before).cast("double"), F.lit(0.0))
        behind = before.isNotNull() & (after.isNull() | (F.col(on) - before <= after - F.col(on)))
        best = F.when(behind, before).otherwise(after)
        hit = F.lit(True) if s.tolerance is None else F.abs(best - F.col(on)) <= s.tolerance
        for n in s.values:
            x, y = F.col(f"_b{k}.{n}"), F.col(f"_a{k}.{n}")
            value = F.when(before.isNull(), y).when(after.isNull() | share.isNull(), x).otherwise(x + (y - x) * share) if s.interpolated else F.when(hit, F.when(behind, x).otherwise(y))
            out.append(value.alias(n))
    return rows.where(F.col("_side") == LEFT).select(*by, on, *[F.col(f"_grid.{c}").alias(c) for c in own], *out)


def asof_attach(left: DataFrame, streams: list[DataFrame], by: list[str], on: str, tolerance: int) -> DataFrame:
    """Nearest rows of several streams, in one pass; where a column comes again, the later stream's value wins if there is one."""
    values = [[c for c in right.columns if c not in (*by, on)] for right in streams]
    got = on_grid(left, [Stream(right, {f"_{k}_{v}": F.col(v) for v in own}, tolerance) for k, (right, own) in enumerate(zip(streams, values))], by, on)
    latest = lambda c: F.coalesce(*[F.col(f"_{k}_{c}") for k in reversed(range(len(streams))) if c in values[k]], *([F.col(c)] if c in left.columns else []))
    return got.select(*[latest(c).alias(c) if any(c in own for own in values) else F.col(c) for c in dict.fromkeys([*left.columns, *[c for own in values for c in own]])])


def interpolate(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str]) -> DataFrame:
    """Every left row with the right's values on the line between the rows around it; constant beyond its ends. Of right rows with one `on` the first by the values counts."""
    first = Window.partitionBy(*by, on).orderBy(*values)
    right = right.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    rows = _around(left, right, by, on, values, values)
    x0, x1 = F.col("_before._on").cast("double"), F.col("_after._on").cast("double")
    share = (F.col(on) - F.col("_before._on")).cast("double") / F.nullif((F.col("_after._on") - F.col("_before._on")).cast("double"), F.lit(0.0))
    line = lambda v: F.when(x0.isNull(), F.col(f"_after.{v}")).when(x1.isNull() | share.isNull(), F.col(f"_before.{v}")).otherwise(F.col(f"_before.{v}") + (F.col(f"_after.{v}") - F.col(f"_before.{v}")) * share)
    return rows.select(*[c for c in left.columns if c not in values], *[line(v).alias(v) for v in values])


def outer_coalesce(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer join of frames on equal keys; where several have a column, the first with a value wins."""
    out = frames[0]
    for k, right in enumerate(frames[1:]):
        named = right.select(*[F.col(c).alias(f"_{k}_{c}") for c in right.columns])
        both = out.join(named, [F.col(c) == F.col(f"_{k}_{c}") for c in on], "full_outer")
        pick = lambda c: F.coalesce(c, f"_{k}_{c}") if c in out.columns and c in right.columns else F.col(c) if c in out.columns else F.col(f"_{k}_{c}")  # noqa: B023, E731
        out = both.select(*[pick(c).alias(c) for c in dict.fromkeys([*out.columns, *right.columns])])
    return out


def nearest_in_cells(a: DataFrame, b: DataFrame, radius: float, by: list[str], key_a: str, key_b: str, x: str = "x", y: str = "y") -> DataFrame:
    """For each row of a the nearest row of b within the radius (of equally near ones the least key_b): by, key_a, key_b, distance.

    Rows of b go to their grid cell, rows of a to the nine around theirs; only neighbours meet."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    near = F.array(*[F.struct((cell(x) + i).alias("i"), (cell(y) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = a.select(*by, key_a, F.col(x).alias("_ax"), F.col(y).alias("_ay"), F.explode(near).alias("_c")).select("*", F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j")).drop("_c")
    right = b.select(*by, key_b, F.col(x).alias("_bx"), F.col(y).alias("_by"), cell(x).alias("_i"), cell(y).alias("_j"))
    d = F.sqrt(F.pow(F.col("_ax") - F.col("_bx"), F.lit(2.0)) + F.pow(F.col("_ay") - F.col("_by"), F.lit(2.0)))
    pairs = left.join(right, [*by, "_i", "_j"]).withColumn("distance", d).where(F.col("distance") <= radius)
    best = pairs.groupBy(*by, key_a).agg(F.min(F.struct("distance", key_b)).alias("_best"))
    return best.select(*by, key_a, f"_best.{key_b}", "_best.distance")


def _bounded(rows: DataFrame, points: DataFrame, by: list[str], key: str, leaf: float) -> DataFrame:
    """rows (by, key, _ax, _ay) with _bound, the distance of one of the points (by, _bx, _by) that is near by the order of a curve: cells whose bits are interleaved. Without a point a row is left out."""
    kind, none = rows.schema[key].dataType, F.lit(None).cast("double")
    both = rows.select(*by, key, "_ax", "_ay", none.alias("_px"), none.alias("_py"))
    both = both.unionByName(points.select(*by, F.lit(None).cast(kind).alias(key), none.alias("_ax"), none.alias("_ay"), F.col("_bx").alias("_px"), F.col("_by").alias("_py")))
    # Bits beyond the 20th don't matter, as any point is a bound.
    both = both.withColumns({f"_z{c}": F.floor(F.coalesce(f"_a{c}", f"_p{c}") / (leaf / 4)).cast("long").bitwiseAND(F.lit((1 << 20) - 1)) for c in "xy"})
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        both = both.withColumns({f"_z{c}": F.col(f"_z{c}").bitwiseOR(F.shiftleft(f"_z{c}", shift)).bitwiseAND(F.lit(mask)) for c in "xy"})
    point = F.when(F.col("_ax").isNull(), F.struct(F.col("_px").alias("x"), F.col("_py").alias("y")))
    both = both.select(*by, key, "_ax", "_ay", F.col("_zx").bitwiseOR(F.shiftleft("_zy", 1)).alias("_z"), point.alias("_p"))
    beside = lambda order: F.last("_p", ignorenulls=True).over(Window.partitionBy(*by).orderBy(order, F.asc_nulls_first("_ax")).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_before", beside(F.asc("_z"))).withColumn("_after", beside(F.desc("_z"))).where(F.col("_ax").isNotNull())
    d = lambda p: F.sqrt((F.col("_ax") - F.col(f"{p}.x")) * (F.col("_ax") - F.col(f"{p}.x")) + (F.col("_ay") - F.col(f"{p}.y")) * (F.col("_ay") - F.col(f"{p}.y")))
    return both.select(*by, key, "_ax", "_ay", F.least(d("_before"), d("_after")).alias("_bound")).where(F.col("_bound").isNotNull())


def nearest_of_all(a: DataFrame, b: DataFrame, by: list[str], key_a: str, key_b: str, leaf: float, x: str = "x", y: str = "y") -> DataFrame:
    """For each row of a the nearest row of b, however far (of equally near ones the least key_b): by, key_a, key_b, distance. Rows without a place, or without any b, are left out.

    Rows of b stand in cells of `leaf`, these in cells eight times as wide, and so on up to a few that hold all; each cell knows
    the box of its rows. Rows of a go down that tree together: a level's cells whose nearest point is farther than some other's farthest
    one are dropped, the rest are followed, and the rows of the last cells are compared. The rows of b next to a row on a curve
    through the plane bound its distance from the start, so that most cells are dropped where they meet. key_a must tell rows of a key apart."""
    there = b.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cell = lambda c: F.floor(F.col(c) / leaf).cast("long")
    points = there.select(*by, F.col(key_b), F.col(x).alias("_bx"), F.col(y).alias("_by"), cell(x).alias("_i"), cell(y).alias("_j"))
    least, most = lambda c: F.min(c).alias(c), lambda c: F.max(c).alias(c)
    boxes = [written(points.groupBy(*by, "_i", "_j").agg(F.min("_bx").alias("_x0"), F.max("_bx").alias("_x1"), F.min("_by").alias("_y0"), F.max("_by").alias("_y1")), "boxes")]
    spread = boxes[0].agg(F.greatest(F.max("_i") - F.min("_i"), F.max("_j") - F.min("_j"))).first()[0] or 0
    while spread > 1:
        up = [F.floor(F.col(c) / 8).cast("long").alias(c) for c in ("_i", "_j")]
        boxes.append(boxes[-1].groupBy(*by, *up).agg(least("_x0"), most("_x1"), least("_y0"), most("_y1")))
        spread = -(-spread // 8)
    of = {c: f"_of_{c}" for c in by}
    named = lambda t: t.withColumnsRenamed(of)
    rows = a.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, key_a, F.col(x).alias("_ax"), F.col(y).alias("_ay"))
    rows = _bounded(rows, points, by, key_a, leaf)
    size = lambda u, v: F.sqrt(u * u + v * v)
    outside = lambda c, lo, hi: F.greatest(F.col(lo) - F.col(c), F.col(c) - F.col(hi), F.lit(0.0))
    across = lambda c, lo, hi: F.greatest(F.abs(F.col(c) - F.col(lo)), F.abs(F.col(c) - F.col(hi)))
    near = size(outside("_ax", "_x0", "_x1"), outside("_ay", "_y0", "_y1"))
    far = size(across("_ax", "_x0", "_x1"), across("_ay", "_y0", "_y1"))
    same, within = [F.col(c) == F.col(f"_of_{c}") for c in by], near <= F.col("_bound") * (1 + 1e-12)
    held = rows.join(named(boxes[-1]), [*same, within])
    for level in range(len(boxes) - 1, -1, -1):
        held = held.select(*by, key_a, "_ax", "_ay", "_i", "_j", near.alias("_near"), F.least("_bound", F.min(far).over(Window.partitionBy(*by, key_a))).alias("_bound"))
        held = held.where(F.col("_near") <= F.col("_bound") * (1 + 1e-12)).select(*by, key_a, "_ax", "_ay", "_bound", F.col("_i").alias("_pi"), F.col("_j").alias("_pj"))
        below, shift = (boxes[level - 1], 8) if level else (points.select(*by, key_b, "_i", "_j", *[F.col(f"_b{c}").alias(f"_{c}{e}") for c in "xy" for e in (0, 1)]), 1)
        down = [*same, F.col("_pi") == F.floor(F.col("_i") / shift), F.col("_pj") == F.floor(F.col("_j") / shift), within]
        held = held.join(named(below), down).drop(*of.values(), "_pi", "_pj")
    held = held.withColumnsRenamed({"_x0": "_bx", "_y0": "_by"})
    d = F.sqrt(F.pow(F.col("_ax") - F.col("_bx"), F.lit(2.0)) + F.pow(F.col("_ay") - F.col("_by"), F.lit(2.0)))
    return held.groupBy(*by, key_a).agg(F.min(F.struct(d.alias("distance"), key_b)).alias("_best")).select(*by, key_a, f"_best.{key_b}", "_best.distance")


def first_or_nearest(rows: DataFrame, distance: Column, radius: float, by: list[str], order: str) -> DataFrame:
    """For each run the first row within the radius, else the nearest: by, order, inside."""
    d = rows.withColumn("_d", distance)
    best = d.groupBy(*by).agg(F.min(F.when(F.col("_d") <= radius, F.col(order))).alias("_first"), F.min(F.struct("_d", order)).alias("_near"))
    return best.select(*by, F.coalesce("_first", f"_near.{order}").alias(order), F.col("_first").isNotNull().alias("inside"))


def nearest_row(rows: DataFrame, x: str, target: Column, by: list[str], order: str) -> DataFrame:
    """For each run the row nearest to a target; the first on ties."""
    return rows.withColumn("_d", F.abs(F.col(x) - target)).groupBy(*by).agg(F.min(F.struct("_d", order, x)).alias("_b")).select(*by, f"_b.{order}", f"_b.{x}")


def in_intervals(rows: DataFrame, intervals: DataFrame, x: str, low: str, high: str, by: list[str] | None = None, slack: float = 0.0) -> DataFrame:
    """Rows with the intervals that hold x, both ends included: the columns of both, `by` once.

    Both meet in cells: an interval stands in the two or three cells that it touches, of the power of two that its length
    fits in, so long and short ones don't get into each other's way; a row asks one cell for each such power that there is."""
    levels = intervals.select(F.greatest(F.ceil(F.log2(F.greatest(F.col(high) - F.col(low) + 2 * slack, F.lit(1e-9)))), F.lit(-30)).cast("int").alias("_level"), "*")
    width = lambda e: F.pow(F.lit(2.0), e)
    cells = F.sequence(F.floor((F.col(low) - slack) / width(F.col("_level"))), F.floor((F.col(high) + slack) / width(F.col("_level"))))
    spread = levels.where(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(cells))
    there = levels.agg(F.sort_array(F.collect_set("_level")).alias("_levels"))  # one row of at most some dozens
    asked = F.transform("_levels", lambda e: F.struct(e.alias("e"), F.floor(F.col(x) / width(e)).alias("c")))
    dealt = rows.crossJoin(F.broadcast(there)).withColumn("_ask", F.explode(asked)).drop("_levels")
    by = by or []
    spread = spread.withColumnsRenamed({c: f"_of_{c}" for c in by})
    held = F.col(x).between(F.col(low) - slack, F.col(high) + slack)
    cond = [F.col("_ask.e") == F.col("_level"), F.col("_ask.c") == F.col("_cell"), held, *[F.col(c) == F.col(f"_of_{c}") for c in by]]
    return dealt.join(spread, cond).drop("_cell", "_ask", "_level", *[f"_of_{c}" for c in by])


def same_sets(members: DataFrame, owner: str, value: str, wanted: list) -> DataFrame:
    """Owners whose set of distinct values is exactly the wanted one."""
    wanted = list(dict.fromkeys(wanted))
    sets = members.groupBy(owner).agg(F.count_distinct(value).alias("_all"), F.count_distinct(F.when(F.col(value).isin(wanted), F.col(value))).alias("_in"))
    return sets.where((F.col("_all") == len(wanted)) & (F.col("_in") == len(wanted))).select(owner)


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The table with the rows whose key it doesn't have; of new rows with one key the first by `order`."""
    w = Window.partitionBy(*keys).orderBy(*(order or [c for c in rows.columns if c not in keys] or keys))
    new = rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return table.unionByName(new.join(table.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def first_near(a: DataFrame, b: DataFrame, radius: float, by: list[str], key_a: str, key_b: str) -> DataFrame:
    """For each run the first row of a that has any row of b within the radius, with the nearest one."""
    found = nearest_in_cells(a, b, radius, by, key_a, key_b)
    return found.groupBy(*by).agg(F.min(F.struct(key_a, key_b, "distance")).alias("_m")).select(*by, f"_m.{key_a}", f"_m.{key_b}", "_m.distance")


def active_interval(rows: DataFrame, intervals: DataFrame, x: str, low: str, high: str, row_key: str, order: str, slack: float = 0.5) -> DataFrame:
    """For each row the first interval, by `order`, that holds x within the slack."""
    hits = in_intervals(rows, intervals, x, low, high, slack=slack)
    w = Window.partitionBy(row_key).orderBy(order)
    return hits.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
