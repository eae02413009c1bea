"""Joins that equality alone doesn't express.

As-of joins are a union and a running window, so that they sort once and never
multiply rows. Distance joins meet in grid cells. Sides are broadcast by Spark's
own size threshold, not by hand.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import EARTH_M, haversine_m, local_xy


def as_of(
    calls: DataFrame, events: DataFrame, keys: list[str], call_time: str, event_time: str, payload: list[str], forward: bool = True
) -> DataFrame:
    """Each call with the first event at or after it (forward) or the last at or before it; ties to the least payload.

    Calls without such an event keep nulls.
    """
    value = F.struct(F.col(event_time).alias("_t"), *payload)
    kind = F.struct(*[f.name for f in calls.schema])
    left = calls.select(*keys, F.col(call_time).alias("_at"), F.lit(1).alias("_kind"), kind.alias("_call"))
    right = events.select(*keys, F.col(event_time).alias("_at"), F.lit(0).alias("_kind"), value.alias("_event"))
    both = left.unionByName(right, allowMissingColumns=True)
    # Within a time, events come before calls, and the least payload last, where the frame ends.
    at = F.desc("_at") if forward else F.asc("_at")
    order = Window.partitionBy(*keys).orderBy(at, F.asc("_kind"), F.desc("_event")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last("_event", ignorenulls=True).over(order)).where("_kind = 1")
    return found.select("_call.*", F.col("_hit._t").alias(event_time), *[F.col(f"_hit.{p}").alias(p) for p in payload])


def nearest_in_time(calls: DataFrame, events: DataFrame, keys: list[str], call_time: str, event_time: str, payload: list[str]) -> DataFrame:
    """Each call with the event closest in time; ties to the earlier one. Two as-of joins, not a range join."""
    earlier = as_of(calls, events.select(*keys, F.col(event_time).alias("_e"), F.struct(*payload).alias("_p")), keys, call_time, "_e", ["_p"], False)
    earlier = earlier.withColumnsRenamed({"_e": "_e0", "_p": "_p0"})
    both = as_of(earlier, events.select(*keys, F.col(event_time).alias("_e"), F.struct(*payload).alias("_p")), keys, call_time, "_e", ["_p"], True)
    first = F.col("_e0").isNotNull() & (F.col("_e").isNull() | (F.col(call_time) - F.col("_e0") <= F.col("_e") - F.col(call_time)))
    best = F.when(first, F.struct(F.col("_e0").alias("t"), F.col("_p0").alias("p"))).otherwise(F.struct(F.col("_e").alias("t"), F.col("_p").alias("p")))
    out = both.withColumn("_b", best)
    return out.select(*calls.columns, F.col("_b.t").alias(event_time), *[F.col(f"_b.p.{p}").alias(p) for p in payload])


def not_in(rows: DataFrame, others: DataFrame, column: str) -> DataFrame:
    """Rows whose value is not among the others'; rows without a value go."""
    return rows.where(F.col(column).isNotNull()).join(others.select(column).distinct(), column, "left_anti")


def full_with_zero(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on coalesced keys, missing measures 0."""
    both = left.join(right, keys, "full")
    return both.fillna(0, [c for c in both.columns if c not in keys])


def _cells(rows: DataFrame, lat: str, lon: str, degrees: float, spread: bool) -> DataFrame:
    """Rows of `degrees` of latitude, cut into whole columns at least as wide as that distance at the row's polar edge.

    With spread, every point in its cell and those around it, across the date line and at the poles too.
    """
    row = F.floor(F.col(lat) / degrees).cast("long")
    out = rows.withColumn("_r", F.explode(F.array(*[row + i for i in (-1, 0, 1)])) if spread else row)
    # The widest gap of longitude lies a little nearer the pole than the row itself.
    edge = F.least(F.lit(90.0), F.greatest(F.abs(F.col("_r") - 1), F.abs(F.col("_r") + 2)) * degrees)
    n = F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / degrees)).cast("long")
    at = F.floor((F.col(lon) + 180) / 360 * n).cast("long")
    if not spread:
        return out.withColumn("_c", F.pmod(at, n))
    return out.withColumn("_c", F.explode(F.array_distinct(F.array(*[F.pmod(at + j, n) for j in (-1, 0, 1)]))))


def within_distance(
    left: DataFrame, right: DataFrame, metres: float, left_at=("lat", "lon"), right_at=("lat_b", "lon_b"), on: list[str] | None = None,
    name: str = "metres",
) -> DataFrame:
    """Pairs within a distance, anywhere on the globe: points meet in cells at least as wide as the distance."""
    degrees = metres / (EARTH_M * math.pi / 180)
    near = _cells(left, *left_at, degrees, False).join(_cells(right, *right_at, degrees, True), [*(on or []), "_r", "_c"])
    return near.withColumn(name, haversine_m(*left_at, *right_at)).where(F.col(name) <= metres).drop("_r", "_c")


def nearest(left: DataFrame, right: DataFrame, key: str, other: str, metres: float, **at) -> DataFrame:
    """Per key the nearest row of the right side within a distance: key, other, metres; ties to the lower id."""
    pairs = within_distance(left.select(key, *at.get("left_at", ("lat", "lon"))), right, metres, **at)
    best = pairs.groupBy(key).agg(F.min(F.struct(F.col("metres"), F.col(other))).alias("b"))
    return best.select(key, F.col(f"b.{other}").alias(other), F.col("b.metres").alias("metres"))


def point_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Fraction along a segment of the point nearest to p, and the distance."""
    dx, dy = bx - ax, by - ay
    along = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    fraction = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return fraction, F.sqrt(F.pow(px - ax - fraction * dx, 2) + F.pow(py - ay - fraction * dy, 2))


def nearest_edge(points: DataFrame, edges: DataFrame, key: str, reach: float, flag_beyond: float, lat0: float) -> DataFrame:
    """Per point the nearest edge: key, edge_idx, fraction, distance_m, flagged; ties to the lower edge.

    edges: edge_idx, lat_a, lon_a, lat_b, lon_b. Points and edges meet in square
    cells of `reach` metres: an edge is put into every cell that its box, widened by
    the reach, touches. Points beyond the reach have no row.
    """
    px, py = local_xy("lat", "lon", lat0)
    ax, ay = local_xy("lat_a", "lon_a", lat0)
    bx, by = local_xy("lat_b", "lon_b", lat0)
    own = points.select(key, px.alias("px"), py.alias("py")).withColumns(
        {"_c": F.floor(F.col("px") / reach).cast("long"), "_r": F.floor(F.col("py") / reach).cast("long")}
    )
    flat = edges.select("edge_idx", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))

    def span(a: str, b: str) -> Column:
        low, high = F.least(a, b) - reach, F.greatest(a, b) + reach
        return F.sequence(F.floor(low / reach).cast("long"), F.floor(high / reach).cast("long"))

    spread = flat.withColumn("_c", F.explode(span("ax", "bx"))).withColumn("_r", F.explode(span("ay", "by")))
    fraction, distance = point_on_segment(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")))
    pairs = own.join(spread, ["_c", "_r"]).select(key, "edge_idx", fraction.alias("fraction"), distance.alias("distance_m"))
    best = pairs.where(F.col("distance_m") <= reach).groupBy(key).agg(F.min(F.struct("distance_m", "edge_idx", "fraction")).alias("b"))
    return best.select(
        key, F.col("b.edge_idx").alias("edge_idx"), F.col("b.fraction").alias("fraction"), F.col("b.distance_m").alias("distance_m"),
        (F.col("b.distance_m") > flag_beyond).alias("flagged"),
    )


def ride_access(
    points: DataFrame, platforms: DataFrame, walks: DataFrame, max_km: float, km_per_h: float, detour: float, penalty_min: float
) -> DataFrame:
    """zone_idx, stop_idx, seconds: platforms within a ride that can't be walked to."""
    near = within_distance(points, platforms, max_km * 1000)
    seconds = F.ceil(F.lit(penalty_min * 60) + F.col("metres") * detour / (km_per_h / 3.6)).cast("long")
    return near.join(walks.select("zone_idx", "stop_idx"), ["zone_idx", "stop_idx"], "left_anti").select("zone_idx", "stop_idx", seconds.alias("seconds"))


def changed_content(left: DataFrame, right: DataFrame, column: str = "signature") -> DataFrame:
    """Signatures that only one side has: side, signature."""
    a = left.select(column).distinct().join(right.select(column), column, "left_anti").withColumn("side", F.lit("a"))
    b = right.select(column).distinct().join(left.select(column), column, "left_anti").withColumn("side", F.lit("b"))
    return a.unionByName(b)


def lookup(names: DataFrame, table: DataFrame, name: str, idx: str) -> tuple[DataFrame, list[str]]:
    """The index of each name and every problem (unknown, ambiguous), in order."""
    counts = table.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min(idx).alias(idx))
    found = names.select(name).distinct().join(counts, name, "left")
    bad = found.where("n is null or n > 1").orderBy(name).limit(1000).collect()
    problems = [f"{r[name]}: {'unknown' if r['n'] is None else 'ambiguous'}" for r in bad]
    return found.where("n = 1").select(name, idx), problems
