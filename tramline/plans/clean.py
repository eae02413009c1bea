"""From feed tables to the canonical network, step by step with counts before and after."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import haversine_m, in_box
from tramline.functions.scalar import clock_seconds, lenient_double, lenient_long
from tramline.operators.joins import not_in
from tramline.operators.windows import dense_index, fills, islands, neighbours, signature, top_rows
from tramline.plans.scratch import written
from tramline.plans.validate import DAYS, DEFAULT_KMH, SPEED_KMH

#: Modes by route type. Fixed values.
MODES = {
    0: "tram", 1: "metro", 2: "rail", 3: "bus", 4: "ferry", 5: "cable_tram", 6: "aerial_lift", 7: "funicular", 11: "trolleybus", 12: "monorail",
}


def mode_of(route_type):
    out = F.lit("other")
    for kind, mode in MODES.items():
        out = F.when(route_type == kind, mode).otherwise(out)
    return out


def active_services(tables: dict[str, DataFrame], day: date) -> DataFrame:
    """service_id: running by weekday and range, with added and without removed dates."""
    text = day.strftime("%Y%m%d")
    out = None
    if "calendar" in tables:
        own = tables["calendar"].where((F.col(DAYS[day.weekday()]) == "1") & (F.col("start_date") <= text) & (F.col("end_date") >= text))
        out = own.select("service_id")
    if "calendar_dates" in tables:
        on = tables["calendar_dates"].where(F.col("date") == text)
        added = on.where("exception_type = '1'").select("service_id")
        out = (added if out is None else out.union(added)).join(on.where("exception_type = '2'").select("service_id"), "service_id", "left_anti")
    return out.distinct()


@dataclass
class Step:
    name: str
    before: int
    after: int


@dataclass
class Network:
    trips: DataFrame
    times: DataFrame
    dropped: DataFrame
    steps: list[Step] = field(default_factory=list)


def interpolate(times: DataFrame, stops: DataFrame) -> DataFrame:
    """Missing times by distance between the timed stops around, floored to seconds and marked estimated."""
    placed = times.join(stops.select("stop_id", "lat", "lon"), "stop_id")
    placed = neighbours(placed, ["trip_id"], ["q"], ["lat", "lon"])
    hop = F.coalesce(haversine_m("prev_lat", "prev_lon", "lat", "lon"), F.lit(0.0))
    w = Window.partitionBy("trip_id").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumn("hop", hop).withColumn("km", F.sum("hop").over(w))
    run = run.withColumns({"t0": F.when(F.col("d").isNotNull(), F.struct("d", "km")), "t1": F.when(F.col("a").isNotNull(), F.struct("a", "km"))})
    run = fills(fills(run, ["trip_id"], ["q"], "t0"), ["trip_id"], ["q"], "t1")
    share = F.coalesce(F.try_divide(F.col("km") - F.col("last_t0.km"), F.col("next_t1.km") - F.col("last_t0.km")), F.lit(0.0))
    guess = F.floor(F.col("last_t0.d") + share * (F.col("next_t1.a") - F.col("last_t0.d"))).cast("long")
    missing = F.col("a").isNull() & F.col("d").isNull()
    return run.select(
        *[c for c in times.columns if c not in ("a", "d")], "lat", "lon",
        F.when(missing, guess).otherwise(F.coalesce("a", "d")).alias("a"), F.when(missing, guess).otherwise(F.coalesce("d", "a")).alias("d"),
        F.when(missing, "estimated").otherwise("observed").alias("time_nature"),
    )


def too_fast(times: DataFrame, kinds: DataFrame) -> DataFrame:
    """The fastest hop of each trip that is faster than its route type allows, rounded to one decimal before the test."""
    hops = neighbours(times, ["trip_id"], ["q"], ["lat", "lon", "d", "stop_id"])
    hops = hops.where("prev_d is not null").join(kinds, "trip_id")
    limit = F.lit(DEFAULT_KMH)
    for kind, kmh in SPEED_KMH.items():
        limit = F.when(F.col("kind") == kind, kmh).otherwise(limit)
    speed = F.round(F.try_divide(haversine_m("prev_lat", "prev_lon", "lat", "lon"), F.col("a") - F.col("prev_d")) * 3.6, 1)
    bad = hops.withColumns({"kmh": speed, "limit": limit}).where("a > prev_d and kmh > limit")
    worst = top_rows(bad, ["trip_id"], [F.desc("kmh"), "q"])
    return worst.select("trip_id", "kmh", "limit", F.col("prev_stop_id").alias("from_stop_id"), F.col("stop_id").alias("to_stop_id"))


def clean(tables: dict[str, DataFrame], day: date, excluded: str | None, box: tuple[float, float, float, float]) -> Network:
    """The cleaning steps in their order: service day, excluded routes, untimed trips, interpolation, speeds, repeats, single stops, study area."""
    if "frequencies" in tables and not tables["frequencies"].isEmpty():
        raise ValueError("feeds with frequencies aren't supported")
    steps: list[Step] = []
    gone = []

    def drop(trips: DataFrame, bad: DataFrame, reason: str) -> DataFrame:
        # Written, so that the plans of later steps don't hold those of all before.
        kept = written(not_in(trips, bad, "trip_id"), "trips")
        lost = trips.join(kept, "trip_id", "left_anti").select("trip_id", F.lit(reason).alias("reason"))
        gone.append(written(lost, "dropped"))
        steps.append(Step(reason, trips.count(), kept.count()))
        return kept

    routes = tables["routes"].withColumn("kind", lenient_long("route_type"))
    trips = written(tables["trips"].join(active_services(tables, day), "service_id", "left_semi"), "trips")
    steps.append(Step("service day", tables["trips"].count(), trips.count()))
    if excluded:
        named = routes.where(F.coalesce(F.col("route_short_name"), F.lit("")).rlike(excluded) | F.coalesce(F.col("route_long_name"), F.lit("")).rlike(excluded))
        trips = drop(trips, trips.join(named, "route_id", "left_semi"), "excluded route")
    stops = tables["stops"].select("stop_id", lenient_double("stop_lat").alias("lat"), lenient_double("stop_lon").alias("lon"))
    times = tables["stop_times"].select(
        "trip_id", "stop_id", lenient_long("stop_sequence").alias("q"), clock_seconds("arrival_time").alias("a"), clock_seconds("departure_time").alias("d")
    )
    timed = times.groupBy("trip_id").agg(F.min_by(F.coalesce("d", "a"), "q").alias("x"), F.max_by(F.coalesce("a", "d"), "q").alias("y"))
    trips = drop(trips, trips.join(timed.where("x is not null and y is not null"), "trip_id", "left_anti"), "no stop times or untimed ends")
    times = written(interpolate(times.join(trips.select("trip_id"), "trip_id", "left_semi"), stops), "times")
    kinds = trips.join(routes.select("route_id", "kind"), "route_id").select("trip_id", "kind")
    trips = drop(trips, too_fast(times, kinds), "implausible speed")
    same = trips.join(signature(times, ["trip_id"], "q", ["stop_id", "a", "d"]), "trip_id")
    again = Window.partitionBy("route_id", "service_id", "signature").orderBy("trip_id")
    trips = drop(trips, same.withColumn("k", F.row_number().over(again)).where("k > 1"), "exact duplicate")
    trips = drop(trips, times.groupBy("trip_id").count().where("count < 2"), "single stop")
    times = times.join(trips.select("trip_id"), "trip_id", "left_semi")
    inside = written(islands(times, ["trip_id"], ["q"], in_box("lat", "lon", box)), "times")
    before = trips.count()
    pieces = inside.select("trip_id", "piece").distinct()
    trips = trips.join(pieces, "trip_id")
    steps.append(Step("study area", before, trips.count()))
    dropped = reduce(lambda a, b: a.unionByName(b), gone)
    return Network(trips, inside, dropped, steps)


def index_network(network: Network) -> tuple[DataFrame, DataFrame]:
    """Trips and times with dense indices; patterns are ordered by their stops as text."""
    keyed = network.times.withColumn("_k", F.concat_ws("#", "trip_id", "piece"))
    stops = dense_index(keyed.select("stop_id").distinct(), ["stop_id"], "stop_idx")
    placed = keyed.join(stops, "stop_id")
    patterns = signature(placed, ["_k"], "q", ["stop_idx"], "pattern")
    listed = dense_index(patterns.select("pattern").distinct(), ["pattern"], "pattern_idx")
    trips = network.trips.withColumn("_k", F.concat_ws("#", "trip_id", "piece")).join(patterns, "_k").join(listed, "pattern")
    trips = dense_index(trips, ["pattern_idx", "trip_id", "piece"], "trip_idx")
    w = Window.partitionBy("trip_idx").orderBy("q")
    times = placed.join(trips.select("_k", "trip_idx"), "_k").withColumn("position", (F.row_number().over(w) - 1).cast("int"))
    return trips, times.select("trip_idx", "position", "stop_idx", F.col("a").alias("arrival"), F.col("d").alias("departure"), "time_nature")
