"""What-if changes of a network, and the comparison of two networks."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import haversine_m
from tramline.operators.windows import dense_index

WHOLE = 1e-9
DIRECTION = 1e-12


@dataclass(frozen=True)
class RemoveRoute:
    route_idx: int


@dataclass(frozen=True)
class ModifyHeadway:
    """Either a factor on the headway, or seconds between departures."""

    route_idx: int
    factor: float | None = None
    headway_s: int | None = None


@dataclass(frozen=True)
class AddRoute:
    route_idx: int
    stops: tuple[int, ...]
    first: int
    last: int
    headway_s: int
    speed_ms: float
    detour: float = 1.15
    dwell_s: int = 20
    both_ways: bool = True


@dataclass(frozen=True)
class Scenario:
    id: str
    mutations: tuple = field(default_factory=tuple)


KINDS = {"remove_route": RemoveRoute, "modify_headway": ModifyHeadway, "add_route": AddRoute}


def load_scenario(path: str) -> Scenario:
    """From JSON (version 1). All problems are collected before an error is raised."""
    raw = json.loads(Path(path).read_text())
    problems = [] if raw.get("version") == 1 else [f"version {raw.get('version')} isn't 1"]
    if raw.get("id") != Path(path).stem:
        problems.append(f"id {raw.get('id')} isn't the file's name")
    out = []
    for k, m in enumerate(raw.get("mutations", [])):
        kind = KINDS.get(m.get("type"))
        if kind is None:
            problems.append(f"mutation {k}: unknown type {m.get('type')}")
            continue
        try:
            out.append(kind(**{n: tuple(v) if isinstance(v, list) else v for n, v in m.items() if n != "type"}))
        except TypeError as e:
            problems.append(f"mutation {k}: {e}")
    if problems:
        raise ValueError("; ".join(problems))
    return Scenario(raw["id"], tuple(out))


def thinned(departures: np.ndarray, factor: float) -> np.ndarray:
    """Departures at the positions k * factor of the given ones: whole positions keep theirs, equal ones too; others lie between, rounded half up."""
    places = np.arange(0, len(departures) - 1 + WHOLE, factor)
    near = np.round(places)
    whole = np.abs(places - near) <= WHOLE
    between = np.floor(np.interp(places, np.arange(len(departures)), departures) + 0.5)
    kept = departures[np.unique(near[whole].astype(int))]
    return np.sort(np.concatenate([kept, np.unique(between[~whole])]).astype(np.int64))


def new_departures(departures: np.ndarray, change: ModifyHeadway) -> np.ndarray:
    own = np.sort(departures)
    if change.factor is not None:
        return thinned(own, change.factor)
    return np.arange(own[0], own[-1] + 1, change.headway_s, dtype=np.int64)


def modify_headway(trips: DataFrame, stop_times: DataFrame, change: ModifyHeadway) -> tuple[DataFrame, DataFrame]:
    """trips and stop_times with the route's departures changed, pattern by pattern.

    A new departure copies the trip nearest in time (ties to the earlier) with all
    times shifted; a departure that exists keeps its trip. Copies get the suffix
    @HH:MM:SS on their trip name and the nature `assumed`.
    """
    first = stop_times.where("position = 0").select("trip_idx", F.col("departure").alias("first"))
    own = trips.where(F.col("route_idx") == change.route_idx).join(first, "trip_idx")

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["first", "trip_idx"])
        times, ids = group["first"].to_numpy(), group["trip_idx"].to_numpy()
        made = new_departures(times, change)
        after = np.searchsorted(times, made, side="left")
        before = np.maximum(after - 1, 0)
        after = np.minimum(after, len(times) - 1)
        earlier = (made - times[before] <= times[after] - made) & (times[after] != made)
        pick = np.where(earlier, before, after)
        # Equal departures each keep a trip of their own.
        again = np.arange(len(made)) - np.searchsorted(made, made, side="left")
        own = times[np.minimum(pick + again, len(times) - 1)] == made
        pick = np.where(own, np.minimum(pick + again, len(times) - 1), pick)
        return pd.DataFrame({"trip_idx": ids[pick], "shift": made - times[pick]})

    planned = own.select("pattern_idx", "trip_idx", "first").groupBy("pattern_idx").applyInPandas(plan, "trip_idx long, shift long")
    return _copies(trips, stop_times, planned, change.route_idx)


def _copies(trips: DataFrame, stop_times: DataFrame, planned: DataFrame, route: int) -> tuple[DataFrame, DataFrame]:
    rows = planned.join(trips, "trip_idx")
    moved = F.col("shift") != 0
    starts = stop_times.where("position = 0").select("trip_idx", F.col("departure").alias("_d"))
    rows = rows.join(starts, "trip_idx")
    at = F.col("_d") + F.col("shift")
    clock = F.format_string("@%02d:%02d:%02d", (at / 3600).cast("int"), (at / 60).cast("int") % 60, (at % 60).cast("int"))
    name = F.when(moved, F.concat(F.col("source_trip_id"), clock)).otherwise(F.col("source_trip_id"))
    changed = rows.select(*[name.alias(c) if c == "source_trip_id" else F.col(c) for c in trips.columns], "shift")
    times = stop_times.join(planned, "trip_idx").join(changed.select("trip_idx", "shift", F.col("source_trip_id").alias("_name")), ["trip_idx", "shift"])
    times = times.select(
        F.col("trip_idx"), "position", "stop_idx", (F.col("arrival") + F.col("shift")).alias("arrival"),
        (F.col("departure") + F.col("shift")).alias("departure"), F.when(moved, "assumed").otherwise(F.col("time_nature")).alias("time_nature"), "_name",
    )
    rest = trips.where(~F.col("route_idx").eqNullSafe(F.lit(route)))
    all_trips = rest.withColumn("_key", F.col("source_trip_id")).unionByName(changed.drop("shift").withColumn("_key", F.col("source_trip_id")))
    kept = stop_times.join(rest.select("trip_idx", F.col("source_trip_id").alias("_name")), "trip_idx")
    all_times = kept.unionByName(times)
    return renumber(all_trips, all_times)


def renumber(trips: DataFrame, stop_times: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense trip_idx in the order of route, pattern, first departure and name; trips carry _key, times _name."""
    starts = stop_times.where("position = 0").groupBy("_name").agg(F.min("departure").alias("_first"))
    indexed = dense_index(
        trips.drop("trip_idx").join(starts, F.col("_key") == F.col("_name")).drop("_name"), ["route_idx", "pattern_idx", "_first", "_key"], "trip_idx"
    )
    names = indexed.select(F.col("_key").alias("_name"), F.col("trip_idx").alias("_new"))
    times = stop_times.drop("trip_idx").join(names, "_name").withColumnRenamed("_new", "trip_idx")
    columns = [c for c in trips.columns if c != "_key"]
    return indexed.select(*columns), times.select("trip_idx", "position", "stop_idx", "arrival", "departure", "time_nature")


def run_profile(stops: DataFrame, route: AddRoute) -> DataFrame:
    """direction, position, stop_idx, offset_s to arrival: great-circle times detour over speed, dwelling at stops between.

    Rounding is on the running total, so that errors don't add up.
    """
    ways = [(0, route.stops), *([(1, route.stops[::-1])] if route.both_ways else [])]
    rows = stops.sparkSession.createDataFrame([(w, k, s) for w, own in ways for k, s in enumerate(own)], "direction int, position int, stop_idx long")
    placed = rows.join(stops.select("stop_idx", "lat", "lon"), "stop_idx")
    w = Window.partitionBy("direction").orderBy("position")
    hop = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon") * route.detour / route.speed_ms
    placed = placed.withColumn("hop", F.coalesce(hop, F.lit(0.0)))
    ran = F.sum("hop").over(w.rowsBetween(Window.unboundedPreceding, 0))
    arrival = F.floor(ran + 0.5) + F.greatest(F.col("position") - 1, F.lit(0)) * route.dwell_s
    last = F.col("position") == len(route.stops) - 1
    dwell = F.when((F.col("position") == 0) | last, 0).otherwise(route.dwell_s)
    return placed.select("direction", "position", "stop_idx", arrival.cast("long").alias("arrival_s"), (arrival + dwell).cast("long").alias("departure_s"))


def add_route(stops: DataFrame, route: AddRoute) -> DataFrame:
    """route_idx, direction, first, position, stop_idx, arrival, departure of all trips of a new route."""
    starts = stops.sparkSession.sql(f"SELECT explode(sequence({route.first}, {route.last}, {route.headway_s})) AS first")
    rows = run_profile(stops, route).join(starts)
    return rows.select(
        F.lit(route.route_idx).alias("route_idx"), "direction", "first", "position", "stop_idx",
        (F.col("first") + F.col("arrival_s")).alias("arrival"), (F.col("first") + F.col("departure_s")).alias("departure"),
    )


def remove_route(trips: DataFrame, stop_times: DataFrame, change: RemoveRoute) -> tuple[DataFrame, DataFrame]:
    """trips and stop_times without the route's trips, numbered anew; trips without a route stay."""
    kept = trips.where(~F.col("route_idx").eqNullSafe(F.lit(change.route_idx))).withColumn("_key", F.col("source_trip_id"))
    times = stop_times.join(kept.select("trip_idx", F.col("_key").alias("_name")), "trip_idx")
    return renumber(kept, times)


def with_route(trips: DataFrame, stop_times: DataFrame, stops: DataFrame, route: AddRoute) -> tuple[DataFrame, DataFrame]:
    """trips and stop_times with those of a new route; its patterns follow the last one, its times are `assumed`, other columns null."""
    clock = F.format_string("%d-%d@%02d:%02d:%02d", "route_idx", "direction", (F.col("first") / 3600).cast("int"), (F.col("first") / 60).cast("int") % 60, F.col("first") % 60)
    calls = add_route(stops, route).withColumn("_name", clock).withColumn("time_nature", F.lit("assumed"))
    last = trips.agg(F.coalesce(F.max("pattern_idx"), F.lit(-1)).alias("_last"))
    new = calls.where("position = 0").select("route_idx", "direction", "_name").crossJoin(F.broadcast(last))  # one row
    made = {"route_idx": F.col("route_idx"), "pattern_idx": F.col("_last") + 1 + F.col("direction"), "source_trip_id": F.col("_name")}
    typed = [made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in trips.schema]
    every = trips.unionByName(new.select(*typed)).withColumn("_key", F.col("source_trip_id"))
    old = stop_times.join(trips.select("trip_idx", F.col("source_trip_id").alias("_name")), "trip_idx")
    columns = ["position", "stop_idx", "arrival", "departure", "time_nature", "_name"]
    times = old.select(*columns).unionByName(calls.select(*columns)).withColumn("trip_idx", F.lit(None).cast("long"))
    return renumber(every, times)


def apply_scenario(trips: DataFrame, stop_times: DataFrame, stops: DataFrame, scenario: Scenario) -> tuple[DataFrame, DataFrame, DataFrame]:
    """trips, stop_times after all mutations in their order, and the changes: n (from 1), type, route_idx, removed, added (trips by name)."""
    names = {kind: name for name, kind in KINDS.items()}
    changes = None
    for n, change in enumerate(scenario.mutations, 1):
        before, held = trips, trips.where(F.col("route_idx") == change.route_idx).isEmpty()
        if held != isinstance(change, AddRoute):
            raise ValueError(f"mutation {n}: route {change.route_idx} {'is unknown' if held else 'exists already'}")
        if isinstance(change, RemoveRoute):
            trips, stop_times = remove_route(trips, stop_times, change)
        elif isinstance(change, ModifyHeadway):
            trips, stop_times = modify_headway(trips, stop_times, change)
        else:
            trips, stop_times = with_route(trips, stop_times, stops, change)
        own, new = before.select("source_trip_id", F.lit(1).alias("_a")), trips.select("source_trip_id", F.lit(1).alias("_b"))
        row = own.join(new, "source_trip_id", "full").agg(F.count_if(F.col("_b").isNull()).alias("removed"), F.count_if(F.col("_a").isNull()).alias("added"))
        row = row.select(F.lit(n).alias("n"), F.lit(names[type(change)]).alias("type"), F.lit(change.route_idx).cast("long").alias("route_idx"), "removed", "added")
        changes = row if changes is None else changes.unionByName(row)
    if changes is None:
        changes = trips.sparkSession.createDataFrame([], "n int, type string, route_idx long, removed long, added long")
    return trips, stop_times, changes


def zone_deltas(a: DataFrame, b: DataFrame, measure: str) -> DataFrame:
    """zone_idx, a, b, delta over both networks' zones; a missing side counts as 0."""
    left = a.select("zone_idx", F.col(measure).cast("double").alias("a"))
    right = b.select("zone_idx", F.col(measure).cast("double").alias("b"))
    both = left.join(right, "zone_idx", "full").fillna(0.0)
    return both.withColumn("delta", F.col("b") - F.col("a"))


def route_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """route_idx, trips and boardings on both sides with their changes, largest change of boardings first."""
    left = a.select("route_idx", F.col("trips").alias("trips_a"), F.col("boardings").alias("boardings_a"))
    right = b.select("route_idx", F.col("trips").alias("trips_b"), F.col("boardings").alias("boardings_b"))
    both = left.join(right, "route_idx", "full").fillna(0)
    both = both.withColumns({"d_trips": F.col("trips_b") - F.col("trips_a"), "d_boardings": F.col("boardings_b") - F.col("boardings_a")})
    return both.orderBy(F.abs("d_boardings").desc(), "route_idx")


def direction_check(deltas: DataFrame, adds: bool, removes: bool) -> DataFrame:
    """One row: verdict and the number of zones against it. Mixed changes aren't checked."""
    wrong = F.count_if(F.col("delta") < -DIRECTION) if adds and not removes else F.count_if(F.col("delta") > DIRECTION) if removes and not adds else F.lit(0)
    verdict = F.when(F.lit(adds and removes), "not checked").when(wrong == 0, "ok").otherwise("wrong")
    return deltas.agg(verdict.alias("verdict"), wrong.cast("long").alias("against"))


def compare_matrices(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """metric, a, b, delta: connected pairs of either matrix, and mean minutes over pairs connected in both."""
    keys = ["origin_zone", "dest_zone"]
    both = a.select(*keys, F.col(column).alias("a")).join(b.select(*keys, F.col(column).alias("b")), keys, "full")
    shared = F.col("a").isNotNull() & F.col("b").isNotNull()
    sums = both.agg(
        F.count("a").cast("double").alias("pa"), F.count("b").cast("double").alias("pb"),
        F.avg(F.when(shared, F.col("a") / 60)).alias("ma"), F.avg(F.when(shared, F.col("b") / 60)).alias("mb"),
    )
    rows = F.array(
        F.struct(F.lit("pairs_connected").alias("metric"), F.col("pa").alias("a"), F.col("pb").alias("b"), (F.col("pb") - F.col("pa")).alias("delta")),
        F.struct(F.lit("mean_minutes").alias("metric"), F.col("ma").alias("a"), F.col("mb").alias("b"), (F.col("mb") - F.col("ma")).alias("delta")),
    )
    return sums.select(F.explode(rows).alias("r")).select("r.*")
