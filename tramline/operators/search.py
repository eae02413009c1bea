"""Round-based journey search on a timetable.

`Timetable` searches all departures of an origin at once: labels are arrays over
departures and stops, and each route is scanned position by position. The search
is distributed by origin. `reach_rounds` is the same as a fixed number of joins.

Rules: round k uses k vehicles at most; a trip is boarded at the earlier of the
time a walk made ready and of the last ride plus the least transfer time, the walk
on a tie; a footpath follows a ride only and never another footpath; the entry
time of a station is paid to board from outside of it, not to arrive.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEVER = 1 << 40


@dataclass(frozen=True)
class Params:
    max_rounds: int = 4
    min_transfer: int = 60


@dataclass
class Route:
    """Trips of one stop sequence, none overtaking another."""

    stops: tuple[int, ...]
    trips: list[int]
    arrivals: np.ndarray
    departures: np.ndarray


@dataclass
class Leg:
    kind: str
    start: int
    end: int
    begin_s: int
    end_s: int
    trip: int | None = None


@dataclass
class Journey:
    departure: int
    arrival: int
    legs: list[Leg] = field(default_factory=list)

    @property
    def rides(self) -> int:
        return sum(x.kind == "ride" for x in self.legs)

    def measures(self) -> dict[str, int]:
        walked = sum(x.end_s - x.begin_s for x in self.legs if x.kind != "ride")
        ridden = sum(x.end_s - x.begin_s for x in self.legs if x.kind == "ride")
        travel = self.arrival - self.departure
        return {"travel": travel, "rides": self.rides, "transfers": max(0, self.rides - 1), "walking": walked, "riding": ridden, "waiting": travel - walked - ridden}


def fifo_routes(trips: list[tuple[int, tuple[int, ...], tuple[int, ...], tuple[int, ...]]]) -> list[Route]:
    """trips: id, stops, arrivals, departures. Trips of equal stops are sorted by times and dealt first-fit into routes without overtaking."""
    by_stops: dict[tuple[int, ...], list] = defaultdict(list)
    ids = set()
    for trip, stops, arrivals, departures in trips:
        if len(stops) < 2 or not len(stops) == len(arrivals) == len(departures):
            raise ValueError(f"trip {trip}: two stops with times at least")
        if trip in ids:
            raise ValueError(f"trip {trip} occurs twice")
        ids.add(trip)
        times = [t for pair in zip(arrivals, departures, strict=True) for t in pair][1:-1]
        if any(x > y for x, y in zip(times, times[1:], strict=False)):
            raise ValueError(f"trip {trip}: times run backwards")
        by_stops[stops].append((departures, arrivals, trip))
    routes = []
    for stops in sorted(by_stops):
        lanes: list[list] = []
        for own in sorted(by_stops[stops]):
            for lane in lanes:
                last = lane[-1]
                if all(x <= y for x, y in zip(last[0], own[0], strict=True)) and all(x <= y for x, y in zip(last[1], own[1], strict=True)):
                    lane.append(own)
                    break
            else:
                lanes.append([own])
        for lane in lanes:
            routes.append(Route(stops, [x[2] for x in lane], np.array([x[1] for x in lane], np.int64), np.array([x[0] for x in lane], np.int64)))
    return routes


class Timetable:
    def __init__(self, routes: list[Route], n_stops: int, footpaths=(), station: dict[int, int] | None = None, entry: dict[int, int] | None = None):
        """footpaths: from, to, seconds. station: stop -> station (itself where missing). entry: station -> seconds."""
        self.routes, self.n = routes, n_stops
        self.at_stop: dict[int, list[int]] = defaultdict(list)
        for k, r in enumerate(routes):
            for s in set(r.stops):
                self.at_stop[s].append(k)
        self.paths: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for a, b, t in footpaths:
            self.paths[a].append((b, t))
        self.station = station or {}
        self.entry = entry or {}

    def entry_s(self, origin: int | None, stop: int) -> int:
        own = self.station.get(stop, stop)
        inside = origin is not None and self.station.get(origin, origin) == own
        return 0 if inside else self.entry.get(own, 0)

    def search(self, access: list[tuple[int, int]], departures: list[int], params: Params = Params(), board_only: list[tuple[int, int]] = ()) -> dict:
        """Labels of every round: ride, foot and walk arrays over departures and stops, and what they came from.

        access: stop, seconds on foot. board_only: the same for rides to a station;
        usable to board where no walk reaches the stop, and no arrival there.
        """
        d = np.asarray(departures, np.int64)
        shape = (len(d), self.n)
        empty = lambda: np.full(shape, NEVER, np.int64)
        ride, foot, walk = empty(), empty(), empty()
        walked = {s for s, _ in access}
        for s, t in access:
            foot[:, s] = np.minimum(foot[:, s], d + t)
            walk[:, s] = np.minimum(walk[:, s], d + t + self.entry_s(None, s))
        for s, t in board_only:
            if s not in walked:
                walk[:, s] = np.minimum(walk[:, s], d + t + self.entry_s(None, s))
        rounds = [{"ride": ride, "foot": foot, "walk": walk}]
        marked = {s for s in range(self.n) if (walk[:, s] < NEVER).any()}
        for _ in range(params.max_rounds):
            last = rounds[-1]
            now = {k: v.copy() for k, v in last.items()}
            now["from"] = {}  # (departure, stop) -> route, trip row, boarding position
            now["path"] = {}  # (departure, stop) -> stop the footpath starts at
            touched = np.zeros(shape, bool)
            for k in sorted({r for s in marked for r in self.at_stop.get(s, ())}):
                self._scan(k, last, now, touched, params)
            ridden = np.flatnonzero(touched.any(axis=0))
            for s in ridden:
                for other, t in self.paths.get(int(s), ()):
                    arrive = np.where(touched[:, s], now["ride"][:, s] + t, NEVER)
                    ready = arrive + self.entry_s(int(s), other)
                    for q in np.flatnonzero(arrive < now["foot"][:, other]):
                        now["path"][int(q), other] = int(s)
                    now["foot"][:, other] = np.minimum(now["foot"][:, other], arrive)
                    better = ready < now["walk"][:, other]
                    now["walk"][:, other] = np.minimum(now["walk"][:, other], ready)
                    touched[:, other] |= better
            rounds.append(now)
            marked = set(np.flatnonzero(touched.any(axis=0)).tolist())
            if not marked:
                break
        return {"departures": d, "rounds": rounds, "min_transfer": params.min_transfer}

    def _scan(self, k: int, last: dict, now: dict, touched: np.ndarray, params: Params) -> None:
        route = self.routes[k]
        n = len(route.trips)
        trip = np.full(len(touched), n, np.int64)
        boarded = np.full(len(touched), -1, np.int64)
        for p, s in enumerate(route.stops):
            on = trip < n
            if p and on.any():
                arrive = np.where(on, route.arrivals[np.minimum(trip, n - 1), p], NEVER)
                better = arrive < now["ride"][:, s]
                if better.any():
                    now["ride"][better, s] = arrive[better]
                    touched[better, s] = True
                    for q in np.flatnonzero(better):
                        now["from"][int(q), s] = (k, int(trip[q]), int(boarded[q]), p)
            if p < len(route.stops) - 1:
                ready = np.minimum(last["walk"][:, s], last["ride"][:, s] + params.min_transfer)
                if (ready < NEVER).any():
                    first = np.searchsorted(route.departures[:, p], ready, side="left")
                    earlier = first < trip
                    boarded = np.where(earlier, p, boarded)
                    trip = np.minimum(trip, first)

    def arrivals(self, found: dict, k: int | None = None) -> np.ndarray:
        """Earliest arrival at each stop with k vehicles at most, by ride or on foot."""
        labels = found["rounds"][-1 if k is None else min(k, len(found["rounds"]) - 1)]
        return np.minimum(labels["ride"], labels["foot"])

    def plan(self, access, egress: list[tuple[int, int]], departure: int, params: Params = Params(), walk_s: int | None = None) -> list[Journey]:
        """Journeys none of which is later and has more vehicles than another, by vehicles. egress: stop, seconds."""
        found = self.search(access, [departure], params)
        out: list[Journey] = []
        best = NEVER
        if walk_s is not None:
            best = departure + walk_s
            out.append(Journey(departure, best, [Leg("walk", -1, -1, departure, best)]))
        for k in range(1, len(found["rounds"])):
            labels = found["rounds"][k]
            at = np.minimum(labels["ride"][0], labels["foot"][0])
            reached = [(int(at[s]) + t, s, t) for s, t in egress if at[s] < NEVER]
            if not reached:
                continue
            arrival, stop, t = min(reached)
            if arrival < best:
                best = arrival
                out.append(Journey(departure, arrival, self._legs(found, k, stop, t, access)))
        return out

    def _legs(self, found: dict, k: int, stop: int, egress_s: int, access) -> list[Leg]:
        legs: list[Leg] = []
        labels = found["rounds"][k]
        at = int(min(labels["ride"][0, stop], labels["foot"][0, stop]))
        if egress_s:
            legs.append(Leg("egress", stop, -1, at, at + egress_s))
        on_foot = labels["foot"][0, stop] < labels["ride"][0, stop]
        departure = int(found["departures"][0])
        while True:
            while k > 0 and found["rounds"][k]["foot"][0, stop] == found["rounds"][k - 1]["foot"][0, stop] and on_foot:
                k -= 1
            if on_foot and k == 0:
                break
            if on_foot:
                origin = found["rounds"][k]["path"][0, stop]
                begin = int(found["rounds"][k]["ride"][0, origin])
                legs.append(Leg("transfer", origin, stop, begin, int(found["rounds"][k]["foot"][0, stop])))
                stop = origin
            while found["rounds"][k]["ride"][0, stop] == found["rounds"][k - 1]["ride"][0, stop]:
                k -= 1
            r, trip, board, alight = found["rounds"][k]["from"][0, stop]
            route = self.routes[r]
            start = route.stops[board]
            legs.append(Leg("ride", start, stop, int(route.departures[trip, board]), int(route.arrivals[trip, alight]), route.trips[trip]))
            stop, k = start, k - 1
            before = found["rounds"][k]
            on_foot = before["walk"][0, stop] <= before["ride"][0, stop] + found["min_transfer"]
        seconds = dict(access).get(stop, 0)
        if seconds:
            legs.append(Leg("access", -1, stop, departure, departure + seconds))
        return legs[::-1]


def travel_times(
    timetable: Timetable, access: list[tuple[int, int]], departures: list[int], egress: dict[int, list[tuple[int, int]]],
    walk_only: dict[int, int], limit_s: int, percents=(25, 50, 75), params: Params = Params(),
) -> list[tuple]:
    """(zone, p...) in seconds: per departure the best of riding and walking, nearest-rank percentiles, unreached as infinite."""
    found = timetable.search(access, departures, params)
    at = timetable.arrivals(found)
    d = found["departures"]
    out = []
    for zone in sorted({*egress, *walk_only}):
        best = np.full(len(d), NEVER, np.int64)
        for s, t in egress.get(zone, ()):
            best = np.minimum(best, np.where(at[:, s] < NEVER, at[:, s] + t - d, NEVER))
        if zone in walk_only:
            best = np.minimum(best, walk_only[zone])
        ordered = np.sort(best)
        ranks = [max(1, -(-p * len(d) // 100)) - 1 for p in percents]
        values = [int(ordered[r]) for r in ranks]
        if values[0] <= limit_s:
            out.append((zone, *(v if v <= limit_s else None for v in values)))
    return out


def usable_trips(calls: DataFrame, departures: list[int], limit_s: int) -> DataFrame:
    """trip, stops, arrivals, departures: all that a search over these departures can use, trips of equal calls once (the least number).

    calls: trip_idx, position, stop_idx, arrival, departure, times not running backwards. A call left before the
    first departure can't be boarded, one reached after the last departure and the limit leads to no result.
    """
    near = calls.where((F.col("departure") >= min(departures)) & (F.col("arrival") <= max(departures) + limit_s))
    rows = near.groupBy("trip_idx").agg(F.array_sort(F.collect_list(F.struct("position", "stop_idx", "arrival", "departure"))).alias("x"))
    rows = rows.where(F.size("x") > 1).select("trip_idx", F.col("x.stop_idx").alias("stops"), F.col("x.arrival").alias("arrivals"), F.col("x.departure").alias("departures"))
    return rows.groupBy("stops", "arrivals", "departures").agg(F.min("trip_idx").alias("trip")).select("trip", "stops", "arrivals", "departures")


def matrix(
    origins: DataFrame, timetable: Timetable, departures: list[int], egress: dict, limit_s: int, percents=(25, 50, 75), params: Params = Params()
) -> DataFrame:
    """Travel-time percentiles of all origins: origin_zone, dest_zone, p<k>_s.

    origins: origin_zone, access (array of struct stop, seconds), walks (array of
    struct zone, seconds). The timetable and the egress lists of a city are broadcast;
    origins are searched in parallel, one search for all departures.
    """
    shared = origins.sparkSession.sparkContext.broadcast((timetable, egress))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, out = shared.value
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                access = [(int(x["stop"]), int(x["seconds"])) for x in r.access]
                walks = {int(x["zone"]): int(x["seconds"]) for x in r.walks} | {int(r.origin_zone): 0}
                rows += [(r.origin_zone, *x) for x in travel_times(own, access, departures, out, walks, limit_s, percents, params)]
            yield pd.DataFrame(rows, columns=["origin_zone", "dest_zone", *(f"p{p}_s" for p in percents)]).astype("Int64")

    return origins.mapInPandas(run, "origin_zone long, dest_zone long, " + ", ".join(f"p{p}_s long" for p in percents))


def reach_rounds(starts: DataFrame, calls: DataFrame, rounds: int, min_transfer: int) -> DataFrame:
    """origin, stop_idx, arrival: earliest arrivals with `rounds` vehicles at most, as joins only.

    starts: origin, stop_idx, ready. calls: route, trip, position, stop_idx, arrival,
    departure, of routes without overtaking. Boarding is an as-of join: union and a
    running window over (route, position, time).
    """
    best = starts.select("origin", "stop_idx", F.col("ready").alias("arrival"), F.lit(False).alias("rode"))
    positions = calls.select("route", "position", "stop_idx").distinct()
    for _ in range(rounds):
        ready = best.select("origin", "stop_idx", (F.col("arrival") + F.when(F.col("rode"), min_transfer).otherwise(0)).alias("at"))
        ready = ready.groupBy("origin", "stop_idx").agg(F.min("at").alias("at")).join(positions, "stop_idx")
        asks = ready.select("route", "position", "at", F.lit(1).alias("kind"), "origin", F.lit(None).cast("long").alias("trip"))
        offers = calls.select("route", "position", F.col("departure").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("origin"), F.col("trip").cast("long"))
        order = Window.partitionBy("route", "position").orderBy(F.desc("at"), "kind", F.desc("trip")).rowsBetween(Window.unboundedPreceding, 0)
        boarded = asks.unionByName(offers).withColumn("hit", F.last("trip", ignorenulls=True).over(order)).where("kind = 1 and hit is not null")
        boarded = boarded.groupBy("origin", F.col("hit").alias("trip")).agg(F.min("position").alias("boarded"))
        rides = boarded.join(calls.select("trip", "position", "stop_idx", "arrival"), "trip").where("position > boarded")
        rides = rides.groupBy("origin", "stop_idx").agg(F.min("arrival").alias("arrival")).withColumn("rode", F.lit(True))
        best = best.unionByName(rides).groupBy("origin", "stop_idx", "rode").agg(F.min("arrival").alias("arrival"))
    return best.groupBy("origin", "stop_idx").agg(F.min("arrival").alias("arrival"))
