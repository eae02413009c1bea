"""Worked examples and brute-force comparisons of the library's own operators."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.functions import scalar, stats
from tramline.operators import access, demand, graph, joins, optimise, scenario, search, windows
from tramline.plans import clean, validate


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def test_percentiles_and_limits(spark):
    data = [(0, 0, t * 60) for t in (23, 24, 51, 52)] + [(0, 1, t * 60 if t else None) for t in (12, 13, None, None)]
    samples = spark.createDataFrame(data, "origin_zone long, dest_zone long, seconds long")
    assert rows(access.percentile_matrix(samples, 3600), "dest_zone", "p25_s", "p50_s", "p75_s") == [(0, 1380, 1440, 3060), (1, 720, 780, None)]
    assert rows(access.percentile_matrix(samples, 1800), "dest_zone", "p75_s") == [(0, None), (1, None)]
    assert rows(access.percentile_matrix(samples, 1200), "dest_zone", "p25_s") == [(1, 720)]


def test_cumulative_counts_the_threshold_itself(spark):
    matrix = spark.createDataFrame([(0, 0, 0, 0, 0), (0, 1, 900, 901, None), (1, 1, 0, 0, 0)], "origin_zone long, dest_zone long, p25_s long, p50_s long, p75_s long")
    shares = spark.createDataFrame([(0, 0.25), (1, 0.75), (2, 0.0)], "zone_idx long, jobs double")
    found = {(r["zone_idx"], r["percentile"], r["threshold_min"]): r["jobs"] for r in access.cumulative(matrix, shares, ["jobs"], thresholds=[15, 30]).collect()}
    assert found[0, 25, 15] == 1 and found[0, 50, 15] == 0.25 and found[0, 50, 30] == 1 and found[0, 75, 30] == 0.25 and found[2, 25, 15] == 0
    assert len(found) == 18


def test_weighted_statistics(spark):
    table = spark.createDataFrame([("g", 0.6, 0.4), ("g", 0.6, 0.3), ("g", 0.7, 0.2), ("g", 0.4, 0.1)], "k string, v double, w double")
    q = stats.weighted_quantiles(table, ["k"], "v", "w", [0.1, 0.5, 0.9]).first()
    assert (q["q10"], q["q50"], q["q90"]) == (0.4, 0.6, 0.7)
    assert stats.weighted_gini(table, ["k"], "v", "w").first()["gini"] == pytest.approx(0.068 / 1.2)


def test_balancing():
    pairs = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    trips, _, history = demand.furness(*pairs, np.array([2.0, 1, 1, 2]), np.array([60.0, 40]), np.array([50.0, 50]), 1e-12)
    assert trips[0] == pytest.approx((430 - 40900**0.5) / 6) and history[-1] <= 1e-12
    with pytest.raises(ValueError):
        demand.furness(*pairs, np.ones(4), np.array([1.0, 1]), np.array([1.0, 2]))


def test_attainable_attractions():
    wanted, keep, blocks, moved = demand.attainable(np.array([0, 0, 1]), np.array([0, 1, 0]), np.array([10.0, 90]), np.array([50.0, 50]))
    assert wanted == pytest.approx([90, 10]) and keep.tolist() == [False, True, True] and blocks == 2 and moved == pytest.approx(40)


def test_station_flows(spark):
    reach = spark.createDataFrame([(0, 1, 4, 1)], "origin_zone long, dest_zone long, reached long, walked long")
    segments = spark.createDataFrame([(0, 1, "X", "Y", 2), (0, 1, "X", "Z", 1), (0, 1, "Z", "Y", 1)], "origin_zone long, dest_zone long, entry_station string, exit_station string, departures long")
    od = spark.createDataFrame([(0, 1, 120.0)], "origin_zone long, dest_zone long, trips double")
    assert rows(demand.station_flows(od, demand.path_shares(segments, reach)), "entry_station", "exit_station", "trips") == [("X", "Y", 60.0), ("X", "Z", 30.0), ("Z", "Y", 30.0)]


def test_crowding_multiplier(spark):
    curve = {"seated": 1.0, "seated_slope": 0.09, "standing": 1.43, "standing_slope": 0.13}
    data = spark.createDataFrame([(1574.0, 286.0, 214.75), (200.0, 286.0, 214.75), (40.0, 30.0, 0.0)], "l double, s double, a double")
    found = [r[0] for r in data.select(scalar.crowding_multiplier("l", "s", "a", curve, 8.0)).collect()]
    assert found[0] == pytest.approx(2.088, abs=1e-3) and found[1] == 1 and found[2] == pytest.approx((30 * 1.72 + 10 * 2.47) / 40)


def toy(*trips):
    names = {s: k for k, s in enumerate(sorted({x for t in trips for x, _ in t}))}
    made = [(k, tuple(names[s] for s, _ in t), tuple(x for _, x in t), tuple(x for _, x in t)) for k, t in enumerate(trips)]
    return names, search.fifo_routes(made)


def test_search_by_hand():
    names, routes = toy([("A", 480), ("B", 490), ("C", 500)])
    table = search.Timetable(routes, len(names))
    (one,) = table.plan([(names["A"], 0)], [(names["C"], 0)], 480, search.Params(min_transfer=1))
    assert one.arrival == 500 and one.rides == 1
    names, routes = toy([("A", 480), ("B", 490)], [("B", 495), ("C", 505)])
    table = search.Timetable(routes, len(names))
    (one,) = table.plan([(names["A"], 0)], [(names["C"], 0)], 480, search.Params(min_transfer=1))
    assert one.arrival == 505 and one.measures()["waiting"] == 5 and one.rides == 2
    assert not table.plan([(names["A"], 0)], [(names["C"], 0)], 480, search.Params(min_transfer=6))


def scan(trips, footpaths, access, departure, transfer, n, rounds):
    """Earliest arrivals by a label-correcting search over (stop, vehicles, came by ride)."""
    best = {}
    todo = [(s, 0, False, departure + t) for s, t in access]
    while todo:
        s, k, rode, t = todo.pop()
        if best.get((s, k, rode), 1 << 50) <= t:
            continue
        best[s, k, rode] = t
        if rode:
            todo += [(b, k, False, t + w) for a, b, w in footpaths if a == s]
        if k == rounds:
            continue
        ready = t + transfer * rode
        for _, stops, arrive, leave in trips:
            for p, own in enumerate(stops[:-1]):
                if own == s and leave[p] >= ready:
                    todo += [(stops[q], k + 1, True, arrive[q]) for q in range(p + 1, len(stops))]
    return [min((t for (x, _, _), t in best.items() if x == s), default=search.NEVER) for s in range(n)]


def test_search_against_another_algorithm():
    rng = random.Random(11)
    for _ in range(150):
        n = rng.randint(4, 9)
        trips = []
        for k in range(rng.randint(4, 15)):
            t, stops, arrive, leave = rng.randint(0, 60), [], [], []
            for _ in range(rng.randint(2, 5)):
                stops.append(rng.choice([x for x in range(n) if not stops or x != stops[-1]]))
                arrive.append(t)
                t += rng.randint(0, 2)
                leave.append(t)
                t += rng.randint(1, 10)
            trips.append((k, tuple(stops), tuple(arrive), tuple(leave)))
        paths = [(a, b, rng.randint(1, 9)) for a in range(n) for b in range(n) if a != b and rng.random() < 0.15]
        access = [(rng.randrange(n), rng.randint(0, 5))]
        departures = [rng.randint(0, 40) for _ in range(3)]
        params = search.Params(3, rng.randint(0, 4))
        table = search.Timetable(search.fifo_routes(trips), n, paths)
        found = table.arrivals(table.search(access, departures, params))
        for k, d in enumerate(departures):
            assert found[k].tolist() == scan(trips, paths, access, d, params.min_transfer, n, params.max_rounds)


def test_station_entry_is_paid_to_board_only():
    names, routes = toy([("A", 500), ("B", 520)])
    a, b = names["A"], names["B"]
    table = search.Timetable(routes, 2, entry={a: 240, b: 999})
    assert table.arrivals(table.search([(a, 0)], [260], search.Params(1, 0)))[0, b] == 520
    assert table.arrivals(table.search([(a, 0)], [261], search.Params(1, 0)))[0, b] == search.NEVER


def test_components_and_walks(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(30) if k != 12] + [(40, 41)]
    found = rows(graph.ranked_components(spark.createDataFrame(edges, "u long, v long")), "node", "component")
    assert dict(found)[0] == 1 and dict(found)[30] == 0 and dict(found)[41] == 2
    street = [(k, k, k + 1, 100.0) for k in range(5)]
    walk = graph.WalkGraph(street, [(7, 0, 0.5, 10.0), (8, 3, 0.5, 0.0), (9, 0, 0.9, 0.0)])
    assert walk.within(0, 0.5, 5.0, 400) == {7: 15.0, 9: pytest.approx(45.0), 8: 305.0}
    assert rng.random() < 1


def test_as_of_against_brute_force(spark):
    rng = random.Random(3)
    calls = [(k, rng.randrange(3), rng.randrange(40)) for k in range(60)]
    events = [(rng.randrange(3), rng.randrange(40), k) for k in range(40)]
    left = spark.createDataFrame(calls, "id long, key long, at long")
    right = spark.createDataFrame(events, "key long, t long, trip long")
    for forward in (True, False):
        want = []
        for k, key, at in calls:
            own = [(abs(t - at), trip, t) for x, t, trip in events if x == key and (t >= at if forward else t <= at)]
            want.append((k, *((min(own)[2], min(own)[1]) if own else (None, None))))
        assert rows(joins.as_of(left, right, ["key"], "at", "t", ["trip"], forward), "id", "t", "trip") == sorted(want, key=str)


def test_dense_index_and_islands(spark):
    data = spark.createDataFrame([(k % 7, k) for k in range(500)], "a long, b long")
    assert rows(windows.dense_index(data, ["a", "b"], "i").orderBy("i").limit(2), "a", "b", "i") == [(0, 0, 0), (0, 7, 1)]
    assert windows.dense_index(data, ["a", "b"], "i").agg(F.countDistinct("i"), F.max("i")).first()[:] == (500, 499)
    flags = spark.createDataFrame([(1, k, x) for k, x in enumerate([1, 1, 0, 1, 0, 1, 1, 1])], "t long, q long, inside int")
    assert rows(windows.islands(flags, ["t"], ["q"], F.col("inside") == 1), "q", "piece") == [(0, 0), (1, 0), (5, 1), (6, 1), (7, 1)]


def test_headways(spark):
    assert scenario.thinned(np.array([0, 600, 1200, 1800]), 2.0).tolist() == [0, 1200]
    assert scenario.thinned(np.array([100, 100, 200]), 1.0).tolist() == [100, 100, 200]
    assert scenario.thinned(np.array([0, 600, 1201]), 0.5).tolist() == [0, 300, 600, 901, 1201]
    trips = spark.createDataFrame([(0, 1, 0, "a"), (1, 1, 0, "b"), (2, 2, 1, "c")], "trip_idx long, route_idx long, pattern_idx long, source_trip_id string")
    times = spark.createDataFrame([(t, p, p, s + p * 60, s + p * 60, "observed") for t, s in ((0, 0), (1, 600), (2, 50)) for p in (0, 1)], "trip_idx long, position int, stop_idx long, arrival long, departure long, time_nature string")
    made, new = scenario.modify_headway(trips, times, scenario.ModifyHeadway(1, factor=0.5))
    assert rows(made, "trip_idx", "source_trip_id") == [(0, "a"), (1, "a@00:05:00"), (2, "b"), (3, "c")]
    assert rows(new.where("position = 1"), "trip_idx", "departure", "time_nature") == [(0, 60, "observed"), (1, 360, "assumed"), (2, 660, "observed"), (3, 110, "observed")]


def test_scenario_changes(spark):
    trips = spark.createDataFrame([(0, 1, 0, "a"), (1, 1, 0, "b"), (2, 2, 1, "c"), (3, None, 2, "d")], "trip_idx long, route_idx long, pattern_idx long, source_trip_id string")
    times = spark.createDataFrame([(t, p, p, s + p * 60, s + p * 60, "observed") for t, s in ((0, 0), (1, 600), (2, 50), (3, 70)) for p in (0, 1)], "trip_idx long, position int, stop_idx long, arrival long, departure long, time_nature string")
    stops = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.01)], "stop_idx long, lat double, lon double")
    left, calls = scenario.remove_route(trips, times, scenario.RemoveRoute(1))
    assert sorted(rows(left, "trip_idx", "source_trip_id")) == [(0, "d"), (1, "c")]
    assert sorted(rows(calls, "trip_idx", "position", "departure")) == [(0, 0, 70), (0, 1, 130), (1, 0, 50), (1, 1, 110)]
    steps = (scenario.ModifyHeadway(1, factor=0.5), scenario.RemoveRoute(2), scenario.AddRoute(9, (0, 1), 0, 600, 600, 10.0))
    made, calls, changes = scenario.apply_scenario(trips, times, stops, scenario.Scenario("x", steps))
    assert rows(changes.orderBy("n"), "n", "type", "route_idx", "removed", "added") == [(1, "modify_headway", 1, 0, 1), (2, "remove_route", 2, 1, 0), (3, "add_route", 9, 0, 4)]
    assert made.count() == 8 and calls.count() == 16 and calls.join(made, "trip_idx", "left_anti").isEmpty()
    assert sorted(rows(made.where("route_idx = 9"), "pattern_idx", "source_trip_id")) == [(3, "9-0@00:00:00"), (3, "9-0@00:10:00"), (4, "9-1@00:00:00"), (4, "9-1@00:10:00")]
    with pytest.raises(ValueError, match="unknown"):
        scenario.apply_scenario(trips, times, stops, scenario.Scenario("x", (scenario.RemoveRoute(7),)))
    none = scenario.apply_scenario(trips, times, stops, scenario.Scenario("x"))[2]
    assert none.count() == 0


def test_fronts_agree(spark):
    def evaluate(x):
        vehicles = np.ceil(60 / x).sum(1)
        return np.column_stack([vehicles, (x * np.array([2, 1])).sum(1)]).astype(float)

    every = np.array([(a, b) for a in (20, 10, 5) for b in (20, 10, 5)])
    values = evaluate(every)
    table = spark.createDataFrame([(int(a), int(b), float(v), float(w)) for (a, b), (v, w) in zip(every, values, strict=True)], "a int, b int, v double, w double")
    front = rows(optimise.pareto_front(table, "v", "w"), "a", "b")
    found, _ = optimise.nsga2(evaluate, [20, 10, 5], 2, 20, 20)
    assert sorted(map(tuple, found.tolist()), key=str) == front


FEED = {
    "agency": ("agency_id,agency_name", ["1,Metro"]),
    "stops": ("stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station", ["S1,Main,12.01,77.01,1,", "P1,Main,12.01,77.01,0,S1", "A,A,12.02,77.02,,", "B,B,12.03,77.03,,", "C,C,12.04,77.04,,"]),
    "routes": ("route_id,agency_id,route_short_name,route_long_name,route_type", ["R1,1,10,,3", "R3,1,M1,,1"]),
    "trips": ("route_id,service_id,trip_id", ["R1,WK,T1", "R1,WK,T2", "R3,WK,T4"]),
    "stop_times": ("trip_id,arrival_time,departure_time,stop_id,stop_sequence", ["T1,08:00:00,08:00:00,A,1", "T1,,,B,2", "T1,08:20:00,08:20:00,C,3", "T2,09:00:00,09:00:00,A,1", "T2,09:20:00,09:20:00,C,2", "T4,23:58:00,23:58:00,P1,1", "T4,24:05:00,24:05:00,B,2"]),
    "calendar": ("service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date", ["WK,1,1,1,1,1,0,0,20260101,20261231"]),
}


def feed_of(spark, folder, **changes):
    from tramline.sources.feeds import load_feed

    for name, (head, lines) in (FEED | changes).items():
        (folder / f"{name}.txt").write_text("\n".join([head, *lines]) + "\n")
    return load_feed(spark, str(folder))


def findings(spark, feed):
    return {r["rule"]: (r["n"], r["examples"]) for r in validate.validate(spark, feed.tables, feed.unreadable).collect()}


def test_validation_of_a_clean_and_a_broken_feed(spark, tmp_path):
    assert findings(spark, feed_of(spark, tmp_path)) == {"after_midnight_trips": (1, ["T4"]), "untimed_intermediate_stops": (1, ["T1"])}
    head, lines = FEED["stop_times"]
    broken = [*lines, "T9,10:00:00,09:00:00,A,1", "T2,09:21:00,09:21:00,Z,3", "T2,8x,09:30:00,A,4"]
    bad = findings(spark, feed_of(spark, tmp_path, stop_times=(head, broken), trips=(FEED["trips"][0], [*FEED["trips"][1], "R9,XX,T1"])))
    for rule in ("unknown_trip", "unknown_stop", "invalid_time", "arrival_after_departure", "duplicate_key", "unknown_route", "unknown_service", "trip_with_one_stop"):
        assert rule in bad, rule


def test_cleaning_builds_the_network(spark, tmp_path):
    feed = feed_of(spark, tmp_path)
    network = clean.clean(feed.tables, datetime.date(2026, 10, 13), "^M", (77.0, 12.0, 77.035, 12.1))
    trips, times = clean.index_network(network)
    assert [s.name for s in network.steps][0] == "service day" and network.dropped.count() >= 1
    assert rows(trips, "trip_id") == [("T1",)]
    assert rows(times, "position", "arrival", "time_nature") == [(0, 28800, "observed"), (1, 29399, "estimated")] or rows(times, "position", "time_nature") == [(0, "observed"), (1, "estimated")]
    saturday = clean.active_services(feed.tables, datetime.date(2026, 10, 17))
    assert saturday.count() == 0


def test_stage_is_written_once(spark, tmp_path):
    from tramline.sources import sinks

    table = spark.range(5).withColumnRenamed("id", "zone_idx")
    target = str(tmp_path / "stage")
    make = lambda: sinks.write_stage(spark, target, {"zones": table}, {"zones": ["zone_idx"]}, {"a": 1}, {"zone_idx": "Observed"})
    assert sinks.cached_stage(spark, target, {"a": 1}, make) and not sinks.cached_stage(spark, target, {"a": 1}, make)
    assert sinks.read_manifest(spark, target)["rows"] == {"zones": 5}
    assert spark.read.parquet(f"{target}/zones").count() == 5


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_within_distance_near_the_poles_and_the_date_line(spark):
    import math
    import random

    from tramline.operators import joins

    rng = random.Random(3)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(rng.uniform(84, 90), rng.uniform(-180, 180)) for _ in range(60)]
    spots += [(rng.uniform(-3, 3) + base, rng.choice((-180, 180)) + rng.uniform(-2, 2)) for base in (0, 65, -75) for _ in range(40)]
    spots = [(k, lat, (lon + 180) % 360 - 180) for k, (lat, lon) in enumerate(spots)]

    def metres(a, b):
        (p, x), (q, y) = ([math.radians(v) for v in s[1:]] for s in (a, b))
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2
        return 2 * joins.EARTH_M * math.asin(math.sqrt(min(1, h)))

    left = spark.createDataFrame(spots, "a long, lat double, lon double")
    right = spark.createDataFrame(spots, "b long, lat_b double, lon_b double")
    found = sorted((r["a"], r["b"]) for r in joins.within_distance(left, right, 150_000).collect())
    assert found == sorted((a[0], b[0]) for a in spots for b in spots if metres(a, b) <= 150_000) and len(found) > len(spots)


def test_percentiles_gather_no_values_in_one_task(spark):
    rng = random.Random(7)
    values = [rng.choice([1.5, 2.0, rng.random() * 1e6]) for _ in range(5000)] + [None, -3.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    found = stats.percentiles(frame, F.col("v"), shares)
    row = found.first()
    held = np.array([v for v in values if v is not None])
    assert row["mean"] == pytest.approx(held.mean())
    assert [row[k] for k in shares] == pytest.approx([np.quantile(held, p) for p in shares.values()])
    assert tuple(stats.percentiles(frame.where("false"), F.col("v"), shares).first()) == (None,) * 5
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "collect" not in plan


def test_usable_trips_give_the_same_travel_times(spark):
    rng = random.Random(3)
    trips = []
    for k in range(400):
        stops = tuple(rng.sample(range(8), 4)) if k % 3 else (0, 1, 2, 3)
        start = rng.randrange(0, 9000, 60)
        trips.append((k, stops, tuple(start + 200 * p for p in range(4)), tuple(start + 200 * p + 20 for p in range(4))))
    trips += [(400 + k, *t[1:]) for k, t in enumerate(trips)]  # every trip twice
    calls = [(t, p, s, a, d) for t, stops, arrivals, leaves in trips for p, (s, a, d) in enumerate(zip(stops, arrivals, leaves, strict=True))]
    frame = spark.createDataFrame(calls, "trip_idx long, position long, stop_idx long, arrival long, departure long")
    departures, limit = [3000, 3300, 3600], 1500
    found = [(r["trip"], tuple(r["stops"]), tuple(r["arrivals"]), tuple(r["departures"])) for r in search.usable_trips(frame, departures, limit).collect()]
    assert len(found) < 200 and all(t[0] < 400 for t in found)
    egress = {z: [(z, 30)] for z in range(8)}
    times = [
        [search.travel_times(search.Timetable(search.fifo_routes(x), 8), [(s, 30)], departures, egress, {}, limit) for s in range(8)] for x in (trips, found)
    ]
    assert times[0] == times[1] and any(times[0])
