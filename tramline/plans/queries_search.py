"""Queries of searches, graphs, scenarios, optimisation, validation and scalar functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions import scalar
from tramline.operators import graph, joins, loads, optimise, scenario, search, windows
from tramline.plans import validate
from tramline.plans.adapters import Canon
from tramline.plans.queries import MATRIX, PEAK, _hav, _matrix, query, rounded
from tramline.plans.queries_network import LOADS, _loads
from tramline.sources.feeds import classify

STARTS = "st AS (SELECT zone_idx AS origin, zone_idx AS stop_idx, 28800 + zone_idx * 60 AS ready FROM zones)"


def _reach_sql(rounds: int, transfer: int) -> str:
    steps = [STARTS, "best0 AS (SELECT origin, stop_idx, ready AS arrival, false AS rode FROM st)"]
    for k in range(rounds):
        steps += [
            f"rd{k} AS (SELECT origin, stop_idx, min(arrival + CASE WHEN rode THEN {transfer} ELSE 0 END) AS at_s FROM best{k} GROUP BY ALL)",
            f"bd{k} AS (SELECT r.origin, p.route_idx, p.position, min(s.departure * 10000000 + s.trip_idx) AS pick FROM rd{k} r JOIN pattern_stops p ON p.stop_idx = r.stop_idx "
            "JOIN (SELECT t.route_idx, s.position, s.departure, s.trip_idx FROM stop_times s JOIN trips t USING (trip_idx)) s ON s.route_idx = p.route_idx AND s.position = p.position AND s.departure >= r.at_s GROUP BY ALL)",
            f"on{k} AS (SELECT origin, pick % 10000000 AS trip_idx, min(position) AS boarded FROM bd{k} GROUP BY ALL)",
            f"al{k} AS (SELECT o.origin, s.stop_idx, min(s.arrival) AS arrival, true AS rode FROM on{k} o JOIN stop_times s ON s.trip_idx = o.trip_idx AND s.position > o.boarded GROUP BY ALL)",
            f"best{k + 1} AS (SELECT origin, stop_idx, rode, min(arrival) AS arrival FROM (SELECT origin, stop_idx, arrival, rode FROM best{k} UNION ALL SELECT origin, stop_idx, arrival, rode FROM al{k}) x GROUP BY ALL)",
        ]
    return "WITH " + ", ".join(steps) + f" SELECT origin, stop_idx, min(arrival) AS arrival FROM best{rounds} GROUP BY ALL"


@query("j03_reach_two_rounds", _reach_sql(2, 60))
def _(c):
    starts = c.zones.select(F.col("zone_idx").alias("origin"), F.col("zone_idx").alias("stop_idx"), (28800 + F.col("zone_idx") * 60).alias("ready"))
    calls = c.stop_times.join(c.trips.select("trip_idx", "route_idx"), "trip_idx")
    calls = calls.select(F.col("route_idx").alias("route"), F.col("trip_idx").alias("trip"), "position", "stop_idx", "arrival", "departure")
    return search.reach_rounds(starts, calls, 2, 60)


@query("j07_search_matrix")
def _(c):
    """Travel-time percentiles of all zones over ten departures, on the timetable of every trip."""
    departures, limit = list(range(28800, 29400, 60)), 7200
    rows = search.usable_trips(c.stop_times, departures, limit)
    # The search kernel holds the city's timetable of these hours whole.
    trips = [(r["trip"], tuple(r["stops"]), tuple(r["arrivals"]), tuple(r["departures"])) for r in rows.toLocalIterator()]
    timetable = search.Timetable(search.fifo_routes(trips), 25)
    egress = {z: [(z, 120)] for z in range(25)}
    one = F.array(F.struct(F.col("zone_idx").alias("stop"), F.lit(120).alias("seconds")))
    walks = F.array(F.struct(F.col("zone_idx").alias("zone"), F.lit(0).alias("seconds")))
    origins = c.zones.select(F.col("zone_idx").alias("origin_zone"), one.alias("access"), walks.alias("walks")).repartition(8)
    return search.matrix(origins, timetable, departures, egress, limit)


EDGES = "ge AS (SELECT zone_idx AS u, zone_idx + 1 AS v FROM zones WHERE zone_idx % 6 < 4 UNION ALL SELECT zone_idx, (5 * zone_idx) % 12 FROM zones WHERE zone_idx % 2 = 0 AND zone_idx < 12 AND zone_idx <> (5 * zone_idx) % 12)"


@query(
    "j15_components",
    f"""WITH RECURSIVE {EDGES}, b AS (SELECT u, v FROM ge UNION SELECT v, u FROM ge), r AS (SELECT DISTINCT u AS node, u AS seen FROM b UNION SELECT r.node, b.v FROM r JOIN b ON r.seen = b.u),
    m AS (SELECT node, min(seen) AS label FROM r GROUP BY node), k AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS rank FROM m GROUP BY label)
    SELECT node, CAST(rank AS INTEGER) AS component FROM m JOIN k USING (label)""",
)
def _(c):
    z = c.zones
    chain = z.where("zone_idx % 6 < 4").select(F.col("zone_idx").alias("u"), (F.col("zone_idx") + 1).alias("v"))
    cross = z.where("zone_idx % 2 = 0 and zone_idx < 12").select(F.col("zone_idx").alias("u"), (F.col("zone_idx") * 5 % 12).alias("v")).where("u <> v")
    return graph.ranked_components(chain.union(cross))


@query(
    "j13_bounded_walks",
    """WITH RECURSIVE we AS (SELECT zone_idx AS a, (zone_idx + 1) % 25 AS b, 200.0e0 + zone_idx % 7 * 50 AS m FROM zones UNION ALL SELECT zone_idx, (zone_idx * 5 + 2) % 25, 900.0e0 FROM zones),
    bi AS (SELECT a, b, m FROM we UNION ALL SELECT b, a, m FROM we), w AS (SELECT zone_idx AS id, zone_idx AS node, 0.0e0 AS d, 0 AS hops FROM zones
      UNION SELECT w.id, bi.b, w.d + bi.m, hops + 1 FROM w JOIN bi ON bi.a = w.node WHERE w.d + bi.m <= 1200 AND hops < 7)
    SELECT id, node AS point, min(d) AS metres FROM w GROUP BY ALL""",
)
def _(c):
    first = c.zones.select(F.col("zone_idx").alias("edge_idx"), F.col("zone_idx").alias("from_node"), ((F.col("zone_idx") + 1) % 25).alias("to_node"), (200.0 + F.col("zone_idx") % 7 * 50).alias("length_m"))
    second = c.zones.select((F.col("zone_idx") + 25).alias("edge_idx"), F.col("zone_idx").alias("from_node"), ((F.col("zone_idx") * 5 + 2) % 25).alias("to_node"), F.lit(900.0).alias("length_m"))
    at = c.zones.select(F.col("zone_idx").alias("id"), F.col("zone_idx").alias("edge_idx"), F.lit(0.0).alias("fraction"), F.lit(0.0).alias("offset"))
    return graph.bounded_walks(at, first.union(second), at.withColumnRenamed("id", "point"), 1200.0)


@query(
    "d09_nearest_edge",
    """WITH e AS (SELECT a.stop_idx AS edge_idx, a.lat AS la, a.lon AS oa, b.lat AS lb, b.lon AS ob FROM stops a JOIN stops b ON b.stop_idx = a.stop_idx + 1),
    k AS (SELECT 6371008.8e0 * pi() / 180 AS y, 6371008.8e0 * pi() / 180 * cos(radians(12.1e0)) AS x),
    p AS (SELECT zone_idx, edge_idx, z.lon * x AS px, z.lat * y AS py, oa * x AS ax, la * y AS ay, ob * x AS bx, lb * y AS bb FROM zones z, e, k),
    f AS (SELECT *, greatest(0, least(1, coalesce(((px - ax) * (bx - ax) + (py - ay) * (bb - ay)) / nullif((bx - ax) * (bx - ax) + (bb - ay) * (bb - ay), 0), 0))) AS fr FROM p),
    d AS (SELECT *, sqrt(power(px - ax - fr * (bx - ax), 2) + power(py - ay - fr * (bb - ay), 2)) AS dist FROM f)
    SELECT zone_idx, edge_idx, round(fr, 4) AS fraction, round(dist, 2) AS distance_m, dist > 300 AS flagged FROM d WHERE dist <= 5000 QUALIFY row_number() OVER (PARTITION BY zone_idx ORDER BY round(dist, 6), edge_idx) = 1""",
)
def _(c):
    ends = c.stops.select((F.col("stop_idx") - 1).alias("edge_idx"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    edges = c.stops.select(F.col("stop_idx").alias("edge_idx"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a")).join(ends, "edge_idx")
    found = joins.nearest_edge(c.zones.select("zone_idx", "lat", "lon"), edges, "zone_idx", 5000.0, 300.0, 12.1)
    return found.withColumns({"fraction": F.round("fraction", 4), "distance_m": F.round("distance_m", 2)})


# Scenarios


@query("n10_zone_deltas", f"WITH {MATRIX}, a AS (SELECT origin_zone AS zone_idx, CAST(count(*) AS DOUBLE) AS n FROM m WHERE p50_s <= 3600 GROUP BY 1), b AS (SELECT origin_zone AS zone_idx, CAST(count(*) AS DOUBLE) AS n FROM m WHERE p75_s <= 3600 GROUP BY 1) SELECT coalesce(a.zone_idx, b.zone_idx) AS zone_idx, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.zone_idx = b.zone_idx")
def _(c):
    m = _matrix(c)
    side = lambda p: m.where(F.col(p) <= 3600).groupBy(F.col("origin_zone").alias("zone_idx")).agg(F.count(F.lit(1)).alias("n"))
    return scenario.zone_deltas(side("p50_s"), side("p75_s"), "n")


@query(
    "n10_route_deltas",
    """WITH a AS (SELECT route_idx, count(*) AS trips, CAST(sum(first_s) AS DOUBLE) AS boardings FROM trips WHERE direction_id = 0 AND route_idx < 15 GROUP BY 1), b AS (SELECT route_idx, count(*) AS trips, CAST(sum(first_s) AS DOUBLE) AS boardings FROM trips WHERE direction_id = 1 AND route_idx > 4 GROUP BY 1)
    SELECT coalesce(a.route_idx, b.route_idx) AS route_idx, coalesce(a.trips, 0) AS trips_a, coalesce(a.boardings, 0) AS boardings_a, coalesce(b.trips, 0) AS trips_b, coalesce(b.boardings, 0) AS boardings_b, coalesce(b.trips, 0) - coalesce(a.trips, 0) AS d_trips, coalesce(b.boardings, 0) - coalesce(a.boardings, 0) AS d_boardings FROM a FULL JOIN b ON a.route_idx = b.route_idx""",
)
def _(c):
    side = lambda test: c.trips.where(test).groupBy("route_idx").agg(F.count(F.lit(1)).alias("trips"), F.sum("first_s").cast("double").alias("boardings"))
    return scenario.route_deltas(side("direction_id = 0 and route_idx < 15"), side("direction_id = 1 and route_idx > 4"))


@query("e47_compare_matrices", f"WITH {MATRIX}, x AS (SELECT count(p50_s) AS pa, count(p75_s) AS pb, avg(p50_s / 60) FILTER (WHERE p50_s IS NOT NULL AND p75_s IS NOT NULL) AS ma, avg(p75_s / 60) FILTER (WHERE p50_s IS NOT NULL AND p75_s IS NOT NULL) AS mb FROM m) SELECT 'pairs_connected' AS metric, CAST(pa AS DOUBLE) AS a, CAST(pb AS DOUBLE) AS b, CAST(pb - pa AS DOUBLE) AS delta FROM x UNION ALL SELECT 'mean_minutes', round(ma, 6), round(mb, 6), round(mb - ma, 6) FROM x")
def _(c):
    m = _matrix(c)
    a, b = m.select("origin_zone", "dest_zone", F.col("p50_s").alias("s")), m.select("origin_zone", "dest_zone", F.col("p75_s").alias("s"))
    return rounded(scenario.compare_matrices(a, b, "s"))


@query("c15_direction_check", f"WITH {MATRIX} SELECT CASE WHEN count(*) FILTER (WHERE p75_s - p50_s < -1e-12) = 0 THEN 'ok' ELSE 'wrong' END AS verdict, count(*) FILTER (WHERE p75_s - p50_s < -1e-12) AS against FROM m")
def _(c):
    return scenario.direction_check(_matrix(c).select((F.col("p75_s") - F.col("p50_s")).alias("delta")), True, False)


@query(
    "n01_remove_route",
    """SELECT row_number() OVER (ORDER BY route_idx, direction_id, first_s, CAST(trip_idx AS VARCHAR)) - 1 AS trip_idx, route_idx,
        direction_id AS pattern_idx, CAST(trip_idx AS VARCHAR) AS source_trip_id FROM trips WHERE route_idx <> 3""",
)
def _(c):
    """All routes but the third, trips numbered anew."""
    trips = c.trips.select("trip_idx", "route_idx", F.col("direction_id").alias("pattern_idx"), F.col("trip_idx").cast("string").alias("source_trip_id"))
    times = c.stop_times.withColumn("time_nature", F.lit("observed"))
    return scenario.remove_route(trips, times, scenario.RemoveRoute(3))[0]


@query("n03_modify_headway")
def _(c):
    """Route 3 at half its headway, over all patterns."""
    trips = c.trips.select("trip_idx", "route_idx", F.col("direction_id").alias("pattern_idx"), F.col("trip_idx").cast("string").alias("source_trip_id"))
    times = c.stop_times.withColumn("time_nature", F.lit("observed"))
    return scenario.modify_headway(trips, times, scenario.ModifyHeadway(3, factor=0.5))[0]


@query("n05_run_profile")
def _(c):
    return scenario.run_profile(c.stops, scenario.AddRoute(99, (0, 7, 14, 21), 25200, 36000, 600, 6.0))


@query("n05_add_route", "SELECT 99 AS route_idx, count(*) AS calls FROM (SELECT unnest(generate_series(25200, 36000, 600)) AS f) x, (SELECT unnest(generate_series(1, 8)) AS k) y")
def _(c):
    return scenario.add_route(c.stops, scenario.AddRoute(99, (0, 7, 14, 21), 25200, 36000, 600, 6.0)).groupBy("route_idx").agg(F.count(F.lit(1)).alias("calls"))


# Optimisation

FACTS = "fa AS (SELECT route_idx, CAST(3600 + route_idx * 300 AS BIGINT) AS cycle_s, 900 AS base_headway_s, count(*) / 1000.0e0 AS load_factor, CAST(count(*) AS DOUBLE) AS boardings FROM trips WHERE route_idx < 3 GROUP BY route_idx)"
SCREEN = f"""{FACTS}, h AS (SELECT unnest([300, 600, 900, 1200]) AS h), cd AS (SELECT a.h || '-' || b.h || '-' || c.h AS candidate, [a.h, b.h, c.h] AS v FROM h a, h b, h c),
ch AS (SELECT candidate, k - 1 AS route_idx, v[k] AS headway_s FROM cd, (SELECT unnest([1, 2, 3]) AS k) y),
sc AS (SELECT candidate, CAST(sum(ceil(cycle_s / headway_s - 1e-9)) AS BIGINT) AS vehicles, max(load_factor * headway_s / base_headway_s) AS load_factor, sum(headway_s / 120 * boardings) / sum(boardings) AS mean_wait_min FROM ch JOIN fa USING (route_idx) GROUP BY candidate)"""


def _screened(c: Canon) -> DataFrame:
    facts = c.trips.where("route_idx < 3").groupBy("route_idx").agg(F.count(F.lit(1)).alias("n"))
    facts = facts.select(
        "route_idx", (3600 + F.col("route_idx") * 300).alias("cycle_s"), F.lit(900).alias("base_headway_s"), (F.col("n") / 1000).alias("load_factor"), F.col("n").cast("double").alias("boardings")
    )
    return optimise.screen(optimise.candidates(facts, [300, 600, 900, 1200]), facts, 30, 1.0)


@query("k10_screen", f"WITH {SCREEN} SELECT candidate, vehicles, round(load_factor, 6) AS load_factor, round(mean_wait_min, 6) AS mean_wait_min, vehicles <= 30 AND load_factor <= 1.0 AS feasible FROM sc")
def _(c):
    return rounded(_screened(c))


@query("k12_pareto_front", f"WITH {SCREEN}, r AS (SELECT candidate, vehicles, round(mean_wait_min, 6) AS mean_wait_min FROM sc) SELECT * FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.vehicles <= a.vehicles AND b.mean_wait_min <= a.mean_wait_min AND (b.vehicles < a.vehicles OR b.mean_wait_min < a.mean_wait_min))")
def _(c):
    rows = rounded(_screened(c)).select("candidate", "vehicles", "mean_wait_min")
    return optimise.pareto_front(rows, "vehicles", "mean_wait_min").select("candidate", "vehicles", "mean_wait_min")


# Validation over the canonical tables as a feed


def _feed(c: Canon) -> dict[str, DataFrame]:
    text = lambda x: F.col(x).cast("string")
    stops = c.stops.select(text("stop_idx").alias("stop_id"), F.col("name").alias("stop_name"), text("lat").alias("stop_lat"), text("lon").alias("stop_lon"), text("parent_stop_idx").alias("parent_station"))
    routes = c.routes.select(text("route_idx").alias("route_id"), F.col("short_name").alias("route_short_name"), F.when(F.col("mode") == "metro", "1").when(F.col("mode") == "tram", "0").otherwise("3").alias("route_type"))
    trips = c.trips.select(text("trip_idx").alias("trip_id"), text("route_idx").alias("route_id"), F.lit("WK").alias("service_id"))
    clock = lambda x: scalar.clock_text(x)
    times = c.stop_times.select(text("trip_idx").alias("trip_id"), text("stop_idx").alias("stop_id"), text("position").alias("stop_sequence"), clock("arrival").alias("arrival_time"), clock("departure").alias("departure_time"))
    return {"stops": stops, "routes": routes, "trips": trips, "stop_times": times}


@query("l01_duplicate_key", "SELECT CAST(sum(k) AS BIGINT) AS n FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) x")
def _(c):
    return validate.finding(windows.duplicates(c.lineitem, ["l_orderkey", "l_linenumber"]), F.concat_ws(",", "l_orderkey", "l_linenumber"), "duplicate_key", "error", "lineitem").select("n")


@query("l02_after_midnight_trips", "SELECT count(DISTINCT trip_idx) AS n FROM stop_times WHERE greatest(arrival, departure) >= 86400 HAVING count(*) > 0")
def _(c):
    rules = validate.times_rules({"stop_times": _feed(c)["stop_times"]})
    return rules[7].select("n")


@query("l03_hop_speeds", f"WITH h AS (SELECT s.trip_idx, r.mode, {_hav('p.lat', 'p.lon', 'q.lat', 'q.lon')} AS m, x.arrival - s.departure AS t FROM stop_times s JOIN stop_times x ON x.trip_idx = s.trip_idx AND x.position = s.position + 1 JOIN stops p ON p.stop_idx = s.stop_idx JOIN stops q ON q.stop_idx = x.stop_idx JOIN trips tr ON tr.trip_idx = s.trip_idx JOIN routes r ON r.route_idx = tr.route_idx) SELECT count(*) AS n FROM h WHERE t > 0 AND m / t * 3.6 > CASE WHEN mode = 'metro' THEN 120 WHEN mode = 'tram' THEN 70 ELSE 80 END")
def _(c):
    feed = _feed(c)
    rows = feed["stop_times"].withColumns({"a": scalar.clock_seconds("arrival_time"), "d": scalar.clock_seconds("departure_time"), "q": scalar.lenient_long("stop_sequence")})
    return validate.hop_rules(feed, rows)[1].select("n")


@query("l04_duplicate_trips", "WITH s AS (SELECT trip_idx, string_agg(stop_idx || '|' || arrival || '|' || departure, ',' ORDER BY position) AS sig FROM stop_times GROUP BY 1) SELECT count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY t.route_idx, sig ORDER BY CAST(t.trip_idx AS VARCHAR)) AS k FROM s JOIN trips t USING (trip_idx)) x WHERE k > 1 HAVING count(*) > 0")
def _(c):
    feed = _feed(c)
    return validate.times_rules(feed)[-1].select("n")


# Scalars


@query("i04_clock_round_trip", "SELECT trip_idx, first_s AS seconds, lpad(CAST(first_s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST((first_s // 60) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(first_s % 60 AS VARCHAR), 2, '0') AS clock FROM trips")
def _(c):
    rows = c.trips.select("trip_idx", scalar.clock_text("first_s").alias("clock"))
    return rows.select("trip_idx", scalar.clock_seconds("clock").alias("seconds"), "clock")


@query("i14_classes", "SELECT zone_idx, CAST(CASE WHEN population > 0 THEN (CASE WHEN population >= 40 THEN 1 ELSE 0 END) + (CASE WHEN population >= 60 THEN 1 ELSE 0 END) + (CASE WHEN population >= 80 THEN 1 ELSE 0 END) ELSE -1 END AS INTEGER) AS class FROM zones")
def _(c):
    return c.zones.select("zone_idx", scalar.class_of("population", [40, 60, 80]).alias("class"))


@query("i01_route_number", "SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '[0-9]+') THEN regexp_extract(p_brand, '[0-9]+') END AS number, lower(p_type) AS kind FROM part")
def _(c):
    return c.part.select("p_partkey", scalar.match_or_null("p_brand", "[0-9]+").alias("number"), F.lower("p_type").alias("kind"))


@query("a07_classify_tags", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'office' WHEN p_size % 5 = 0 THEN 'shop' WHEN p_size % 3 = 0 THEN 'health' WHEN p_size % 2 = 0 THEN 'food' END AS category FROM part")
def _(c):
    s = F.col("p_size")
    tags = F.map_from_entries(
        F.filter(
            F.array(
                F.struct(F.lit("office").alias("k"), F.when(s % 7 == 0, "yes").alias("v")), F.struct(F.lit("shop").alias("k"), F.when(s % 5 == 0, "yes").alias("v")),
                F.struct(F.lit("amenity").alias("k"), F.when(s % 3 == 0, "clinic").when(s % 2 == 0, "cafe").alias("v")),
            ),
            lambda x: x["v"].isNotNull(),
        )
    )
    return c.part.select("p_partkey", tags.alias("tags")).select("p_partkey", classify(F.col("tags")).alias("category"))


@query("i15_vehicles", "SELECT route_idx, CAST(ceil((3600 + route_idx * 300) / 420 - 1e-9) AS BIGINT) AS vehicles FROM routes")
def _(c):
    return c.routes.select("route_idx", scalar.vehicles_needed(3600 + F.col("route_idx") * 300, F.lit(420)).alias("vehicles"))


@query("i12_fares", "SELECT zone_idx, CASE WHEN population % 12 <= 2 THEN 10.0e0 WHEN population % 12 <= 5 THEN 20.0e0 ELSE 30.0e0 END AS metro, 6.0e0 + (greatest(ceil((population % 17) / 2.0e0), 1) - 1) * 2.0e0 AS bus FROM zones")
def _(c):
    hops, km = F.col("population") % 12, F.col("population") % 17
    return c.zones.select("zone_idx", scalar.metro_fare(hops, [(2, 10.0), (5, 20.0), (99, 30.0)]).alias("metro"), scalar.stage_fare(km, 2.0, 6.0, 2.0).alias("bus"))
