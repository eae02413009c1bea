"""Queries of loads, demand, network listings, scenarios and graphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import scalar, stats
from tramline.operators import demand, graph, joins, loads, optimise, scenario, search
from tramline.plans.adapters import Canon
from tramline.plans.queries import CURVE, MATRIX, PEAK, _hav, _matrix, query, rounded

CAPACITY = "cap AS (SELECT trip_idx, vehicle, seats, CAST(seats + floor(6.0 * area) AS BIGINT) AS capacity, CAST(seats + floor(8.0 * area) AS BIGINT) AS crush_capacity, area FROM capacity)"
LOADS = f"""{CAPACITY},
sl AS (
  SELECT s.trip_idx, s.position, s.stop_idx AS from_stop_idx, lead(s.stop_idx) OVER w AS to_stop_idx, s.departure, lead(s.arrival) OVER w AS arrival,
    coalesce(f.boardings, 0) AS boardings, coalesce(f.alightings, 0) AS alightings,
    greatest(sum(coalesce(f.boardings, 0) - coalesce(f.alightings, 0)) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS load
  FROM stop_times s LEFT JOIN flows f ON s.trip_idx = f.trip_idx AND s.position = f.position WINDOW w AS (PARTITION BY s.trip_idx ORDER BY s.position)),
ld AS (
  SELECT sl.*, cap.vehicle, cap.seats, cap.capacity, cap.crush_capacity, load / cap.capacity AS load_factor, load / cap.crush_capacity AS crush_factor,
    cap.area, {_hav('p.lat', 'p.lon', 'q.lat', 'q.lon')} / 1000 AS km
  FROM sl JOIN cap USING (trip_idx) JOIN stops p ON p.stop_idx = from_stop_idx JOIN stops q ON q.stop_idx = to_stop_idx WHERE to_stop_idx IS NOT NULL)"""


def _capacity(c: Canon) -> DataFrame:
    vehicles = c.capacity.select("vehicle", "seats", "area").distinct()
    return loads.capacities(c.capacity.select("trip_idx", "vehicle"), vehicles, 6.0, 8.0)


def _loads(c: Canon) -> DataFrame:
    return loads.with_distances(loads.segment_loads(c.stop_times, c.flows, _capacity(c)), c.stops)


@query("e19_trip_vehicles", f"WITH {CAPACITY} SELECT trip_idx, vehicle, capacity, crush_capacity FROM cap")
def _(c):
    modes = c.trips.select("trip_idx", "route_idx").join(c.routes.select("route_idx", "mode"), "route_idx")
    default = F.lit("bus")
    named = modes.select("trip_idx", loads.vehicle_of([(F.col("mode") == "metro", "train"), (F.col("mode") == "tram", "car")], default).alias("vehicle"))
    vehicles = c.capacity.select("vehicle", "seats", "area").distinct()
    return loads.capacities(named, vehicles, 6.0, 8.0).select("trip_idx", "vehicle", "capacity", "crush_capacity")


@query("e20_segment_loads", f"WITH {LOADS} SELECT trip_idx, position, from_stop_idx, to_stop_idx, departure, arrival, round(boardings, 6) AS boardings, round(alightings, 6) AS alightings, round(load, 6) AS load, vehicle, seats, capacity, crush_capacity, round(load_factor, 6) AS load_factor, round(crush_factor, 6) AS crush_factor FROM ld")
def _(c):
    return rounded(loads.segment_loads(c.stop_times, c.flows, _capacity(c)))


@query("e21_stop_flows", "SELECT s.stop_idx, sum(boardings) AS boardings, sum(alightings) AS alightings FROM flows f JOIN stop_times s ON s.trip_idx = f.trip_idx AND s.position = f.position GROUP BY s.stop_idx HAVING sum(boardings) + sum(alightings) > 0")
def _(c):
    return loads.stop_flows(c.flows, c.stop_times)


@query(
    "e23_route_metrics",
    f"""WITH {LOADS} SELECT t.route_idx, count(DISTINCT ld.trip_idx) AS trips, count(DISTINCT ld.trip_idx) FILTER (WHERE departure >= {PEAK[0]} AND departure < {PEAK[1]}) AS peak_trips,
      round(sum(boardings), 6) AS boardings, round(coalesce(sum(boardings) FILTER (WHERE departure >= {PEAK[0]} AND departure < {PEAK[1]}), 0), 6) AS peak_boardings, round(sum(load * km), 3) AS passenger_km,
      round(sum(load * km) / nullif(sum(capacity * km), 0), 6) AS utilisation, round(max(load_factor), 6) AS max_load_factor, round(avg(CASE WHEN load_factor > 1 THEN 1.0 ELSE 0.0 END), 6) AS share_over_capacity
    FROM ld JOIN trips t USING (trip_idx) GROUP BY t.route_idx""",
)
def _(c):
    out = loads.route_metrics(_loads(c), c.trips, PEAK)
    return rounded(out.withColumn("passenger_km", F.round("passenger_km", 3)))


@query(
    "e24_city_metrics",
    f"""WITH {LOADS} SELECT round(sum(boardings), 3) AS boardings, round(sum(load * km), 3) AS passenger_km, round(sum(load * (arrival - departure) / 3600), 3) AS passenger_hours,
      round(sum(load * km * load_factor) / sum(load * km), 6) AS mean_load_factor, round(coalesce(sum(load * km) FILTER (WHERE load_factor > 1), 0) / sum(load * km), 6) AS crowded_share FROM ld""",
)
def _(c):
    out = loads.city_metrics(_loads(c))
    return out.select(*[F.round(x, 3).alias(x) for x in ("boardings", "passenger_km", "passenger_hours")], *[F.round(x, 6).alias(x) for x in ("mean_load_factor", "crowded_share")])


@query("e26_gate_flows", "SELECT station_idx, coalesce((SELECT sum(passengers) FROM gates WHERE entry_station = station_idx), 0) AS entries, coalesce((SELECT sum(passengers) FROM gates WHERE exit_station = station_idx), 0) AS exits FROM stations")
def _(c):
    return loads.gate_flows(c.gates, c.stations)


@query("e31_peak_segments", f"WITH {LOADS} SELECT t.route_idx, from_stop_idx, to_stop_idx, count(*) AS trips, round(sum(load), 6) AS passengers, round(max(load), 6) AS max_load, round(max(load_factor), 6) AS max_load_factor, min(capacity) AS capacity, round(sum(load) / (count(*) * min(capacity)), 6) AS mean_load_factor, any_value(r.mode) AS mode, any_value(r.short_name) AS short_name FROM ld JOIN trips t USING (trip_idx) LEFT JOIN routes r ON r.route_idx = t.route_idx WHERE departure >= {PEAK[0]} AND departure < {PEAK[1]} GROUP BY t.route_idx, from_stop_idx, to_stop_idx")
def _(c):
    return rounded(loads.peak_segments(_loads(c), c.trips, c.routes, PEAK))


@query(
    "e32_load_bands",
    f"""WITH {LOADS}, s AS (SELECT t.route_idx, from_stop_idx, to_stop_idx, sum(load) AS passengers, coalesce(sum(load) / (count(*) * min(capacity)), 0) AS f FROM ld JOIN trips t USING (trip_idx) JOIN routes r ON r.route_idx = t.route_idx WHERE r.mode = 'bus' AND departure >= {PEAK[0]} AND departure < {PEAK[1]} GROUP BY t.route_idx, from_stop_idx, to_stop_idx),
    b AS (SELECT band, count(f) AS segments, coalesce(sum(passengers), 0) AS passengers FROM (VALUES ('under 0.5', -1, 0.5), ('0.5-1.0', 0.5, 1), ('1.0-1.5', 1, 1.5), ('over 1.5', 1.5, 1e9)) v(band, lo, hi) LEFT JOIN s ON f >= lo AND f < hi GROUP BY band)
    SELECT band, segments, round(passengers, 6) AS passengers, coalesce(round(segments / nullif(sum(segments) OVER (), 0), 6), 0) AS share_segments, coalesce(round(passengers / nullif(sum(passengers) OVER (), 0), 6), 0) AS share_passengers FROM b""",
)
def _(c):
    return rounded(loads.load_bands(loads.peak_segments(_loads(c), c.trips, c.routes, PEAK)))


@query("e33_crowding_segments", f"WITH {LOADS} SELECT from_stop_idx, to_stop_idx, count(*) AS vehicles, round(sum(load), 6) AS passengers, CAST(sum(capacity) AS BIGINT) AS capacity, round(max(load_factor), 6) AS max_load_factor FROM ld GROUP BY ALL")
def _(c):
    return rounded(loads.crowding_segments(_loads(c), c.trips))


FRAMES = f"WITH {LOADS}, fr AS (SELECT CAST(floor(departure / 900) * 900 AS BIGINT) AS bin, from_stop_idx, to_stop_idx, count(*) AS vehicles, sum(load) AS passengers, CAST(sum(capacity) AS BIGINT) AS capacity, max(load_factor) AS max_load_factor FROM ld GROUP BY ALL)"


@query("e34_frames", FRAMES + ", pr AS (SELECT from_stop_idx, to_stop_idx, row_number() OVER (ORDER BY from_stop_idx, to_stop_idx) - 1 AS pair FROM (SELECT DISTINCT from_stop_idx, to_stop_idx FROM fr WHERE passengers >= 20)) SELECT fr.from_stop_idx, fr.to_stop_idx, bin, vehicles, round(passengers, 6) AS passengers, capacity, round(max_load_factor, 6) AS max_load_factor, pair FROM fr JOIN pr USING (from_stop_idx, to_stop_idx) WHERE passengers >= 20")
def _(c):
    return rounded(loads.frames(_loads(c), c.trips, 900, 20.0)[0])


@query("e34_frame_totals", FRAMES + " SELECT bin, round(sum(passengers), 6) AS passengers, round(coalesce(sum(passengers) FILTER (WHERE passengers < 20), 0), 6) AS dropped FROM fr GROUP BY bin")
def _(c):
    return rounded(loads.frames(_loads(c), c.trips, 900, 20.0)[1])


@query(
    "i11_crowding_multiplier",
    f"""WITH {LOADS}, d AS (SELECT *, load - seats AS st, CASE WHEN area > 0 THEN least((load - seats) / area, 8.0e0) ELSE 8.0e0 END AS dn FROM ld)
    SELECT trip_idx, position, round(CASE WHEN st > 0 THEN (seats * (1.0e0 + 0.09e0 * dn) + st * (1.43e0 + 0.13e0 * dn)) / load ELSE 1.0 END, 6) AS multiplier FROM d""",
)
def _(c):
    rows = _loads(c).join(c.capacity.select("trip_idx", "area"), "trip_idx")
    return rounded(rows.select("trip_idx", "position", scalar.crowding_multiplier("load", "seats", "area", CURVE, 8.0).alias("multiplier")))


@query(
    "k06_perceived_seconds",
    f"""WITH {LOADS}, d AS (SELECT *, load - seats AS st, CASE WHEN area > 0 THEN least((load - seats) / area, 8.0e0) ELSE 8.0e0 END AS dn FROM ld),
    m AS (SELECT trip_idx, position, CAST(arrival - departure AS DOUBLE) AS s, (arrival - departure) * CASE WHEN st > 0 THEN (seats * (1.0e0 + 0.09e0 * dn) + st * (1.43e0 + 0.13e0 * dn)) / load ELSE 1.0 END AS x FROM d)
    SELECT trip_idx, position, s AS seconds, round(x + 1e-7, 2) AS crowded_s, coalesce(sum(s) OVER w, 0) AS seconds_before, round(coalesce(sum(x) OVER w, 0) + 1e-7, 2) AS crowded_before
    FROM m WINDOW w AS (PARTITION BY trip_idx ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def _(c):
    rows = _loads(c).join(c.capacity.select("trip_idx", "area"), "trip_idx")
    out = loads.perceived_seconds(rows, CURVE, 8.0)
    # Shifted off the ties that whole seconds times the curve's decimals make.
    return rounded(out.withColumns({x: F.col(x) + 1e-7 for x in ("crowded_s", "crowded_before")}), 2)


# Network listings


@query("e35_routes_listing", f"SELECT r.route_idx, r.short_name, r.mode, count(t.trip_idx) AS trips, count(t.trip_idx) FILTER (WHERE t.first_s >= {PEAK[0]} AND t.first_s < {PEAK[1]}) AS window_trips FROM routes r LEFT JOIN trips t ON r.route_idx = t.route_idx GROUP BY ALL")
def _(c):
    in_peak = (F.col("first_s") >= PEAK[0]) & (F.col("first_s") < PEAK[1])
    sums = c.trips.groupBy("route_idx").agg(F.count(F.lit(1)).alias("trips"), F.count_if(in_peak).alias("window_trips"))
    return c.routes.select("route_idx", "short_name", "mode").join(sums, "route_idx", "left").fillna(0, ["trips", "window_trips"])


@query("e36_route_detail", "SELECT t.route_idx, min(direction_id) AS direction_id, min(headsign) AS headsign, count(*) AS trips, min(first_s) AS first_departure, max(first_s) AS last_departure FROM trips t GROUP BY t.route_idx")
def _(c):
    return c.trips.groupBy("route_idx").agg(
        F.min("direction_id").alias("direction_id"), F.min("headsign").alias("headsign"), F.count(F.lit(1)).alias("trips"),
        F.min("first_s").alias("first_departure"), F.max("first_s").alias("last_departure"),
    )


@query(
    "e37_stops_listing",
    """WITH own AS (SELECT stop_idx, stop_idx AS at FROM stops UNION SELECT coalesce(parent_stop_idx, stop_idx), stop_idx FROM stops)
    SELECT o.stop_idx, string_agg(DISTINCT r.mode, ',' ORDER BY r.mode) AS modes, count(DISTINCT p.route_idx) AS routes FROM own o JOIN pattern_stops p ON p.stop_idx = o.at JOIN routes r ON r.route_idx = p.route_idx GROUP BY o.stop_idx""",
)
def _(c):
    inherited = c.stops.select(F.coalesce("parent_stop_idx", "stop_idx").alias("stop_idx"), F.col("stop_idx").alias("at"))
    own = c.stops.select("stop_idx", F.col("stop_idx").alias("at")).union(inherited).distinct()
    served = own.join(c.pattern_stops.select(F.col("stop_idx").alias("at"), "route_idx"), "at").join(c.routes.select("route_idx", "mode"), "route_idx")
    return served.groupBy("stop_idx").agg(F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"), F.countDistinct("route_idx").alias("routes"))


@query("e38_network_segments", "SELECT a.stop_idx AS from_stop_idx, b.stop_idx AS to_stop_idx, count(DISTINCT a.route_idx) AS routes, count(*) AS trips FROM pattern_stops a JOIN pattern_stops b ON a.route_idx = b.route_idx AND b.position = a.position + 1 JOIN trips t ON t.route_idx = a.route_idx GROUP BY ALL")
def _(c):
    w = Window.partitionBy("route_idx").orderBy("position")
    hops = c.pattern_stops.select("route_idx", F.col("stop_idx").alias("from_stop_idx"), F.lead("stop_idx").over(w).alias("to_stop_idx")).where("to_stop_idx is not null")
    per_route = c.trips.groupBy("route_idx").agg(F.count(F.lit(1)).alias("n"))
    return hops.join(per_route, "route_idx").groupBy("from_stop_idx", "to_stop_idx").agg(F.countDistinct("route_idx").alias("routes"), F.sum("n").alias("trips"))


@query("e11_stop_modes", "SELECT DISTINCT p.stop_idx, r.mode FROM pattern_stops p JOIN routes r ON r.route_idx = p.route_idx")
def _(c):
    return c.pattern_stops.join(c.routes, "route_idx").select("stop_idx", "mode").distinct()


@query("e10_stop_counts_by_mode", "SELECT p.stop_idx % 5 AS zone_idx, count(DISTINCT p.stop_idx) FILTER (WHERE r.mode = 'bus') AS stops_bus, count(DISTINCT p.stop_idx) FILTER (WHERE r.mode = 'metro') AS stops_metro, count(DISTINCT p.stop_idx) FILTER (WHERE r.mode = 'tram') AS stops_other FROM pattern_stops p JOIN routes r ON r.route_idx = p.route_idx GROUP BY 1")
def _(c):
    served = c.pattern_stops.join(c.routes, "route_idx").select((F.col("stop_idx") % 5).alias("zone_idx"), "stop_idx", "mode").distinct()
    one = lambda m: F.count_if(F.col("mode") == m)
    return served.groupBy("zone_idx").agg(one("bus").alias("stops_bus"), one("metro").alias("stops_metro"), one("tram").alias("stops_other"))


@query("e09_buildings_by_zone", "SELECT z.zone_idx, count(b.building) FILTER (WHERE confidence >= 0.65) AS building_count_c65, coalesce(sum(area) FILTER (WHERE confidence >= 0.65), 0) AS building_area_m2_c65, count(b.building) FILTER (WHERE confidence >= 0.75) AS building_count_c75, coalesce(sum(area) FILTER (WHERE confidence >= 0.75), 0) AS building_area_m2_c75 FROM zones z LEFT JOIN buildings b ON z.zone_idx = b.zone_idx GROUP BY z.zone_idx")
def _(c):
    cuts = []
    for k in (65, 75):
        held = F.col("confidence") >= k / 100
        cuts += [F.count_if(held).alias(f"building_count_c{k}"), F.sum(F.when(held, F.col("area")).otherwise(0.0)).alias(f"building_area_m2_c{k}")]
    sums = c.buildings.groupBy("zone_idx").agg(*cuts)
    return c.zones.select("zone_idx").join(sums, "zone_idx", "left").fillna(0)


@query("e40_station_lines", "SELECT station_idx, name, array_to_string(list_sort(string_split(lines, '+')), '+') AS lines, len(string_split(lines, '+')) AS n_lines FROM stations")
def _(c):
    parts = F.array_sort(F.split("lines", r"\+"))
    return c.stations.select("station_idx", "name", F.array_join(parts, "+").alias("lines"), F.size(parts).cast("long").alias("n_lines"))


@query("e29_station_sets", "SELECT station_idx, CASE WHEN list_bool_and([x IN ('B') FOR x IN string_split(lines, '+')]) THEN 'excluded' WHEN name IN ('Stop 10') THEN 'held_out' ELSE 'training' END AS station_set FROM stations")
def _(c):
    return c.stations.select("station_idx", loads.station_set(F.col("lines"), F.col("name"), ["B"], ["Stop 10"]).alias("station_set"))


@query(
    "e30_fit",
    """WITH s AS (SELECT entry_station AS k, sum(passengers) AS s FROM gates GROUP BY 1), o AS (SELECT exit_station AS k, sum(passengers) * 1.1 AS o FROM gates GROUP BY 1),
    j AS (SELECT s.s, o.o, s.s / sum(s.s) OVER () AS a, o.o / sum(o.o) OVER () AS b, CASE WHEN s.s + o.o > 0 THEN sqrt(2 * power(s.s - o.o, 2) / (s.s + o.o)) ELSE 0 END AS g FROM s JOIN o USING (k))
    SELECT count(*) AS n, round(sqrt(avg(power(a - b, 2))), 9) AS rmse_share, round(1 - sum(power(a - b, 2)) / (sum(b * b) - count(*) * power(avg(b), 2)), 6) AS r2, round(corr(a, b), 6) AS pearson,
      round(avg(g), 6) AS mean_geh, round(avg(CASE WHEN g < 5 THEN 1.0 ELSE 0.0 END), 6) AS share_geh_5, round(sum(s) / sum(o), 6) AS level_ratio FROM j""",
)
def _(c):
    s = c.gates.groupBy(F.col("entry_station").alias("station_idx")).agg(F.sum("passengers").alias("simulated"))
    o = c.gates.groupBy(F.col("exit_station").alias("station_idx")).agg((F.sum("passengers") * 1.1).alias("observed"))
    out = stats.fit(loads.station_fit(s, o), [], "simulated", "observed")
    return out.select("n", F.round("rmse_share", 9).alias("rmse_share"), *[F.round(x, 6).alias(x) for x in ("r2", "pearson", "mean_geh", "share_geh_5", "level_ratio")])


@query("e39_observed_entries", "SELECT station, round(sum(n) / 30.0, 6) AS mean_entries FROM (SELECT user_id % 25 AS station, count(*) AS n FROM calls WHERE (t // 3600) % 24 IN (8, 9) GROUP BY 1) x GROUP BY station")
def _(c):
    hours = F.floor(F.col("t") / 3600) % 24
    rows = c.calls.where(hours.isin(8, 9)).groupBy((F.col("user_id") % 25).alias("station")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("station", F.round(F.col("n") / 30.0, 6).alias("mean_entries"))


# Demand

ENDS = "en AS (SELECT z.zone_idx, population * CAST(0.1 AS DOUBLE) * 0.5 AS origin, a.employment_score AS destination_proxy, a.employment_score * (SELECT sum(population * CAST(0.1 AS DOUBLE) * 0.5) FROM zones) / (SELECT sum(employment_score) FROM attraction) AS destination FROM zones z JOIN attraction a USING (zone_idx))"


def _pairs(c: Canon) -> DataFrame:
    costs = _matrix(c).select("origin_zone", "dest_zone", F.col("p25_s").alias("cost_s")).where("cost_s is not null and origin_zone <> dest_zone")
    return demand.live_pairs(costs, demand.trip_ends(c.zones, c.attraction, 0.1, 0.5))


@query("e44_trip_ends", f"WITH {ENDS} SELECT zone_idx, round(origin, 6) AS origin, destination_proxy, round(destination, 6) AS destination FROM en")
def _(c):
    return rounded(demand.trip_ends(c.zones, c.attraction, 0.1, 0.5))


def _round_sql(rounds: int) -> str:
    steps, last = [], "b0"
    for k in range(rounds):
        steps.append(f"r{k} AS (SELECT origin_zone, dest_zone, cost_s, o, d, t * o / sum(t) OVER (PARTITION BY origin_zone) AS t FROM {last})")
        steps.append(f"b{k + 1} AS (SELECT origin_zone, dest_zone, cost_s, o, d, t * d / sum(t) OVER (PARTITION BY dest_zone) AS t FROM r{k})")
        last = f"b{k + 1}"
    return (
        f"WITH {MATRIX}, {ENDS}, b0 AS (SELECT origin_zone, dest_zone, p25_s AS cost_s, eo.origin AS o, ed.destination AS d, exp(-0.02 * p25_s / 60) AS t FROM m "
        "JOIN en eo ON eo.zone_idx = origin_zone JOIN en ed ON ed.zone_idx = dest_zone WHERE origin_zone <> dest_zone AND eo.origin > 0 AND ed.destination > 0), "
        + ", ".join(steps) + f" SELECT origin_zone, dest_zone, cost_s, round(t, 6) AS trips FROM {last}"
    )


@query("k02_balance_rounds", _round_sql(5))
def _(c):
    return rounded(demand.balance_rounds(_pairs(c), 0.02, 5))


@query("k02_balance")
def _(c):
    return rounded(demand.balance(demand.bipartite_blocks(_pairs(c)), 0.02), 4)


@query("c08_live_pairs", f"WITH {MATRIX}, {ENDS} SELECT origin_zone, dest_zone FROM m JOIN en a ON a.zone_idx = origin_zone JOIN en b ON b.zone_idx = dest_zone WHERE origin_zone <> dest_zone AND a.origin > 0 AND b.destination > 0")
def _(c):
    return _pairs(c).select("origin_zone", "dest_zone")


@query("e43_time_bands", f"WITH {MATRIX}, j AS (SELECT od.purpose, od.trips, m.p25_s / 60 AS mi FROM od JOIN m USING (origin_zone, dest_zone)), g AS (SELECT purpose, trips, mi FROM j UNION ALL SELECT 'all', trips, mi FROM j) SELECT purpose, sum(trips) AS trips, round(sum(trips * mi) / sum(trips), 6) AS mean_min, coalesce(sum(trips) FILTER (WHERE mi <= 15), 0) AS to_15, coalesce(sum(trips) FILTER (WHERE mi > 15 AND mi <= 30), 0) AS to_30, coalesce(sum(trips) FILTER (WHERE mi > 30 AND mi <= 60), 0) AS to_60, coalesce(sum(trips) FILTER (WHERE mi > 60), 0) AS over_60 FROM g GROUP BY purpose")
def _(c):
    rows = c.od.join(_matrix(c).select("origin_zone", "dest_zone", F.col("p25_s").alias("cost_s")), ["origin_zone", "dest_zone"])
    return rounded(demand.time_bands(rows, [15, 30, 60], scalar.band_of))


@query("e17_pair_table", "SELECT origin_zone, dest_zone, sum(trips) AS trips FROM od GROUP BY ALL HAVING sum(trips) > 0")
def _(c):
    return loads.pair_table(c.od)


@query("e18_by_origin", "SELECT origin_zone, len(list(dest_zone)) AS n, string_agg(CAST(dest_zone AS VARCHAR), ',' ORDER BY dest_zone) AS dests FROM (SELECT DISTINCT origin_zone, dest_zone FROM od WHERE trips > 0) x GROUP BY origin_zone")
def _(c):
    rows = loads.by_origin(loads.pair_table(c.od))
    return rows.select("origin_zone", F.size("dests").cast("long").alias("n"), F.array_join(F.transform("dests", lambda x: x.cast("string")), ",").alias("dests"))


@query("e57_gateway_table", "SELECT zone_idx, gateway, passengers, round(passengers / sum(passengers) OVER (PARTITION BY zone_idx), 9) AS share FROM (SELECT s_nationkey AS zone_idx, s_suppkey AS gateway, CAST(abs(round(s_acctbal)) AS BIGINT) AS passengers FROM supplier) x")
def _(c):
    rows = c.supplier.select(F.col("s_nationkey").alias("zone_idx"), F.col("s_suppkey").alias("gateway"), F.abs(F.round("s_acctbal")).cast("long").alias("passengers"))
    return rounded(demand.gateway_table(rows), 9)


@query("e45_gateway_od", "SELECT g.zone_idx AS origin_zone, a.zone_idx AS dest_zone, round(g.passengers * 0.3 * a.employment_score / (SELECT sum(employment_score) FROM attraction), 9) AS trips FROM (SELECT CAST(s_nationkey AS BIGINT) AS zone_idx, CAST(count(*) AS DOUBLE) AS passengers FROM supplier GROUP BY 1) g CROSS JOIN attraction a")
def _(c):
    gates = c.supplier.groupBy(F.col("s_nationkey").cast("long").alias("zone_idx")).agg(F.count(F.lit(1)).cast("double").alias("passengers"))
    weights = c.attraction.select(F.col("zone_idx").alias("dest_zone"), F.col("employment_score").alias("w")).join(c.zones.select(F.col("zone_idx").alias("origin_zone")))
    return rounded(demand.gateway_od(gates, weights, 0.3), 9)
