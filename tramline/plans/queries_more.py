"""Queries of filters, set operations, sorts, small aggregates and conversions, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tramline.functions import geo, scalar, stats
from tramline.operators import demand, joins, loads, windows
from tramline.plans.queries import MATRIX, PEAK, _hav, _matrix, query, rounded


@query("c01_conform", "SELECT CAST(stop_idx AS INTEGER) AS stop_idx, name, lat, lon, CAST(parent_stop_idx AS INTEGER) AS parent_stop_idx FROM stops")
def _(c):
    return c.stops.select(F.col("stop_idx").cast("int"), "name", "lat", "lon", F.col("parent_stop_idx").cast("int"))


@query("c03_route_name_exclusion", "SELECT p_partkey FROM part WHERE NOT (regexp_matches(p_brand, '3$') OR regexp_matches(p_type, '^PRO'))")
def _(c):
    return c.part.where(~(F.col("p_brand").rlike("3$") | F.col("p_type").rlike("^PRO"))).select("p_partkey")


@query("c04_location_type", "SELECT stop_idx FROM stops WHERE coalesce(CASE WHEN stop_idx % 4 = 0 THEN NULL ELSE stop_idx % 4 END, 0) IN (0, 1)")
def _(c):
    kind = F.when(F.col("stop_idx") % 4 != 0, F.col("stop_idx") % 4)
    return c.stops.where(F.coalesce(kind, F.lit(0)).isin(0, 1)).select("stop_idx")


@query("c09_half_open_window", f"SELECT trip_idx FROM trips WHERE first_s >= {PEAK[0]} AND first_s < {PEAK[1]}")
def _(c):
    return c.trips.where(loads.in_window(*PEAK, "first_s")).select("trip_idx")


@query("c10_walk_pairs", "SELECT origin_zone, dest_zone FROM (SELECT origin_zone, dest_zone, count(*) AS reached, count(*) FILTER (WHERE raw_s <= 3600) AS walked FROM journeys GROUP BY ALL) x WHERE walked * 2 >= reached")
def _(c):
    reach = c.journeys.groupBy("origin_zone", "dest_zone").agg(F.count(F.lit(1)).alias("reached"), F.count_if(F.col("raw_s") <= 3600).alias("walked"))
    return demand.walk_pairs(reach).select("origin_zone", "dest_zone")


@query("c13_within_tolerance", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_quantity * 60 - l_linenumber * 600) <= l_linenumber * 600 * 0.2e0 OR abs(l_quantity * 60 - l_linenumber * 600) <= 300 AS ok FROM lineitem")
def _(c):
    ok = scalar.within_tolerance(F.col("l_quantity") * 60, F.col("l_linenumber") * 600, 0.2, 5.0)
    return c.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ok.alias("ok"))


@query("d01_trips_with_dims", "SELECT t.trip_idx, r.short_name, r.mode, t.direction_id FROM trips t JOIN routes r ON t.route_idx = r.route_idx")
def _(c):
    return c.trips.join(c.routes, "route_idx").select("trip_idx", "short_name", "mode", "direction_id")


@query("d04_anti_walk_pairs", f"WITH {MATRIX} SELECT origin_zone, dest_zone, purpose, trips FROM od WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.origin_zone = od.origin_zone AND m.dest_zone = od.dest_zone AND p25_s <= 1800)")
def _(c):
    near = _matrix(c).where("p25_s <= 1800").select("origin_zone", "dest_zone")
    return c.od.join(near, ["origin_zone", "dest_zone"], "left_anti").select("origin_zone", "dest_zone", "purpose", "trips")


@query("d17_lookup", "SELECT short_name, min(route_idx) AS route_idx FROM routes WHERE short_name IN ('R1', 'R7', 'R99') GROUP BY short_name HAVING count(*) = 1")
def _(c):
    names = c.routes.where(F.col("short_name").isin("R1", "R7")).select("short_name")
    return joins.lookup(names, c.routes.select("short_name", "route_idx"), "short_name", "route_idx")[0]


@query("d19_reach_from_zone", f"WITH {MATRIX} SELECT dest_zone, z.name, p50_s FROM m JOIN zones z ON z.zone_idx = m.dest_zone WHERE origin_zone = 3 AND p50_s <= 3600")
def _(c):
    reach = _matrix(c).where("origin_zone = 3 and p50_s <= 3600").join(c.zones.select(F.col("zone_idx").alias("dest_zone"), "name"), "dest_zone")
    return reach.select("dest_zone", "name", "p50_s")


@query("e08_nearest_quantiles", "WITH v AS (SELECT l_quantity AS q, row_number() OVER (ORDER BY l_quantity) - 1 AS k, count(*) OVER () AS n FROM lineitem) SELECT max(q) FILTER (WHERE k = CAST(round(0.5e0 * (n - 1)) AS BIGINT)) AS q50, max(q) FILTER (WHERE k = CAST(round(0.95e0 * (n - 1)) AS BIGINT)) AS q95 FROM v")
def _(c):
    # Ranks come from counts per value, so that no task sorts the table.
    counts = c.lineitem.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("k"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.orderBy("l_quantity"))).withColumn("n", F.sum("k").over(Window.partitionBy()))
    pick = lambda p: F.min(F.when(F.col("upto") > F.round(p * (F.col("n") - 1)), F.col("l_quantity")))
    return upto.agg(pick(0.5).alias("q50"), pick(0.95).alias("q95"))


@query("e12_population_by_cell", "SELECT CAST(floor((lat + 90) / 0.05) AS BIGINT) * 4294967296 + CAST(floor((lon + 180) / 0.05) AS BIGINT) AS cell, CAST(sum(population) AS BIGINT) AS population, round(sum(population * lat) / sum(population), 6) AS pop_lat, round(sum(population * lon) / sum(population), 6) AS pop_lon FROM zones WHERE population > 0 GROUP BY 1")
def _(c):
    rows = c.zones.where("population > 0").withColumn("cell", geo.cell_of("lat", "lon", 0.05)).groupBy("cell")
    mean = lambda x: F.sum(F.col("population") * F.col(x)) / F.sum("population")
    return rounded(rows.agg(F.sum("population").alias("population"), mean("lat").alias("pop_lat"), mean("lon").alias("pop_lon")))


@query("e13_landcover_shares", "SELECT region, round(count(*) FILTER (WHERE zone_idx % 3 = 0) / count(*), 6) AS landcover_40, round(count(*) FILTER (WHERE zone_idx % 3 = 1) / count(*), 6) AS landcover_50 FROM zones GROUP BY region")
def _(c):
    share = lambda k: F.count_if(F.col("zone_idx") % 3 == k) / F.count(F.lit(1))
    return rounded(c.zones.groupBy("region").agg(share(0).alias("landcover_40"), share(1).alias("landcover_50")))


@query("e15_employment_score", "SELECT zone_idx, round(0.7e0 * wealth / (SELECT sum(wealth) FROM attraction) + 0.3e0 * employment_score / (SELECT sum(employment_score) FROM attraction), 9) AS score FROM attraction")
def _(c):
    every = Window.partitionBy()
    score = 0.7 * F.col("wealth") / F.sum("wealth").over(every) + 0.3 * F.col("employment_score") / F.sum("employment_score").over(every)
    return rounded(c.attraction.select("zone_idx", score.alias("score")), 9)


@query("e27_demand_station_flows", "SELECT (origin_zone % 5) * 5 AS entry_station, (dest_zone % 5) * 5 AS exit_station, sum(trips * CASE WHEN (origin_zone + dest_zone) % 2 = 0 THEN 0.5e0 ELSE 1.0e0 END) AS trips FROM od GROUP BY ALL")
def _(c):
    pairs = c.od.select("origin_zone", "dest_zone").distinct()
    share = F.when((F.col("origin_zone") + F.col("dest_zone")) % 2 == 0, 0.5).otherwise(1.0)
    shares = pairs.select("*", (F.col("origin_zone") % 5 * 5).alias("entry_station"), (F.col("dest_zone") % 5 * 5).alias("exit_station"), share.alias("share"))
    return demand.station_flows(c.od, shares)


@query("e51_ratio_percentiles", "SELECT round(avg(l_extendedprice / l_quantity), 6) AS mean, round(quantile_cont(l_extendedprice / l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice / l_quantity, 0.95), 6) AS p95 FROM lineitem")
def _(c):
    x = F.col("l_extendedprice") / F.col("l_quantity")
    return rounded(stats.percentiles(c.lineitem, x, {"p50": 0.5, "p95": 0.95}))


@query("e55_straight_km", f"SELECT a.zone_idx AS origin_zone, b.zone_idx AS dest_zone, round({_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 1000, 6) AS distance_km FROM (SELECT DISTINCT origin_zone, dest_zone FROM od) o JOIN zones a ON a.zone_idx = o.origin_zone JOIN zones b ON b.zone_idx = o.dest_zone")
def _(c):
    a = c.zones.select(F.col("zone_idx").alias("origin_zone"), F.col("lat").alias("la"), F.col("lon").alias("oa"))
    b = c.zones.select(F.col("zone_idx").alias("dest_zone"), F.col("lat").alias("lb"), F.col("lon").alias("ob"))
    pairs = c.od.select("origin_zone", "dest_zone").distinct().join(a, "origin_zone").join(b, "dest_zone")
    return rounded(pairs.select("origin_zone", "dest_zone", geo.great_circle_km("la", "oa", "lb", "ob").alias("distance_km")))


@query("e56_counts_by_kind", "SELECT event_type, count(*) AS n FROM calls GROUP BY event_type")
def _(c):
    return c.calls.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("g03_nulls_last", "SELECT stop_idx, parent_stop_idx, row_number() OVER (ORDER BY parent_stop_idx DESC NULLS LAST, stop_idx) AS k FROM stops")
def _(c):
    w = Window.orderBy(F.desc_nulls_last("parent_stop_idx"), "stop_idx")
    return c.stops.select("stop_idx", "parent_stop_idx", F.row_number().over(w).cast("long").alias("k"))


@query("g04_busiest_routes", "SELECT route_idx, count(*) AS trips FROM trips GROUP BY route_idx ORDER BY trips DESC, route_idx LIMIT 5")
def _(c):
    return c.trips.groupBy("route_idx").agg(F.count(F.lit(1)).alias("trips")).orderBy(F.desc("trips"), "route_idx").limit(5)


@query("g07_seeded_sample")
def _(c):
    return windows.sample_rows(c.orders.select("o_orderkey"), ["o_orderkey"], 7, 200)


@query("g08_examples", "SELECT event_type, count(*) AS n, string_agg(u, ',' ORDER BY u) FILTER (WHERE k <= 5) AS examples FROM (SELECT event_type, CAST(user_id AS VARCHAR) AS u, dense_rank() OVER (PARTITION BY event_type ORDER BY CAST(user_id AS VARCHAR)) AS k FROM (SELECT DISTINCT event_type, user_id FROM calls)) x GROUP BY event_type")
def _(c):
    held = c.calls.select("event_type", F.col("user_id").cast("string").alias("u")).distinct()
    first = windows.top_rows(held, ["event_type"], ["u"], 5).groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list("u")), ",").alias("examples"))
    return held.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).join(first, "event_type")


@query("h01_union_all", "SELECT route_idx AS id, short_name AS name, CAST(NULL AS BIGINT) AS parent FROM routes UNION ALL SELECT stop_idx, name, parent_stop_idx FROM stops")
def _(c):
    a = c.routes.select(F.col("route_idx").alias("id"), F.col("short_name").alias("name"))
    b = c.stops.select(F.col("stop_idx").alias("id"), "name", F.col("parent_stop_idx").alias("parent"))
    return a.unionByName(b, allowMissingColumns=True)


@query("h02_union_distinct", "SELECT stop_idx FROM pattern_stops WHERE route_idx < 5 UNION SELECT stop_idx FROM pattern_stops WHERE route_idx > 12")
def _(c):
    return c.pattern_stops.where("route_idx < 5").select("stop_idx").union(c.pattern_stops.where("route_idx > 12").select("stop_idx")).distinct()


@query("h04_difference", "SELECT stop_idx FROM stops EXCEPT SELECT stop_idx FROM pattern_stops WHERE route_idx < 3")
def _(c):
    return c.stops.select("stop_idx").exceptAll(c.pattern_stops.where("route_idx < 3").select("stop_idx").distinct())


@query("h05_top_overlap", "SELECT count(*) AS shared FROM (SELECT zone_idx FROM attraction ORDER BY employment_score DESC, zone_idx LIMIT 5) a JOIN (SELECT zone_idx FROM attraction ORDER BY wealth DESC, zone_idx LIMIT 5) b USING (zone_idx)")
def _(c):
    top = lambda x: c.attraction.orderBy(F.desc(x), "zone_idx").limit(5).select("zone_idx")
    return top("employment_score").intersect(top("wealth")).agg(F.count(F.lit(1)).alias("shared"))


@query("i03_half_up", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice / 7 + 0.5e0) AS BIGINT) AS units FROM lineitem")
def _(c):
    return c.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalar.half_up(F.col("l_extendedprice") / 7).alias("units"))


@query("i09_haversine", f"SELECT a.stop_idx, round({_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS metres FROM stops a JOIN stops b ON b.stop_idx = a.stop_idx + 1")
def _(c):
    b = c.stops.select((F.col("stop_idx") - 1).alias("stop_idx"), F.col("lat").alias("lb"), F.col("lon").alias("ob"))
    return rounded(c.stops.join(b, "stop_idx").select("stop_idx", geo.haversine_m("lat", "lon", "lb", "ob").alias("metres")), 3)


@query("i13_departure_weights", "SELECT s AS departure, round(CASE WHEN s < 32400 THEN 0.465e0 ELSE 0.535e0 END / 60 / (0.465e0 + 0.535e0), 9) AS weight FROM (SELECT unnest(generate_series(28800, 35999, 60)) AS s) x")
def _(c):
    rows = c.spark.range(28800, 36000, 60).select(F.col("id").alias("departure"))
    hourly = F.when(F.col("departure") < 32400, 0.465).otherwise(0.535) / 60
    return rounded(rows.select("departure", (hourly / F.sum(hourly).over(Window.partitionBy())).alias("weight")), 9)


@query("i16_hash", "SELECT o_orderkey, sha256(o_orderpriority || ':' || o_orderkey) AS key FROM orders")
def _(c):
    return c.orders.select("o_orderkey", F.sha2(F.concat_ws(":", "o_orderpriority", F.col("o_orderkey").cast("string")), 256).alias("key"))


@query("i17_colour_cap", "SELECT quantile_disc(s_acctbal, 0.98) AS cap FROM supplier WHERE s_acctbal > 0")
def _(c):
    return c.supplier.where("s_acctbal > 0").agg(F.expr("percentile_disc(0.98) WITHIN GROUP (ORDER BY s_acctbal)").alias("cap"))
