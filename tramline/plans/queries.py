"""One query per operator over the canonical views, and the SQL that its result must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions import geo, scalar, stats
from tramline.operators import access, demand, graph, joins, loads, optimise, scenario, search, windows
from tramline.plans.adapters import Canon, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EARTH = geo.EARTH_M
PEAK = (28800, 36000)
CURVE = {"seated": 1.0, "seated_slope": 0.09, "standing": 1.43, "standing_slope": 0.13}
BOX = (77.01, 12.01, 77.15, 12.15)


def query(name: str, sql: str | None = None):
    def add(make: Callable[[Canon], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Canon(spark, sf_dir))
        if sql:
            SQL[name] = oracle(sql)
        return make

    return add


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums doesn't show."""
    return frame.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


def _matrix(c: Canon) -> DataFrame:
    return access.percentile_matrix(c.samples, 7200)


MATRIX = """m0 AS (
  SELECT origin_zone, dest_zone, quantile_disc(coalesce(seconds, 1073741824), 0.25) AS a, quantile_disc(coalesce(seconds, 1073741824), 0.5) AS b,
    quantile_disc(coalesce(seconds, 1073741824), 0.75) AS c FROM samples GROUP BY ALL),
m AS (
  SELECT origin_zone, dest_zone, a AS p25_s, CASE WHEN b <= 7200 THEN b END AS p50_s, CASE WHEN c <= 7200 THEN c END AS p75_s FROM m0 WHERE a <= 7200)"""
SHARES = """sh AS (
  SELECT z.zone_idx, a.employment_score / (SELECT sum(employment_score) FROM attraction) AS est_jobs,
    CAST(z.population AS DOUBLE) / (SELECT sum(population) FROM zones) AS population FROM zones z JOIN attraction a USING (zone_idx))"""
LONG = "lm AS (SELECT origin_zone, dest_zone, unnest([25, 50, 75]) AS percentile, unnest([p25_s, p50_s, p75_s]) AS seconds FROM m)"
CUMULATIVE = f"""{MATRIX}, {SHARES}, {LONG},
cu AS (
  SELECT z.zone_idx, p.percentile, t.threshold_min, coalesce(sum(sh.est_jobs) FILTER (WHERE lm.seconds <= t.threshold_min * 60), 0) AS est_jobs,
    coalesce(sum(sh.population) FILTER (WHERE lm.seconds <= t.threshold_min * 60), 0) AS population
  FROM zones z CROSS JOIN (SELECT unnest([25, 50, 75]) AS percentile) p CROSS JOIN (SELECT unnest([15, 30, 45, 60]) AS threshold_min) t
  LEFT JOIN lm ON lm.origin_zone = z.zone_idx AND lm.percentile = p.percentile LEFT JOIN sh ON sh.zone_idx = lm.dest_zone GROUP BY ALL)"""


# Accessibility


@query("e01_cumulative", f"WITH {CUMULATIVE} SELECT zone_idx, percentile, threshold_min, round(est_jobs, 6) AS est_jobs, round(population, 6) AS population FROM cu")
def _(c):
    shares = access.opportunities(c.zones, c.attraction, "employment_score")
    return rounded(access.cumulative(_matrix(c), shares, ["est_jobs", "population"]))


@query("e07_percentile_matrix", f"WITH {MATRIX} SELECT * FROM m")
def _(c):
    return _matrix(c)


@query(
    "e02_headline_sensitivity",
    f"""WITH {MATRIX}, w AS (SELECT zone_idx, employment_score / (SELECT sum(employment_score) FROM attraction) AS jobs,
      wealth / (SELECT sum(wealth) FROM attraction) AS wealth FROM attraction),
    s AS (SELECT t.threshold_min, coalesce(sum(jobs) FILTER (WHERE p50_s <= t.threshold_min * 60), 0) / 25 AS j,
      coalesce(sum(w.wealth) FILTER (WHERE p50_s <= t.threshold_min * 60), 0) / 25 AS v
      FROM (SELECT unnest([15, 30, 45, 60]) AS threshold_min) t CROSS JOIN m JOIN w ON w.zone_idx = m.dest_zone GROUP BY ALL)
    SELECT 'jobs' AS weighting, threshold_min, round(j, 6) AS share, round(j - j, 6) AS change FROM s
    UNION ALL SELECT 'wealth', threshold_min, round(v, 6), round(v - j, 6) FROM s""",
)
def _(c):
    every = Window.partitionBy()
    share = lambda x: c.attraction.select("zone_idx", (F.col(x) / F.sum(x).over(every)).alias("share"))
    return rounded(access.headline_sensitivity(_matrix(c), {"jobs": share("employment_score"), "wealth": share("wealth")}, 50))


@query("e03_opportunities", f"WITH {SHARES} SELECT zone_idx, round(est_jobs, 9) AS est_jobs, round(population, 9) AS population FROM sh")
def _(c):
    return rounded(access.opportunities(c.zones, c.attraction, "employment_score"), 9)


@query(
    "e04_summaries",
    f"""WITH {CUMULATIVE}, ed AS (SELECT zone_idx FROM zones WHERE zone_idx % 4 = 0),
    r AS (SELECT s.scope, percentile, threshold_min, cu.est_jobs AS v, CAST(z.population AS DOUBLE) AS w, zone_idx FROM cu JOIN zones z USING (zone_idx)
      CROSS JOIN (SELECT unnest(['all', 'no_edge']) AS scope) s WHERE s.scope = 'all' OR zone_idx NOT IN (SELECT zone_idx FROM ed)),
    st AS (SELECT scope, percentile, threshold_min, v, sum(w) AS w FROM r GROUP BY ALL),
    k AS (SELECT *, sum(w) OVER (PARTITION BY scope, percentile, threshold_min ORDER BY v) AS upto, sum(w) OVER (PARTITION BY scope, percentile, threshold_min) AS tot FROM st)
    SELECT scope, percentile, threshold_min, round(sum(v * w) / sum(w), 6) AS mean, round(coalesce(sum(w) FILTER (WHERE v < 0.01), 0) / sum(w), 6) AS share_below,
      round(min(v) FILTER (WHERE upto >= tot * 0.1 - 1e-12), 6) AS q10, round(min(v) FILTER (WHERE upto >= tot * 0.25 - 1e-12), 6) AS q25,
      round(min(v) FILTER (WHERE upto >= tot * 0.5 - 1e-12), 6) AS q50, round(min(v) FILTER (WHERE upto >= tot * 0.75 - 1e-12), 6) AS q75,
      round(min(v) FILTER (WHERE upto >= tot * 0.9 - 1e-12), 6) AS q90,
      round(CASE WHEN sum(w) > 0 AND sum(w * v) > 0 THEN sum(w * v * (2 * upto - w - tot)) / (sum(w) * sum(w * v)) ELSE 0 END, 6) AS gini
    FROM k GROUP BY ALL""",
)
def _(c):
    shares = access.opportunities(c.zones, c.attraction, "employment_score")
    # Equal shares must be one step whatever the order they were summed in.
    table = rounded(access.cumulative(_matrix(c), shares, ["est_jobs"]), 12)
    return rounded(access.summaries(table, c.zones, c.zones.where("zone_idx % 4 = 0").select("zone_idx"), "est_jobs"))


@query(
    "e50_wide_table",
    f"WITH {CUMULATIVE} SELECT zone_idx, " + ", ".join(f"round(max(est_jobs) FILTER (WHERE percentile = {p} AND threshold_min = {t}), 6) AS p{p}_t{t}" for p in (25, 50, 75) for t in (15, 30, 45, 60)) + " FROM cu GROUP BY zone_idx",
)
def _(c):
    shares = access.opportunities(c.zones, c.attraction, "employment_score")
    return rounded(access.wide(access.cumulative(_matrix(c), shares, ["est_jobs"]), "est_jobs"))


@query("c07_candidate_pairs", f"WITH {MATRIX} SELECT origin_zone, dest_zone, p50_s AS cost_s FROM m WHERE p50_s IS NOT NULL AND origin_zone <> dest_zone")
def _(c):
    return access.candidate_pairs(_matrix(c), "p50_s")


@query("h06_merge_origins", f"WITH {MATRIX} SELECT origin_zone, dest_zone, p25_s, CASE WHEN origin_zone % 3 = 0 THEN NULL ELSE p50_s END AS p50_s, p75_s FROM m")
def _(c):
    m = _matrix(c)
    fresh = m.where("origin_zone % 3 = 0").withColumn("p50_s", F.lit(None).cast("long"))
    return access.merge_origins(m, fresh, m.where("origin_zone % 3 = 0").select("origin_zone").distinct())


@query(
    "c11_edge_zones",
    f"""SELECT zone_idx, least((lon - {BOX[0]}) * cos(radians(lat)) * {EARTH} * pi() / 180, ({BOX[2]} - lon) * cos(radians(lat)) * {EARTH} * pi() / 180,
      (lat - {BOX[1]}) * {EARTH} * pi() / 180, ({BOX[3]} - lat) * {EARTH} * pi() / 180) < 2000 AS edge_zone FROM zones""",
)
def _(c):
    return c.zones.select("zone_idx", geo.near_box_edge("lat", "lon", BOX, 2000).alias("edge_zone"))


@query("c05_inside_box", f"SELECT stop_idx FROM stops WHERE lat BETWEEN {BOX[1]} AND {BOX[3]} AND lon BETWEEN {BOX[0]} AND {BOX[2]}")
def _(c):
    return c.stops.where(geo.in_box("lat", "lon", BOX)).select("stop_idx")


@query("c14_zone_points", "SELECT zone_idx, CASE WHEN population > 50 THEN lat + 0.001 ELSE lat END AS lat, CASE WHEN population > 50 THEN lon + 0.001 ELSE lon END AS lon, CASE WHEN population > 50 THEN 'population' ELSE 'centre' END AS point_kind FROM zones")
def _(c):
    own = F.when(F.col("population") > 50, 0.001)
    return c.zones.select("zone_idx", *access.zone_point(F.col("lat"), F.col("lon"), F.col("lat") + own, F.col("lon") + own))


# Joins


@query("d02_parent_lookup", "SELECT s.stop_idx, s.name, p.name AS parent_name FROM stops s LEFT JOIN stops p ON s.parent_stop_idx = p.stop_idx")
def _(c):
    parents = c.stops.select(F.col("stop_idx").alias("parent_stop_idx"), F.col("name").alias("parent_name"))
    return c.stops.select("stop_idx", "name", "parent_stop_idx").join(parents, "parent_stop_idx", "left").drop("parent_stop_idx")


@query("c06_null_rejecting_anti", "SELECT stop_idx, parent_stop_idx FROM stops WHERE parent_stop_idx IS NOT NULL AND parent_stop_idx NOT IN (SELECT stop_idx FROM stops WHERE stop_idx % 10 = 0)")
def _(c):
    hit = c.stops.where("stop_idx % 10 = 0").select(F.col("stop_idx").alias("parent_stop_idx"))
    return joins.not_in(c.stops.select("stop_idx", "parent_stop_idx"), hit, "parent_stop_idx")


@query("d03_semi_stop_times", "SELECT trip_idx, position, stop_idx FROM stop_times WHERE trip_idx IN (SELECT trip_idx FROM trips WHERE route_idx % 7 = 0)")
def _(c):
    return c.stop_times.join(c.trips.where("route_idx % 7 = 0"), "trip_idx", "left_semi").select("trip_idx", "position", "stop_idx")


@query(
    "d05_full_outer_flows",
    """SELECT coalesce(a.s, b.s) AS station_idx, coalesce(entries, 0) AS entries, coalesce(exits, 0) AS exits FROM
    (SELECT entry_station AS s, sum(passengers) AS entries FROM gates WHERE entry_station > 0 GROUP BY 1) a FULL JOIN
    (SELECT exit_station AS s, sum(passengers) AS exits FROM gates WHERE exit_station < 20 GROUP BY 1) b ON a.s = b.s""",
)
def _(c):
    a = c.gates.where("entry_station > 0").groupBy(F.col("entry_station").alias("station_idx")).agg(F.sum("passengers").alias("entries"))
    b = c.gates.where("exit_station < 20").groupBy(F.col("exit_station").alias("station_idx")).agg(F.sum("passengers").alias("exits"))
    return joins.full_with_zero(a, b, ["station_idx"])


HAVERSINE = "2 * {r} * asin(sqrt(least(1.0, power(sin(radians({b1} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({b1})) * power(sin(radians({b2} - {a2}) / 2), 2))))"


def _hav(a1, a2, b1, b2):
    return HAVERSINE.format(r=EARTH, a1=a1, a2=a2, b1=b1, b2=b2)


@query("d06_distance_join", f"SELECT z.zone_idx, s.stop_idx, round({_hav('z.lat', 'z.lon', 's.lat', 's.lon')}, 3) AS metres FROM zones z, stops s WHERE {_hav('z.lat', 'z.lon', 's.lat', 's.lon')} <= 4000")
def _(c):
    stops = c.stops.select("stop_idx", F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    return rounded(joins.within_distance(c.zones.select("zone_idx", "lat", "lon"), stops, 4000).select("zone_idx", "stop_idx", "metres"), 3)


@query(
    "d06_ride_access",
    f"""SELECT z.zone_idx, s.stop_idx, CAST(ceil(300 + {_hav('z.lat', 'z.lon', 's.lat', 's.lon')} * 1.3 / (15 / 3.6)) AS BIGINT) AS seconds FROM zones z, stops s
    WHERE {_hav('z.lat', 'z.lon', 's.lat', 's.lon')} <= 4000 AND (z.zone_idx + s.stop_idx) % 3 <> 0""",
)
def _(c):
    stops = c.stops.select("stop_idx", F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    walks = c.zones.select("zone_idx").join(c.stops.select("stop_idx"), (F.col("zone_idx") + F.col("stop_idx")) % 3 == 0)
    return joins.ride_access(c.zones.select("zone_idx", "lat", "lon"), stops, walks, 4.0, 15.0, 1.3, 5.0)


@query("d10_nearest_stop", f"WITH d AS (SELECT z.zone_idx, s.stop_idx, {_hav('z.lat', 'z.lon', 's.lat', 's.lon')} AS metres FROM zones z, stops s) SELECT zone_idx, stop_idx, round(metres, 3) AS metres FROM d WHERE metres <= 6000 QUALIFY row_number() OVER (PARTITION BY zone_idx ORDER BY metres, stop_idx) = 1")
def _(c):
    stops = c.stops.select("stop_idx", F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    return rounded(joins.nearest(c.zones, stops, "zone_idx", "stop_idx", 6000), 3)


@query("d14_as_of_departure", "SELECT c.event_id, c.at, (SELECT min(first_s) FROM trips WHERE route_idx = c.route_idx AND first_s >= c.at) AS first_s FROM (SELECT event_id, user_id % 20 AS route_idx, t % 86400 AS at FROM calls) c")
def _(c):
    asks = c.calls.select("event_id", (F.col("user_id") % 20).alias("route_idx"), (F.col("t") % 86400).alias("at"))
    return joins.as_of(asks, c.trips.select("route_idx", "first_s", "trip_idx"), ["route_idx"], "at", "first_s", ["trip_idx"]).select("event_id", "at", "first_s")


@query(
    "d15_nearest_in_time",
    """SELECT c.event_id, c.at, arg_min(t.first_s, abs(t.first_s - c.at) * 1000000 + t.first_s) AS first_s FROM
    (SELECT event_id, user_id % 20 AS route_idx, t % 86400 AS at FROM calls) c JOIN trips t USING (route_idx) GROUP BY ALL""",
)
def _(c):
    asks = c.calls.select("event_id", (F.col("user_id") % 20).alias("route_idx"), (F.col("t") % 86400).alias("at"))
    return joins.nearest_in_time(asks, c.trips.select("route_idx", "first_s", "trip_idx"), ["route_idx"], "at", "first_s", ["trip_idx"]).select("event_id", "at", "first_s")


@query("d07_near_duplicates", f"SELECT a.stop_idx AS a, b.stop_idx AS b FROM stops a JOIN stops b ON a.stop_idx < b.stop_idx WHERE {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 12000")
def _(c):
    left = c.stops.select(F.col("stop_idx").alias("a"), "lat", "lon")
    right = c.stops.select(F.col("stop_idx").alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    return joins.within_distance(left, right, 12000).where("a < b").select("a", "b")


@query(
    "d16_changed_signatures",
    """WITH s AS (SELECT trip_idx, string_agg(stop_idx || '|' || arrival, ',' ORDER BY position) AS signature FROM stop_times GROUP BY trip_idx),
    a AS (SELECT DISTINCT signature FROM s WHERE trip_idx % 10 < 6), b AS (SELECT DISTINCT signature FROM s WHERE trip_idx % 10 > 3)
    SELECT 'a' AS side, signature FROM a WHERE signature NOT IN (SELECT signature FROM b) UNION ALL SELECT 'b', signature FROM b WHERE signature NOT IN (SELECT signature FROM a)""",
)
def _(c):
    s = windows.signature(c.stop_times, ["trip_idx"], "position", ["stop_idx", "arrival"])
    return joins.changed_content(s.where("trip_idx % 10 < 6"), s.where("trip_idx % 10 > 3")).select("side", "signature")


@query("d12_point_in_cell", "SELECT stop_idx, CAST(floor((lat + 90) / 0.05) AS BIGINT) * 4294967296 + CAST(floor((lon + 180) / 0.05) AS BIGINT) AS cell FROM stops")
def _(c):
    return c.stops.select("stop_idx", geo.cell_of("lat", "lon", 0.05).alias("cell"))


# Windows


@query("f01_neighbours", "SELECT event_id, lag(t) OVER w AS prev_t, lead(t) OVER w AS next_t FROM calls WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)")
def _(c):
    return windows.neighbours(c.calls, ["user_id"], ["t", "event_id"], ["t"]).select("event_id", "prev_t", "next_t")


@query("f03_running_sums", "SELECT event_id, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS upto, round(coalesce(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS before FROM calls WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)")
def _(c):
    rows = windows.running_sum(c.calls, ["user_id"], ["t", "event_id"], "value", "upto")
    return rounded(windows.running_sum(rows, ["user_id"], ["t", "event_id"], "value", "before", exclusive=True).select("event_id", "upto", "before"))


@query(
    "f04_fills",
    """SELECT event_id, last_value(v IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_v,
    first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_v
    FROM (SELECT event_id, user_id, t, CASE WHEN event_id % 3 = 0 THEN event_id END AS v FROM calls) x WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)""",
)
def _(c):
    rows = c.calls.withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("event_id")))
    return windows.fills(rows, ["user_id"], ["t", "event_id"], "v").select("event_id", "last_v", "next_v")


@query(
    "f05_islands",
    """WITH a AS (SELECT event_id, user_id, t, value > 30 AS inside FROM calls),
    b AS (SELECT *, CASE WHEN inside AND NOT coalesce(lag(inside) OVER w, false) THEN 1 ELSE 0 END AS s FROM a WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM b),
    n AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS k FROM r WHERE inside)
    SELECT event_id, user_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY run) - 1 AS INTEGER) AS piece FROM n WHERE k >= 2""",
)
def _(c):
    return windows.islands(c.calls, ["user_id"], ["t", "event_id"], F.col("value") > 30).select("event_id", "user_id", "piece")


@query("f05_sessions", "SELECT event_id, CAST(sum(g) OVER (PARTITION BY user_id ORDER BY t, event_id) AS INTEGER) AS session FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 3600 THEN 1 ELSE 0 END AS g FROM calls) x")
def _(c):
    return windows.sessions(c.calls, ["user_id"], "t", 3600, "event_id").select("event_id", "session")


@query("f06_numbered", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS INTEGER) AS k FROM calls")
def _(c):
    return windows.numbered(c.calls, ["user_id"], ["t", "event_id"], "k").select("event_id", "k")


@query("f10_top_per_key", "SELECT event_id, user_id, value FROM calls QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def _(c):
    return windows.top_rows(c.calls, ["user_id"], [F.desc("value"), "event_id"]).select("event_id", "user_id", "value")


@query("f11_dense_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS idx FROM orders")
def _(c):
    return windows.dense_index(c.orders.select("o_orderpriority", "o_orderkey"), ["o_orderpriority", "o_orderkey"], "idx").select("o_orderkey", "idx")


@query("f12_duplicates", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1")
def _(c):
    return windows.duplicates(c.lineitem, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("f13_rank_with_tie_break", "SELECT zone_idx, row_number() OVER (ORDER BY employment_score DESC, zone_idx) AS score_rank FROM attraction")
def _(c):
    return c.attraction.select("zone_idx", F.row_number().over(Window.orderBy(F.desc("employment_score"), "zone_idx")).cast("long").alias("score_rank"))


@query("f14_spearman", "WITH r AS (SELECT rank() OVER (ORDER BY a.employment_score) + (count(*) OVER (PARTITION BY a.employment_score) - 1) / 2.0 AS x, rank() OVER (ORDER BY z.population) + (count(*) OVER (PARTITION BY z.population) - 1) / 2.0 AS y FROM attraction a JOIN zones z USING (zone_idx)) SELECT round(corr(x, y), 9) AS spearman FROM r")
def _(c):
    return rounded(stats.spearman(c.attraction.join(c.zones, "zone_idx"), "employment_score", "population"), 9)


@query("f15_share_of_total", "SELECT origin_zone, dest_zone, purpose, round(trips / sum(trips) OVER (PARTITION BY origin_zone), 9) AS share FROM od")
def _(c):
    return rounded(windows.share_of_total(c.od, ["origin_zone"], "trips", "share").select("origin_zone", "dest_zone", "purpose", "share"), 9)


@query("f15_logit_share", "WITH e AS (SELECT origin_zone, dest_zone, purpose, exp(-0.12 * (trips - min(trips) OVER (PARTITION BY origin_zone, dest_zone))) AS e FROM od) SELECT origin_zone, dest_zone, purpose, round(e / sum(e) OVER (PARTITION BY origin_zone, dest_zone), 9) AS share FROM e")
def _(c):
    return rounded(windows.logit_share(c.od, ["origin_zone", "dest_zone"], "trips", 0.12, "share").select("origin_zone", "dest_zone", "purpose", "share"), 9)


@query("e54_trip_signature", "SELECT trip_idx, string_agg(stop_idx || '|' || arrival || '|' || departure, ',' ORDER BY position) AS signature FROM stop_times GROUP BY trip_idx")
def _(c):
    return windows.signature(c.stop_times, ["trip_idx"], "position", ["stop_idx", "arrival", "departure"])


@query("g05_top_fraction", "SELECT p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) <= (SELECT greatest(1, count(*) // 20) FROM part)")
def _(c):
    return windows.top_fraction(c.part, [F.desc("p_retailprice"), "p_partkey"], 0.05).select("p_partkey", "p_retailprice")


@query("g06_top_by_absolute_delta", "SELECT s_suppkey, round(s_acctbal, 2) AS bal FROM supplier ORDER BY abs(s_acctbal) DESC, s_suppkey LIMIT 10")
def _(c):
    return c.supplier.orderBy(F.abs("s_acctbal").desc(), "s_suppkey").limit(10).select("s_suppkey", F.round("s_acctbal", 2).alias("bal"))
