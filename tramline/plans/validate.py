"""Rules of a timetable feed. Every finding: rule, severity, file, n, examples (five at most, sorted)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions.geo import haversine_m
from tramline.functions.scalar import clock_seconds, compact_date, lenient_double, lenient_long
from tramline.operators.joins import within_distance
from tramline.operators.windows import duplicates, signature

SCHEMA = "rule string, severity string, file string, n long, examples array<string>"
#: Most kilometres an hour by route type, and other thresholds. Fixed values.
SPEED_KMH = {0: 70, 1: 120, 2: 160, 3: 80, 11: 80, 12: 120}
DEFAULT_KMH = 150
ZERO_HOP_M = 100
NEAR_M = 5
EXAMPLES = 5
#: Required columns and key of each file. Fixed values.
REQUIRED = {
    "stops": (["stop_id"], ["stop_id"]), "routes": (["route_id", "route_type"], ["route_id"]),
    "trips": (["route_id", "service_id", "trip_id"], ["trip_id"]),
    "stop_times": (["trip_id", "stop_id", "stop_sequence"], ["trip_id", "stop_sequence"]), "agency": (["agency_name"], ["agency_id"]),
    "calendar": (["service_id", "start_date", "end_date"], ["service_id"]), "calendar_dates": (["service_id", "date", "exception_type"], ["service_id", "date"]),
}
FOREIGN = [
    ("unknown_route", "trips", "route_id", "routes", "route_id"), ("unknown_trip", "stop_times", "trip_id", "trips", "trip_id"),
    ("unknown_stop", "stop_times", "stop_id", "stops", "stop_id"), ("unknown_parent_station", "stops", "parent_station", "stops", "stop_id"),
    ("unknown_shape", "trips", "shape_id", "shapes", "shape_id"), ("unknown_agency", "routes", "agency_id", "agency", "agency_id"),
]
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def finding(rows: DataFrame, example: Column, rule: str, severity: str, file: str) -> DataFrame:
    """One row if any: the exact count, and the first examples by order without gathering all of them."""
    held = rows.select(example.cast("string").alias("e"))
    first = held.distinct().orderBy("e").limit(EXAMPLES).agg(F.array_sort(F.collect_list("e")).alias("examples"))
    counted = held.agg(F.count(F.lit(1)).alias("n"))
    return counted.join(first).where("n > 0").select(  # one row each
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(file).alias("file"), "n", "examples"
    )


def structural(tables: dict[str, DataFrame]) -> list[DataFrame]:
    out = []
    for file, (columns, key) in REQUIRED.items():
        if file not in tables:
            continue
        table = tables[file]
        for c in columns:
            if c in table.columns:
                out.append(finding(table.where(F.col(c).isNull()), F.lit(c), "missing_value", "error", file))
        if all(k in table.columns for k in key):
            out.append(finding(duplicates(table, key), F.concat_ws(",", *key), "duplicate_key", "error", file))
    for rule, file, column, parent, parent_key in FOREIGN:
        if file in tables and parent in tables and column in tables[file].columns:
            used = tables[file].where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
            out.append(finding(used.join(tables[parent].select(F.col(parent_key).alias("v")), "v", "left_anti"), F.col("v"), rule, "error", file))
    if {"calendar", "calendar_dates"} & tables.keys() and "trips" in tables:
        known = reduce(lambda a, b: a.union(b), [tables[t].select("service_id") for t in ("calendar", "calendar_dates") if t in tables])
        unknown = tables["trips"].where("service_id is not null").join(known, "service_id", "left_anti")
        out.append(finding(unknown, F.col("service_id"), "unknown_service", "error", "trips"))
    if {"stops", "stop_times", "routes", "trips"} <= tables.keys():
        stops, times, routes, trips = (tables[t] for t in ("stops", "stop_times", "routes", "trips"))
        kind = F.coalesce(lenient_long("location_type"), F.lit(0)) if "location_type" in stops.columns else F.lit(0)
        out.append(finding(stops.where(kind == 0).join(times, "stop_id", "left_anti"), F.col("stop_id"), "unused_stop", "warning", "stops"))
        out.append(finding(routes.join(trips, "route_id", "left_anti"), F.col("route_id"), "route_without_trips", "warning", "routes"))
        out.append(finding(trips.join(times, "trip_id", "left_anti"), F.col("trip_id"), "trip_without_stop_times", "warning", "trips"))
        single = times.groupBy("trip_id").count().where("count = 1")
        out.append(finding(single, F.col("trip_id"), "trip_with_one_stop", "warning", "stop_times"))
        named = [c for c in ("route_short_name", "route_long_name") if c in routes.columns]
        if named:
            out.append(finding(routes.where(F.coalesce(*named).isNull()), F.col("route_id"), "missing_route_name", "error", "routes"))
    if "stops" in tables and "stop_name" in tables["stops"].columns:
        out.append(near_duplicate_stops(tables["stops"]))
    return out


def near_duplicate_stops(stops: DataFrame, metres: float = NEAR_M) -> DataFrame:
    """Two stops of one name within a few metres that aren't parts of one station."""
    parent = F.coalesce("parent_station", "stop_id") if "parent_station" in stops.columns else F.col("stop_id")
    rows = stops.select("stop_id", F.lower("stop_name").alias("name"), parent.alias("parent"), lenient_double("stop_lat").alias("lat"), lenient_double("stop_lon").alias("lon"))
    other = rows.select(F.col("stop_id").alias("id_b"), "name", F.col("parent").alias("parent_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    pairs = within_distance(rows.where("lat is not null and lon is not null"), other, metres, on=["name"]).where("stop_id < id_b")
    pairs = pairs.where(~F.coalesce(F.col("parent") == F.col("parent_b"), F.lit(False)))
    return finding(pairs, F.concat_ws("/", "stop_id", "id_b"), "near_duplicate_stops", "warning", "stops")


def semantic(tables: dict[str, DataFrame], box=None) -> list[DataFrame]:
    out = []
    if "stops" in tables:
        lat, lon = lenient_double("stop_lat"), lenient_double("stop_lon")
        rows = tables["stops"].withColumns({"_lat": lat, "_lon": lon})
        own = F.col("stop_id")
        none = F.col("stop_lat").isNull() | F.col("stop_lon").isNull()
        out.append(finding(rows.where(none), own, "missing_coordinate", "error", "stops"))
        out.append(finding(rows.where(~none & (F.col("_lat").isNull() | F.col("_lon").isNull())), own, "invalid_coordinate", "error", "stops"))
        wide = (F.abs("_lat") > 90) | (F.abs("_lon") > 180)
        out.append(finding(rows.where(wide), own, "coordinate_out_of_range", "error", "stops"))
        zero = (F.col("_lat") == 0) & (F.col("_lon") == 0)
        out.append(finding(rows.where(zero), own, "zero_coordinate", "error", "stops"))
        if box:
            outside = ~(F.col("_lon").between(box[0], box[2]) & F.col("_lat").between(box[1], box[3]))
            out.append(finding(rows.where(outside & ~wide & ~zero), own, "outside_bbox", "warning", "stops"))
    if "stop_times" in tables:
        out += times_rules(tables)
    if "calendar" in tables or "calendar_dates" in tables:
        out += calendar_rules(tables)
    if "frequencies" in tables:
        t = tables["frequencies"]
        start, end, gap = clock_seconds("start_time"), clock_seconds("end_time"), lenient_long("headway_secs")
        bad = F.coalesce(start.isNull() | end.isNull() | gap.isNull() | (gap <= 0) | (end <= start), F.lit(True))
        out.append(finding(t.where(bad), F.col("trip_id"), "invalid_frequency", "error", "frequencies"))
    if "shapes" in tables:
        out += shape_rules(tables)
    return out


def times_rules(tables: dict[str, DataFrame]) -> list[DataFrame]:
    raw = tables["stop_times"]
    rows = raw.withColumns({"a": clock_seconds("arrival_time"), "d": clock_seconds("departure_time"), "q": lenient_long("stop_sequence")})
    own, file = F.col("trip_id"), "stop_times"
    given = (F.col("arrival_time").isNotNull() & F.col("a").isNull()) | (F.col("departure_time").isNotNull() & F.col("d").isNull())
    w = Window.partitionBy("trip_id").orderBy("q")
    flow = rows.withColumns(
        {
            "k": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("trip_id")),
            "last": F.last("d", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    untimed = F.col("arrival_time").isNull() & F.col("departure_time").isNull()
    ends = (F.col("k") == 1) | (F.col("k") == F.col("n"))
    out = [
        finding(rows.where(given), own, "invalid_time", "error", file),
        finding(rows.where(F.col("stop_sequence").isNotNull() & (F.col("q").isNull() | (F.col("q") < 0))), own, "invalid_stop_sequence", "error", file),
        finding(rows.where("a > d"), own, "arrival_after_departure", "error", file),
        finding(rows.where(F.greatest("a", "d") > 48 * 3600), own, "time_beyond_48h", "warning", file),
        finding(flow.where(untimed & ends), own, "missing_endpoint_time", "error", file),
        finding(flow.where(untimed & ~ends), own, "untimed_intermediate_stops", "info", file),
        finding(flow.where(F.col("a") < F.col("last")), own, "decreasing_time", "error", file),
        finding(rows.where(F.greatest("a", "d") >= 24 * 3600).select("trip_id").distinct(), own, "after_midnight_trips", "info", file),
    ]
    if {"stops", "trips", "routes"} <= tables.keys():
        out += hop_rules(tables, rows)
        trips = tables["trips"].join(signature(rows, ["trip_id"], "q", ["stop_id", "a", "d"]), "trip_id")
        again = Window.partitionBy("route_id", "service_id", "signature").orderBy("trip_id")
        out.append(finding(trips.withColumn("k", F.row_number().over(again)).where("k > 1"), own, "duplicate_trips", "warning", "trips"))
    return out


def hop_rules(tables: dict[str, DataFrame], rows: DataFrame) -> list[DataFrame]:
    """Hops without time over a distance, and hops faster than their route type allows."""
    stops = tables["stops"].select("stop_id", lenient_double("stop_lat").alias("lat"), lenient_double("stop_lon").alias("lon"))
    kinds = tables["trips"].select("trip_id", "route_id").join(tables["routes"].select("route_id", lenient_long("route_type").alias("kind")), "route_id")
    w = Window.partitionBy("trip_id").orderBy("q")
    placed = rows.join(stops, "stop_id")
    hops = placed.select(
        "trip_id", haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")).alias("m"), (F.col("a") - F.lag("d").over(w)).alias("s")
    ).join(kinds.select("trip_id", "kind"), "trip_id")
    limit = F.lit(DEFAULT_KMH)
    for kind, kmh in SPEED_KMH.items():
        limit = F.when(F.col("kind") == kind, kmh).otherwise(limit)
    own = F.col("trip_id")
    return [
        finding(hops.where((F.col("s") == 0) & (F.col("m") > ZERO_HOP_M)), own, "zero_time_hop", "warning", "stop_times"),
        finding(hops.where((F.col("s") > 0) & (F.try_divide("m", "s") * 3.6 > limit)), own, "implausible_speed", "warning", "stop_times"),
    ]


def calendar_rules(tables: dict[str, DataFrame]) -> list[DataFrame]:
    out = []
    if "calendar" in tables:
        c = tables["calendar"].withColumns({"_s": compact_date("start_date"), "_e": compact_date("end_date")})
        own = F.col("service_id")
        out.append(finding(c.where("_s is null or _e is null"), own, "invalid_date", "error", "calendar"))
        out.append(finding(c.where("_s > _e"), own, "start_after_end", "error", "calendar"))
        bad = reduce(lambda a, b: a | b, [~F.coalesce(F.col(d).isin("0", "1"), F.lit(False)) for d in DAYS if d in c.columns], F.lit(False))
        out.append(finding(c.where(bad), own, "invalid_weekday_flag", "error", "calendar"))
        idle = reduce(lambda a, b: a & b, [F.coalesce(F.col(d), F.lit("0")) == "0" for d in DAYS if d in c.columns], F.lit(True))
        never = c.where(idle)
        if "calendar_dates" in tables:
            never = never.join(tables["calendar_dates"].where("exception_type = '1'"), "service_id", "left_anti")
        out.append(finding(never, own, "service_never_runs", "warning", "calendar"))
    if "calendar_dates" in tables:
        d = tables["calendar_dates"]
        out.append(finding(d.where(compact_date("date").isNull()), F.col("service_id"), "invalid_date", "error", "calendar_dates"))
        out.append(finding(d.where(~F.coalesce(F.col("exception_type").isin("1", "2"), F.lit(False))), F.col("service_id"), "invalid_exception_type", "error", "calendar_dates"))
    return out


def shape_rules(tables: dict[str, DataFrame]) -> list[DataFrame]:
    s = tables["shapes"].withColumns({"_lat": lenient_double("shape_pt_lat"), "_lon": lenient_double("shape_pt_lon"), "_q": lenient_long("shape_pt_sequence")})
    own = F.col("shape_id")
    out = [finding(s.where("_lat is null or _lon is null or _q is null"), own, "invalid_shape_point", "error", "shapes")]
    if "shape_dist_traveled" in s.columns:
        w = Window.partitionBy("shape_id").orderBy("_q")
        back = s.withColumn("_d", lenient_double("shape_dist_traveled")).withColumn("_p", F.lag("_d").over(w)).where("_d < _p")
        out.append(finding(back, own, "decreasing_shape_distance", "warning", "shapes"))
    if "trips" in tables and "shape_id" in tables["trips"].columns:
        out.append(finding(s.select("shape_id").distinct().join(tables["trips"], "shape_id", "left_anti"), own, "unused_shape", "info", "shapes"))
    return out


def validate(spark: SparkSession, tables: dict[str, DataFrame], unreadable: dict[str, str] | None = None, box=None) -> DataFrame:
    """All findings, by severity, rule and file."""
    driver = [("unreadable_file", "error", n, 1, [why]) for n, why in (unreadable or {}).items()]
    driver += [("missing_required_file", "error", n, 1, []) for n in ("agency", "stops", "routes", "trips", "stop_times") if n not in tables]
    if not {"calendar", "calendar_dates"} & tables.keys():
        driver.append(("missing_calendar", "error", "calendar", 1, []))
    driver += [
        ("missing_required_column", "error", f, 1, [c]) for f, (columns, _) in REQUIRED.items() if f in tables for c in columns if c not in tables[f].columns
    ]
    parts = [spark.createDataFrame(driver, SCHEMA), *structural(tables), *semantic(tables, box)]
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy(rank, "rule", "file")
