"""Passenger loads on scheduled trips, and the measures derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import great_circle_km
from tramline.functions.scalar import crowding_multiplier, ratio
from tramline.functions.stats import geh

#: Relative error that sums of passengers may have.
CONSERVED = 1e-9


def pair_table(od: DataFrame) -> DataFrame:
    """origin_zone, dest_zone, trips: all purposes together, pairs without trips left out."""
    return od.groupBy("origin_zone", "dest_zone").agg(F.sum("trips").alias("trips")).where("trips > 0")


def by_origin(pairs: DataFrame) -> DataFrame:
    """origin_zone, dests (sorted), trips: one row per origin; bounded by the number of zones."""
    return pairs.groupBy("origin_zone").agg(F.array_sort(F.collect_list(F.struct("dest_zone", "trips"))).alias("x")).select(
        "origin_zone", F.col("x.dest_zone").alias("dests"), F.col("x.trips").alias("trips")
    )


def vehicle_of(rules: list[tuple[Column, str]], default: Column) -> Column:
    """Name of the first matching rule's vehicle, else the mode's default."""
    out = default
    for test, vehicle in reversed(rules):
        out = F.when(test, F.lit(vehicle)).otherwise(out)
    return out


def capacities(trips: DataFrame, vehicles: DataFrame, design: float, crush: float) -> DataFrame:
    """trips (vehicle) with seats, area, capacity, crush_capacity from vehicles (vehicle, seats, area)."""
    return trips.join(vehicles, "vehicle", "left").withColumns(
        {
            "capacity": (F.col("seats") + F.floor(F.lit(design) * F.col("area"))).cast("long"),
            "crush_capacity": (F.col("seats") + F.floor(F.lit(crush) * F.col("area"))).cast("long"),
        }
    )


def segment_loads(stop_times: DataFrame, flows: DataFrame, capacity: DataFrame) -> DataFrame:
    """One row per trip and hop: boardings, alightings, load, capacities and factors.

    stop_times: trip_idx, position, stop_idx, arrival, departure. flows: trip_idx,
    position, boardings, alightings. Loads are running sums; a trip that doesn't end
    empty is an error.
    """
    w = Window.partitionBy("trip_idx").orderBy("position")
    rows = stop_times.join(flows, ["trip_idx", "position"], "left").fillna(0.0, ["boardings", "alightings"])
    rows = rows.withColumns(
        {
            "load": F.sum(F.col("boardings") - F.col("alightings")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "to_stop_idx": F.lead("stop_idx").over(w), "arrival_next": F.lead("arrival").over(w),
            "_boarded": F.sum("boardings").over(Window.partitionBy("trip_idx")),
        }
    )
    wrong = F.col("to_stop_idx").isNull() & (F.abs("load") > CONSERVED * F.greatest(F.col("_boarded"), F.lit(1.0)))
    checked = F.when(wrong, F.raise_error(F.lit("a trip doesn't end empty"))).otherwise(F.greatest(F.col("load"), F.lit(0.0)))
    rows = rows.withColumn("load", checked.cast("double")).where("to_stop_idx is not null")
    rows = rows.join(capacity.select("trip_idx", "vehicle", "seats", "capacity", "crush_capacity"), "trip_idx", "left")
    return rows.select(
        "trip_idx", "position", F.col("stop_idx").alias("from_stop_idx"), "to_stop_idx", "departure", F.col("arrival_next").alias("arrival"),
        F.col("boardings").cast("double").alias("boardings"), F.col("alightings").cast("double").alias("alightings"), "load", "vehicle", "seats",
        "capacity", "crush_capacity", ratio("load", "capacity").alias("load_factor"), ratio("load", "crush_capacity").alias("crush_factor"),
    )


def stop_flows(flows: DataFrame, stop_times: DataFrame) -> DataFrame:
    """stop_idx, boardings, alightings; stops without either left out."""
    rows = flows.join(stop_times.select("trip_idx", "position", "stop_idx"), ["trip_idx", "position"])
    sums = rows.groupBy("stop_idx").agg(F.sum("boardings").alias("boardings"), F.sum("alightings").alias("alightings"))
    return sums.where("boardings + alightings > 0")


def with_distances(loads: DataFrame, stops: DataFrame) -> DataFrame:
    """loads with km, the great-circle length of each hop."""
    a = stops.select(F.col("stop_idx").alias("from_stop_idx"), F.col("lat").alias("_la"), F.col("lon").alias("_oa"))
    b = stops.select(F.col("stop_idx").alias("to_stop_idx"), F.col("lat").alias("_lb"), F.col("lon").alias("_ob"))
    joined = loads.join(a, "from_stop_idx").join(b, "to_stop_idx")
    return joined.withColumn("km", great_circle_km("_la", "_oa", "_lb", "_ob")).drop("_la", "_oa", "_lb", "_ob")


def in_window(start: int, end: int, column: str = "departure") -> Column:
    """Half-open: start <= departure < end."""
    return (F.col(column) >= start) & (F.col(column) < end)


def route_metrics(loads: DataFrame, trips: DataFrame, window: tuple[int, int]) -> DataFrame:
    """Per route: trips and peak trips, boardings, passenger and vehicle km, utilisation, highest factor, crowded share."""
    peak = in_window(*window)
    rows = loads.join(trips.select("trip_idx", "route_idx"), "trip_idx")
    return rows.groupBy("route_idx").agg(
        F.countDistinct("trip_idx").alias("trips"), F.countDistinct(F.when(peak, F.col("trip_idx"))).alias("peak_trips"),
        F.sum("boardings").alias("boardings"), F.sum(F.when(peak, F.col("boardings")).otherwise(0.0)).alias("peak_boardings"),
        F.sum(F.col("load") * F.col("km")).alias("passenger_km"),
        F.try_divide(F.sum(F.col("load") * F.col("km")), F.sum(F.col("capacity") * F.col("km"))).alias("utilisation"),
        F.max("load_factor").alias("max_load_factor"),
        F.avg((F.col("load_factor") > 1).cast("double")).alias("share_over_capacity"),
    )


def city_metrics(loads: DataFrame) -> DataFrame:
    """One row: boardings, passenger km and hours, mean load factor by passenger km, crowded share of passenger km."""
    pkm, hours = F.col("load") * F.col("km"), F.col("load") * (F.col("arrival") - F.col("departure")) / 3600
    crowded = F.sum(F.when(F.col("load_factor") > 1, pkm).otherwise(0.0))
    return loads.agg(
        F.sum("boardings").alias("boardings"), F.sum(pkm).alias("passenger_km"), F.sum(hours).alias("passenger_hours"),
        F.try_divide(F.sum(pkm * F.col("load_factor")), F.sum(pkm)).alias("mean_load_factor"),
        F.try_divide(crowded, F.sum(pkm)).alias("crowded_share"),
    )


def gate_flows(gates: DataFrame, stations: DataFrame) -> DataFrame:
    """station_idx, entries, exits of every station; gates: entry_station, exit_station, passengers."""
    entries = gates.groupBy(F.col("entry_station").alias("station_idx")).agg(F.sum("passengers").alias("entries"))
    exits = gates.groupBy(F.col("exit_station").alias("station_idx")).agg(F.sum("passengers").alias("exits"))
    return stations.select("station_idx").join(entries, "station_idx", "left").join(exits, "station_idx", "left").fillna(0.0)


def peak_segments(loads: DataFrame, trips: DataFrame, routes: DataFrame, window: tuple[int, int]) -> DataFrame:
    """Per route and directed stop pair in the window: trips, passengers, highest load and factor, capacity, mean factor, mode, short name.

    The mean factor is passengers over the places that all its trips offer; segments without passengers stay.
    """
    rows = loads.where(in_window(*window)).join(trips.select("trip_idx", "route_idx"), "trip_idx")
    found = rows.groupBy("route_idx", "from_stop_idx", "to_stop_idx").agg(
        F.count(F.lit(1)).alias("trips"), F.sum("load").alias("passengers"), F.max("load").alias("max_load"),
        F.max("load_factor").alias("max_load_factor"), F.min("capacity").alias("capacity"),
    )
    found = found.withColumn("mean_load_factor", F.try_divide("passengers", F.col("trips") * F.col("capacity")))
    return found.join(routes.select("route_idx", "mode", "short_name"), "route_idx", "left")


#: Upper edges of the bands of a load factor, and their names. Fixed values.
LOAD_EDGES = (0.5, 1.0, 1.5)
LOAD_LABELS = ("under 0.5", "0.5-1.0", "1.0-1.5", "over 1.5")


def load_bands(segments: DataFrame, mode: str = "bus") -> DataFrame:
    """All bands of the mean load factor: segments of a mode and their passengers, with shares; a segment without factor counts as empty."""
    own = segments.where(F.col("mode") == mode)
    factor, band = F.coalesce("mean_load_factor", F.lit(0.0)), F.lit(LOAD_LABELS[-1])
    for edge, label in reversed(list(zip(LOAD_EDGES, LOAD_LABELS))):  # the last label has no edge
        band = F.when(factor < edge, label).otherwise(band)
    rows = own.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("segments"), F.sum("passengers").alias("passengers"))
    bands = segments.sparkSession.createDataFrame([(x,) for x in LOAD_LABELS], "band string")
    rows = bands.join(rows, "band", "left").fillna(0, ["segments"]).fillna(0.0, ["passengers"])
    every = Window.partitionBy()  # four rows
    shares = {f"share_{c}": F.coalesce(F.try_divide(F.col(c), F.sum(c).over(every)), F.lit(0.0)) for c in ("segments", "passengers")}
    return rows.withColumns(shares)


def crowding_segments(loads: DataFrame, trips: DataFrame, bin_s: int | None = None) -> DataFrame:
    """Per directed stop pair, and time bin if given: vehicles, passengers, capacity, highest factor."""
    keys = ["from_stop_idx", "to_stop_idx"]
    rows = loads.join(trips.select("trip_idx"), "trip_idx", "left_semi")
    if bin_s:
        rows = rows.withColumn("bin", (F.floor(F.col("departure") / bin_s) * bin_s).cast("long"))
        keys = ["bin", *keys]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("vehicles"), F.sum("load").alias("passengers"), F.sum("capacity").alias("capacity"),
        F.max("load_factor").alias("max_load_factor"),
    )


def frames(loads: DataFrame, trips: DataFrame, bin_s: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows of each frame with a pair index, and frame totals with what rows under `least` passengers hold.

    The index numbers the directed stop pairs: a table bounded by the network, not by the loads.
    """
    rows = crowding_segments(loads, trips, bin_s)
    shown = rows.where(F.col("passengers") >= least)
    pairs = shown.select("from_stop_idx", "to_stop_idx").distinct()
    pairs = pairs.withColumn("pair", (F.row_number().over(Window.orderBy("from_stop_idx", "to_stop_idx")) - 1).cast("long"))
    totals = rows.groupBy("bin").agg(
        F.sum("passengers").alias("passengers"), F.sum(F.when(F.col("passengers") < least, F.col("passengers")).otherwise(0.0)).alias("dropped")
    )
    return shown.join(pairs, ["from_stop_idx", "to_stop_idx"]), totals


def station_fit(simulated: DataFrame, observed: DataFrame) -> DataFrame:
    """station_idx, simulated, observed, geh over a full outer join."""
    both = simulated.join(observed, "station_idx", "full").fillna(0.0)
    return both.withColumn("geh", geh(F.col("simulated"), F.col("observed")))


def station_set(lines: Column, name: Column, excluded: list[str], held_out: list[str]) -> Column:
    """excluded if all lines are, held_out by name, else training."""
    gone = F.forall(F.split(lines, r"\+"), lambda x: x.isin(*excluded)) if excluded else F.lit(False)
    return F.when(gone, "excluded").when(name.isin(*held_out) if held_out else F.lit(False), "held_out").otherwise("training")


def perceived_seconds(loads: DataFrame, curve: dict[str, float], crush: float) -> DataFrame:
    """trip_idx, position, seconds and crowded seconds of each hop, and both summed over the hops before it."""
    seconds = (F.col("arrival") - F.col("departure")).cast("double")
    area = F.coalesce("area", F.lit(0.0)) if "area" in loads.columns else F.lit(0.0)
    crowded = seconds * crowding_multiplier("load", "seats", area, curve, crush)
    before = Window.partitionBy("trip_idx").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    rows = loads.select("trip_idx", "position", seconds.alias("seconds"), crowded.alias("crowded_s"))
    return rows.withColumns(
        {"seconds_before": F.coalesce(F.sum("seconds").over(before), F.lit(0.0)), "crowded_before": F.coalesce(F.sum("crowded_s").over(before), F.lit(0.0))}
    )
