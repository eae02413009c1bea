"""Reading timetable feeds, street extracts, places, rasters, ridership and settings."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions.geo import cell_of, in_box
from tramline.functions.scalar import clean_text, lenient_double


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header: all columns text, trimmed, empty as null."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return raw.select(*[clean_text(F.col(f"`{c}`")).alias(c.replace("﻿", "").strip()) for c in raw.columns])


@dataclass
class Feed:
    tables: dict[str, DataFrame]
    unreadable: dict[str, str]


def load_feed(spark: SparkSession, folder: str) -> Feed:
    """Every *.txt of a folder on any file system; files that can't be read are recorded, not raised."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    tables, bad = {}, {}
    for path in sorted(str(x.getPath()) for x in listed if str(x.getPath()).endswith(".txt")):
        name = path.rpartition("/")[2].removesuffix(".txt")
        try:
            table = read_text_table(spark, path)
            if not table.columns:
                raise ValueError("no header")
            tables[name] = table
        except Exception as e:  # any parse error is a finding
            bad[name] = str(e)[:200]
    return Feed(tables, bad)


#: Street classes that may be walked, and tag values that forbid or allow it. Fixed values.
WALKABLE = (
    "footway", "path", "pedestrian", "steps", "living_street", "residential", "service", "unclassified", "tertiary",
    "tertiary_link", "secondary", "secondary_link", "primary", "primary_link", "track", "road", "corridor", "crossing",
)
FOOT_NO, ACCESS_NO, FOOT_YES = ("no", "private", "use_sidepath"), ("no", "private"), ("yes", "designated", "permissive")


def exclusion(tags: Column, walkable: tuple[str, ...] = WALKABLE) -> Column:
    """Why a way can't be walked; null if it can. An explicit permission on foot overrides a closed access."""
    kind, foot, access = tags["highway"], tags["foot"], tags["access"]
    return (
        F.when(kind.isNull(), "no highway").when(~kind.isin(*walkable), "highway").when(foot.isin(*FOOT_NO), "foot")
        .when(access.isin(*ACCESS_NO) & ~F.coalesce(foot.isin(*FOOT_YES), F.lit(False)), "access")
    )


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, lat, lon, tags) and ways (way, nodes, tags) of an OSM XML extract."""
    tag = "array<struct<_k:string,_v:string>>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id long, _lat double, _lon double, tag {tag}").load(path)
    ways = spark.read.format("xml").option("rowTag", "way").schema(f"_id long, nd array<struct<_ref:long>>, tag {tag}").load(path)

    def tags(x: str) -> Column:
        return F.map_from_entries(F.coalesce(F.transform(x, lambda t: F.struct(t["_k"], t["_v"])), F.array().cast("array<struct<k:string,v:string>>")))

    return (
        nodes.select(F.col("_id").alias("node"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), tags("tag").alias("tags")),
        ways.select(F.col("_id").alias("way"), F.col("nd._ref").alias("nodes"), tags("tag").alias("tags")),
    )


def walk_segments(nodes: DataFrame, ways: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """way, from_node, to_node and coordinates: each pair of consecutive nodes of a walkable way, both inside the box."""
    held = ways.where(exclusion(F.col("tags")).isNull()).select("way", F.posexplode("nodes").alias("k", "node"))
    w = Window.partitionBy("way").orderBy("k")
    inside = nodes.where(in_box("lat", "lon", box)).select("node", "lat", "lon")
    placed = held.join(inside, "node", "left")
    pairs = placed.withColumns({"to_node": F.lead("node").over(w), "lat_b": F.lead("lat").over(w), "lon_b": F.lead("lon").over(w)})
    pairs = pairs.where("lat is not null and lat_b is not null and node <> to_node")
    return pairs.select("way", F.col("node").alias("from_node"), "to_node", F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), "lat_b", "lon_b")


#: Tags of places by category; the first match wins. Fixed values.
HEALTH = ("hospital", "clinic", "doctors", "dentist", "pharmacy")
EDUCATION = ("school", "college", "university", "kindergarten")
FOOD = ("restaurant", "cafe", "fast_food", "food_court", "bar", "pub", "ice_cream")
NOT_A_PLACE = (
    "atm", "bench", "bicycle_parking", "clock", "drinking_water", "fountain", "motorcycle_parking", "parking", "parking_entrance",
    "parking_space", "post_box", "recycling", "shelter", "telephone", "toilets", "vending_machine", "waste_basket", "waste_disposal",
    "water_point",
)


def classify(tags: Column) -> Column:
    """Category of a place: office, shop, health, education, food, craft, industrial, amenity_other, else null."""
    amenity = tags["amenity"]
    return (
        F.when(tags["office"].isNotNull(), "office").when(tags["shop"].isNotNull(), "shop")
        .when(amenity.isin(*HEALTH) | tags["healthcare"].isNotNull(), "health").when(amenity.isin(*EDUCATION), "education")
        .when(amenity.isin(*FOOD), "food").when(tags["craft"].isNotNull(), "craft")
        .when((tags["landuse"] == "industrial") | (tags["man_made"] == "works"), "industrial")
        .when(amenity.isNotNull() & ~amenity.isin(*NOT_A_PLACE), "amenity_other")
    )


def pois(nodes: DataFrame, ways: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """osm_type, osm_id, category, lat, lon inside the box; a way lies at the mean of its nodes."""
    own = nodes.select(F.lit("node").alias("osm_type"), F.col("node").alias("osm_id"), classify(F.col("tags")).alias("category"), "lat", "lon")
    named = ways.withColumn("category", classify(F.col("tags"))).where("category is not null")
    parts = named.select("way", "category", F.explode(F.array_distinct("nodes")).alias("node")).join(nodes.select("node", "lat", "lon"), "node")
    mean = parts.groupBy("way", "category").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    mean = mean.select(F.lit("way").alias("osm_type"), F.col("way").alias("osm_id"), "category", "lat", "lon")
    return own.where("category is not null").unionByName(mean).where(in_box("lat", "lon", box))


def read_buildings(spark: SparkSession, path: str) -> DataFrame:
    """latitude, longitude, area, confidence from CSV, compressed or not."""
    raw = read_text_table(spark, path)
    return raw.select(
        lenient_double("latitude").alias("lat"), lenient_double("longitude").alias("lon"),
        lenient_double("area_in_meters").alias("area"), lenient_double("confidence").alias("confidence"),
    )


def read_hubs(spark: SparkSession, path: str) -> DataFrame:
    """name and rings (arrays of [lon, lat]) of the polygons of a GeoJSON file, by name. Unnamed or repeated hubs are an error."""
    ring = "array<array<double>>"
    schema = f"features array<struct<properties:struct<name:string>,geometry:struct<type:string,coordinates:string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    rows = raw.select(F.col("f.properties.name").alias("name"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    rings = F.when(F.col("type") == "Polygon", F.array(F.from_json("c", f"array<{ring}>"))).otherwise(F.from_json("c", f"array<array<{ring}>>"))
    named = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("name")))
    bad = F.col("name").isNull() | (F.col("n") > 1)
    name = F.when(bad, F.raise_error(F.lit("hubs need unique names"))).otherwise(F.col("name"))
    return named.select(name.alias("name"), rings.alias("polygons")).orderBy("name")


def pixels(frame: DataFrame, west: float, north: float, step: float, cell: float) -> DataFrame:
    """Pixels (row, col, value) with lat and lon of their centres and the zone cell they lie in."""
    lat, lon = F.lit(north) - (F.col("row") + 0.5) * step, F.lit(west) + (F.col("col") + 0.5) * step
    return frame.withColumns({"lat": lat, "lon": lon}).withColumn("cell", cell_of("lat", "lon", cell))


@dataclass(frozen=True)
class RidershipLayout:
    """Where a provider's ridership files keep what."""

    date: str
    hour: str
    station: str
    trips: str
    origin: str = ""
    destination: str = ""


LAYOUTS = {"hourly": RidershipLayout("Date", "Hour", "Station", "Ridership", "Origin Station", "Destination Station")}


def read_ridership(spark: SparkSession, entries: str, exits: str, layout: str, stations: DataFrame) -> DataFrame:
    """date, hour, station_idx, entries, exits. Unknown stations, bad hours, negative counts and repeats are an error."""
    own = LAYOUTS[layout]

    def side(path: str, name: str) -> DataFrame:
        rows = spark.read.parquet(path)
        return rows.select(
            F.col(f"`{own.date}`").cast("date").alias("date"), F.col(f"`{own.hour}`").cast("int").alias("hour"),
            F.trim(F.col(f"`{own.station}`")).alias("name"), F.col(f"`{own.trips}`").cast("double").alias(name),
        )

    both = side(entries, "entries").join(side(exits, "exits"), ["date", "hour", "name"], "full").fillna(0.0)
    both = both.join(stations.select("name", "station_idx"), "name", "left")
    both = both.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date", "hour", "name")))
    bad = F.col("station_idx").isNull() | ~F.col("hour").between(0, 23) | (F.col("entries") < 0) | (F.col("exits") < 0) | (F.col("n") > 1)
    checked = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("ridership row isn't valid: "), F.coalesce("name", F.lit("?"))))).otherwise(F.col("station_idx"))
    return both.select("date", "hour", checked.alias("station_idx"), "entries", "exits")


def strict_settings(path: str, sections: dict[str, set[str]]) -> dict:
    """TOML whose sections and keys must be known."""
    raw = tomllib.loads(Path(path).read_text())
    unknown = [f"[{s}]" for s in raw if s not in sections]
    unknown += [f"{s}.{k}" for s, own in raw.items() if s in sections and isinstance(own, dict) for k in own if k not in sections[s]]
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return raw


def run_sql(spark: SparkSession, sql: str, tables: dict[str, str], args: dict | None = None) -> DataFrame:
    """A statement over Parquet paths as views, with named parameters."""
    for name, path in tables.items():
        spark.read.parquet(path).createOrReplaceTempView(name)
    return spark.sql(sql, args=args or {})
