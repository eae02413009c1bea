"""Canonical views over the driver's tables, by one text for Spark and for the reference database.

The texts use macros where the two dialects differ: DAYS(a, b), SERIES(a, b)
and EPOCH(ts).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: View name -> text, in an order in which each uses only those before it and the tables.
VIEWS: dict[str, str] = {
    "zones": """SELECT CAST(n_nationkey AS BIGINT) AS zone_idx, n_name AS name, CAST(n_regionkey AS BIGINT) AS region,
        CAST(coalesce(people, 0) AS BIGINT) AS population, CAST(12.0 AS DOUBLE) + (n_nationkey * 37 % 100) * CAST(0.002 AS DOUBLE) AS lat, CAST(77.0 AS DOUBLE) + (n_nationkey * 53 % 100) * CAST(0.002 AS DOUBLE) AS lon
        FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS people FROM customer GROUP BY c_nationkey) c ON c_nationkey = n_nationkey""",
    "attraction": """SELECT CAST(n_nationkey AS BIGINT) AS zone_idx, CAST(coalesce(jobs, 0) AS DOUBLE) AS employment_score, CAST(coalesce(wealth, 0) AS DOUBLE) AS wealth
        FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS jobs, sum(CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0 END) AS wealth
        FROM supplier GROUP BY s_nationkey) s ON s_nationkey = n_nationkey""",
    "journeys": """SELECT CAST(c_nationkey AS BIGINT) AS origin_zone, CAST(s_nationkey AS BIGINT) AS dest_zone, c_mktsegment AS purpose,
        CAST(l_quantity AS DOUBLE) AS trips, CAST((abs(DAYS(l_shipdate, o_orderdate)) % 150) * 60 AS BIGINT) AS raw_s
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""",
    "samples": "SELECT origin_zone, dest_zone, CASE WHEN raw_s <= 7200 THEN raw_s END AS seconds FROM journeys",
    "od": "SELECT origin_zone, dest_zone, purpose, sum(trips) AS trips FROM journeys GROUP BY origin_zone, dest_zone, purpose",
    "stops": """SELECT CAST(k AS BIGINT) AS stop_idx, concat('Stop ', CAST(k AS VARCHAR(9))) AS name, CAST(12.0 AS DOUBLE) + (k * 37 % 100) * CAST(0.002 AS DOUBLE) AS lat, CAST(77.0 AS DOUBLE) + (k * 53 % 100) * CAST(0.002 AS DOUBLE) AS lon,
        CAST(CASE WHEN k % 5 = 0 THEN NULL ELSE k - k % 5 END AS BIGINT) AS parent_stop_idx FROM (SELECT SERIES(0, 24) AS k) x""",
    "routes": """SELECT CAST(r AS BIGINT) AS route_idx, concat('R', CAST(r AS VARCHAR(9))) AS short_name, CASE WHEN r % 4 = 0 THEN 'metro' WHEN r % 4 = 3 THEN 'tram' ELSE 'bus' END AS mode
        FROM (SELECT SERIES(0, 19) AS r) x""",
    "pattern_stops": """SELECT CAST(r AS BIGINT) AS route_idx, CAST(p AS BIGINT) AS position, CAST((r * 7 + p * (1 + r % 4)) % 25 AS BIGINT) AS stop_idx
        FROM (SELECT r, SERIES(0, 5) AS p FROM (SELECT SERIES(0, 19) AS r) x) y""",
    "trips": """SELECT o_orderkey AS trip_idx, o_custkey % 20 AS route_idx, 21600 + (o_orderkey * 97) % 57600 AS first_s, o_orderkey % 2 AS direction_id,
        o_orderpriority AS headsign FROM orders""",
    "stop_times": """SELECT trip_idx, position, stop_idx, first_s + position * (180 + t.route_idx * 7) AS arrival,
        first_s + position * (180 + t.route_idx * 7) + CASE WHEN position > 0 AND position < 5 THEN 15 ELSE 0 END AS departure
        FROM trips t JOIN pattern_stops p ON t.route_idx = p.route_idx""",
    "rides": """SELECT l_orderkey AS trip_idx, CAST((l_linenumber - 1) % 5 AS BIGINT) AS board,
        CAST((l_linenumber - 1) % 5 + 1 + l_partkey % (5 - (l_linenumber - 1) % 5) AS BIGINT) AS alight, CAST(l_quantity AS DOUBLE) AS pax, l_partkey FROM lineitem""",
    "flows": """SELECT trip_idx, position, sum(b) AS boardings, sum(a) AS alightings FROM (
        SELECT trip_idx, board AS position, pax AS b, 0.0 AS a FROM rides UNION ALL SELECT trip_idx, alight, 0.0, pax FROM rides) x GROUP BY trip_idx, position""",
    "capacity": """SELECT trip_idx, CASE WHEN r.mode = 'metro' THEN 'train' WHEN r.mode = 'tram' THEN 'car' ELSE 'bus' END AS vehicle,
        CAST(CASE WHEN r.mode = 'metro' THEN 90 WHEN r.mode = 'tram' THEN 60 ELSE 30 END AS DOUBLE) AS seats,
        CAST(CASE WHEN r.mode = 'metro' THEN 20 WHEN r.mode = 'tram' THEN 8 ELSE 0 END AS DOUBLE) AS area FROM trips t JOIN routes r ON t.route_idx = r.route_idx""",
    "calls": """SELECT event_id, user_id, event_type, CAST(value AS DOUBLE) AS value, EPOCH(ts) AS t FROM events""",
    "stations": """SELECT stop_idx AS station_idx, name, CASE WHEN stop_idx % 10 = 0 THEN 'A+B' WHEN stop_idx % 15 = 5 THEN 'B' ELSE 'A' END AS lines FROM stops WHERE parent_stop_idx IS NULL""",
    "gates": """SELECT (origin_zone % 5) * 5 AS entry_station, (dest_zone % 5) * 5 AS exit_station, sum(trips) AS passengers FROM journeys
        GROUP BY (origin_zone % 5) * 5, (dest_zone % 5) * 5""",
    "buildings": """SELECT p_partkey AS building, p_partkey % 30 AS zone_idx, CAST(p_size AS DOUBLE) AS area, CAST(60 + p_partkey % 40 AS DOUBLE) / 100 AS confidence, p_type FROM part""",
}


def _spark(text: str) -> str:
    text = re.sub(r"DAYS\(([^,()]+), ([^,()]+)\)", r"datediff(CAST(\1 AS DATE), CAST(\2 AS DATE))", text)
    text = re.sub(r"SERIES\((\w+), (\w+)\)", r"explode(sequence(\1, \2))", text)
    text = re.sub(r"EPOCH\((\w+)\)", r"unix_timestamp(\1)", text)
    return re.sub(r"VARCHAR\(9\)", "STRING", text)


def _duck(text: str) -> str:
    text = re.sub(r"DAYS\(([^,()]+), ([^,()]+)\)", r"date_diff('day', CAST(\2 AS DATE), CAST(\1 AS DATE))", text)
    text = re.sub(r"SERIES\((\w+), (\w+)\)", r"unnest(generate_series(\1, \2))", text)
    return re.sub(r"EPOCH\((\w+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", text)


def _needs(text: str) -> list[str]:
    words = set(re.findall(r"\w+", text))
    found: list[str] = []
    for name in VIEWS:
        if name in words:
            found += [n for n in [*_needs(VIEWS[name]), name] if n not in found]
    return found


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in BASE}


class Canon:
    """The canonical views of one data folder as frames, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            text = VIEWS[name]
            words = set(re.findall(r"\w+", text))
            used = [n for n in (*BASE, *VIEWS) if n != name and n in words]
            self._made[name] = self.sql(_spark(text), used)
        return self._made[name]

    def sql(self, text: str, used: list[str]) -> DataFrame:
        """A statement over named views and tables, without leaving views behind."""
        for n in used:
            text = re.sub(rf"\b(FROM|JOIN)(\s+){n}\b", rf"\1\2{{{n}}}", text)
        return self.spark.sql(text, **{n: getattr(self, n) for n in used})


def oracle(body: str) -> str:
    """A statement of the reference database with the views it uses as leading CTEs."""
    own = re.match(r"\s*WITH( RECURSIVE)?\s", body)
    needed = ",\n".join(f"{n} AS ({_duck(VIEWS[n])})" for n in _needs(body))
    if not needed:
        return body
    if own:
        return f"WITH{own[1] or ''} {needed},\n{body[own.end():]}"
    return f"WITH {needed}\n{body}"
