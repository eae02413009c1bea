"""Distances, grid cells and well-known geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres. Fixed value.
EARTH_M = 6371008.8


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    half_lat, half_lon = (b - a) / 2, F.radians(_c(lon2) - _c(lon1)) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def great_circle_km(lat1, lon1, lat2, lon2) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) / 1000


def local_xy(lat, lon, lat0: float) -> tuple[Column, Column]:
    """Metres east and north in an equirectangular projection around the latitude lat0."""
    import math

    scale = EARTH_M * math.pi / 180
    return _c(lon) * (scale * math.cos(math.radians(lat0))), _c(lat) * scale


def cell_of(lat, lon, size: float) -> Column:
    """Id of the square cell of `size` degrees that holds a point: row * 2**32 + column."""
    row = F.floor((_c(lat) + 90) / size).cast("long")
    column = F.floor((_c(lon) + 180) / size).cast("long")
    return row * (1 << 32) + column


def cell_centre(cell, size: float) -> tuple[Column, Column]:
    row = F.shiftright(_c(cell), 32)
    column = _c(cell).bitwiseAND(F.lit((1 << 32) - 1).cast("long"))
    return (row + 0.5) * size - 90, (column + 0.5) * size - 180


def cell_wkt(cell, size: float) -> Column:
    """The cell's outline as WKT."""
    lat, lon = cell_centre(cell, size)
    h = size / 2
    corners = [(-h, -h), (-h, h), (h, h), (h, -h), (-h, -h)]
    points = [F.concat_ws(" ", F.round(lon + dx, 6).cast("string"), F.round(lat + dy, 6).cast("string")) for dy, dx in corners]
    return F.concat(F.lit("POLYGON(("), F.concat_ws(", ", *points), F.lit("))"))


def in_box(lat, lon, box: tuple[float, float, float, float]) -> Column:
    """Inside (west, south, east, north), borders included; null is outside."""
    west, south, east, north = box
    return F.coalesce(_c(lat).between(south, north) & _c(lon).between(west, east), F.lit(False))


def near_box_edge(lat, lon, box: tuple[float, float, float, float], metres: float) -> Column:
    """The nearest border of the box is less than so many metres away."""
    import math

    west, south, east, north = box
    degree = EARTH_M * math.pi / 180
    side = F.cos(F.radians(_c(lat))) * degree
    return F.least(
        (_c(lon) - west) * side, (F.lit(east) - _c(lon)) * side, (_c(lat) - south) * degree, (F.lit(north) - _c(lat)) * degree
    ) < metres
