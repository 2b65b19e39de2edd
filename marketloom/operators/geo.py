"""Distance search and distance join on the globe."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import haversine_km
from ..functions.fixed_values import EARTH_RADIUS_KM
from ..session import sized_broadcast
from .matching import full_width

KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180
ROWS_PER_PLACE = 4_096
SLOTS_PER_CELL = 4


def bounding_box(lat: str, lon: str, ref_lat: float, ref_lon: float, km: float) -> Column:
    """Cheap range predicates that contain the circle, so that scans can skip row groups."""
    d_lat = km / KM_PER_DEGREE * (1 + 1e-9)
    south, north = ref_lat - d_lat, ref_lat + d_lat
    box = F.col(lat).between(south, north)
    if south <= -90 or north >= 90:
        return box
    reach = math.sin(min(km / EARTH_RADIUS_KM, math.pi / 2)) / math.cos(math.radians(ref_lat))
    if reach >= 1:
        return box
    d_lon = math.degrees(math.asin(reach)) * (1 + 1e-9)
    west, east = ref_lon - d_lon, ref_lon + d_lon
    if west < -180 or east > 180:
        return box
    return box & F.col(lon).between(west, east)


def within_distance(df: DataFrame, lat: str, lon: str, ref_lat: float, ref_lon: float, km: float) -> DataFrame:
    """Rows within `km` of one reference point, with their distance."""
    distance = haversine_km(F.lit(ref_lat), F.lit(ref_lon), lat, lon)
    boxed = df.where(bounding_box(lat, lon, ref_lat, ref_lon, km))
    return boxed.withColumn("distance_km", distance).where(F.col("distance_km") <= km)


def distance_join(
    points: DataFrame, rows: DataFrame, km: float, lat: str = "lat", lon: str = "lon", point_lat: str = "ref_lat", point_lon: str = "ref_lon",
    digits: int | None = None,
) -> DataFrame:
    """Many reference points against rows: equi join on grid cells, then the exact distance.

    Cells are at least `km` high, so a point's matches lie in its latitude band
    and the two next to it. Each point covers the longitude cells its circle can
    reach; near the poles that is the whole band. A row lies in one cell only,
    so no pair occurs twice; a cell's places are dealt to several slots, so that a
    crowded cell is several tasks.

    The join and the distance work on distinct places; each result is spread over
    the rows of both places where it is found. A product of unit vectors rules out
    most pairs of a cell before the distance is computed, and distances are rounded
    to `digits`, if given, per pair of places. The result itself grows with the rows
    times the points near them.
    """
    left, right = _by_place(points, point_lat, point_lon, "_p"), _by_place(rows, lat, lon, "_r")
    near = _near_places(left, right, km)
    if digits is not None:
        near = near.withColumn("distance_km", F.round("distance_km", digits))
    spread = near.withColumn("_p", F.explode("_p")).withColumn("_r", F.explode("_r"))
    names = [F.col(f"_p.`{c}`").alias(c) for c in points.columns] + [F.col(f"_r.`{c}`").alias(c) for c in rows.columns]
    return spread.select(*names, "distance_km")


def _by_place(df: DataFrame, lat: str, lon: str, name: str) -> DataFrame:
    """Distinct places (`{name}_lat`, `{name}_lon`, unit vector) with their rows as arrays of some thousand at most."""
    place = [f"{name}_lat", f"{name}_lon"]
    placed = df.select(F.col(lat).alias(place[0]), F.col(lon).alias(place[1]), F.struct(*[F.col(c) for c in df.columns]).alias(name))
    placed = placed.where(F.col(place[0]).isNotNull() & F.col(place[1]).isNotNull())
    busy = placed.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_PLACE).alias("_parts")).where("_parts > 1")
    cut = placed.join(sized_broadcast(busy), place, "left")
    part = F.pmod(F.xxhash64(name), F.coalesce("_parts", F.lit(1)))
    a, b = F.radians(place[0]), F.radians(place[1])
    unit = {f"{name}x": F.cos(a) * F.cos(b), f"{name}y": F.cos(a) * F.sin(b), f"{name}z": F.sin(a)}
    return cut.groupBy(*place, part.alias("_part")).agg(F.collect_list(name).alias(name)).drop("_part").withColumns(unit)


def _near_places(points: DataFrame, rows: DataFrame, km: float) -> DataFrame:
    """Pairs of places within `km` with their distance."""
    point_lat, point_lon, lat, lon = "_p_lat", "_p_lon", "_r_lat", "_r_lon"
    size = max(km / KM_PER_DEGREE, 0.01)
    n_lon = max(int(360 // size), 1)
    cell_lon_size = 360.0 / n_lon
    band = lambda c: F.floor((c + 90) / size).cast("int")
    wrap = lambda c: F.pmod(F.floor((c + 180) / cell_lon_size).cast("int"), F.lit(n_lon))

    top = F.least(F.abs(F.col(point_lat)) + size * 1.000001, F.lit(90.0))
    reach = F.sin(F.lit(min(km / EARTH_RADIUS_KM, math.pi / 2))) / F.cos(F.radians(F.abs(F.col(point_lat))))
    steps = F.when(
        (top >= 90) | (reach >= 1) | reach.isNull(), F.lit(n_lon // 2 + 1)
    ).otherwise(F.least(F.ceil(F.degrees(F.asin(F.least(reach, F.lit(1.0)))) * 1.000001 / cell_lon_size).cast("int"), F.lit(n_lon // 2 + 1)))
    home = F.floor((F.col(point_lon) + 180) / cell_lon_size).cast("int")
    columns = F.array_distinct(
        F.transform(F.sequence(home - steps, home + steps), lambda c: F.pmod(c, F.lit(n_lon)))
    )
    lowest = band(F.col(point_lat)) - 1
    covered = points.withColumn("_band", F.explode(F.sequence(lowest, lowest + 2))).withColumn("_cell", F.explode(columns))
    placed = rows.withColumn("_band", band(F.col(lat))).withColumn("_cell", wrap(F.col(lon)))
    covered = covered.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS_PER_CELL - 1))))
    placed = placed.withColumn("_slot", F.pmod(F.xxhash64(lat, lon), F.lit(SLOTS_PER_CELL)).cast("int"))
    keys = ["_band", "_cell", "_slot"]
    joined = full_width(covered, keys).join(full_width(placed, keys), keys).drop(*keys)
    likeness = sum((F.col(f"_p{c}") * F.col(f"_r{c}") for c in "xyz"), F.lit(0.0))
    hopeful = joined.where(likeness >= math.cos(min(km / EARTH_RADIUS_KM, math.pi)) - 1e-9)
    distance = haversine_km(point_lat, point_lon, lat, lon)
    return hopeful.withColumn("distance_km", distance).where(F.col("distance_km") <= km)
