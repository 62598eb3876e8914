"""Target points: strided pixels, polar planes, latitude/longitude boxes, and pruning of what they need."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.functions import geo
from crestline.functions.geo import KM_PER_DEGREE, RADIUS_M, Affine


def first_row_south_of(t: Affine, n_rows: int, lat_max: float) -> int:
    """The first raster row whose pixel centres lie at or south of a latitude (north-up transforms), one row early at most."""
    if t.e >= 0:
        return 0
    at = (RADIUS_M * math.radians(lat_max) - t.f) / t.e - 0.5
    return min(n_rows, max(0, math.floor(at)))


def strided(spark: SparkSession, t: Affine, n_rows: int, n_cols: int, stride: int, lat_max: float | None = None, row_phase: int = 0, col_phase: int = 0, col_stride: int | None = None) -> DataFrame:
    """target_id, row, col, lat, lon of each stride-th pixel's centre, at or south of lat_max.

    The latitude limit also bounds the generated rows, so what it excludes isn't made first.
    """
    low = row_phase
    if lat_max is not None and not t.rotated:
        first = first_row_south_of(t, n_rows, lat_max)
        low += -(-(max(first, row_phase) - row_phase) // stride) * stride
    rows = spark.range(low, n_rows, stride).select(F.col("id").cast("int").alias("row"))
    cols = F.sequence(F.lit(col_phase), F.lit(n_cols - 1), F.lit(col_stride or stride))
    cells = rows.select("row", F.explode(cols).alias("col"))
    lat, lon = geo.pixel_centre("row", "col", t)
    out = cells.select((F.col("row").cast("long") * n_cols + F.col("col")).alias("target_id"), "row", "col", lat.alias("lat"), lon.alias("lon"))
    return out if lat_max is None else out.where(F.col("lat") <= lat_max)


def lattice(spark: SparkSession, rows: range, cols: range, row: str, col: str) -> DataFrame:
    """target_id and the two numbers of each cell of rows x cols, row after row; made from one flat range."""
    place, width = F.col("id"), max(1, len(cols))
    cells = spark.range(len(rows) * len(cols))
    return cells.select(place.alias("target_id"), (F.floor(place / width) + rows.start).cast("int").alias(row), (place % width + cols.start).cast("int").alias(col))


def _multiples(low: float, high: float, step: float) -> range:
    """The whole numbers k with low <= k step <= high."""
    return range(math.ceil(low / step), math.floor(high / step) + 1)


def polar_grid(spark: SparkSession, spacing_km: float, lat_max: float | None = None, region: tuple[float, float, float] | None = None) -> DataFrame:
    """target_id, x_km, y_km, lat, lon on multiples of spacing_km in the south-polar plane.

    A cap at or south of lat_max, or a square region (centre x, centre y, width; km), cut at lat_max if that is given
    too. A cap without lat_max ends at -80 degrees; a region without it isn't cut. Rows go by y, then x.
    """
    cap = lat_max if region or lat_max is not None else -80.0
    rim = math.inf if cap is None else 2.0 * geo.RADIUS_KM * math.tan(math.radians(90.0 + cap) / 2.0)
    x, y, half = (region[0], region[1], region[2] / 2) if region else (0.0, 0.0, rim)
    plane = lattice(spark, _multiples(y - half, y + half, spacing_km), _multiples(x - half, x + half, spacing_km), "iy", "ix")
    plane = plane.select("target_id", *((F.col(i) * F.lit(float(spacing_km))).alias(c) for i, c in (("ix", "x_km"), ("iy", "y_km"))))
    lat, lon = geo.from_polar("x_km", "y_km")
    return plane.where(F.hypot("x_km", "y_km") <= rim + 1e-9).select("target_id", "x_km", "y_km", lat.alias("lat"), lon.alias("lon"))


def box_grid(spark: SparkSession, lat0: float, lat1: float, lon0: float, lon1: float, spacing_km: float, mode: str = "exact") -> DataFrame:
    """target_id, grid_row, grid_col, lat, lon at a ground spacing, from the box's south-west corner.

    exact: each row has the longitude step of its own latitude; rect: all rows that of the box's middle. Ids follow one
    another along the row that has most columns; shorter rows leave the rest out.
    """
    if mode not in ("exact", "rect"):
        raise ValueError(f"no such grid: {mode}")
    (south, north), (west, east) = sorted((lat0, lat1)), sorted((lon0, lon1))
    up, middle = spacing_km / KM_PER_DEGREE, 0.5 * (south + north)
    widest = middle if mode == "rect" else min(max(0.0, south), north)  # the latitude nearest the equator
    fits = lambda room, step: math.floor(room / step + 1e-9)
    cells = lattice(spark, range(fits(north - south, up) + 1), range(fits(east - west, up / math.cos(math.radians(widest))) + 1), "grid_row", "grid_col")
    cells = cells.withColumn("lat", F.lit(south) + F.lit(up) * F.col("grid_row"))
    across = F.lit(spacing_km) / (F.lit(KM_PER_DEGREE) * F.cos(F.radians("lat" if mode == "exact" else F.lit(middle))))
    cells = cells.withColumn("across", across).where(F.col("grid_col") <= F.floor(F.lit(east - west) / F.col("across") + F.lit(1e-9)))
    return cells.select("target_id", "grid_row", "grid_col", "lat", (F.lit(west) + F.col("across") * F.col("grid_col")).alias("lon"))


def probes(targets: DataFrame, k: int = 8) -> DataFrame:
    """At most k targets, evenly spread over target_id's order: places i (n - 1) / (k - 1), cut to whole numbers."""
    n = targets.count()
    if not n:
        return targets
    places = sorted({int(i * (n - 1) / (k - 1)) if k > 1 else 0 for i in range(k)})
    from crestline.operators.summary import numbered

    return numbered(targets, "target_id").where(F.col("place").isin(places)).drop("place")
