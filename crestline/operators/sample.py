"""Elevations at points: a lookup of raster pixels, in three dialects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions import geo
from crestline.sources.raster import Dem

#: Bytes of decoded rows up to which the raster is sent to all executors.
BROADCAST_BYTES = 512 << 20


@dataclass(frozen=True)
class Dialect:
    """How a point finds its pixel, and what a scan's rays are.

    classic: nearest pixel (half to even), no wrap; whole kilometres, azimuths by whole degrees, an unclipped arc sine,
    the largest of the angles. fullres: floor pixel, wrap and clamp if the raster spans the sphere; scheduled distances,
    azimuths around the circle, the angle of the largest slope. region: classic's pixels with fullres' rays, evenly spaced.
    """

    name: str
    floor: bool
    clip: bool
    whole_degrees: bool
    keep_blank: bool


CLASSIC = Dialect("classic", False, False, True, False)
FULLRES = Dialect("fullres", True, True, False, False)
REGION = Dialect("region", False, True, False, True)


def pixel(x: Column, y: Column, dem: Dem, dialect: Dialect) -> tuple[Column, Column]:
    """row, col of projected coordinates; outside a raster that isn't global they are out of range."""
    if not dialect.floor:
        return geo.nearest_pixel(x, y, dem.transform)
    row, col = geo.floor_pixel(x, y, dem.transform)
    return geo.wrapped(row, col, dem.n_rows, dem.n_cols) if dem.is_global else (row, col)


def small(dem: Dem) -> bool:
    """Whether what is held of the raster, its window if it has one, can be broadcast."""
    r0, r1, c0, c1 = dem.window or (0, dem.n_rows, 0, dem.n_cols)
    return (r1 - r0) * (c1 - c0) * 8 <= BROADCAST_BYTES


def lookup(points: DataFrame, dem: Dem, row: str, col: str, out: str) -> DataFrame:
    """points with the pixel's metres as column out; null outside the raster and without data.

    One record of the raster is a whole row, so the join is by row; the value is picked from its array. Small rasters
    are broadcast, larger ones joined by shuffle.
    """
    heights = dem.heights().select(F.col("row").cast("long").alias("_row"), F.col("h").alias("_h"))
    heights = F.broadcast(heights) if small(dem) else heights
    inside = F.when(F.col(col).between(dem.first_col, dem.n_cols - 1), (F.col(col) - dem.first_col).cast("int"))
    return points.join(heights, F.col(row) == F.col("_row"), "left").withColumn(out, F.get("_h", inside)).drop("_row", "_h")


def sample(points: DataFrame, dem: Dem, dialect: Dialect = FULLRES, lat: str = "lat", lon: str = "lon", out: str = "h_target") -> DataFrame:
    """points with the elevation at lat, lon (degrees)."""
    x, y = geo.projected(lon, lat)
    row, col = pixel(x, y, dem, dialect)
    return lookup(points.withColumns({"_r": row, "_c": col}), dem, "_r", "_c", out).drop("_r", "_c")


def sample_xy(points: DataFrame, dem: Dem, dialect: Dialect = FULLRES, x: str = "x", y: str = "y", out: str = "h_target") -> DataFrame:
    """points with the elevation at projected coordinates (metres)."""
    row, col = pixel(F.col(x), F.col(y), dem, dialect)
    return lookup(points.withColumns({"_r": row, "_c": col}), dem, "_r", "_c", out).drop("_r", "_c")


def check(dem: Dem, lat: float, lon: float, dialect: Dialect = FULLRES) -> float | None:
    """The elevation at one point, or None."""
    points = dem.rows.sparkSession.createDataFrame([(float(lat), float(lon))], "lat double, lon double")
    return sample(points, dem, dialect).first().h_target
