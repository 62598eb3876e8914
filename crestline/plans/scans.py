"""The scans: which targets, which rays, which raster rows, and the results' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.functions import geo, rays
from crestline.operators import targets as grids
from crestline.operators.horizon import extremes, long_profile, profiles
from crestline.operators.sample import CLASSIC, FULLRES, REGION, Dialect, sample
from crestline.sources.raster import Dem


def ray_plan(dem: Dem, dialect: Dialect, max_radius_km: float, n_azimuths: int, step_km: float = 1.0) -> tuple[list[float], list[float]]:
    """Azimuths and distances of a dialect."""
    if dialect is CLASSIC:
        d = rays.whole_kilometres(max_radius_km)
    elif dialect is FULLRES:
        d = rays.scheduled(max_radius_km, dem.pixel_km)
    else:
        d = rays.even(step_km, max_radius_km)
    return rays.azimuths(n_azimuths, dialect.whole_degrees), d


def scan(targets: DataFrame, dem: Dem, dialect: Dialect = FULLRES, max_radius_km: float = 500.0, n_azimuths: int = 360, step_km: float = 1.0, full_profile: bool = False, strategy: str = "auto", sampled: bool = False) -> DataFrame:
    """targets with h_target and the extreme angles and azimuths; targets without elevation go.

    Targets of which no ray met anything go too, but for the region dialect, which keeps them blank.
    """
    held = targets if sampled else sample(targets, dem, dialect)
    held = held.where("h_target is not null")
    azimuth, distance = ray_plan(dem, dialect, max_radius_km, n_azimuths, step_km)
    found = profiles(held, dem, dialect, azimuth, distance, strategy)
    out = held.join(found, "target_id").withColumns(extremes("profile", azimuth))
    if not dialect.keep_blank:
        out = out.where("worst_angle_deg is not null")
    return out.withColumnRenamed("profile", "full_profile_deg") if full_profile else out.drop("profile")


def scan_grid(dem: Dem, stride: int = 20, lat_max: float | None = None, dialect: Dialect = FULLRES, **options) -> DataFrame:
    """Every stride-th pixel of the raster."""
    spark = dem.rows.sparkSession
    return scan(grids.strided(spark, dem.transform, dem.n_rows, dem.n_cols, stride, lat_max), dem, dialect, **options)


def scan_polar(dem: Dem, spacing_km: float, lat_max: float | None = None, region: tuple[float, float, float] | None = None, **options) -> DataFrame:
    """A regular grid in the south-polar plane; row and col name the raw floor pixel, without wrap or clamp."""
    return scan(with_pixel(grids.polar_grid(dem.rows.sparkSession, spacing_km, lat_max, region), dem), dem, FULLRES, **options)


def with_pixel(cells: DataFrame, dem: Dem) -> DataFrame:
    row, col = geo.floor_pixel(*geo.projected("lon", "lat"), dem.transform)
    return cells.withColumns({"row": row.cast("int"), "col": col.cast("int")})


def box_targets(dem: Dem, lat0: float, lat1: float, lon0: float, lon1: float, spacing_km: float = 0.5, mode: str = "exact", dialect: Dialect = REGION, max_radius_km: float = 500.0) -> tuple[DataFrame, Dem]:
    """A box's cells, and the part of the raster that their rays can reach; 0 km leaves what lies under the box."""
    (south, north), (west, east) = sorted((lat0, lat1)), sorted((lon0, lon1))
    cells = with_pixel(grids.box_grid(dem.rows.sparkSession, south, north, west, east, spacing_km, mode), dem)
    if dialect is not REGION:
        return cells, dem
    reach = geo.scan_window(south, north, west, east, max_radius_km) if max_radius_km else (south - 0.5, north + 0.5, west - 0.5, east + 0.5)
    return cells, dem.part(*reach)


def scan_box(dem: Dem, lat0: float, lat1: float, lon0: float, lon1: float, spacing_km: float = 0.5, mode: str = "exact", dialect: Dialect = REGION, max_radius_km: float = 500.0, elevation_only: bool = False, **options) -> DataFrame:
    """A box at a ground spacing; only the raster's rows and columns that its rays can reach are read."""
    cells, held = box_targets(dem, lat0, lat1, lon0, lon1, spacing_km, mode, dialect, 0.0 if elevation_only else max_radius_km)
    if elevation_only:
        return sample(cells, held, dialect).where("h_target is not null")
    return scan(cells, held, dialect, max_radius_km, **options)


def horizon_mask(spark: SparkSession, dem: Dem, lat: float, lon: float, max_radius_km: float = 50.0, n_azimuths: int = 360, dialect: Dialect = CLASSIC, strategy: str = "auto") -> DataFrame:
    """azimuth, angle_deg of one point; raises if it has no elevation."""
    point = spark.createDataFrame([(0, float(lat), float(lon))], "target_id long, lat double, lon double")
    h = sample(point, dem, dialect).first().h_target
    if h is None:
        raise ValueError(f"no elevation at {lat}, {lon}")
    azimuth, distance = ray_plan(dem, dialect, max_radius_km, n_azimuths)
    found = profiles(point.withColumn("h_target", F.lit(h)), dem, dialect, azimuth, distance, strategy)
    return long_profile(found, azimuth).select("azimuth", "angle_deg")


def resolution_note(dem: Dem, spacing_km: float) -> str:
    """What a spacing finer than the raster's pixels gives."""
    each = geo.targets_per_pixel(dem.pixel_km, spacing_km)
    return f"{each:.2f} targets a pixel of {dem.pixel_km:.3f} km" + ("; finer than the raster, no new terrain" if each > 1 else "")


def run_meta(dem: Dem, n_targets: int, **settings) -> dict:
    """What names a run, for its metadata file: its settings, and the raster that it read."""
    t = dem.transform
    return {"version": 1} | settings | {"targets": n_targets, "dem": {"shape": [dem.n_rows, dem.n_cols], "pixel_km": dem.pixel_km, "transform": [t.a, t.b, t.c, t.d, t.e, t.f], "decoded_bytes": dem.n_rows * dem.n_cols * 8}}
