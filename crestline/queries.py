"""A query for each operator, over rasters and results that are made from the driver's tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.functions import geo, rays
from crestline.functions.geo import RADIUS_M, Affine
from crestline.operators import summary, targets
from crestline.operators.horizon import profiles
from crestline.operators.sample import CLASSIC, FULLRES, sample
from crestline.plans import scans
from crestline.session import shared_dir
from crestline.sources import raster, results
from crestline.sources.raster import Dem
from crestline.streaming.incremental import in_slices

N_COLS, NODATA = 64, -32768


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def _raw_rows(spark: SparkSession, sf_dir: str, nodata: bool = False) -> tuple[DataFrame, int]:
    """row, dn of the synthetic raster, and how many rows it has."""
    held = _embeddings(spark, sf_dir)
    n = held.count()
    row = F.col("vec_id").cast("int")

    def dn(v, k):
        value = F.floor(v.cast("double") * 8000.0).cast("smallint")
        return F.when((row * 7 + k * 13) % 97 == 0, F.lit(NODATA).cast("smallint")).otherwise(value) if nodata else value

    return held.select(row.alias("row"), F.transform("embedding", dn).alias("dn")), n


def dem(spark: SparkSession, sf_dir: str, nodata: bool = False) -> Dem:
    """A raster around the whole sphere: a row for each vector, a column for each of its values."""
    rows, n = _raw_rows(spark, sf_dir, nodata)
    t = Affine(2 * math.pi * RADIUS_M / N_COLS, 0.0, -math.pi * RADIUS_M, 0.0, -math.pi * RADIUS_M / n, math.pi * RADIUS_M / 2)
    return Dem(rows, t, n, N_COLS, scale=0.5, offset=0.0, nodata_dn=NODATA if nodata else None)


def region(spark: SparkSession, sf_dir: str) -> Dem:
    """Rows 100..399 and columns 10..49 of it as a raster of its own."""
    whole = dem(spark, sf_dir)
    t = whole.transform
    rows = whole.rows.where("row between 100 and 399").select((F.col("row") - 100).alias("row"), F.slice("dn", 11, 40).alias("dn"))
    return Dem(rows, Affine(t.a, 0.0, t.c + t.a * 10, 0.0, t.e, t.f + t.e * 100), 300, 40, scale=0.5)


def _strided(spark: SparkSession, d: Dem, stride: int = 100) -> DataFrame:
    return targets.strided(spark, d.transform, d.n_rows, d.n_cols, stride, row_phase=10, col_phase=3, col_stride=8)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = spark.read.parquet(f"{sf_dir}/customer.parquet")
    lat = ((F.col("c_custkey") * 7919) % 17900) / 100.0 - 89.5
    lon = ((F.col("c_custkey") * 104729) % 36000) / 100.0 - 180.0
    return held.select(F.col("c_custkey").alias("id"), lat.alias("lat"), lon.alias("lon"), F.col("c_acctbal").alias("elevation"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as a scan gives them, without a scan; some cells are missing."""
    d = dem(spark, sf_dir)
    held = sample(_strided(spark, d, 50), d, FULLRES).where("(row + col) % 17 != 0")
    return held.select(
        "row",
        "col",
        "lat",
        "lon",
        "h_target",
        F.expr("cast((row * 7 + col * 11) % 360 as double)").alias("worst_azimuth"),
        (F.abs("h_target") / 50.0).alias("worst_angle_deg"),
        F.expr("cast((row * 13 + col * 3) % 360 as double)").alias("best_azimuth"),
        (-F.abs("h_target") / 200.0).alias("best_angle_deg"),
        F.expr("row % 3").alias("run"),
    )


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


_SCAN = ["row", "col", "lat", "lon", "h_target", "worst_azimuth", "worst_angle_deg", "best_azimuth", "best_angle_deg"]


def _scan_columns(df: DataFrame, *first: str) -> DataFrame:
    return _rounded(df.select(*first, *_SCAN), lat=8, lon=8, worst_angle_deg=6, best_angle_deg=6)


def horizon_scan_fullres(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dem(spark, sf_dir)
    return _scan_columns(scans.scan(_strided(spark, d), d, FULLRES, 500, 36))


def horizon_scan_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scan as a plan of rows, joins and aggregations."""
    d = dem(spark, sf_dir)
    return _scan_columns(scans.scan(_strided(spark, d), d, FULLRES, 500, 36, strategy="sql"))


def horizon_scan_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scan as rasters take that are too large to be broadcast."""
    d = dem(spark, sf_dir)
    return _scan_columns(scans.scan(_strided(spark, d), d, FULLRES, 500, 36, strategy="tiles"))


def horizon_scan_classic(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dem(spark, sf_dir)
    return _scan_columns(scans.scan(_strided(spark, d), d, CLASSIC, 300, 36))


def horizon_scan_classic_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dem(spark, sf_dir)
    return _scan_columns(scans.scan(_strided(spark, d), d, CLASSIC, 300, 36, strategy="sql"))


def horizon_profile_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dem(spark, sf_dir)
    return _rounded(scans.horizon_mask(spark, d, -12.3, 45.6, 50, 360, CLASSIC), angle_deg=6)


def horizon_full_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dem(spark, sf_dir)
    held = scans.scan(_strided(spark, d, 250), d, FULLRES, 100, 24, full_profile=True)
    text = F.array_join(F.transform("full_profile_deg", lambda v: geo.fixed(v, 5)), ",", "null")
    return held.select("row", "col", text.alias("profile"))


def horizon_scan_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dem(spark, sf_dir)
    return _scan_columns(scans.scan_box(d, -6, -4, 20, 26, 20, max_radius_km=150, n_azimuths=24, step_km=5), "grid_row", "grid_col")


def horizon_elevation_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = scans.scan_box(dem(spark, sf_dir), -45, -40, 10, 15, 10, mode="rect", elevation_only=True)
    return _rounded(held.select("grid_row", "grid_col", "row", "col", "lat", "lon", "h_target"), lat=8, lon=8)


def horizon_scan_polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = scans.scan_polar(dem(spark, sf_dir), 100, lat_max=-80, max_radius_km=200, n_azimuths=24)
    return _scan_columns(held, "x_km", "y_km")


def horizon_regional_dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = region(spark, sf_dir)
    grid = targets.strided(spark, d.transform, d.n_rows, d.n_cols, 50, row_phase=5, col_phase=1, col_stride=7)
    return _scan_columns(scans.scan(grid, d, FULLRES, 150, 24))


def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan in slices that is broken off half-way and resumed."""
    d, path = dem(spark, sf_dir), f"{shared_dir(spark)}/crestline-slices-{uuid.uuid4().hex}"
    grid = _strided(spark, d)
    run = lambda t: scans.scan(t, d, FULLRES, 500, 36)
    in_slices(grid.where("row < 200"), run, path, 10_000)
    return _scan_columns(in_slices(grid, run, path, 10_000))


def dem_sample_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sample(_points(spark, sf_dir), dem(spark, sf_dir), FULLRES, out="h").select("id", "lat", "lon", "h"), lat=6, lon=6)


def dem_sample_classic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(_points(spark, sf_dir), dem(spark, sf_dir, nodata=True), CLASSIC, out="h").select("id", "h")


def dem_decode_nodata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.coverage(dem(spark, sf_dir, nodata=True).pixels(), "h", ["row"])


def _downsampled(spark: SparkSession, sf_dir: str, factor: int, method: str) -> DataFrame:
    d = raster.downsample(dem(spark, sf_dir, nodata=True), factor, method)
    return _rounded(d.pixels().select("row", "col", "h"), h=6)


def dem_downsample_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _downsampled(spark, sf_dir, 5, "max")


def dem_downsample_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _downsampled(spark, sf_dir, 5, "average")


def dem_downsample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _downsampled(spark, sf_dir, 9, "nearest")


def dem_downsample_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _downsampled(spark, sf_dir, 9, "stride")


def dem_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded to single precision in chunks of bytes."""
    rows, n = _raw_rows(spark, sf_dir, nodata=True)
    d = raster.ingest(rows, dem(spark, sf_dir).transform, n, N_COLS, 0.5, 0.0, NODATA, chunk_mb=0.02)
    return d.chunked().groupBy("chunk").agg(F.min("row").alias("row_start"), (F.max("row") + 1).alias("row_end"), F.sum(F.expr("size(filter(h, v -> v is not null))")).alias("n_valid"))


def dem_chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows find their chunk by the manifest's ranges."""
    rows, n = _raw_rows(spark, sf_dir)
    chunks = spark.createDataFrame([(k, c["row_start"], c["row_end"]) for k, c in enumerate(raster.manifest(n, 128))], "chunk int, row_start int, row_end int")
    raster.check_manifest(chunks, n)
    held = rows.join(F.broadcast(chunks), (F.col("row") >= F.col("row_start")) & (F.col("row") < F.col("row_end")))
    return held.groupBy("chunk", "row_start", "row_end").agg(F.count("*").alias("n_rows"), F.min(F.array_min("dn")).cast("int").alias("dn_min"), F.max(F.array_max("dn")).cast("int").alias("dn_max"), F.count_if(F.col("chunk") == F.floor(F.col("row") / 128)).alias("n_same"))


def dem_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dem(spark, sf_dir).part(-20, 10, 30, 80)
    return d.pixels().select("row", "col", "h")


def pixel_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dem(spark, sf_dir)
    return _rounded(targets.strided(spark, d.transform, d.n_rows, d.n_cols, 50, col_stride=1).select("row", "col", "lat", "lon"), lat=9, lon=9)


def geodesic_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _points(spark, sf_dir)
    lat, lon = geo.destination("lat", "lon", F.col("id") % 400 + 1.0, F.col("id") * 37 % 360 * 1.0)
    return held.select("id", F.round(lat, 7).alias("lat2"), F.round(lon, 7).alias("lon2"))


def distance_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rays.schedule_frame(spark, 500, 0.11845), distance_km=9)


def stride_grid_lat_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dem(spark, sf_dir)
    grid = targets.strided(spark, d.transform, d.n_rows, d.n_cols, 20, lat_max=-30.0, col_stride=4)
    return _rounded(grid.select("row", "col", "lat", "lon"), lat=9, lon=9)


def polar_cap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(targets.polar_grid(spark, 25, -85).select("x_km", "y_km", "lat", "lon"), lat=9, lon=9)


def polar_region_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(targets.polar_grid(spark, 10, None, (50.0, -30.0, 120.0)).select("x_km", "y_km", "lat", "lon"), lat=9, lon=9)


def _box(spark: SparkSession, mode: str) -> DataFrame:
    return _rounded(targets.box_grid(spark, -45, -40, 10, 15, 5, mode).select("grid_row", "grid_col", "lat", "lon"), lat=9, lon=9)


def box_grid_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _box(spark, "exact")


def box_grid_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _box(spark, "rect")


def polar_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = summary.with_polar_columns(_points(spark, sf_dir), centre_lon=30.0, mirror=True)
    return _rounded(held.select("id", "x_km", "y_km", "rho_km", "azimuth_deg"), x_km=6, y_km=6, rho_km=6, azimuth_deg=6)


def column_alias_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _points(spark, sf_dir).withColumnsRenamed({"lat": "latitude", "lon": "Lon"})
    return _rounded(summary.with_polar_columns(held).select("id", "rho_km"), rho_km=6)


def cartesian_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = geo.cartesian("lat", "lon", "elevation", 10.0)
    return _points(spark, sf_dir).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


def cloud_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = geo.cartesian("lat", "lon", "elevation")
    held = summary.cloud_bounds(_points(spark, sf_dir).select(x.alias("x"), y.alias("y"), z.alias("z")))
    return _rounded(held, mid_x=2, mid_y=2, mid_z=2, half_edge=3)


def surface_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary.surface(_results(spark, sf_dir), "worst_angle_deg", 5.0), x=2, y=2, z=2, value=6)


def surface_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.surface(_results(spark, sf_dir), "worst_angle_deg").agg(F.count("*").alias("n_cells"), F.count_if(F.col("value").isNull()).alias("n_missing"))


def angle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = summary.summary(_results(spark, sf_dir), "worst_angle_deg", "best_angle_deg")
    return _rounded(held, v_min=6, v_median=6, v_mean=6, v_p95=6, v_max=6)


def angle_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary.histogram(_results(spark, sf_dir), "worst_angle_deg"), left=6, right=6)


def angle_histogram_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary.histogram(_results(spark, sf_dir), "worst_angle_deg", 12, "run"), left=6, right=6)


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary.run_stats(_results(spark, sf_dir), "worst_angle_deg", "run"), v_mean=6, v_min=6, v_max=6)


def shaded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary.scaled(_results(spark, sf_dir), "worst_angle_deg").select("row", "col", "shade"), shade=9)


def image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = summary.image_pixel("lat", "lon", 181, 361)
    return _points(spark, sf_dir).select("id", r.alias("image_row"), c.alias("image_col"))


def results_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An envelope as JSON text, and its results read back."""
    held = results.enveloped(_results(spark, sf_dir).drop("run"), dem_basename="synthetic", stride=50, max_radius_km=500.0, num_points=36)
    text = held.select(F.to_json(F.struct(*held.columns)).alias("json"))
    back = text.select(F.from_json("json", results.envelope(results.STRIDED)).alias("e")).select(F.col("e.completed").alias("completed"), F.inline("e.results"))
    return _rounded(back, lat=8, lon=8)


def region_csv_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _results(spark, sf_dir).withColumns({"grid_row": F.expr("cast(row div 50 as int)"), "grid_col": F.expr("cast(col div 8 as int)")})
    blank = {c: F.when(F.col("row") % 4 != 0, F.col(c)) for c in ("worst_azimuth", "worst_angle_deg", "best_azimuth", "best_angle_deg")}
    return results.box_text(held.withColumns(blank).withColumn("best_azimuth", F.col("best_azimuth") / 7.0))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/crestline-{name}-{uuid.uuid4().hex}"


def results_polar_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with the polar plane's columns among them as CSV, and read back by the header's names."""
    x, y, _, _ = geo.polar("lat", "lon", max_lat=90.0)
    held = _results(spark, sf_dir).select("row", "col", "lat", "lon", "h_target", x.alias("x_km"), y.alias("y_km"), "worst_azimuth", "worst_angle_deg", "best_azimuth", "best_angle_deg", "run")
    path = _folder(spark, "polar-csv")
    results.write_csv(held, path)
    back = results.read_csv(spark, path, results.POLAR, numbers=("run",))
    return _rounded(back.select("row", "col", "x_km", "y_km", "worst_azimuth", "worst_angle_deg", "best_angle_deg", F.col("run").cast("int").alias("run")), x_km=6, y_km=6, worst_angle_deg=9, best_angle_deg=9)


def results_json_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as a bare JSON list in files, and read back."""
    path = _folder(spark, "json-list")
    held = _results(spark, sf_dir).drop("run")
    held.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*held.columns)))).alias("value")).write.text(path)
    return _rounded(results.read_json(spark, path).drop("full_profile_deg"), lat=8, lon=8)


def results_box_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box scan's CSV, with its blank fields, read back."""
    held = _results(spark, sf_dir).withColumns({"grid_row": F.expr("cast(row div 50 as int)"), "grid_col": F.expr("cast(col div 8 as int)")})
    blank = {c: F.when(F.col("row") % 4 != 0, F.col(c)) for c in ("worst_azimuth", "worst_angle_deg", "best_azimuth", "best_angle_deg")}
    path = _folder(spark, "box-csv")
    results.write_box_csv(held.withColumns(blank), path)
    return results.read_csv(spark, path, results.BOX)


def image_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colours of a picture of 61 x 121 pixels, of half the globe, under points."""
    rows = spark.range(61).select(F.col("id").cast("int").alias("image_row"), F.transform(F.sequence(F.lit(0), F.lit(362)), lambda k: F.pmod(F.col("id").cast("int") * 31 + k * 7, F.lit(256))).alias("rgb"))
    return summary.image_values(_points(spark, sf_dir).select("id", "lat", "lon"), rows, 61, 121, extent=(-90.0, 90.0, -60.0, 60.0)).select("id", "red", "green", "blue")


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dem(spark, sf_dir)
    done = _results(spark, sf_dir).where("run = 0")
    return results.remaining(_strided(spark, d, 50), done, "row", "col").select("row", "col")


def probe_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dem(spark, sf_dir)
    return targets.probes(_strided(spark, d, 50), 8).select("row", "col")


def blank_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays of a regional raster that met nothing, by azimuth."""
    d = region(spark, sf_dir)
    grid = sample(targets.strided(spark, d.transform, d.n_rows, d.n_cols, 50, row_phase=5, col_phase=0, col_stride=39), d, FULLRES)
    azimuth = rays.azimuths(12, False)
    found = profiles(grid, d, FULLRES, azimuth, [200.0, 300.0], "sql")
    return found.select(F.posexplode("profile").alias("az_id", "angle")).groupBy("az_id").agg(F.count("*").alias("n_rays"), F.count_if(F.col("angle").isNull()).alias("n_blank"))


ALL = (
    horizon_scan_fullres, horizon_scan_sql, horizon_scan_tiles, horizon_scan_classic, horizon_scan_classic_sql, horizon_profile_point, horizon_full_profile, horizon_scan_box, horizon_elevation_only, horizon_scan_polar, horizon_regional_dem, incremental_scan,
    dem_sample_points, dem_sample_classic, dem_decode_nodata, dem_downsample_max, dem_downsample_avg, dem_downsample_nearest, dem_downsample_stride, dem_ingest, dem_chunk_lookup, dem_window,
    pixel_centers, geodesic_destinations, distance_schedule, stride_grid_lat_cap, polar_cap_grid, polar_region_grid, box_grid_exact, box_grid_rect, polar_columns, column_alias_pick, cartesian_xyz, cloud_bounds,
    surface_grid, surface_missing, angle_summary, angle_histogram, angle_histogram_by_run, run_stats, shaded_values, image_pixels, image_colours, results_json_roundtrip, results_json_list, results_polar_csv, results_box_csv, region_csv_format, resume_anti_join, probe_targets, blank_rays,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}
