"""python -m crestline COMMAND ...: rasters to Parquet, scans, and what follows them."""

from __future__ import annotations

import argparse
import json
import os
import time
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from crestline.functions import geo
from crestline.functions.geo import Affine
from crestline.operators import sample, summary
from crestline.operators import targets as grids
from crestline.operators.targets import probes
from crestline.plans import scans
from crestline.sources import figures, npy, raster, results, tiff
from crestline.streaming import incremental

DIALECTS = {d.name: d for d in (sample.CLASSIC, sample.FULLRES, sample.REGION)}


def _dem(spark: SparkSession, base: str) -> raster.Dem:
    return raster.from_meta(spark.read.parquet(f"{base}/rows"), raster.read_meta(spark, f"{base}/meta.json"))


def _keep(dem: raster.Dem, base: str, **more) -> None:
    if dem.rows_per_chunk:
        dem.chunked().write.mode("overwrite").partitionBy("chunk").parquet(f"{base}/rows")
    else:
        dem.rows.write.mode("overwrite").parquet(f"{base}/rows")
    raster.write_meta(f"{base}/meta.json", dem.meta(**more))


def ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    os.makedirs(a.output, exist_ok=True)
    if a.input.endswith((".tif", ".tiff")):
        seen = tiff.inspect(a.input)
        nodata = a.nodata if a.nodata is not None else seen["nodata"]
        dem = raster.ingest(tiff.read_tiff(spark, a.input), Affine(*(a.transform or seen["transform"])), *seen["shape"], a.scale, a.offset, nodata, not a.raw, a.chunk_mb)
    elif a.input.endswith(".json"):  # metadata that lists chunk files beside it
        meta = raster.read_meta(spark, a.input)
        dem = raster.from_meta(npy.read_chunks(spark, os.path.dirname(os.path.abspath(a.input)), meta), meta)
        dem = replace(dem, rows_per_chunk=dem.rows_per_chunk or raster.rows_per_chunk(dem.n_cols, 8, a.chunk_mb))
    else:
        rows = npy.read_npy(spark, a.input)
        n = rows.count()
        dem = raster.Dem(rows, Affine(*a.transform), n, len(rows.first().h), rows_per_chunk=raster.rows_per_chunk(len(rows.first().h), 8, a.chunk_mb))
    _keep(dem, a.output, source_file=a.input)


def downsample(spark: SparkSession, a: argparse.Namespace) -> None:
    os.makedirs(a.output, exist_ok=True)
    _keep(raster.downsample(_dem(spark, a.dem), a.factor, a.method), a.output, decimation_factor=a.factor, resampling_method=a.method)


def _save(df, a: argparse.Namespace) -> None:
    results.guard(df.sparkSession, a.output, "overwrite" if a.overwrite else "error")
    if a.output.endswith(".json"):
        results.write_json(df.drop("target_id"), a.output)
    elif a.output.endswith(".csv"):
        results.write_csv(df.drop("target_id"), a.output, "overwrite" if a.overwrite else "error")
    else:
        df.write.mode("overwrite" if a.overwrite else "errorifexists").parquet(a.output)


def _progress(done: int, total: int, seconds: float) -> None:
    print(f"{done} of {total} targets, {1000 * seconds / done:.1f} ms each, {seconds / done * (total - done) / 60:.1f} min left")


def _run(spark: SparkSession, a: argparse.Namespace, dem: raster.Dem, targets, scan, **settings) -> None:
    """A scan from targets to output: what a few probes cost, slices that a later call resumes, metadata, a summary.

    With --resume the results are a Parquet table, to which finished slices are appended; what is there isn't scanned
    again. Ctrl-C between or within slices loses the slice that was on its way, and no more.
    """
    total = targets.count()
    if not total:
        print("no targets, nothing to scan")
        return
    if a.probe:
        few = targets.orderBy("target_id").limit(a.probe) if a.probe_first else probes(targets, a.probe)
        began = time.perf_counter()
        n = few.count()
        scan(few).count()
        each = (time.perf_counter() - began) / max(1, n)
        print(f"{n} probes took {each * 1000:.1f} ms a target; {total} targets take at most {each * total / 60:.1f} min")
    if a.resume:
        try:
            held = incremental.in_slices(targets, scan, a.output, a.slice, seconds=a.checkpoint_seconds, told=_progress)
        except KeyboardInterrupt:
            spark.sparkContext.cancelAllJobs()
            raise SystemExit(f"stopped; finished slices are in {a.output}, and the same command goes on") from None
    else:
        _save(scan(targets), a)
        held = None
    meta = scans.run_meta(dem, total, radius_km=a.radius, azimuths=a.azimuths, **settings)
    results.write_run_meta(spark, a.output + ".meta.json", meta)
    if held is not None and "worst_angle_deg" in held.columns:
        summary.summary(held, "worst_angle_deg", "best_angle_deg").show(truncate=False)


def grid(spark: SparkSession, a: argparse.Namespace) -> None:
    dem = _dem(spark, a.dem)
    targets = grids.strided(spark, dem.transform, dem.n_rows, dem.n_cols, a.stride, a.lat_max)
    run = lambda t: scans.scan(t, dem, DIALECTS[a.dialect], a.radius, a.azimuths, full_profile=a.full_profile)
    _run(spark, a, dem, targets, run, command="grid", stride=a.stride, lat_max=a.lat_max, dialect=a.dialect)


def polar(spark: SparkSession, a: argparse.Namespace) -> None:
    dem = _dem(spark, a.dem)
    targets = scans.with_pixel(grids.polar_grid(spark, a.spacing, a.lat_max, tuple(a.region) if a.region else None), dem)
    run = lambda t: scans.scan(t, dem, sample.FULLRES, a.radius, a.azimuths)
    _run(spark, a, dem, targets, run, command="polar", spacing_km=a.spacing, lat_max=a.lat_max, region=a.region)


def box(spark: SparkSession, a: argparse.Namespace) -> None:
    dem, dialect = _dem(spark, a.dem), DIALECTS[a.dialect]
    print(scans.resolution_note(dem, a.spacing))
    settings = {"command": "box", "lat": a.lat, "lon": a.lon, "spacing_km": a.spacing, "grid": a.grid, "dialect": a.dialect}
    if a.elevation_only:
        _save(scans.scan_box(dem, *a.lat, *a.lon, a.spacing, a.grid, dialect, a.radius, True), a)
        return
    targets, held = scans.box_targets(dem, *a.lat, *a.lon, a.spacing, a.grid, dialect, a.radius)
    run = lambda t: scans.scan(t, held, dialect, a.radius, a.azimuths, a.step)
    if a.output.endswith(".csv") and not a.resume:
        results.write_box_csv(run(targets), a.output, "overwrite" if a.overwrite else "error")
        results.write_run_meta(spark, a.output + ".meta.json", scans.run_meta(dem, targets.count(), radius_km=a.radius, azimuths=a.azimuths, **settings))
        summary.summary(results.read_csv(spark, a.output), "worst_angle_deg", "best_angle_deg").show(truncate=False)
    else:
        _run(spark, a, dem, targets, run, **settings)


def point(spark: SparkSession, a: argparse.Namespace) -> None:
    scans.horizon_mask(spark, _dem(spark, a.dem), a.at[0], a.at[1], a.radius, a.azimuths, DIALECTS[a.dialect]).orderBy("azimuth").show(a.azimuths, False)


def check(spark: SparkSession, a: argparse.Namespace) -> None:
    print(sample.check(_dem(spark, a.dem), *a.at, DIALECTS[a.dialect]))


def to_csv(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.output and len(a.inputs) > 1:
        raise SystemExit("--output goes with one input")
    for path in a.inputs:
        results.json_to_csv(spark, path, a.output)


def polar_columns(spark: SparkSession, a: argparse.Namespace) -> None:
    results.add_polar_columns(spark, a.input, a.output, lat=a.lat_col, lon=a.lon_col, centre_lon=a.centre_lon, mirror=a.mirror, max_lat=a.max_lat, overwrite=a.overwrite)


def histogram(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = results.read_csv(spark, a.input, with_file=True, numbers=(a.column,))
    if a.column not in rows.columns or summary.drop_unknown(rows, a.column).isEmpty():
        print(f"skipped {a.input}: no values of {a.column}; there are {rows.columns}")
        return
    summary.histogram(rows, a.column, a.bins, "file").orderBy("file", "bin").show(10_000, False)
    summary.run_stats(rows, a.column, "file").show(truncate=False)
    if a.figures:
        os.makedirs(a.figures, exist_ok=True)
        each = summary.histogram(rows, a.column, a.bins, "file")
        for name in sorted(r.file for r in each.select("file").distinct().collect()):
            figures.histogram_figure(each.where(F.col("file") == name), os.path.join(a.figures, f"{os.path.splitext(name)[0]}_{a.column}.png"))
        figures.histogram_figure(summary.histogram(rows, a.column, a.bins, "file", shared=True), os.path.join(a.figures, f"all_{a.column}.png"), "file")


def figure(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = results.read_table(spark, a.input) if a.input.lower().endswith((".csv", ".json")) else spark.read.parquet(a.input)
    if a.kind == "map":
        lat, lon = summary.pick(rows, summary.LAT_NAMES), summary.pick(rows, summary.LON_NAMES)
        n = figures.map_figure(rows, a.column, a.output, lat, lon)
    else:
        x, y, z = geo.cartesian("lat", "lon", "h_target", a.exaggeration)
        n = figures.cloud_figure(rows.select(x.alias("x"), y.alias("y"), z.alias("z"), F.col(a.column).alias("value")), a.output, *a.view)
    print(f"{n} pixels drawn")


def inspect(spark: SparkSession, a: argparse.Namespace) -> None:
    print(json.dumps(tiff.inspect(a.input), indent=1))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="crestline", description=__doc__)
    sub = top.add_subparsers(required=True)

    def add(run, *, dem: bool = False, output: bool = False, rays: bool = False, dialect: str | None = None) -> argparse.ArgumentParser:
        p = sub.add_parser(run.__name__.replace("_", "-"))
        p.set_defaults(run=run)
        if dem:
            p.add_argument("dem")
        if output:
            p.add_argument("output")
            p.add_argument("--overwrite", action="store_true")
        if rays:
            p.add_argument("--radius", type=float, default=500.0)
            p.add_argument("--azimuths", type=int, default=360)
            p.add_argument("--resume", action="store_true", help="append finished slices to a Parquet table, and go on where it ends")
            p.add_argument("--slice", type=int, default=100_000, help="targets between two commits")
            p.add_argument("--checkpoint-seconds", type=float, help="how often to commit; slices become as long")
            p.add_argument("--probe", type=int, default=0, help="targets to time first")
            p.add_argument("--probe-first", action="store_true", help="time the first targets, not spread ones")
        if dialect:
            p.add_argument("--dialect", choices=DIALECTS, default=dialect)
        return p

    p = add(ingest)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--transform", type=float, nargs=6)
    p.add_argument("--scale", type=float, default=1.0)
    p.add_argument("--offset", type=float, default=0.0)
    p.add_argument("--nodata", type=float)
    p.add_argument("--raw", action="store_true")
    p.add_argument("--chunk-mb", type=float, default=raster.CHUNK_MB)
    p = add(downsample, dem=True)
    p.add_argument("output")
    p.add_argument("--factor", type=int, default=9)
    p.add_argument("--method", choices=("nearest", "max", "average", "stride"), default="nearest")
    p = add(grid, dem=True, output=True, rays=True, dialect="fullres")
    p.add_argument("--stride", type=int, default=20)
    p.add_argument("--lat-max", type=float)
    p.add_argument("--full-profile", action="store_true")
    p = add(polar, dem=True, output=True, rays=True)
    p.add_argument("--spacing", type=float, required=True)
    p.add_argument("--lat-max", type=float)
    p.add_argument("--region", type=float, nargs=3)
    p = add(box, dem=True, output=True, rays=True, dialect="region")
    p.add_argument("--lat", type=float, nargs=2, default=(-45.0, -40.0))
    p.add_argument("--lon", type=float, nargs=2, default=(10.0, 15.0))
    p.add_argument("--spacing", type=float, default=0.5)
    p.add_argument("--grid", choices=("exact", "rect"), default="exact")
    p.add_argument("--step", type=float, default=1.0)
    p.add_argument("--elevation-only", action="store_true")
    p = add(point, dem=True, dialect="classic")
    p.add_argument("at", type=float, nargs=2, metavar=("LAT", "LON"))
    p.add_argument("--radius", type=float, default=50.0)
    p.add_argument("--azimuths", type=int, default=360)
    p = add(check, dem=True, dialect="fullres")
    p.add_argument("at", type=float, nargs=2, metavar=("LAT", "LON"))
    p = add(to_csv)
    p.add_argument("inputs", nargs="+")
    p.add_argument("--output")
    p = add(polar_columns)
    p.add_argument("input")
    p.add_argument("--output")
    p.add_argument("--lat-col")
    p.add_argument("--lon-col")
    p.add_argument("--centre-lon", type=float, default=0.0)
    p.add_argument("--mirror", action="store_true")
    p.add_argument("--max-lat", type=float, default=0.0)
    p.add_argument("--overwrite", action="store_true")
    p = add(histogram)
    p.add_argument("input")
    p.add_argument("--column", default="worst_angle_deg")
    p.add_argument("--bins", type=int, default=30)
    p.add_argument("--figures", help="folder for a figure of each file, and one of all")
    p = add(figure)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--kind", choices=("map", "cloud"), default="map")
    p.add_argument("--column", default="worst_angle_deg")
    p.add_argument("--exaggeration", type=float, default=1.0)
    p.add_argument("--view", type=float, nargs=2, default=(30.0, 20.0), metavar=("AZIMUTH", "ELEVATION"))
    p = add(inspect)
    p.add_argument("input")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    a.run(spark or SparkSession.builder.appName("crestline").getOrCreate(), a)


if __name__ == "__main__":
    main()
