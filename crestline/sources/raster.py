"""Rasters of elevations: rows of raw numbers or metres, with the transform that places them."""

from __future__ import annotations

import functools
import json
import math
import os
import tempfile
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.functions import geo
from crestline.functions.geo import Affine

#: Metadata of a raster: optional fields are null.
META = (
    "transform array<double>, shape array<int>, dtype string, nodata string, bounds struct<left:double,bottom:double,right:double,top:double>, crs_wkt string, source_file string, "
    "scale_applied double, offset_applied double, decimation_factor int, approx_resolution_m double, resampling_method string, rows_per_chunk int, "
    "chunks array<struct<file:string,row_start:int,row_end:int>>, format string, scale double, offset double, nodata_dn double, pixel_size_m double"
)
#: Decimal megabytes of a chunk at most.
CHUNK_MB = 20.0


@dataclass(frozen=True)
class Dem:
    """rows: row int and h array<double> (metres, null: no data), or dn (raw numbers, with scale, offset and nodata_dn)."""

    rows: DataFrame
    transform: Affine
    n_rows: int
    n_cols: int
    scale: float = 1.0
    offset: float = 0.0
    nodata_dn: float | None = None
    rows_per_chunk: int | None = None
    first_col: int = 0
    #: Rows outside are not held (a window); lookups there are null.
    window: tuple[int, int, int, int] | None = None
    #: What was made from the raster once and serves again.
    kept: dict = field(init=False, compare=False, repr=False, default_factory=dict)

    @functools.cached_property
    def raw(self) -> bool:
        return "dn" in self.rows.columns

    @functools.cached_property
    def is_global(self) -> bool:
        return self.transform.spans_sphere(self.n_rows, self.n_cols)

    @property
    def pixel_km(self) -> float:
        return abs(self.transform.a) / 1000.0

    def without_rows(self) -> Dem:
        """Shape, transform and decoding alone, as they go to executors."""
        shape = replace(self, rows=None)
        shape.__dict__.update(raw=self.raw, is_global=self.is_global)
        return shape

    def value(self, dn: Column) -> Column:
        """Metres of a raw number; the nodata value, compared before scaling, is null."""
        metres = dn.cast("double") * F.lit(self.scale) + F.lit(self.offset)
        return metres if self.nodata_dn is None else F.when(dn != F.lit(self.nodata_dn), metres)

    def heights(self) -> DataFrame:
        """row, h array<double>; NaN is null."""
        if self.raw:
            return self.rows.select("row", F.transform("dn", self.value).alias("h"))
        return self.rows.select("row", F.transform("h", lambda v: F.when(~F.isnan(v), v.cast("double"))).alias("h"))

    def pixels(self) -> DataFrame:
        """row, col, h: a row for each pixel."""
        return self.heights().select("row", F.posexplode("h").alias("col", "h")).withColumn("col", F.col("col") + self.first_col)

    def chunked(self) -> DataFrame:
        """rows with their chunk, for write.partitionBy('chunk')."""
        return self.rows.withColumn("chunk", F.floor(F.col("row") / self.rows_per_chunk).cast("int"))

    def rows_between(self, first: int, last: int) -> Dem:
        """Only rows first..last are read: the filter reaches the scan."""
        return replace(self, rows=self.rows.where(F.col("row").between(first, last)))

    def part(self, lat_lo: float, lat_hi: float, lon_lo: float, lon_hi: float, pad: int = 3) -> Dem:
        """The window of rows and columns around these bounds, by nearest pixels; raises if it lies outside."""
        at = [nearest(lon, lat, self.transform) for lat in (lat_lo, lat_hi) for lon in (lon_lo, lon_hi)]
        r0, r1 = max(0, min(r for r, _ in at) - pad), min(self.n_rows, max(r for r, _ in at) + pad + 1)
        c0, c1 = max(0, min(c for _, c in at) - pad), min(self.n_cols, max(c for _, c in at) + pad + 1)
        if r1 <= r0 or c1 <= c0:
            raise ValueError("the region lies outside the raster")
        name = "dn" if self.raw else "h"
        rows = self.rows.where(F.col("row").between(r0, r1 - 1)).select("row", F.slice(name, c0 - self.first_col + 1, c1 - c0).alias(name))
        return replace(self, rows=rows, first_col=c0, window=(r0, r1, c0, c1))

    def meta(self, **more) -> dict:
        t = self.transform
        bounds = {"left": t.c, "top": t.f, "right": t.c + t.a * self.n_cols, "bottom": t.f + t.e * self.n_rows}
        return {"transform": [t.a, t.b, t.c, t.d, t.e, t.f], "shape": [self.n_rows, self.n_cols], "bounds": bounds, "scale": self.scale, "offset": self.offset, "nodata_dn": self.nodata_dn, "rows_per_chunk": self.rows_per_chunk, "chunks": manifest(self.n_rows, self.rows_per_chunk) if self.rows_per_chunk else None} | more


def nearest(lon: float, lat: float, t: Affine) -> tuple[int, int]:
    """row, col on the driver, of bounds."""
    dx, dy = geo.RADIUS_M * math.radians(lon) - t.c, geo.RADIUS_M * math.radians(lat) - t.f
    return round((t.a * dy - t.d * dx) / t.det), round((t.e * dx - t.b * dy) / t.det)


def rows_per_chunk(n_cols: int, item_bytes: int, chunk_mb: float = CHUNK_MB) -> int:
    return max(1, math.floor(chunk_mb * 1e6 / (n_cols * item_bytes)))


def manifest(n_rows: int, per_chunk: int, name: str = "chunk={k}") -> list[dict]:
    """Half-open, contiguous row ranges."""
    return [{"file": name.format(k=k), "row_start": a, "row_end": min(n_rows, a + per_chunk)} for k, a in enumerate(range(0, n_rows, per_chunk))]


def check_manifest(chunks: DataFrame, n_rows: int) -> None:
    """Raises unless the chunks (row_start, row_end) follow one another and cover all rows."""
    turn = Window.orderBy("row_start")
    gaps = chunks.withColumn("was", F.lag("row_end", 1, 0).over(turn)).where("row_start != was or row_end <= row_start")
    last = chunks.agg(F.max("row_end").alias("m")).first().m
    if last != n_rows or not gaps.isEmpty():
        raise ValueError("the chunks don't cover all rows, one after the other")


def read_meta(spark: SparkSession, path: str) -> dict:
    """A raster's metadata file."""
    return spark.read.schema(META).option("multiLine", True).json(path).first().asDict(recursive=True)


def write_meta(path: str, meta: dict) -> None:
    write_json_atomic(path, meta)


def write_json_atomic(path: str, payload) -> None:
    """A driver-side JSON file that is there whole or not at all."""
    handle, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w") as f:
        json.dump(payload, f)
    os.replace(part, path)


def check_shape(dem: Dem) -> None:
    """Raises unless the rows are 0..n_rows - 1, each once and of n_cols pixels."""
    name = "dn" if dem.raw else "h"
    seen = dem.rows.agg(F.count("*").alias("n"), F.countDistinct("row").alias("d"), F.min("row").alias("a"), F.max("row").alias("z"), F.min(F.size(name)).alias("least"), F.max(F.size(name)).alias("most")).first()
    if tuple(seen) != (dem.n_rows, dem.n_rows, 0, dem.n_rows - 1, dem.n_cols, dem.n_cols):
        raise ValueError(f"the rows have {seen.asDict()}, not the shape {[dem.n_rows, dem.n_cols]} of the metadata")


def from_meta(rows: DataFrame, meta: dict, check: bool = False) -> Dem:
    """A raster of Parquet rows and its metadata; layouts with and without chunks, raw or in metres. check: compares their shapes."""
    chunks = meta.get("chunks")
    if chunks:
        check_manifest(rows.sparkSession.createDataFrame(chunks, "file string, row_start int, row_end int"), meta["shape"][0])
    nodata = meta.get("nodata_dn")
    dem = Dem(rows, Affine(*meta["transform"]), *meta["shape"], scale=meta.get("scale") or 1.0, offset=meta.get("offset") or 0.0, nodata_dn=nodata, rows_per_chunk=meta.get("rows_per_chunk"))
    if check:
        check_shape(dem)
    return dem


def ingest(pixels: DataFrame, transform: Affine, n_rows: int, n_cols: int, scale: float = 1.0, offset: float = 0.0, nodata_dn: float | None = None, decode: bool = True, chunk_mb: float = CHUNK_MB) -> Dem:
    """A raster from rows (row, dn array): decoded to metres, or raw in chunks of at most chunk_mb."""
    held = Dem(pixels.select("row", "dn"), transform, n_rows, n_cols, scale, offset, nodata_dn)
    per = rows_per_chunk(n_cols, 4 if decode else 2, chunk_mb)
    if decode:
        floats = held.heights().select("row", F.col("h").cast("array<float>").alias("h"))
        return Dem(floats, transform, n_rows, n_cols, rows_per_chunk=per)
    return replace(held, rows_per_chunk=per)


def downsample(dem: Dem, factor: int, method: str = "nearest") -> Dem:
    """Every block of factor x factor pixels becomes one.

    max and average skip null; nearest takes the pixel under the block's centre. These three drop what is left over at
    the far edges. stride takes each block's first pixel, and keeps a last, partial block.
    """
    if method not in ("max", "average", "nearest", "stride"):
        raise ValueError(f"no such method: {method}")
    if method == "stride":
        n_rows, n_cols, scale = -(-dem.n_rows // factor), -(-dem.n_cols // factor), (factor, factor)
    else:
        n_rows, n_cols = dem.n_rows // factor, dem.n_cols // factor
        scale = (dem.n_cols / n_cols, dem.n_rows / n_rows)
    held = dem.heights().where(F.col("row") < n_rows * factor)
    index = F.sequence(F.lit(0), F.lit(n_cols - 1))
    if method in ("stride", "nearest"):
        first = 0 if method == "stride" else factor // 2
        rows = held.where(F.col("row") % factor == first).select((F.col("row") / factor).cast("int").alias("row"), F.transform(index, lambda k: F.get("h", k * factor + first)).alias("h"))
    else:
        # within a row first, then over the block's rows, so a shuffled row is an array of the new width
        part = lambda k: F.filter(F.slice("h", k * factor + 1, factor), lambda v: v.isNotNull())
        if method == "max":
            cut = held.select((F.col("row") / factor).cast("int").alias("row"), F.posexplode(F.transform(index, lambda k: F.array_max(part(k)))).alias("col", "v"))
            cells = cut.groupBy("row", "col").agg(F.max("v").alias("v"))
        else:
            sums = lambda k: F.struct(F.aggregate(part(k), F.lit(0.0), lambda a, v: a + v).alias("s"), F.size(part(k)).alias("n"))
            cut = held.select((F.col("row") / factor).cast("int").alias("row"), F.posexplode(F.transform(index, sums)).alias("col", "v"))
            cells = cut.groupBy("row", "col").agg(F.try_divide(F.sum("v.s"), F.sum("v.n")).alias("v"))
        rows = cells.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "v"))), lambda x: x["v"]).alias("h"))  # n_cols values a row
    return Dem(rows, dem.transform.scaled(*scale), n_rows, n_cols)
