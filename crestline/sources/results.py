"""Result tables: readers of JSON and CSV, sinks, and what is left to do of an interrupted run."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crestline.functions import geo
from crestline.operators.summary import require, scalar_columns, with_polar_columns
from crestline.sources.raster import write_json_atomic

_KINDS = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "array<double>": T.ArrayType(T.DoubleType())}


def _struct(ddl: str) -> T.StructType:
    """A schema from 'name kind, name kind'; needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


STRIDED = _struct("row int, col int, lat double, lon double, h_target double, worst_azimuth double, worst_angle_deg double, best_azimuth double, best_angle_deg double")
POLAR = _struct("row int, col int, lat double, lon double, h_target double, x_km double, y_km double, worst_azimuth double, worst_angle_deg double, best_azimuth double, best_angle_deg double")
BOX = _struct("grid_row int, grid_col int, row int, col int, lat double, lon double, h_target double, worst_azimuth double, worst_angle_deg double, best_azimuth double, best_angle_deg double")
GAIN_CUTS = _struct("theta_deg int, elevation_deg int, E_plane_phi0_gain_dBi double, H_plane_phi90_gain_dBi double, E_plane_norm_dB double, H_plane_norm_dB double")
PROFILE = T.StructField("full_profile_deg", T.ArrayType(T.DoubleType()))


def envelope(row: T.StructType) -> T.StructType:
    """The JSON object around a run's results."""
    head = "dem_basename string, stride int, stride_unit string, projection string, lat_max_deg double, region_km array<double>, point_spacing_km double, dem_resolution_m double, radial_samples_per_azimuth int, max_radius_km double, num_points int, total_candidates long, completed long"
    return T.StructType([*_struct(head).fields, T.StructField("results", T.ArrayType(row))])


def read_json(spark: SparkSession, path: str, row: T.StructType = STRIDED) -> DataFrame:
    """Results of an envelope, or of a bare list."""
    full = T.StructType([*row.fields, PROFILE])
    schema = T.StructType([*envelope(full).fields, *full.fields])
    held = spark.read.schema(schema).option("multiLine", True).json(path)
    inside = held.where("results is not null").select(F.inline("results"))
    bare = held.where("results is null").select(*full.fieldNames())
    return inside.unionByName(bare)


#: The columns' types by name, whatever file they are in.
_KNOWN = {f.name: f.dataType for row in (STRIDED, POLAR, BOX, GAIN_CUTS) for f in row}


def _by_header(held: DataFrame, row: T.StructType | None, numbers: tuple[str, ...]) -> list[Column]:
    """A CSV's columns, found by the names in its header: known ones and numbers cast, others left as text."""
    if row is not None:
        require(held, *row.fieldNames())
    kinds = _KNOWN | dict.fromkeys(numbers, T.DoubleType())
    out = []
    for name in held.columns:
        text, kind = F.col(f"`{name}`"), kinds.get(name)
        number = text if kind is None else text.try_cast("double")
        out.append((number if kind in (None, T.DoubleType()) else number.cast(kind)).alias(name))
    return out


def read_csv(spark: SparkSession, path: str, row: T.StructType | None = None, with_file: bool = False, numbers: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one file, or of a pattern's files with one header; empty fields are null; with_file names each row's file.

    All columns are kept, in the header's order; row names columns that must be there, numbers others to read as doubles.
    """
    held = spark.read.option("header", True).option("nullValue", "").option("enforceSchema", False).csv(path)
    return held.select(*_by_header(held, row, numbers), *([F.col("_metadata.file_name").alias("file")] if with_file else []))


def read_table(spark: SparkSession, path: str, row: T.StructType = STRIDED) -> DataFrame:
    """JSON or CSV by the file's ending; scalar columns only."""
    return scalar_columns(read_json(spark, path, row)) if path.lower().endswith(".json") else read_csv(spark, path)


def read_gain_cuts(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with comment lines before its header."""
    held = spark.read.option("comment", "#").option("header", True).option("enforceSchema", False).csv(path)
    return held.select(*_by_header(held, GAIN_CUTS, ()))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Base maps as bytes; figures.read_pixels decodes PNG files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def there(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, in any file system that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def guard(spark: SparkSession, path: str, mode: str = "error", source: str | None = None) -> None:
    """Refuses to write over the input, or over what is there, unless mode is 'overwrite' or 'resume'."""
    if source and os.path.abspath(source) == os.path.abspath(path):
        raise ValueError("the output would replace its input")
    if mode == "error" and there(spark, path):
        raise FileExistsError(path)


def default_output(path: str, ending: str) -> str:
    return os.path.splitext(path)[0] + ending


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """A CSV folder with a header; profiles become JSON text."""
    arrays = {f.name: F.to_json(f.name) for f in df.schema if isinstance(f.dataType, T.ArrayType)}
    df.withColumns(arrays).write.mode("overwrite" if mode == "overwrite" else "append" if mode == "resume" else "errorifexists").option("header", True).csv(path)


def json_to_csv(spark: SparkSession, json_path: str, csv_path: str | None = None, row: T.StructType = STRIDED) -> DataFrame:
    """Converts a results file, and returns its rows."""
    df = read_json(spark, json_path, row)
    write_csv(df, csv_path or default_output(json_path, ".csv"), "overwrite")
    return df


def convert_all(spark: SparkSession, json_paths: list[str], row: T.StructType = STRIDED) -> list[str]:
    """Converts several files, each beside itself."""
    for p in json_paths:
        json_to_csv(spark, p, row=row)
    return [default_output(p, ".csv") for p in json_paths]


def add_polar_columns(spark: SparkSession, path: str, output: str | None = None, **options) -> DataFrame:
    df = with_polar_columns(read_table(spark, path), **options)
    target = output or default_output(path, "_polar.csv")
    guard(spark, target, "overwrite", path)
    write_csv(df, target, "overwrite")
    return df


def enveloped(results: DataFrame, **head) -> DataFrame:
    """One row: the envelope with its results in row-major order. For results that fit one JSON file."""
    rows = F.array_sort(F.collect_list(F.struct(*results.columns)))
    return results.agg(*(F.lit(v).alias(k) for k, v in head.items()), F.count("*").alias("completed"), rows.alias("results"))


def write_json(results: DataFrame, path: str, **head) -> None:
    """A driver-side JSON file, whole or not at all; larger runs belong in Parquet."""
    rows = [r.asDict(recursive=True) for r in results.orderBy("row", "col").toLocalIterator()]
    write_json_atomic(path, head | {"completed": len(rows), "results": rows})


def write_run_meta(spark: SparkSession, path: str, meta: dict) -> None:
    """A run's metadata as one JSON file beside its results, in whatever file system they are; an earlier one is replaced."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(json.dumps(meta, indent=1).encode()))
    finally:
        out.close()


def box_text(results: DataFrame) -> DataFrame:
    """A box scan's rows as text with each column's decimals; blank where there is none."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    text = {"lat": geo.fixed("lat", 8), "lon": geo.fixed("lon", 8), "h_target": geo.fixed("h_target", 2), "worst_azimuth": geo.azimuth_text("worst_azimuth"), "worst_angle_deg": geo.fixed("worst_angle_deg", 6), "best_azimuth": geo.azimuth_text("best_azimuth"), "best_angle_deg": geo.fixed("best_angle_deg", 6)}
    return results.select(*(empty(text[c] if c in text else F.col(c).cast("string")).alias(c) for c in BOX.fieldNames()))


def write_box_csv(results: DataFrame, path: str, mode: str = "error") -> None:
    guard(results.sparkSession, path, mode)
    write_csv(box_text(results.orderBy("grid_row", "grid_col")), path, mode)


def remaining(targets: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Targets without a finished result; a key counts, not how many rows there are."""
    return targets.join(done.select(*keys).distinct(), list(keys), "left_anti")
