"""Summaries of result rows: counts, percentiles, histograms, regular grids, clouds."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from crestline.functions import geo


def known(c: Column | str) -> Column:
    """The value, or null if it is NaN or infinite."""
    v = geo.column(c)
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def drop_unknown(df: DataFrame, *columns: str) -> DataFrame:
    """Without the rows in which one of these is null or not finite."""
    for c in columns:
        df = df.where(known(c).isNotNull())
    return df


def numbered(df: DataFrame, order: str, block: int = 4096) -> DataFrame:
    """df with place: its rows' numbers from 0 in ascending order of an integer column.

    Counts of blocks of the column's values are summed, and rows are numbered within a block, so no task sorts all rows.
    """
    held = df.withColumn("_block", F.floor(F.col(order) / block))
    counts = held.groupBy("_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_block").orderBy(order)
    return held.withColumn("_k", F.row_number().over(within)).join(counts, "_block").withColumn("place", F.col("_before") + F.col("_k") - 1).drop("_block", "_before", "_k")


def coverage(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """n_total, n_valid, n_missing, and the least and greatest value."""
    v = known(value)
    return df.groupBy(*by).agg(F.count("*").alias("n_total"), F.count(v).alias("n_valid"), (F.count("*") - F.count(v)).alias("n_missing"), F.min(v).alias("v_min"), F.max(v).alias("v_max"))


#: Bands of values that percentiles are searched in.
BANDS = 4096
#: Percentiles of a summary.
QUANTILES = {"v_median": 0.5, "v_p95": 0.95}


def summary(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each column: n, min, median, mean, p95 (interpolated), max of its finite values; n 0 and nulls without any.

    One pass over df: equal values are counted together, the counts summed by bands of equal width, and only the bands
    that hold a percentile's places are sorted, so no task holds a column's values.
    """
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), known(c).cast("double").alias("v")) for c in columns))).alias("x")
    each = df.select(values).select("x.field", "x.v").where("v is not null").groupBy("field", "v").agg(F.count("*").alias("c"))
    basic = each.groupBy("field").agg(F.sum("c").alias("n"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.try_divide(F.sum(F.col("v") * F.col("c")), F.sum("c")).alias("v_mean"))
    at = {q: (F.col("n") - 1) * F.lit(share) for q, share in QUANTILES.items()}
    basic = basic.withColumns({f"{q}_{side}": cut(place).cast("long") for q, place in at.items() for side, cut in (("lo", F.floor), ("hi", F.ceil))})
    places = [f"{q}_{side}" for q in QUANTILES for side in ("lo", "hi")]
    few = F.broadcast(basic)  # a row for each column
    width = F.col("v_max") - F.col("v_min")
    band = F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("v_min"), width) * (BANDS - 1)).cast("int"), F.lit(0))
    banded = each.join(few.select("field", "v_min", "v_max"), "field").select("field", "v", "c", band.alias("band"))
    over = Window.partitionBy("field").orderBy("band")  # at most BANDS rows a column
    bands = banded.groupBy("field", "band").agg(F.sum("c").alias("held")).withColumn("end", F.sum("held").over(over)).join(few, "field")
    holds = [(F.col(p) >= F.col("end") - F.col("held")) & (F.col(p) < F.col("end")) for p in places]
    some = bands.where(functools.reduce(Column.__or__, holds)).select("field", "band", (F.col("end") - F.col("held")).alias("before"), *places)
    ranked = banded.join(F.broadcast(some), ["field", "band"])  # as many bands as places at most
    ranked = ranked.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("field", "band").orderBy("v")))
    found = ranked.groupBy("field").agg(*(F.max(F.when((F.col(p) < F.col("upto")) & (F.col(p) >= F.col("upto") - F.col("c")), F.col("v"))).alias(f"at_{p}") for p in places))
    between = {q: F.col(f"at_{q}_lo") + (F.col(f"at_{q}_hi") - F.col(f"at_{q}_lo")) * (place - F.floor(place)) for q, place in at.items()}
    done = basic.join(found, "field").withColumns(between)
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "field string")
    return F.broadcast(names).join(done, "field", "left").select("field", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "v_min", "v_median", "v_mean", "v_p95", "v_max")


def run_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    v = known(value)
    return df.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("v_mean"), F.min(v).alias("v_min"), F.max(v).alias("v_max"))


def histogram(df: DataFrame, value: str, bins: int = 30, by: str | None = None, shared: bool = False) -> DataFrame:
    """bin (from 0), left, right, n of equal-width bins from the least to the greatest value, the last one closed.

    With by, a histogram of each group, with edges of its own unless shared. Bins without values have n 0. If all
    values are equal the edges are half a unit to either side. Without values there are no rows.
    """
    keys = [by] if by else []
    held = df.select(*keys, known(value).alias("v")).where("v is not null")
    lo, hi = F.min("v").alias("lo"), F.max("v").alias("hi")
    edges = held.groupBy(*keys).agg(lo, hi).where("lo is not null")
    if shared and by:
        edges = held.select(by).distinct().join(F.broadcast(held.agg(lo, hi)))  # one row
    same = F.col("lo") == F.col("hi")
    edges = edges.select(*keys, F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    joined = held.join(edges, by) if by else held.join(F.broadcast(edges))  # one row
    at = F.least(F.width_bucket("v", "lo", "hi", F.lit(bins)), F.lit(bins).cast("long")) - 1
    counts = joined.groupBy(*keys, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    frame = edges.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return frame.join(counts, [*keys, "bin"], "left").select(*keys, "bin", (F.col("lo") + width * F.col("bin")).alias("left"), (F.col("lo") + width * (F.col("bin") + 1)).alias("right"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def surface(df: DataFrame, value: str, exaggeration: float = 1.0) -> DataFrame:
    """A regular grid of results (row, col, lat, lon, h_target): row_idx, col_idx, x, y, z, value.

    Latitudes and longitudes come from linear fits over row and col; a missing cell has elevation 0 and no value.
    """
    fit = df.agg(F.regr_slope("lat", "row").alias("a_lat"), F.regr_intercept("lat", "row").alias("b_lat"), F.regr_slope("lon", "col").alias("a_lon"), F.regr_intercept("lon", "col").alias("b_lon"))
    # a raster's distinct rows, and its columns, number as many as its edges are long
    rows = df.select("row").distinct().withColumn("row_idx", F.dense_rank().over(Window.orderBy("row")) - 1)
    cols = df.select("col").distinct().withColumn("col_idx", F.dense_rank().over(Window.orderBy("col")) - 1)
    line = cols.agg(F.collect_list(F.struct("col", "col_idx")).alias("line"))
    cells = rows.join(F.broadcast(line)).select("row", "row_idx", F.inline("line")).join(df.select("row", "col", F.col("h_target").alias("h"), F.col(value).alias("value")), ["row", "col"], "left")
    placed = cells.join(F.broadcast(fit))  # one row
    lat, lon = F.col("a_lat") * F.col("row") + F.col("b_lat"), F.col("a_lon") * F.col("col") + F.col("b_lon")
    x, y, z = geo.cartesian(lat, lon, F.coalesce("h", F.lit(0.0)), exaggeration)
    return placed.select("row_idx", "col_idx", x.alias("x"), y.alias("y"), z.alias("z"), known("value").alias("value"))


def cloud_bounds(df: DataFrame) -> DataFrame:
    """Centre and half edge of the cube around x, y, z."""
    spread = [F.max(c) - F.min(c) for c in ("x", "y", "z")]
    return df.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mid_{c}") for c in ("x", "y", "z")), (F.greatest(*spread) / 2.0).alias("half_edge"))


def scaled(df: DataFrame, value: str, out: str = "shade") -> DataFrame:
    """df with the value's place between the least (0) and the greatest (1); null where there is none."""
    v = known(value)
    ends = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    return df.join(F.broadcast(ends)).withColumn(out, F.try_divide(v - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def image_pixel(lat: Column | str, lon: Column | str, height: int, width: int, extent: tuple[float, float, float, float] = (-180.0, 180.0, -90.0, 90.0)) -> tuple[Column, Column]:
    """Row and column of an equirectangular image of extent (left, right, bottom, top), by truncation, kept inside it."""
    left, right, bottom, top = map(float, extent)
    r = ((F.lit(top) - geo.column(lat)) / F.lit(top - bottom) * F.lit(height - 1)).cast("int")
    c = ((geo.column(lon) - F.lit(left)) / F.lit(right - left) * F.lit(width - 1)).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(height - 1), r)), F.greatest(F.lit(0), F.least(F.lit(width - 1), c))


def image_values(df: DataFrame, image: DataFrame, height: int, width: int, lat: str = "lat", lon: str = "lon", extent: tuple[float, float, float, float] = (-180.0, 180.0, -90.0, 90.0)) -> DataFrame:
    """df with red, green and blue of the pixel under lat, lon; image: image_row and rgb, an array of three a column."""
    r, c = image_pixel(lat, lon, height, width, extent)
    placed = df.withColumns({"image_row": r, "_c": c}).join(image.select("image_row", "rgb"), "image_row", "left")
    part = lambda k: F.get("rgb", F.col("_c") * 3 + k)
    return placed.withColumns({"red": part(0), "green": part(1), "blue": part(2)}).drop("image_row", "_c", "rgb")


def scalar_columns(df: DataFrame) -> DataFrame:
    """Without arrays, structs and maps."""
    return df.select(*(f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))))


def require(df: DataFrame, *columns: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}; there are {df.columns}")


#: Names under which tables carry coordinates, the first found counting.
LAT_NAMES, LON_NAMES = ("lat", "latitude", "Lat", "Latitude", "LAT"), ("lon", "longitude", "Lon", "Longitude", "LON")


def pick(df: DataFrame, names: tuple[str, ...], given: str | None = None) -> str:
    """The first of these columns that is there, or the one given."""
    for name in [given] if given else names:
        if name in df.columns:
            return name
    raise ValueError(f"none of {[given] if given else list(names)} is a column; there are {df.columns}")


def with_polar_columns(df: DataFrame, lat: str | None = None, lon: str | None = None, centre_lon: float = 0.0, mirror: bool = False, max_lat: float = 0.0, overwrite: bool = False) -> DataFrame:
    """df with x_km, y_km, rho_km, azimuth_deg; raises if it has them already, unless they may be overwritten."""
    new = ("x_km", "y_km", "rho_km", "azimuth_deg")
    clash = [c for c in new if c in df.columns]
    if clash and not overwrite:
        raise ValueError(f"there are columns {clash} already")
    values = geo.polar(pick(df, LAT_NAMES, lat), pick(df, LON_NAMES, lon), centre_lon, mirror, max_lat)
    return df.drop(*clash).withColumns(dict(zip(new, values)))
