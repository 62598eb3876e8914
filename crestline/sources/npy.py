"""A data source of .npy rasters: spark.read.format('npy').load(path or pattern); one partition for each band of rows."""

from __future__ import annotations

import ast
import functools
import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def header(path: str) -> tuple[np.dtype, tuple[int, ...], int]:
    """dtype, shape and the data's offset; only C order is supported."""
    with open(path, "rb") as f:
        if f.read(6) != b"\x93NUMPY":
            raise ValueError(f"{path}: not an .npy file")
        major, _ = f.read(2)
        size = struct.unpack("<H" if major == 1 else "<I", f.read(2 if major == 1 else 4))[0]
        spec = ast.literal_eval(f.read(size).decode("latin-1"))
        if spec["fortran_order"] or len(spec["shape"]) != 2:
            raise ValueError(f"{path}: not a two-dimensional array in C order")
        return np.dtype(spec["descr"]), spec["shape"], f.tell()


@dataclass
class Band(InputPartition):
    path: str
    first: int
    last: int
    row: int

    def __init__(self, path: str, first: int, last: int, row: int):
        super().__init__(None)
        self.path, self.first, self.last, self.row = path, first, last, row


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = sorted(glob.glob(options["path"]))
        if not self.files:
            raise FileNotFoundError(options["path"])
        self.band = int(options.get("rows", 512))

    def partitions(self) -> list[Band]:
        out, row = [], 0
        for path in self.files:  # chunk files follow one another by name
            n = header(path)[1][0]
            out += [Band(path, k, min(n, k + self.band), row + k) for k in range(0, n, self.band)]
            row += n
        return out

    def read(self, band: Band) -> Iterator[pa.RecordBatch]:
        dtype, shape, offset = header(band.path)
        data = np.memmap(band.path, dtype, "r", offset, shape)[band.first : band.last]
        for k in range(0, len(data), 64):
            some = np.asarray(data[k : k + 64], np.float64)
            ends = np.arange(len(some) + 1, dtype=np.int32) * shape[1]
            values = pa.array(some.ravel(), pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(band.row + k, band.row + k + len(some), dtype=np.int32)), pa.ListArray.from_arrays(pa.array(ends), values)], names=["row", "h"])


class Npy(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row int, h array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)


def read_npy(spark: SparkSession, path: str, rows: int = 512) -> DataFrame:
    """row, h (NaN is null). Files must be readable at one path by every executor; Parquet is the format to keep."""
    from crestline.session import ship

    ship(spark)
    spark.dataSource.register(Npy)
    return spark.read.format("npy").option("rows", rows).load(path)


def read_chunks(spark: SparkSession, folder: str, meta: dict, rows: int = 512) -> DataFrame:
    """The chunk files that a raster's metadata lists, each at its row_start: row and dn (raw numbers) or h (metres).

    What a file is named says nothing of its place. Raises if the chunks don't cover all rows, or a file has another
    shape than the metadata says.
    """
    from crestline.sources.raster import check_manifest

    chunks, raw = meta["chunks"], meta.get("scale") is not None
    check_manifest(spark.createDataFrame([(c["row_start"], c["row_end"]) for c in chunks], "row_start int, row_end int"), meta["shape"][0])
    parts = []
    for c in chunks:
        path = os.path.join(folder, c["file"])
        if (shape := header(path)[1]) != (c["row_end"] - c["row_start"], meta["shape"][1]):
            raise ValueError(f"{path} has the shape {shape}, not that of rows {c['row_start']} to {c['row_end']} of {meta['shape']}")
        parts.append(read_npy(spark, path, rows).withColumn("row", F.col("row") + c["row_start"]))
    held = functools.reduce(DataFrame.unionByName, parts)
    return held.select("row", F.col("h").cast("array<int>").alias("dn")) if raw else held


def write_npy(rows: DataFrame, path: str, n_rows: int, n_cols: int, dtype: str = "float32") -> None:
    """A driver-side file, a row at a time."""
    out = np.lib.format.open_memmap(path, "w+", np.dtype(dtype), (n_rows, n_cols))
    for row, values in rows.select("row", "h").toLocalIterator():
        out[row] = [np.nan if v is None else v for v in values]
    out.flush()
