"""A data source of uncompressed TIFF rasters: spark.read.format('dem_tiff').load(path); one partition for each band of rows.

Baseline files with strips of one band (8-, 16- or 32-bit integers, 32- or 64-bit floats, either byte order) are read
here; other files need rasterio, which is imported only then.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from crestline.functions.geo import Affine
from crestline.sources.npy import Band

#: TIFF field types as (struct code, bytes), and the tags that are used.
_FIELDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS_PER_STRIP, SAMPLE_FORMAT = 256, 257, 258, 259, 273, 277, 278, 339
PIXEL_SCALE, TIE_POINT, NODATA = 33550, 33922, 42113
#: Tags of the coordinate system's keys and texts; keys of the model and of systems' codes and names; models.
GEO_KEYS, GEO_TEXT = 34735, 34737
MODEL, CODES, NAMES = 1024, (3072, 2048), (1026, 3073, 2049)
PROJECTED, GEOGRAPHIC, NO_CODE = 1, 2, 32767


def tags(path: str) -> tuple[str, dict[int, tuple]]:
    """Byte order and the first directory's tags."""
    with open(path, "rb") as f:
        order = {b"II": "<", b"MM": ">"}.get(f.read(2))
        if order is None or struct.unpack(f"{order}H", f.read(2))[0] != 42:
            raise ValueError(f"{path}: not a plain TIFF file")
        f.seek(struct.unpack(f"{order}I", f.read(4))[0])
        entries = [struct.unpack(f"{order}HHI4s", f.read(12)) for _ in range(struct.unpack(f"{order}H", f.read(2))[0])]
        out = {}
        for tag, kind, n, inline in entries:
            if kind not in _FIELDS:
                continue
            code, size = _FIELDS[kind]
            data = inline[: n * size]
            if n * size > 4:
                f.seek(struct.unpack(f"{order}I", inline)[0])
                data = f.read(n * size)
            out[tag] = (data,) if kind == 2 else struct.unpack(f"{order}{n * len(code)}{code[0]}", data)
        return order, out


class Layout:
    """Where a file's rows are, and what its pixels mean."""

    def __init__(self, path: str):
        order, t = tags(path)
        self.n_rows, self.n_cols = t[HEIGHT][0], t[WIDTH][0]
        if t.get(COMPRESSION, (1,))[0] != 1 or t.get(SAMPLES, (1,))[0] != 1 or OFFSETS not in t:
            raise NotImplementedError(f"{path}: not uncompressed strips of one band")
        kind = {1: "u", 2: "i", 3: "f"}[t.get(SAMPLE_FORMAT, (1,))[0]]
        self.dtype = np.dtype(f"{order}{kind}{t[BITS][0] // 8}")
        self.strip, self.offsets = t.get(ROWS_PER_STRIP, (self.n_rows,))[0], t[OFFSETS]
        self.nodata = float(t[NODATA][0].rstrip(b"\0 ")) if NODATA in t else None
        self.transform = None
        if PIXEL_SCALE in t and TIE_POINT in t:
            (sx, sy, *_), (col, row, _, x, y, *_) = t[PIXEL_SCALE], t[TIE_POINT]
            self.transform = Affine(sx, 0.0, x - col * sx, 0.0, -sy, y + row * sy)

    def rows(self, path: str, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(first // self.strip, -(-last // self.strip)):
            begin = k * self.strip
            n = min(self.strip, self.n_rows - begin)
            data = np.memmap(path, self.dtype, "r", self.offsets[k], (n, self.n_cols))
            for row in range(max(first, begin), min(last, begin + n)):
                yield row, data[row - begin]


def coordinate_system(t: dict[int, tuple]) -> dict | None:
    """Whether coordinates are degrees or metres of a projection, and the system's code and name, by a file's tags."""
    if GEO_KEYS not in t:
        return None
    words, text = t[GEO_KEYS], t.get(GEO_TEXT, (b"",))[0].rstrip(b"\0").decode("latin-1")
    found = {}
    for key, place, n, value in zip(*(words[4 + k : 4 + 4 * words[3] : 4] for k in range(4))):
        found[key] = value if place == 0 else text[value : value + n].rstrip("|") if place == GEO_TEXT else None
    model = found.get(MODEL)
    codes = [found[k] for k in CODES if found.get(k) not in (None, NO_CODE)]
    return {"projected": model == PROJECTED, "geographic": model == GEOGRAPHIC, "code": codes[0] if codes else None, "name": next((found[k] for k in NAMES if found.get(k)), None)}


def inspect(path: str) -> dict:
    """Shape, type, nodata value, coordinate system, transform, bounds and pixel size of a file."""
    held = Layout(path)
    t = held.transform
    out = {"shape": [held.n_rows, held.n_cols], "dtype": held.dtype.name, "nodata": held.nodata, "crs": coordinate_system(tags(path)[1]), "transform": None, "bounds": None, "pixel_size_m": None}
    if t is not None:
        bounds = {"left": t.c, "top": t.f, "right": t.c + t.a * held.n_cols, "bottom": t.f + t.e * held.n_rows}
        out |= {"transform": [t.a, t.b, t.c, t.d, t.e, t.f], "bounds": bounds, "pixel_size_m": abs(t.a)}
    return out


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.band = options["path"], int(options.get("rows", 512))

    def _shape(self) -> tuple[int, int]:
        try:
            held = Layout(self.path)
        except NotImplementedError:
            import rasterio

            with rasterio.open(self.path) as f:
                return f.shape
        return held.n_rows, held.n_cols

    def partitions(self) -> list[Band]:
        n = self._shape()[0]
        return [Band(self.path, k, min(n, k + self.band), k) for k in range(0, n, self.band)]

    def _values(self, band: Band) -> Iterator[tuple[int, np.ndarray]]:
        try:
            yield from Layout(band.path).rows(band.path, band.first, band.last)
        except NotImplementedError:
            import rasterio
            from rasterio.windows import Window

            with rasterio.open(band.path) as f:
                for row in range(band.first, band.last):
                    yield row, f.read(1, window=Window(0, row, f.width, 1))[0]

    def read(self, band: Band) -> Iterator[pa.RecordBatch]:
        for row, values in self._values(band):
            dn = pa.array(np.asarray(values, np.float64), pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(dn)], pa.int32()), dn)], names=["row", "dn"])


class Tiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dem_tiff"

    def schema(self) -> str:
        return "row int, dn array<double>"

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)


def read_tiff(spark: SparkSession, path: str, rows: int = 512) -> DataFrame:
    """row, dn (raw numbers); for raster.ingest. Files must be readable at one path by every executor."""
    from crestline.session import ship

    ship(spark)
    spark.dataSource.register(Tiff)
    return spark.read.format("dem_tiff").option("rows", rows).load(path)
