"""Figures as PNG files, and PNG base maps as rows of pixels.

What is drawn is aggregated on the cluster to at most a picture's bars or pixels; only that reaches the driver. There
is no text but numbers, for which a small font is enough.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.operators.summary import known, scaled

#: Width and height of a figure in pixels.
SIZE = (800, 600)
MARGIN = 48
#: Colours of histograms that share a figure, in turn, and the ends and middle of a value's range.
COLOURS = ((70, 130, 180), (220, 120, 50), (60, 150, 90), (170, 70, 140), (130, 110, 70), (90, 90, 90))
RAMP = np.array([(48, 40, 120), (60, 160, 140), (250, 220, 70)], float)

#: Channels by a PNG's colour type; 3 is a palette.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Digits of three by five dots, a row for each string.
_DIGITS = {
    "0": "### #.# #.# #.# ###", "1": ".#. ##. .#. .#. ###", "2": "### ..# ### #.. ###", "3": "### ..# ### ..# ###",
    "4": "#.# #.# ### ..# ..#", "5": "### #.. ### ..# ###", "6": "### #.. ### #.# ###", "7": "### ..# ..# ..# ..#",
    "8": "### #.# ### #.# ###", "9": "### #.# ### ..# ###", "-": "... ... ### ... ...", ".": "... ... ... ... .#.",
}


def png_bytes(pixels: np.ndarray) -> bytes:
    """A PNG of an array (height, width, 3) of bytes."""
    height, width, _ = pixels.shape
    lines = np.zeros((height, 1 + 3 * width), np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def png_pixels(content: bytes) -> np.ndarray:
    """(height, width, 3) bytes of a PNG of eight bits a channel that isn't interlaced: gray becomes three equal channels, alpha goes."""
    if content[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, palette, head = 8, b"", None, None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced:
        raise ValueError("only PNGs of eight bits a channel, not interlaced")
    n = _CHANNELS[colour]
    held = _unfiltered(np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * n), n).reshape(height, width, n)
    if colour == 3:
        return palette[held[:, :, 0]]
    return np.repeat(held[:, :, :1], 3, axis=2) if n < 3 else held[:, :, :3]


def _unfiltered(lines: np.ndarray, n: int) -> np.ndarray:
    """A PNG's lines, each after its filter's number, as the bytes that were filtered; n bytes a pixel."""
    height, width = lines.shape[0], lines.shape[1] - 1
    out = np.zeros((height + 1, n + width), np.uint8)  # zeros above and to the left
    for y, line in enumerate(lines, 1):
        kind, row, above = line[0], line[1:], out[y - 1]
        if kind == 0:
            out[y, n:] = row
        elif kind == 1:
            out[y, n:] = np.cumsum(row.reshape(-1, n), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y, n:] = row + above[n:]
        else:
            now, up = [0] * (n + width), above.tolist()
            for k, v in enumerate(row.tolist(), n):
                a, b, c = now[k - n], up[k], up[k - n]
                near = (a + b) // 2 if kind == 3 else min((a, b, c), key=lambda x: abs(a + b - c - x))
                now[k] = (v + near) & 255
            out[y] = now
    return out[1:, n:]


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """path, image_row, rgb (red, green and blue of each column in turn) of PNG files; for summary.image_values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                pixels = png_pixels(bytes(content))
                for k in range(0, len(pixels), 256):
                    part = pixels[k : k + 256]
                    yield pd.DataFrame({"path": name, "image_row": np.arange(k, k + len(part), dtype=np.int32), "rgb": list(part.reshape(len(part), -1).astype(np.int32))})

    held = spark.read.format("binaryFile").load(path).select("path", "content")
    return held.mapInPandas(run, "path string, image_row int, rgb array<int>")


def _blank(size: tuple[int, int]) -> np.ndarray:
    return np.full((size[1], size[0], 3), 255, np.uint8)


def _write(pixels: np.ndarray, path: str) -> None:
    with open(path, "wb") as f:
        f.write(png_bytes(pixels))


def _number(pixels: np.ndarray, x: int, y: int, value: float, scale: int = 2) -> None:
    """A number, its first dot at x, y."""
    for k, sign in enumerate(c for c in f"{value:.6g}" if c in _DIGITS):
        dots = np.array([[d == "#" for d in row] for row in _DIGITS[sign].split()]).repeat(scale, 0).repeat(scale, 1)
        left = x + k * 4 * scale
        place = pixels[y : y + dots.shape[0], left : left + dots.shape[1]]
        place[dots[: place.shape[0], : place.shape[1]]] = 0


def histogram_figure(bins: DataFrame, path: str, by: str | None = None, size: tuple[int, int] = SIZE) -> int:
    """Draws histogram's rows as bars, a group's outlined over the others; how many groups. One bin is one row of bins."""
    keys = [by] if by else []
    rows = bins.select(*keys, "bin", "left", "right", "n").orderBy(*keys, "bin").collect()  # bins times groups
    pixels = _blank(size)
    if not rows:
        _write(pixels, path)
        return 0
    lo, hi, top = min(r.left for r in rows), max(r.right for r in rows), max(1, max(r.n for r in rows))
    width, height = size[0] - 2 * MARGIN, size[1] - 2 * MARGIN
    base = MARGIN + height
    x = lambda v: MARGIN + round((v - lo) / (hi - lo) * width)
    groups = sorted({str(r[by]) for r in rows}) if by else [""]
    for r in rows:
        colour = COLOURS[groups.index(str(r[by]) if by else "") % len(COLOURS)]
        a, b, y = x(r.left), max(x(r.left) + 1, x(r.right)), base - round(r.n / top * height)
        bar = pixels[y:base, a:b]
        bar[:] = colour if len(groups) == 1 else (bar.astype(int) + colour) // 2  # several shine through
        pixels[y:base, [a, b - 1]] = 0 if len(groups) == 1 else colour
        pixels[y : y + 2, a:b] = colour
    pixels[base, MARGIN : MARGIN + width + 1] = 0
    pixels[MARGIN : base + 1, MARGIN] = 0
    for v in (lo, (lo + hi) / 2, hi):
        _number(pixels, max(2, x(v) - 16), base + 10, v)
    _number(pixels, 2, MARGIN, top)
    _write(pixels, path)
    return len(groups)


def _shaded(places: list[tuple[int, int, float | None]], pixels: np.ndarray, dot: int) -> None:
    for r, c, v in places:
        at = (v or 0.0) * (len(RAMP) - 1)
        k = min(int(at), len(RAMP) - 2)
        colour = (200, 200, 200) if v is None else (RAMP[k] + (RAMP[k + 1] - RAMP[k]) * (at - k)).astype(np.uint8)
        pixels[r : r + dot, c : c + dot] = colour


def map_figure(df: DataFrame, value: str, path: str, lat: str = "lat", lon: str = "lon", size: tuple[int, int] = SIZE, dot: int = 3) -> int:
    """Draws rows at their longitude and latitude, coloured by the mean value under each pixel; how many pixels."""
    ends = df.agg(F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east"))
    held = df.select(F.col(lat).alias("y"), F.col(lon).alias("x"), known(value).alias("v")).join(F.broadcast(ends))  # one row
    across = F.coalesce(F.try_divide(F.col("x") - F.col("west"), F.col("east") - F.col("west")), F.lit(0.5))
    down = F.coalesce(F.try_divide(F.col("north") - F.col("y"), F.col("north") - F.col("south")), F.lit(0.5))
    return _pixels(held.where("x is not null and y is not null"), across, down, F.avg("v"), path, size, dot)


def cloud_figure(df: DataFrame, path: str, azimuth: float = 30.0, elevation: float = 20.0, size: tuple[int, int] = SIZE, dot: int = 3) -> int:
    """Draws points x, y, z with a value, seen from far away in a direction (degrees); of a pixel's points the nearest shows."""
    a, e = math.radians(azimuth), math.radians(elevation)
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    right = y * math.cos(a) - x * math.sin(a)
    ahead = x * math.cos(a) + y * math.sin(a)
    held = df.where("x is not null and y is not null and z is not null").select(right.alias("u"), (z * math.cos(e) - ahead * math.sin(e)).alias("w"), (ahead * math.cos(e) + z * math.sin(e)).alias("depth"), known("value").alias("v"))
    edge = F.greatest(F.max("u") - F.min("u"), F.max("w") - F.min("w"))
    ends = held.agg(((F.max("u") + F.min("u")) / 2).alias("mid_u"), ((F.max("w") + F.min("w")) / 2).alias("mid_w"), edge.alias("edge"))
    held = held.join(F.broadcast(ends))  # one row
    across = F.coalesce(F.try_divide(F.col("u") - F.col("mid_u"), F.col("edge")), F.lit(0.0)) * (min(size) / size[0]) + 0.5
    down = F.coalesce(F.try_divide(F.col("mid_w") - F.col("w"), F.col("edge")), F.lit(0.0)) * (min(size) / size[1]) + 0.5
    return _pixels(held, across, down, F.max_by("v", "depth"), path, size, dot)


def _pixels(held: DataFrame, across: Column, down: Column, shown: Column, path: str, size: tuple[int, int], dot: int) -> int:
    """Draws shown of the rows of each pixel, its place given as shares of the figure."""
    width, height = size[0] - 2 * MARGIN, size[1] - 2 * MARGIN
    r, c = F.floor(down * (height - dot)).cast("int"), F.floor(across * (width - dot)).cast("int")
    cells = scaled(held.groupBy(r.alias("r"), c.alias("c")).agg(shown.alias("v")), "v")
    places = [(MARGIN + p.r, MARGIN + p.c, p.shade) for p in cells.select("r", "c", "shade").collect()]  # a figure's pixels at most
    pixels = _blank(size)
    _shaded(sorted(places, key=lambda p: p[:2]), pixels, dot)
    _write(pixels, path)
    return len(places)
