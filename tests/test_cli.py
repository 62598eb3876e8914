import json
import math
import struct

import numpy as np
import pytest

from crestline.__main__ import main
from crestline.functions.geo import RADIUS_M
from crestline.sources import tiff
from crestline.sources.figures import png_pixels


def write_tiff(path, data, scale, tie, nodata, order="<", strip=7):
    """Uncompressed strips of 16-bit integers."""
    rows, cols = data.shape
    strips = [data[k : k + strip].astype(f"{order}i2").tobytes() for k in range(0, rows, strip)]
    entries, extra, at = [], b"", 8 + sum(map(len, strips))
    offsets = np.cumsum([8, *map(len, strips)])[:-1]

    def tag(number, kind, code, *values):
        nonlocal extra
        body = values[0] if kind == 2 else struct.pack(f"{order}{len(values)}{code}", *values)
        n = len(body) if kind == 2 else len(values)
        if len(body) > 4:
            extra, body = extra + body, struct.pack(f"{order}I", at + len(extra))
        entries.append(struct.pack(f"{order}HHI", number, kind, n) + body.ljust(4, b"\0"))

    for number, value in ((256, cols), (257, rows), (258, 16), (259, 1)):
        tag(number, 3, "H", value)
    tag(273, 4, "I", *offsets)
    tag(277, 3, "H", 1)
    tag(278, 3, "H", strip)
    tag(339, 3, "H", 2)
    tag(33550, 12, "d", *scale)
    tag(33922, 12, "d", *tie)
    tag(42113, 2, "s", nodata)
    directory = struct.pack(f"{order}H", len(entries)) + b"".join(entries) + b"\0" * 4
    path.write_bytes((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, at + len(extra)) + b"".join(strips) + extra + directory)


@pytest.fixture(params=["<", ">"])
def picture(request, tmp_path):
    data = (np.arange(36 * 72).reshape(36, 72) * 37 % 4001 - 2000).astype(np.int16)
    data[3, 4] = -32768
    px = (2 * math.pi * RADIUS_M / 72, math.pi * RADIUS_M / 36)
    write_tiff(tmp_path / "a.tif", data, (*px, 0.0), (0.0, 0.0, 0.0, -math.pi * RADIUS_M, math.pi * RADIUS_M / 2, 0.0), b"-32768\0", request.param)
    return tmp_path / "a.tif", data


def test_tiff(spark, picture):
    path, data = picture
    assert tiff.inspect(str(path))["shape"] == [36, 72]
    rows = {r.row: r.dn for r in tiff.read_tiff(spark, str(path), 10).collect()}
    assert all(rows[k] == data[k].tolist() for k in range(36))
    path.write_bytes(b"no")
    with pytest.raises(ValueError):
        tiff.tags(str(path))


def test_coordinate_system():
    keys = (1, 1, 0, 3, 1024, 0, 1, 1, 1026, 34737, 5, 0, 3072, 0, 1, 32767)
    assert tiff.coordinate_system({34735: keys, 34737: (b"Moon|\0",)}) == {"projected": True, "geographic": False, "code": None, "name": "Moon"}
    assert tiff.coordinate_system({34735: (1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 30100)})["code"] == 30100
    assert tiff.coordinate_system({}) is None


def test_commands(spark, picture, capsys):
    path, data = picture
    at = lambda x: str(path.parent / x)
    main(["ingest", str(path), at("dem"), "--scale", "0.5", "--raw"], spark)
    main(["check", at("dem"), "1", "1"], spark)
    assert str(data[17, 36] * 0.5) in capsys.readouterr().out
    main(["downsample", at("dem"), at("small"), "--factor", "3", "--method", "max"], spark)
    main(["check", at("small"), "1", "1"], spark)
    assert str(data[15:18, 36:39].max() * 0.5) in capsys.readouterr().out
    main(["grid", at("dem"), at("grid.json"), "--stride", "12", "--radius", "60", "--azimuths", "4"], spark)
    main(["to-csv", at("grid.json")], spark)
    main(["polar-columns", at("grid.json")], spark)
    main(["polar", at("dem"), at("polar"), "--spacing", "400", "--radius", "60", "--azimuths", "4"], spark)
    main(["box", at("dem"), at("box.csv"), "--lat", "-6", "4", "--lon", "0", "9", "--spacing", "100", "--radius", "60", "--azimuths", "4"], spark)
    main(["box", at("dem"), at("heights"), "--elevation-only", "--spacing", "50"], spark)
    main(["point", at("dem"), "1", "2", "--azimuths", "4"], spark)
    main(["histogram", at("grid.csv"), "--bins", "3"], spark)
    main(["histogram", at("grid.csv"), "--bins", "3", "--figures", at("drawn")], spark)
    main(["figure", at("grid.csv"), at("map.png")], spark)
    main(["figure", at("grid.json"), at("cloud.png"), "--kind", "cloud"], spark)
    names = [path.parent / "map.png", path.parent / "cloud.png", *(path.parent / "drawn").iterdir()]
    assert len(names) >= 4 and all(len({tuple(p) for p in png_pixels(x.read_bytes()).reshape(-1, 3).tolist()}) > 2 for x in names)
    main(["inspect", str(path)], spark)
    assert spark.read.parquet(at("polar")).count() > 0 and spark.read.parquet(at("heights")).count() > 0
    with pytest.raises(FileExistsError):
        main(["polar", at("dem"), at("polar"), "--spacing", "400"], spark)
    with pytest.raises(SystemExit):
        main(["to-csv", "a", "b", "--output", "c"], spark)


def test_runs_resume(spark, picture, capsys):
    """A run in slices goes on where it ended; metadata, what probes cost and a summary come with it."""
    at = lambda x: str(picture[0].parent / x)
    main(["ingest", str(picture[0]), at("dem"), "--scale", "0.5", "--raw", "--chunk-mb", "0.001"], spark)
    assert spark.read.parquet(at("dem/rows")).where("chunk = 1").count() > 0 and any(x.name == "chunk=1" for x in (picture[0].parent / "dem/rows").iterdir())
    capsys.readouterr()
    main(["grid", at("dem"), at("none"), "--stride", "12", "--lat-max", "-95"], spark)
    assert "no targets" in capsys.readouterr().out
    box = ["box", at("dem"), at("run"), "--lat", "-6", "4", "--lon", "0", "9", "--spacing", "50", "--radius", "60", "--azimuths", "4", "--resume", "--slice", "11", "--checkpoint-seconds", "0.01"]
    main([*box, "--probe", "2", "--probe-first"], spark)
    said = capsys.readouterr().out
    assert "2 probes took" in said and "v_p95" in said and "min left" in said
    n = spark.read.parquet(at("run")).count()
    files = len(spark.read.parquet(at("run")).inputFiles())
    main(box, spark)
    held = spark.read.parquet(at("run"))
    assert held.count() == n == held.select("target_id").distinct().count() and len(held.inputFiles()) == files > 1
    meta = json.loads((picture[0].parent / "run.meta.json").read_text())
    assert meta["targets"] == n and meta["command"] == "box" and meta["dem"]["shape"] == [36, 72]
    (picture[0].parent / "few.csv").write_text("a,b\n1,\n")
    main(["histogram", at("few.csv"), "--column", "b"], spark)
    assert "skipped" in capsys.readouterr().out
