"""Raster files in and out, grids at rest, and what becomes of files that can't be read."""

import datetime as dt
import struct
import sys
import types
import zlib

import numpy as np
import pytest

from thermagrid.sources import grids, rasters

DAY = dt.date(2024, 1, 5)


@pytest.mark.parametrize("kind", ["uint8", "int16", "uint16", "int32", "float32", "float64"])
def test_a_raster_comes_back_as_it_was(kind):
    cells = (np.arange(700).reshape(20, 35) % 200).astype(kind)
    got = rasters.decode(rasters.encode(rasters.Raster(cells, 100.5, 40.0, 0.25, 0.5, 4326, -9999.0), strip_rows=6))
    assert got.cells.dtype == cells.dtype and np.array_equal(got.cells, cells)
    assert (got.x0, got.y0, got.dx, got.dy, got.epsg, got.nodata) == (100.5, 40.0, 0.25, 0.5, 4326, -9999)


def lzw(raw):
    """The format's compression, as its specification has it."""
    out, held, bits = bytearray(), 0, 0

    def put(code, width):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)

    put(256, 9)
    table, width, w = {bytes([i]): i for i in range(256)}, 9, b""
    following = 258
    for x in raw:
        k = bytes([x])
        if w + k in table:
            w += k
            continue
        put(table[w], width)
        table[w + k] = following
        following += 1
        if following == 511 + 1:
            width = 10
        elif following == 1023 + 1:
            width = 11
        elif following == 2047 + 1:
            width = 12
        elif following == 4094:
            put(256, width)
            table, width, following = {bytes([i]): i for i in range(256)}, 9, 258
        w = k
    put(table[w], width)
    put(257, width)
    out.append(held << (8 - bits) & 255)
    return bytes(out)


def tiff(order, data, width, height, compression, extra=(), bits=16, samples=1):
    """A file with tiles or strips given by extra, in either byte order."""
    tags = [(256, 4, (width,)), (257, 4, (height,)), (258, 3, (bits,)), (259, 3, (compression,)), (277, 3, (samples,)), *extra]
    at = 8 + len(data) + len(data) % 2
    codes = {3: "H", 4: "I"}
    directory, more, beyond = struct.pack(order + "H", len(tags)), b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, value in sorted(tags):
        field = struct.pack(order + codes[kind] * len(value), *value)
        if len(field) > 4:
            more, field = more + field, struct.pack(order + "I", beyond + len(more))
        directory += struct.pack(order + "HHI", tag, kind, len(value)) + field.ljust(4, b"\0")
    return (struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, at) + data).ljust(at, b"\0") + directory + struct.pack(order + "I", 0) + more


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [1, 5, 8])
def test_strips_of_other_writers(order, compression):
    cells = np.random.default_rng(1).integers(0, 300, (50, 41)).astype("u2")
    pack = {1: bytes, 5: lzw, 8: zlib.compress}[compression]
    strips = [pack(cells[a : a + 20].astype(order + "u2").tobytes()) for a in (0, 20, 40)]
    places = np.cumsum([8, *map(len, strips)]).tolist()
    raw = tiff(order, b"".join(strips), 41, 50, compression, [(273, 4, tuple(places[:3])), (278, 4, (20,)), (279, 4, tuple(map(len, strips)))])
    assert np.array_equal(rasters.decode(raw).cells, cells)


def test_tiles_with_differences_and_several_bands():
    cells = np.random.default_rng(2).integers(0, 9000, (37, 45, 2)).astype("u2")
    tiles = []
    for r in (0, 32):
        for c in (0, 32):
            block = np.zeros((32, 32, 2), "u2")
            part = cells[r : r + 32, c : c + 32]
            block[: part.shape[0], : part.shape[1]] = part
            tiles.append(zlib.compress(np.diff(block, axis=1, prepend=np.zeros((32, 1, 2), "u2")).astype("<u2").tobytes()))
    places = np.cumsum([8, *map(len, tiles)]).tolist()
    extra = [(317, 3, (2,)), (322, 4, (32,)), (323, 4, (32,)), (324, 4, tuple(places[:4])), (325, 4, tuple(map(len, tiles)))]
    raw = tiff("<", b"".join(tiles), 45, 37, 8, extra, samples=2)
    for band in (1, 2):
        assert np.array_equal(rasters.decode(raw, band).cells, cells[:, :, band - 1])
    with pytest.raises(ValueError):
        rasters.decode(raw, 3)


def test_files_of_days_and_their_status(spark, tmp_path):
    rows = [(DAY + dt.timedelta(k), r, c, None if (r + c) % 4 == 0 else 270.0 + k + r + c / 8) for k in range(2) for r in range(10) for c in range(6)]
    df = spark.createDataFrame(rows, "d date, r int, c int, lst double")
    folder = f"file://{tmp_path}/out"
    files = rasters.write_geotiff(df, "lst", folder, (10, 6), (100.0, 50.0), (0.25, 0.25), rows=4).collect()
    assert len(files) == 6 and all(r.bytes > 0 for r in files)
    (tmp_path / "out" / "20240109_bad.tif").write_bytes(b"II*\0" + b"x" * 2000)
    (tmp_path / "out" / "20240110_short.tif").write_bytes(b"II*\0")
    status = {r.path.rsplit("/", 1)[1]: r for r in rasters.file_status(spark, folder, least_bytes=16).collect()}
    assert {n for n, r in status.items() if r.status == "error"} == {"20240109_bad.tif", "20240110_short.tif"}
    part = status["20240105_lst_0001.tif"]
    assert (part.d, part.rows, part.cols, part.y0, part.crs) == (DAY, 4, 6, 49.0, "EPSG:4326")
    back = rasters.read_geotiff(spark, folder).collect()
    first = {r.path: r for r in rasters.file_status(spark, folder, least_bytes=16).collect()}
    got = {(r.d, r.r + round((50.0 - first[r.path].y0) / 0.25), r.c): r.value for r in back}
    assert got == {(d, r, c): v if v is None else pytest.approx(v, abs=1e-4) for d, r, c, v in rows}


class Band(np.ndarray):
    attrs: dict


def test_quantised_bands_and_their_fallback(monkeypatch):
    dn = np.array([[10, -1, 200], [32767, 5, 7]])

    class File(dict):
        attrs = {"Left-Top X": np.array([5.0]), "Left-Top Y": 7.0, "Resolution X": 0.5, "Resolution Y": [0.5]}

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    band = dn.view(Band)
    band.attrs = {"Slope": np.array([0.5]), "Intercept": 100.0, "valid_range": [0, 150], "FillValue": 7}
    fake = types.ModuleType("h5py")
    fake.File = lambda *_: File({"LST": band})
    monkeypatch.setitem(sys.modules, "h5py", fake)
    got = rasters._quantised(b"", "none", "LST", None)
    assert np.array_equal(got.cells, [[105, np.nan, np.nan], [np.nan, 102.5, np.nan]], equal_nan=True) and (got.x0, got.dy) == (5.0, 0.5)
    assert rasters._quantised(b"", "LST", None, (0, 32767)).cells[1, 0] == 0.5 * 32767 + 100
    with pytest.raises(ValueError):
        rasters._quantised(b"", "none", None, None)


def test_a_window_reads_its_tiles_only(spark, tmp_path):
    rows = [(DAY + dt.timedelta(k), r, c, float(100 * r + c + k)) for k in range(3) for r in range(20) for c in range(20)]
    path = f"{tmp_path}/tiles"
    grids.write_tiles(grids.tiled(spark.createDataFrame(rows, "d date, r int, c int, v double"), "v", 4), path)
    got = grids.window_read(spark, path, "v", (5, 9), (2, 6), ("2024-01-06", "2024-01-06"), 4)
    assert {(r.d, r.r, r.c, r.v) for r in got.collect()} == {x for x in rows if x[0] == DAY + dt.timedelta(1) and 5 <= x[1] < 9 and 2 <= x[2] < 6}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(d" in plan and "GreaterThanOrEqual(tile_r,1)" in plan


def test_repeated_pixels_and_types_of_tiles(spark):
    df = spark.createDataFrame([(DAY, 0, 0, 3.0), (DAY, 0, 0, 2.0), (DAY, 0, 1, None), (DAY, 5, 2, 7.0)], "d date, r int, c int, v double")
    tiles = grids.tiled(df, "v", 4, "short")
    assert dict(tiles.dtypes)["values"] == "array<smallint>"
    assert {(r.r, r.c, r.v) for r in grids.untiled(tiles, "v", 4).collect()} == {(0, 0, 2.0), (5, 2, 7.0)}


def test_grids_without_a_place_or_system(spark):
    rows = [("a", 10.0, 20.0, 0.5, 0.5, 4, 6, "EPSG:6933"), ("b", None, None, None, None, 180, 360, None), ("c", 10.0, 20.0, 0.5, 0.5, 4, 6, "EPSG:6933")]
    table = spark.createDataFrame(rows, "name string, x0 double, y0 double, dx double, dy double, rows int, cols int, crs string")
    got = {r.name: (r.min_x, r.max_y, r.max_x, r.min_y, r.crs) for r in grids.bounds(table).collect()}
    assert got["a"] == (10, 20, 13, 18, "EPSG:6933") and got["b"] == (-180, 90, 180, -90, "EPSG:4326")
    assert {r.name: r.as_name for r in grids.same_grid(table).collect()} == {"a": "a", "b": "b", "c": "a"}


def test_masks_reports_and_codes_for_missing(spark, tmp_path):
    df = spark.createDataFrame([(DAY, 0, 0, 1.5), (DAY, 0, 1, None), (DAY, 1, 0, 3.0)], "d date, r int, c int, v double")
    assert sorted(r.v for r in grids.exported(df, "v").collect()) == [-9999.0, 1.5, 3.0]
    mask = spark.createDataFrame([(0, 0, 5.0), (1, 0, None)], "r int, c int, dem double")
    assert {(r.r, r.c): r.v for r in grids.masked(df, "v", mask, "dem").collect()} == {(0, 0): 1.5, (0, 1): None, (1, 0): None}
    grids.write_report(df, f"{tmp_path}/report")
    assert spark.read.csv(f"{tmp_path}/report", header=True, inferSchema=True).count() == 3
    assert len(list((tmp_path / "report").glob("part-*"))) == 1
    assert grids.empty(spark, 3, 4, "v").where("v is null").count() == 12
