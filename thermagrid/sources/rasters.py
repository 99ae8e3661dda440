"""GeoTIFF and HDF5 rasters as pixel tables, and GeoTIFF files from them.

Files come through Spark's binaryFile source, so any file system that Spark reads will do; a file is decoded in the task
that read it.  GeoTIFF is decoded here with numpy and zlib alone; HDF5 needs h5py on the workers, imported when a file is
opened.  A file that can't be read gives no pixels but a row in ``file_status``.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grids import listing

#: TIFF field types (struct code), and tags of the baseline and of GeoTIFF.
_KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _STRIPS, _SAMPLES, _STRIP_ROWS, _STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
_PLANAR, _PREDICTOR, _TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_BYTES, _FORMAT = 284, 317, 322, 323, 324, 325, 339
_SCALE, _TIEPOINT, _GEOKEYS, _NODATA = 33550, 33922, 34735, 42113
_EPSG_KEYS = (2048, 3072)  # geographic, projected


@dataclass
class Raster:
    """One band: its cells, the upper left corner and size of a cell, its EPSG code and its code for missing."""

    cells: np.ndarray
    x0: float | None = None
    y0: float | None = None
    dx: float | None = None
    dy: float | None = None
    epsg: int | None = None
    nodata: float | None = None


def _lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bit first; 256 clears the table and 257 ends."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, None
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last is not None:
            table.append(last + entry[:1])
            width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
        last = entry
    return bytes(out)


def _unpacked(raw: bytes, compression: int) -> bytes:
    if compression == 1:
        return raw
    if compression == 5:
        return _lzw(raw)
    if compression in (8, 32946):
        return zlib.decompress(raw)
    raise ValueError(f"TIFF compression {compression} is not supported")


def _tags(raw: bytes) -> tuple[str, dict[int, tuple | bytes]]:
    """Byte order and the tags of the first image of a TIFF or BigTIFF file."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 16:
        raise ValueError("no TIFF file")
    version = struct.unpack(order + "H", raw[2:4])[0]
    big = version == 43
    if version not in (42, 43):
        raise ValueError("no TIFF file")
    at = struct.unpack(order + ("Q" if big else "I"), raw[8:16] if big else raw[4:8])[0]
    head, entry, inline = ("Q", "HHQ8s", 8) if big else ("H", "HHI4s", 4)
    n = struct.unpack_from(order + head, raw, at)[0]
    at += struct.calcsize(head)
    found = {}
    for _ in range(n):
        tag, kind, count, value = struct.unpack_from(order + entry, raw, at)
        at += struct.calcsize("=" + entry)
        code = _KINDS.get(kind)
        if code is None:
            continue
        size = count * struct.calcsize("=" + code)
        if size > inline:
            start = struct.unpack(order + ("Q" if big else "I"), value)[0]
            value = raw[start : start + size]
        if len(value) < size:
            raise ValueError("TIFF file is cut short")
        found[tag] = value[:count] if code == "s" else struct.unpack(order + code * count, value[:size])
    return order, found


def decode(raw: bytes, band: int = 1) -> Raster:
    """One band of the first image of a GeoTIFF file, whole."""
    order, tags = _tags(raw)

    def one(tag: int, default: int) -> int:
        return tags[tag][0] if tag in tags else default

    width, height, samples = one(_WIDTH, 0), one(_HEIGHT, 0), one(_SAMPLES, 1)
    if not 1 <= band <= samples:
        raise ValueError(f"no band {band} of {samples}")
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(_FORMAT, 1)] }{one(_BITS, 8) // 8}")
    apart = one(_PLANAR, 1) == 2
    per = 1 if apart else samples
    if _TILES in tags:
        wide, high, places, sizes = one(_TILE_WIDTH, 0), one(_TILE_HEIGHT, 0), tags[_TILES], tags[_TILE_BYTES]
    else:
        wide, high, places, sizes = width, min(one(_STRIP_ROWS, height), height), tags[_STRIPS], tags[_STRIP_BYTES]
    across, down = -(-width // wide), -(-height // high)
    cells = np.zeros((height, width), kind.newbyteorder("="))
    for k in range(across * down):
        part = k + (band - 1) * across * down if apart else k
        r, c = k // across * high, k % across * wide
        rows = high if _TILES in tags else min(high, height - r)
        data = np.frombuffer(_unpacked(raw[places[part] : places[part] + sizes[part]], one(_COMPRESSION, 1)), np.uint8)
        predictor = one(_PREDICTOR, 1)
        if predictor == 3:  # bytes of a row by significance, as differences
            planes = np.cumsum(data[: rows * wide * per * kind.itemsize].reshape(rows, -1, per), 1, dtype=np.uint8).reshape(rows, kind.itemsize, -1)
            block = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, wide, per)
        else:
            block = data.view(kind)[: rows * wide * per].reshape(rows, wide, per)
            if predictor == 2:
                block = np.cumsum(block, 1, dtype=kind.newbyteorder("="))
        cells[r : r + rows, c : c + wide] = block[: height - r, : width - c, 0 if apart else band - 1]
    found = Raster(cells)
    if _SCALE in tags and _TIEPOINT in tags:
        i, j, _, x, y, _ = tags[_TIEPOINT][:6]
        found.dx, found.dy = tags[_SCALE][:2]
        found.x0, found.y0 = x - i * found.dx, y + j * found.dy
    keys = np.array(tags.get(_GEOKEYS, (0, 0, 0, 0))).reshape(-1, 4)[1:]
    found.epsg = next((int(v) for key, place, _, v in keys if key in _EPSG_KEYS and place == 0 and v < 32767), None)
    if _NODATA in tags:
        text = bytes(tags[_NODATA]).rstrip(b"\0 ").decode()
        found.nodata = float(text) if text else None
    return found


def encode(raster: Raster, strip_rows: int = 256) -> bytes:
    """A GeoTIFF file of one band, deflated in strips."""
    cells = np.ascontiguousarray(raster.cells)
    code = {"u": 1, "i": 2, "f": 3}[cells.dtype.kind]
    strips = [zlib.compress(cells[a : a + strip_rows].astype(cells.dtype.newbyteorder("<")).tobytes()) for a in range(0, len(cells), strip_rows)]
    places = np.cumsum([8, *map(len, strips)])
    tags: list[tuple[int, str, tuple | bytes]] = [
        (_WIDTH, "I", (cells.shape[1],)), (_HEIGHT, "I", (cells.shape[0],)), (_BITS, "H", (cells.itemsize * 8,)), (_COMPRESSION, "H", (8,)),
        (_PHOTOMETRIC, "H", (1,)), (_STRIPS, "I", tuple(places[:-1].tolist())), (_SAMPLES, "H", (1,)), (_STRIP_ROWS, "I", (strip_rows,)),
        (_STRIP_BYTES, "I", tuple(map(len, strips))), (_FORMAT, "H", (code,)),
    ]
    if raster.dx is not None:
        tags += [(_SCALE, "d", (raster.dx, raster.dy, 0.0)), (_TIEPOINT, "d", (0.0, 0.0, 0.0, raster.x0, raster.y0, 0.0))]
    if raster.epsg is not None:
        model, key = (2, 2048) if raster.epsg == 4326 else (1, 3072)
        tags.append((_GEOKEYS, "H", (1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, 1, key, 0, 1, raster.epsg)))
    if raster.nodata is not None:
        tags.append((_NODATA, "s", f"{raster.nodata:g}".encode() + b"\0"))
    kinds = {"H": 3, "I": 4, "d": 12, "s": 2}
    at = int(places[-1]) + int(places[-1]) % 2
    directory, more = struct.pack("<H", len(tags)), b""
    beyond = at + 2 + 12 * len(tags) + 4
    for tag, kind, value in tags:
        data = value if kind == "s" else struct.pack("<" + kind * len(value), *value)
        if len(data) > 4:
            field = struct.pack("<I", beyond + len(more))
            more += data + b"\0" * (len(data) % 2)
        else:
            field = data.ljust(4, b"\0")
        directory += struct.pack("<HHI", tag, kinds[kind], len(value)) + field
    body = struct.pack("<2sHI", b"II", 42, at) + b"".join(strips)
    return body.ljust(at, b"\0") + directory + struct.pack("<I", 0) + more


def _quantised(raw: bytes, band: str, fallback: str | None, valid: tuple[float, float] | None) -> Raster:
    """A band of an HDF5 file in its unit: numbers in the valid range other than the fill value, times slope plus intercept."""
    import h5py

    with h5py.File(io.BytesIO(raw), "r") as file:
        name = band if band in file else fallback
        if name is None or name not in file:
            raise ValueError(f"no band {band!r}")
        data, attrs = file[name], dict(file[name].attrs)

        def number(key: str, default: float) -> float:
            return float(np.ravel(attrs[key])[0]) if key in attrs else default

        low, high = valid or tuple(np.ravel(attrs.get("valid_range", (-np.inf, np.inf))).astype(float)[:2])
        dn = np.asarray(data[()], float)
        keep = (dn >= low) & (dn <= high) & (dn != number("FillValue", np.nan))
        cells = np.where(keep, dn * number("Slope", 1.0) + number("Intercept", 0.0), np.nan)
        top = {k: float(np.ravel(file.attrs[k])[0]) for k in ("Left-Top X", "Left-Top Y", "Resolution X", "Resolution Y") if k in file.attrs}
    return Raster(cells, top.get("Left-Top X"), top.get("Left-Top Y"), top.get("Resolution X"), top.get("Resolution Y"))


def _files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return found.where(~F.element_at(F.split("path", "/"), -1).startswith(".")).select("path", "content")


#: Pixels that one Arrow batch of a decoded file holds.
BATCH_PIXELS = 1 << 20


def _pixels(files: DataFrame, opened: Callable[[bytes], Raster], nodata: float | None) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    raster = opened(content.as_buffer().to_pybytes())
                except Exception:  # such a file has a row in file_status
                    continue
                missing = raster.nodata if nodata is None else nodata
                height, width = raster.cells.shape
                step = max(1, BATCH_PIXELS // max(1, width))
                for a in range(0, height, step):
                    v = raster.cells[a : a + step].astype(float).ravel()
                    r, c = np.divmod(np.arange(len(v), dtype=np.int64), width)
                    bad = ~np.isfinite(v) | ((v == missing) if missing is not None else False)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]).take(pa.array(np.zeros(len(v), np.int64))), pa.array((r + a).astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(v, mask=bad)],
                        ["path", "r", "c", "value"],
                    )

    from ..functions.calendar import file_date

    rows = files.mapInArrow(read, "path string, r int, c int, value double")
    return rows.select("path", file_date(F.col("path")).alias("d"), "r", "c", "value")


def read_geotiff(spark: SparkSession, folder: str, glob: str = "*.tif", band: int = 1, nodata: float | None = None) -> DataFrame:
    """(path, d, r, c, value) of the GeoTIFF files of a folder; d is the date in a file's name.  nodata, or else the
    file's own code, is NULL, as are NaN and infinity."""
    return _pixels(_files(spark, folder, glob), lambda raw: decode(raw, band), nodata)


def read_hdf5(spark: SparkSession, folder: str, band: str, fallback: str | None = None, valid: tuple[float, float] | None = None, glob: str = "*.HDF") -> DataFrame:
    """(path, d, r, c, value) of a band, or else the fallback band, of the HDF5 files of a folder, in its unit.  valid
    replaces the file's own valid range."""
    return _pixels(_files(spark, folder, glob), lambda raw: _quantised(raw, band, fallback, valid), None)


def file_status(spark: SparkSession, folder: str, glob: str = "*.tif", opened: Callable[[bytes], Raster] = decode, least_bytes: int = 1024) -> DataFrame:
    """(path, d, status, reason, and the grid's x0, y0, dx, dy, rows, cols, crs) of every file: ok, or error where it is
    too short or can't be decoded."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    raw = content.as_buffer().to_pybytes()
                    if len(raw) < least_bytes:
                        raise ValueError(f"only {len(raw)} bytes")
                    x = opened(raw)
                    rows.append((path, "ok", None, x.x0, x.y0, x.dx, x.dy, *x.cells.shape, f"EPSG:{x.epsg}" if x.epsg else None))
                except Exception as error:  # the row says why
                    rows.append((path, "error", f"{type(error).__name__}: {error}"[:300], *[None] * 7))
            kinds = [pa.string()] * 3 + [pa.float64()] * 4 + [pa.int32()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["path", "status", "reason", "x0", "y0", "dx", "dy", "rows", "cols", "crs"]
    schema = "path string, status string, reason string, x0 double, y0 double, dx double, dy double, rows int, cols int, crs string"
    found = _files(spark, folder, glob).mapInArrow(look, schema)
    days = listing(spark, folder, glob).select("path", "d")
    return days.join(found, "path").select("path", "d", *names[1:])


def write_geotiff(df: DataFrame, value: str, folder: str, shape: tuple[int, int], corner: tuple[float, float], size: tuple[float, float], epsg: int | None = 4326, nodata: float = -9999.0, kind: str = "float32", rows: int = 4096) -> DataFrame:
    """Write df (d, r, c, value) as GeoTIFF files, one for each day and ``rows`` rows of the grid, each with its own place;
    NULL becomes nodata.  Returns (path, bytes).

    The folder must be one that all executors share; a file is moved into place whole, so a repeated task replaces it.
    A task holds the rows of one file."""

    def save(key: tuple, group: pa.Table) -> pa.Table:
        from pyarrow import fs

        day, block = key[0].as_py(), key[1].as_py()
        first = block * rows
        cells = np.full((min(rows, shape[0] - first), shape[1]), nodata, kind)
        there = group.column("v").is_valid().to_numpy()
        r, c = group.column("r").to_numpy() - first, group.column("c").to_numpy()
        cells[r[there], c[there]] = group.column("v").to_numpy()[there]
        raw = encode(Raster(cells, corner[0], corner[1] - first * size[1], *size, epsg, nodata))
        store, root = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        name = f"{day:%Y%m%d}_{value}" + (f"_{block:04d}.tif" if shape[0] > rows else ".tif")
        draft = f"{root}/.{name}.{np.random.default_rng().integers(1 << 62)}"
        with store.open_output_stream(draft, compression=None) as out:
            out.write(raw)
        store.move(draft, f"{root}/{name}")
        return pa.table({"path": [f"{folder}/{name}"], "bytes": pa.array([len(raw)], pa.int64())})

    cells = df.select("d", F.expr(f"cast(r div {rows} as int)").alias("block"), "r", "c", F.col(value).cast("double").alias("v"))
    return cells.groupBy("d", "block").applyInArrow(save, "path string, bytes long")
