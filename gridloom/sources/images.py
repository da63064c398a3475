"""Sinks: PNG and GeoTIFF bytes of tiles, GeoTIFF files that tasks write, and the export archive of a mosaic."""

from __future__ import annotations

import io
import os
import re
import struct
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.errors import RasterException
from gridloom.functions import tilemath
from gridloom.functions.colors import Color
from gridloom.operators.aggregate import class_condition
from gridloom.operators.layers import is_sparse
from gridloom.sources.byteranges import local_path
from gridloom.sources.tilestore import delete


def encode_png(rgba: np.ndarray) -> bytes:
    """A PNG of an array (height, width, 4) of bytes."""
    height, width, _ = rgba.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), rgba.astype(np.uint8).reshape(height, -1)], axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def encode_tiff(bands: list[np.ndarray], origin: tuple[float, float], scale: tuple[float, float], nodata: float | None = None) -> bytes:
    """A GeoTIFF of doubles, one deflated strip for each band."""
    height, width = bands[0].shape
    return tiff_of_strips([[zlib.compress(b.astype("<f8").tobytes())] for b in bands], width, height, height, origin, scale, nodata)


def tiff_of_strips(bands: list[list[bytes]], width: int, height: int, rows: int, origin: tuple[float, float], scale: tuple[float, float], nodata: float | None = None) -> bytes:
    """A GeoTIFF of doubles from deflated strips of ``rows`` rows each, band after band."""
    n, strips = len(bands), [strip for band in bands for strip in band]
    wanted = [(256, "I", [width]), (257, "I", [height]), (258, "H", [64] * n), (259, "H", [8]), (262, "H", [1]), (273, "I", None), (277, "H", [n]), (278, "I", [rows]),
              (279, "I", [len(s) for s in strips]), (284, "H", [2 if n > 1 else 1]), (339, "H", [3] * n), (33550, "d", [scale[0], abs(scale[1]), 0.0]), (33922, "d", [0.0, 0.0, 0.0, *origin, 0.0])]
    text = b"" if nodata is None else f"{nodata!r}\0".encode()
    entries = len(wanted) + bool(text)
    free = 8 + 2 + 12 * entries + 4
    sizes = {t: struct.calcsize(f"<{len(v) if v else len(strips)}{k}") for t, k, v in wanted}
    data_at = free + sum(s for s in sizes.values() if s > 4) + (len(text) if len(text) > 4 else 0)
    starts = [data_at + sum(map(len, strips[:i])) for i in range(len(strips))]
    head, tail = b"II*\0" + struct.pack("<IH", 8, entries), b""
    for tag, kind, values in wanted:
        raw = struct.pack(f"<{len(strips) if values is None else len(values)}{kind}", *(starts if values is None else values))
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", free + len(tail))
        tail += raw if len(raw) > 4 else b""
        head += struct.pack("<HHI", tag, {"H": 3, "I": 4, "d": 12}[kind], len(strips) if values is None else len(values)) + place
    if text:
        head += struct.pack("<HHI", 42113, 2, len(text)) + (text.ljust(4, b"\0") if len(text) <= 4 else struct.pack("<I", free + len(tail)))
        tail += text if len(text) > 4 else b""
    return head + struct.pack("<I", 0) + tail + b"".join(strips)


def png_tiles(tiles: DataFrame, tile_size: int) -> DataFrame:
    """tilez, tilex, tiley, png of tiles with arrays r, g, b, a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            channels = [batch.column(k).to_pylist() for k in range(3, 7)]
            images = [encode_png(np.array(c, dtype=np.int64).T.reshape(tile_size, tile_size, 4)) for c in zip(*channels, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(images, pa.binary())], names=["tilez", "tilex", "tiley", "png"])

    return tiles.select("tilez", "tilex", "tiley", "r", "g", "b", "a").mapInArrow(run, "tilez int, tilex int, tiley int, png binary")


def rendered(tiles: DataFrame, colormap: dict[str, Color], tile_size: int) -> DataFrame:
    """tilez, tilex, tiley, png and ``statistics`` (a map of class to pixels) of tiles (data) in a discrete colour map.

    The classes of a pixel are evaluated once, as bits of one number. Of
    overlapping classes the later one gives the colour, and each counts for itself;
    classes without pixels count 0.
    """
    names, palette = list(colormap), np.array([(0, 0, 0, 0), *colormap.values()], np.uint8)
    if len(names) > 62:
        raise RasterException("A colour map may have 62 classes at most.")

    def bits(value: Column) -> Column:
        found = [F.when(class_condition(name, value, masked=True), 1 << k).otherwise(0).cast("long") for k, name in enumerate(names)]
        return reduce(lambda a, b: a + b, found, F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images, counts = [], []
            for k in range(batch.num_rows):
                classes = batch.column(3)[k].values.to_numpy(zero_copy_only=False)
                kinds, at, sizes = np.unique(classes, return_inverse=True, return_counts=True)
                last = np.array([int(kind).bit_length() for kind in kinds])
                images.append(encode_png(palette[last[at]].reshape(tile_size, tile_size, 4)))
                counts.append([(name, int(sizes[(kinds >> j) & 1 == 1].sum())) for j, name in enumerate(names)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(images, pa.binary()), pa.array(counts, pa.map_(pa.string(), pa.int64()))], names=["tilez", "tilex", "tiley", "png", "statistics"])

    return tiles.select("tilez", "tilex", "tiley", F.transform("data", bits).alias("classes")).mapInArrow(run, "tilez int, tilex int, tiley int, png binary, statistics map<string,bigint>")


def colormap_text(colormap: dict) -> str:
    """The colour map as lines of value and channels; a continuous one has its colours and range."""
    # The form of the first two lines and of an entry.
    kind = "CONTINUOUS" if colormap.get("continuous") else "DISCRETE"
    entries = (",".join([str(k), *map(str, v), str(k)]) for k, v in colormap.items() if k != "continuous")
    return "\n".join(["# Raster Algebra Colormap", f"INTERPOLATION: {kind}", *entries, ""])


def slug(text: str, most: int = 100) -> str:
    """A file name of lower-case ASCII letters, digits, dashes and underscores."""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s-]", "", plain.lower())).strip("-_")[:most]


def export_name(filename: str = "", now: datetime | None = None) -> str:
    """The name of an export without its ending: a prefix, the user's name if given, and the time."""
    return "_".join(filter(None, ["algebra_export", slug(filename), f"{now or datetime.now():%Y_%m_%d_%H_%M}"]))


def export_range(extents: list[tuple[float, float, float, float]], max_zooms: list[int], zoom: int | None = None, bbox: tuple[float, float, float, float] | None = None) -> tuple[int, tuple[int, int, int, int]]:
    """Zoom and index box of an export.

    ``extents`` are those of the layers in metres; ``bbox`` is in degrees
    (EPSG:4326) and replaces them. The zoom defaults to the layers' highest.
    """
    at = max(max_zooms) if zoom is None else zoom
    if bbox is not None:
        return at, tilemath.tile_index_range(tilemath.project_bbox(bbox, 4326, 3857), at)
    return at, reduce(tilemath.unite, [tilemath.tile_index_range(e, at) for e in extents])


def readme_text(formula: str, zoom: int, box: tuple[int, int, int, int], layers: dict[str, tuple[int, str]], bbox: tuple | None = None, url: str = "", description: str = "", now: datetime | None = None) -> str:
    """What an export holds; ``layers`` maps names in the formula to layer id and title."""
    lines = ["Raster algebra export", f"Made on: {now or datetime.now():%Y-%m-%d at %H:%M}", *([f"From: {url}"] if url else []), "", *([description, ""] if description else []), f"Formula: {formula}", f"Zoom: {zoom}",
             f"Tiles in x: {box[0]} - {box[2]}", f"Tiles in y: {box[1]} - {box[3]}", f"Bounding box: {'that of all layers' if bbox is None else ','.join(map(str, bbox))}", "", "Layers:",
             *(f'{layer} "{title}" (in the formula: {name})' for name, (layer, title) in layers.items()), ""]
    return "\n".join(lines)


def mosaic_tiff(mosaic: DataFrame, box: tuple[int, int, int, int], tile_size: int, origin: tuple[float, float], scale: tuple[float, float], nodata: float | None = None) -> bytes:
    """A GeoTIFF of one mosaic.

    Each row of tiles is a strip that a task compresses; the driver only strings
    the strips together, as an export is one file, whose size the mosaic
    operator bounds.
    """
    width, height = (box[2] - box[0] + 1) * tile_size, (box[3] - box[1] + 1) * tile_size

    def compress(pixels: pa.Table) -> pa.Table:
        row = pixels["strip"][0].as_py()
        grid = np.zeros((tile_size, width))
        grid[pixels["gy"].to_numpy() - row * tile_size, pixels["gx"].to_numpy() - box[0] * tile_size] = pixels["value"].to_numpy()
        return pa.table({"strip": pa.array([row], pa.int32()), "packed": pa.array([zlib.compress(grid.astype("<f8").tobytes())], pa.binary())})

    dealt = mosaic.select("gx", "gy", "value", F.floor(F.col("gy") / tile_size).cast("int").alias("strip"))
    strips = [bytes(r["packed"]) for r in sorted(dealt.groupBy("strip").applyInArrow(compress, "strip int, packed binary").collect())]
    return tiff_of_strips([strips], width, height, tile_size, origin, scale, nodata)


#: Bytes of pixels of the tiles that are packed together, at most.
PACKED = 16 << 20


def write_tiff(tiles: DataFrame, box: tuple[int, int, int, int], tile_size: int, path: str, origin: tuple[float, float], scale: tuple[float, float], nodata: float | None = None) -> None:
    """Write tiles (tilex, tiley, data; whole or sparse) over an index box as one tiled BigTIFF of any size, in a folder that all tasks share.

    Tasks deflate runs of neighbouring tiles, kept beside the file until their places
    in it are known, and write them there; the driver sees the bytes of each run
    only. Pixels without a value are ``nodata``, or 0 without such a number. Tiles that
    are not there take no bytes: their place and size are 0, as in GDAL's sparse files.
    """
    spark, sparse, n = tiles.sparkSession, is_sparse(tiles), tile_size * tile_size
    across, down = box[2] - box[0] + 1, box[3] - box[1] + 1
    empty, run = 0.0 if nodata is None else nodata, max(PACKED // (8 * n), 1)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        numbers, sizes, packed = [], [], []
        for k, data, *places in zip(*(table[c] for c in ("k", "data", *(["places"] if sparse else []))), strict=True):
            held = data.values.to_numpy(zero_copy_only=False)
            grid, gone = np.full(n, empty), data.values.is_null().to_numpy(zero_copy_only=False)
            grid[places[0].values.to_numpy() if sparse else slice(None)] = np.where(gone, empty, held)
            packed.append(zlib.compress(grid.astype("<f8").tobytes(), 1))
            numbers.append(k.as_py())
            sizes.append(len(packed[-1]))
        return pa.table({"run": pa.array([numbers[0] // run], pa.int64()), "bytes": pa.array([sum(sizes)], pa.int64()), "numbers": pa.array([numbers], pa.list_(pa.int64())),
                         "sizes": pa.array([sizes], pa.list_(pa.int64())), "packed": pa.array([b"".join(packed)], pa.binary())})

    inside = F.col("tilex").between(box[0], box[2]) & F.col("tiley").between(box[1], box[3])
    k = (F.col("tiley") - box[1]).cast("long") * across + F.col("tilex") - box[0]
    numbered = tiles.where(inside).select(F.floor(k / run).alias("run"), k.alias("k"), "data", *(["places"] if sparse else []))
    form = "run long, bytes long, numbers array<long>, sizes array<long>, packed binary"
    numbered.groupBy("run").applyInArrow(pack, form).write.parquet(f"{path}.packed")
    runs = spark.read.schema(form).parquet(f"{path}.packed")

    head, tables = _big_head(across * tile_size, down * tile_size, tile_size, across * down, origin, scale, nodata)
    starts, at = {}, len(head) + 16 * across * down
    for row in runs.select("run", "bytes").sort("run").collect():
        starts[row[0]] = at
        at += row[1]
    target = local_path(path)
    with open(target, "wb") as out:
        out.write(head)
        out.truncate(at)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = os.open(target, os.O_WRONLY)
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    ends = np.cumsum([starts[row["run"]], *row["sizes"]])
                    _write(file, row["packed"], int(ends[0]))
                    first, last = row["numbers"][0], row["numbers"][-1]
                    index = np.zeros((2, last - first + 1), "<u8")
                    index[:, np.array(row["numbers"]) - first] = ends[:-1], row["sizes"]
                    for table, part in zip(tables, index, strict=True):
                        _write(file, part.tobytes(), table + 8 * first)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])
        finally:
            os.close(file)

    if runs.mapInArrow(place, "n long").agg(F.sum("n")).first()[0] != (len(starts) or None):
        raise RasterException(f"{path} was not written as a whole.")
    delete(spark, f"{path}.packed")


def _write(file: int, raw: bytes, at: int) -> None:
    view = memoryview(raw)
    while view:
        done = os.pwrite(file, view, at)
        view, at = view[done:], at + done


def _big_head(width: int, height: int, tile_size: int, count: int, origin: tuple[float, float], scale: tuple[float, float], nodata: float | None) -> tuple[bytes, tuple[int, int]]:
    """The start of a BigTIFF of deflated tiles of doubles, and the places of the tables of starts and of sizes; these follow it."""
    text = b"" if nodata is None else f"{nodata!r}\0".encode()
    wanted = [(256, "I", [width]), (257, "I", [height]), (258, "H", [64]), (259, "H", [8]), (262, "H", [1]), (277, "H", [1]), (284, "H", [1]), (322, "I", [tile_size]), (323, "I", [tile_size]),
              (324, "Q", None), (325, "Q", None), (339, "H", [3]), (33550, "d", [scale[0], abs(scale[1]), 0.0]), (33922, "d", [0.0, 0.0, 0.0, *origin, 0.0]), *([(42113, "s", text)] if text else [])]
    free = 16 + 8 + 20 * len(wanted) + 8
    long = [struct.pack(f"<{len(v)}{kind}", *v) if kind != "s" else v for _, kind, v in wanted if v is not None]
    tables_at = free + sum(len(raw) for raw in long if len(raw) > 8)
    tables_at += -tables_at % 8
    tables = (tables_at, tables_at + 8 * count)
    head, tail = b"II" + struct.pack("<HHHQQ", 43, 8, 0, 16, len(wanted)), b""
    for tag, kind, numbers in wanted:
        if numbers is None:  # one number stands in the tag itself, and is then found there
            head += struct.pack("<HHQ", tag, 16, count)
            if count == 1:
                tables = (len(head), tables[1]) if tag == 324 else (tables[0], len(head))
            head += struct.pack("<Q", 0 if count == 1 else tables[tag == 325])
            continue
        raw = numbers if kind == "s" else struct.pack(f"<{len(numbers)}{kind}", *numbers)
        head += struct.pack("<HHQ", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[kind], len(numbers)) + (raw.ljust(8, b"\0") if len(raw) <= 8 else struct.pack("<Q", free + len(tail)))
        tail += raw if len(raw) > 8 else b""
    return (head + struct.pack("<Q", 0) + tail).ljust(tables_at, b"\0"), tables


def export_archive(mosaic: DataFrame, box: tuple[int, int, int, int], tile_size: int, origin: tuple[float, float], scale: tuple[float, float],
                   formula: str, colormap: dict, filename: str = "", zoom: int = 0, layers: dict[str, tuple[int, str]] | None = None, bbox: tuple | None = None, url: str = "",
                   description: str = "", nodata: float = 0.0, now: datetime | None = None) -> tuple[str, bytes]:
    """File name and ZIP of one mosaic with its colour map and a README."""
    name = export_name(filename, now)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(f"{name}.tif", mosaic_tiff(mosaic, box, tile_size, origin, scale, nodata))
        archive.writestr("README.txt", readme_text(formula, zoom, box, layers or {}, bbox, url, description, now))
        archive.writestr("COLORMAP.txt", colormap_text(colormap))
    return f"{name}.zip", out.getvalue()
