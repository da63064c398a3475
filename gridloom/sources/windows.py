"""The scan of raster files: rows that each hold a block of pixels as an array.

A data source plans the strips and tiles of TIFFs from their tags alone. Runs of
neighbouring strips or tiles of about a million pixels are windows; a task fetches
the bytes of its windows and decodes one at a time, so a file of any size is
read by many tasks in bounded memory. Windows outside a wanted box, and bands that
are not wanted, are never fetched. Local files and web servers are read by ranges.
Stores that only Spark's file systems reach, and archives, are read file by file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from gridloom.config import DEFAULTS, Settings
from gridloom.sources.byteranges import Ranges, download, is_web
from gridloom.sources.rasterfile import PIXELS, Layout, block_rows, checked_path, decode, s3_options, tiff_layout
from gridloom.sources.tilestore import scratch

#: Pixels of a window, bytes between two ranges that are fetched together nevertheless, and tasks of one scan; beyond, tasks take several windows, one after the other.
WINDOW_PIXELS, GAP, MOST_TASKS = 1 << 20, 1 << 16, 20_000

BLOCKS = "path string, band int, gx int, gy int, width int, height int, data array<double>, nodata double, origin_x double, origin_y double, scale_x double, scale_y double, srid int"
#: The same for Arrow.
SCHEMA = pa.schema([(name, {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[kind]) for name, kind in (c.split(" ") for c in BLOCKS.split(", "))])
PIXEL_NAMES = [column.split(" ")[0] for column in PIXELS.split(", ")]
#: Pixel rows that go on together, about.
BATCH_ROWS = 1 << 16
Box = tuple[int, int, int, int]


@dataclass(frozen=True)
class Window:
    """Strips or tiles (number, start, size) of a TIFF, or, without a layout, a whole file."""

    path: str
    size: int | None
    layout: Layout | None
    parts: tuple[tuple[int, int, int], ...] = ()


@dataclass
class Windows(InputPartition):
    value: list[Window]


def plan(path: str, box: Box | None = None, band: int | None = None, most: int = WINDOW_PIXELS, without: float | None = None) -> list[Window]:
    """The windows of a file that meet a box of pixels (left, top, right, bottom; ends are inside).

    Strips and tiles that a sparse file leaves out are not planned if their value is the one to do ``without``.
    """
    ranges = Ranges(path)
    try:
        if ranges.fetch(0, 2) not in (b"II", b"MM"):
            return [Window(path, ranges.size, None)]
        layout, places = tiff_layout(ranges.fetch)
    finally:
        ranges.close()
    wanted: list[tuple[int, int, int]] = []
    for k, (start, size) in enumerate(places):
        if size == 0 and without is not None and layout.empty == without:
            continue
        plane, row, column, rows = layout.block(k)
        meets = box is None or (column <= box[2] and column + layout.wide > box[0] and row <= box[3] and row + rows > box[1])
        if meets and not (band is not None and layout.planes and plane != band):
            wanted.append((k, start, size))
    found: list[list[tuple[int, int, int]]] = []
    pixels = 0
    for part in wanted:
        plane, row, column, rows = layout.block(part[0])
        own = min(layout.wide * rows * layout.per, most)
        # A strip goes on with the one above it; a row of tiles and a plane begin anew.
        follows = found and part[0] == found[-1][-1][0] + 1 and (layout.across > 1 or row > 0)
        if follows and pixels + own <= most:
            found[-1].append(part)
            pixels += own
        else:
            found.append([part])
            pixels = own
    return [Window(path, ranges.size, layout, tuple(parts)) for parts in found]


def _fetched(ranges: Ranges, parts: tuple[tuple[int, int, int], ...]):
    """A function that fetches the bytes of some strips, whose near neighbours are read at once, if they are small."""
    held = [(s, n) for _, s, n in parts if n]
    if not held:
        return ranges.fetch
    first, last = min(s for s, _ in held), max(s + n for s, n in held)
    used = sum(n for _, n in held)
    if last - first > used + GAP * len(parts) or last - first > 8 * WINDOW_PIXELS:
        return ranges.fetch
    raw = ranges.fetch(first, last - first)
    return lambda start, length: raw[start - first : start - first + length]


def _cropped(array: np.ndarray, row: int, column: int, layout: Layout, box: Box | None) -> tuple[np.ndarray, int, int]:
    """What of some rows lies in the raster and in the box, with its first row and column."""
    left, top, right, bottom = box or (0, 0, layout.width - 1, layout.height - 1)
    a, b = max(top - row, 0), min(bottom, layout.height - 1) - row + 1
    c, d = max(left - column, 0), min(right, layout.width - 1) - column + 1
    return array[a : max(b, a), c : max(d, c)], row + a, column + c


def decoded(window: Window, box: Box | None, band: int | None, most: int = WINDOW_PIXELS) -> Iterator[tuple]:
    """band, first column, first row, pixels, and nodata, origin, scale and system of the blocks of a window."""
    ranges = Ranges(window.path, window.size)
    try:
        if window.layout is None:
            yield from whole(ranges.fetch(0, ranges.size), box, band, most)
            return
        layout = window.layout
        described = (layout.nodata, layout.origin, layout.scale, layout.srid)
        fetch = _fetched(ranges, window.parts)
        held: list[np.ndarray] = []
        held_at = (0, 0, 0)

        def flush() -> Iterator[tuple]:
            if held:
                rows = held[0] if len(held) == 1 else np.concatenate(held)
                plane, row, column = held_at
                rows, row, column = _cropped(rows, row, column, layout, box)
                for sample in range(layout.per if rows.size else 0):
                    if band is None or band == plane + sample:
                        yield plane + sample, column, row, rows[:, :, sample], *described
                held.clear()

        for k, start, size in window.parts:
            plane, _, column, _ = layout.block(k)
            for row, part in block_rows(fetch, layout, k, start, size, most):
                goes_on = held and not layout.tiled and held_at[0] == plane and held_at[1] + sum(map(len, held)) == row and sum(h.size for h in held) + part.size <= most
                if not goes_on:
                    yield from flush()
                    held_at = (plane, row, column)
                held.append(part)
        yield from flush()
    finally:
        ranges.close()


def whole(raw: bytes, box: Box | None, band: int | None, most: int = WINDOW_PIXELS) -> Iterator[tuple]:
    """The same of a file that is decoded at once: an ASCII grid or an archive."""
    raster = decode(raw)
    for number, pixels in enumerate(raster.bands):
        height, width = pixels.shape
        left, top, right, bottom = box or (0, 0, width - 1, height - 1)
        step = max(1, most // max(width, 1))
        for row in range(max(top, 0), min(bottom + 1, height) if band in (None, number) else 0, step):
            part = pixels[row : min(row + step, bottom + 1, height), max(left, 0) : right + 1]
            if part.size:
                yield number, max(left, 0), row, part, raster.nodata, raster.origin, raster.scale, raster.srid


def batch_of(path: str, blocks: list[tuple], nodata: float | None) -> pa.RecordBatch:
    """Blocks of ``decoded`` as rows of the table BLOCKS."""
    flat = [b[3].astype(np.float64).ravel() for b in blocks]
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in flat])]).astype(np.int32)
    data = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0)))
    columns = [[path] * len(blocks), [b[0] for b in blocks], [b[1] for b in blocks], [b[2] for b in blocks], [b[3].shape[1] for b in blocks], [b[3].shape[0] for b in blocks], data,
               [b[4] if nodata is None else nodata for b in blocks], [b[5][0] for b in blocks], [b[5][1] for b in blocks], [b[6][0] for b in blocks], [b[6][1] for b in blocks], [b[7] for b in blocks]]
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)


class RasterBlocks(DataSource):
    """``spark.read.format("raster_blocks")``: options files (JSON list), box (JSON list), band, nodata, folder, pixels, without.

    With ``without`` the rows are pixels, but for those of that value.
    """

    @classmethod
    def name(cls) -> str:
        return "raster_blocks"

    def schema(self) -> str:
        return PIXELS if "without" in self.options else BLOCKS

    def reader(self, schema: StructType) -> DataSourceReader:
        return BlockReader(dict(self.options))


class BlockReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = json.loads(options["files"])
        self.box = tuple(json.loads(options["box"])) if "box" in options else None
        self.band = int(options["band"]) if "band" in options else None
        self.nodata = float(options["nodata"]) if "nodata" in options else None
        self.folder, self.most = options.get("folder", ""), int(options.get("pixels", WINDOW_PIXELS))
        self.without = float(options["without"]) if "without" in options else None

    def partitions(self) -> list[Windows]:
        def planned(path: str) -> list[Window]:
            if is_web(path) and Ranges(path).size is None:
                path = download(path, self.folder)
            return plan(path, self.box, self.band, self.most, self.without)

        with ThreadPoolExecutor(16) as pool:
            windows = [w for one in pool.map(planned, self.files) for w in one]
        each = -(-len(windows) // MOST_TASKS)
        if self.without is not None:  # small windows bound what is decoded at once, not what a task does
            each = max(each, WINDOW_PIXELS // self.most)
        return [Windows(windows[k : k + each]) for k in range(0, len(windows), max(each, 1))]

    def read(self, partition: Windows | None) -> Iterator[pa.RecordBatch]:
        windows = partition.value if partition else []  # Spark reads a scan of no partition as None
        if self.without is not None:
            yield from self._pixels(windows)
            return
        for window in windows:
            for block in decoded(window, self.box, self.band, self.most):
                yield batch_of(window.path, [block], self.nodata)


    def _pixels(self, windows: list[Window]) -> Iterator[pa.RecordBatch]:
        """Rows of PIXELS, those of several blocks together."""
        held, rows = [], 0
        for window in windows:
            for band, column, row, pixels, nodata, origin, scale, _ in decoded(window, self.box, self.band, self.most):
                y, x = np.nonzero(pixels != self.without)
                if not len(y):
                    continue
                fixed = (nodata if self.nodata is None else self.nodata, *origin, *scale)
                n, number = len(y), pixels[y, x].astype(np.float64)
                columns = [pa.repeat(pa.scalar(window.path), n), pa.repeat(pa.scalar(band, pa.int32()), n), pa.array(x + column, pa.int32()), pa.array(y + row, pa.int32()), pa.array(number),
                           *(pa.repeat(pa.scalar(v, pa.float64()), n) for v in fixed)]
                held.append(pa.RecordBatch.from_arrays(columns, names=PIXEL_NAMES))
                rows += n
                if rows >= BATCH_ROWS:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def read_pixels(spark: SparkSession, path: str, without: float, nodata: float | None = None, box: Box | None = None, band: int | None = None, settings: Settings = DEFAULTS, pixels: int = WINDOW_PIXELS) -> DataFrame:
    """Rows of ``pixels_of_blocks(read_blocks(...))`` but for pixels of the value ``without``, which never become rows; see ``read_blocks``."""
    return _scan(spark, path, nodata, box, band, settings, pixels, without)


def read_blocks(spark: SparkSession, path: str, nodata: float | None = None, box: Box | None = None, band: int | None = None, settings: Settings = DEFAULTS, pixels: int = WINDOW_PIXELS) -> DataFrame:
    """One row for each block of pixels of every file at ``path`` (a file, folder or pattern), in the columns BLOCKS.

    ``nodata`` overrides that of the files; ``box`` (of pixels, ends inside) and
    ``band`` leave the rest unread. Values are raw, nodata among them. A missing
    file is an error here, before any job. Options of s3 hold for the file systems
    that this read opens.
    """
    return _scan(spark, path, nodata, box, band, settings, pixels)


def _scan(spark: SparkSession, path: str, nodata: float | None, box: Box | None, band: int | None, settings: Settings, pixels: int, without: float | None = None) -> DataFrame:
    source = checked_path(path)
    scheme = source.partition(":")[0] if "://" in source else ""
    if is_web(source):
        Ranges(source)  # an error of the server shows at once
        files = [source]
    else:
        options = s3_options(settings) if scheme == "s3a" else {}
        listing = spark.read.format("binaryFile").options(**options).load(source)
        if scheme not in ("", "file"):
            blocks = _whole_files(listing, nodata, box, band)
            return blocks if without is None else pixels_of_blocks(blocks).where((F.col("value") != without) | F.col("value").isNull())
        files = sorted(r.path for r in listing.select("path").collect())  # names only; contents are not read
    if not files:
        return spark.createDataFrame([], BLOCKS if without is None else PIXELS)
    wanted = {"files": json.dumps(files), "pixels": str(pixels)}
    wanted |= {"box": json.dumps(box)} if box is not None else {}
    wanted |= {"band": str(band)} if band is not None else {}
    wanted |= {"nodata": repr(float(nodata))} if nodata is not None else {}
    wanted |= {"without": repr(float(without))} if without is not None else {}
    wanted |= {"folder": scratch(spark, "download")} if is_web(source) else {}
    spark.dataSource.register(RasterBlocks)
    return spark.read.format("raster_blocks").options(**wanted).load()


def _whole_files(listing: DataFrame, nodata: float | None, box: Box | None, band: int | None) -> DataFrame:
    """Blocks of files that only Spark can open; each is held by the task that reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for block in whole(raw, box, band):
                    yield batch_of(name, [block], nodata)

    return listing.select("path", "content").mapInArrow(run, BLOCKS)


def pixels_of_blocks(blocks: DataFrame) -> DataFrame:
    """One row per pixel, in the columns PIXELS."""
    opened = blocks.select("*", F.posexplode("data").alias("pos", "value"))
    return opened.withColumns({"gx": F.col("gx") + F.col("pos") % F.col("width"), "gy": (F.col("gy") + F.floor(F.col("pos") / F.col("width"))).cast("int")}).select(*PIXEL_NAMES)
