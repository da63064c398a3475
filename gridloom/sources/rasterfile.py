"""The formats of raster files: ESRI ASCII grids and TIFFs, also inside ZIP archives.

A TIFF is read through a function that fetches bytes, so that its tags, and any
of its strips or tiles, can be read alone; see ``windows`` for the scan.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import DEFAULTS, Settings
from gridloom.errors import RasterException
from gridloom.operators.layers import drop_nodata

#: Schemes that a source may have, and TIFF tags and sample types.
SCHEMES = ("", "file", "http", "https", "s3", "s3a", "hdfs", "viewfs")
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_BYTES, PLANAR, FORMAT, SCALE, TIE = 256, 257, 258, 259, 273, 277, 279, 284, 339, 33550, 33922
NODATA_TAG = 42113
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, ROWS_PER_STRIP, GEOKEYS = 317, 322, 323, 324, 325, 278, 34735
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}

PIXELS = "path string, band int, gx int, gy int, value double, nodata double, origin_x double, origin_y double, scale_x double, scale_y double"


class Raster:
    """Decoded bands (each a 2-D array) with nodata, origin and pixel size."""

    def __init__(self, bands: list[np.ndarray], nodata: float | None, origin=(0.0, 0.0), scale=(1.0, -1.0), srid: int | None = None):
        self.bands, self.nodata, self.origin, self.scale, self.srid = bands, nodata, origin, scale, srid


def decode_ascii(raw: bytes) -> Raster:
    """An ESRI ASCII grid: a header of names and numbers, then rows from the top."""
    head, rows = {}, []
    for line in raw.decode("ascii", "replace").splitlines():
        parts = line.split()
        if parts and parts[0][0].isalpha() and parts[0].lower() != "nan":
            head[parts[0].lower()] = float(parts[1])
        elif parts:
            rows += [float(p) for p in parts]
    try:
        width, height, size = int(head["ncols"]), int(head["nrows"]), head.get("cellsize", 1.0)
    except KeyError as error:
        raise RasterException("The ASCII grid has no size.") from error
    left = head.get("xllcorner", head.get("xllcenter", size / 2) - size / 2)
    low = head.get("yllcorner", head.get("yllcenter", size / 2) - size / 2)
    return Raster([np.array(rows).reshape(height, width)], head.get("nodata_value"), (left, low + height * size), (size, -size))


def unpack_lzw(raw: bytes) -> bytes:
    """Bytes of an LZW strip: codes of 9 to 12 bits, highest bit first; 256 clears the table and 257 ends."""
    singles = [bytes([b]) for b in range(256)] + [b"", b""]
    table, out, last = list(singles), [], b""
    width, held, bits = 9, 0, 0
    for byte in raw:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(singles), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise RasterException("The LZW data of the TIFF are broken.")
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        # The width grows one code early.
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


#: Reads bytes of a source: ``fetch(start, length)``, fewer where the source ends.
Fetch = Callable[[int, int], bytes]


def fetch_of(raw: bytes) -> Fetch:
    return lambda start, length: raw[start : start + length]


def read_tags(fetch: Fetch) -> tuple[str, dict[int, list]]:
    """Byte order and tags of the first image of a TIFF or BigTIFF; only the bytes of the tags are read."""
    raw = fetch(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    kind = struct.unpack(order + "H", raw[2:4])[0] if order and len(raw) >= 8 else 0
    if kind not in (42, 43):
        raise RasterException("Not a TIFF.")
    place, step, number, count = ("I", 12, 4, "H") if kind == 42 else ("Q", 20, 8, "Q")
    at = struct.unpack_from(order + place, raw, 4 if kind == 42 else 8)[0]
    entries = struct.unpack(order + count, fetch(at, struct.calcsize(count)))[0]
    listed = fetch(at + struct.calcsize(count), entries * step)
    tags: dict[int, list] = {}
    letters = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
    for k in range(entries):
        tag, sort, n = struct.unpack_from(order + "HH" + place, listed, step * k)
        size, value = SIZES.get(sort, 1) * n, listed[step * k + 4 + number : step * (k + 1)]
        if sort in letters:
            part = value[:size] if size <= number else fetch(struct.unpack(order + place, value)[0], size)
            tags[tag] = [part.rstrip(b"\0").decode("ascii", "replace")] if sort == 2 else list(struct.unpack(f"{order}{n}{letters[sort]}", part))
    return order, tags


def srid_of(tags: dict[int, list]) -> int | None:
    """The EPSG code among a GeoTIFF's keys: that of a projected system, else of a geographic one."""
    keys = tags.get(GEOKEYS, [])
    found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    return next((found[k] for k in (3072, 2048) if found.get(k, 32767) != 32767), None)


@dataclass(frozen=True)
class Layout:
    """How the pixels of a TIFF lie in its file: strips or tiles of ``high`` rows and ``wide`` columns, plane after plane."""

    width: int
    height: int
    samples: int
    kind: str
    packing: int
    predictor: int
    planes: bool
    tiled: bool
    wide: int
    high: int
    nodata: float | None
    origin: tuple[float, float]
    scale: tuple[float, float]
    srid: int | None

    @property
    def across(self) -> int:
        return -(-self.width // self.wide)

    @property
    def down(self) -> int:
        return -(-self.height // self.high)

    @property
    def per(self) -> int:
        """Samples of a pixel that lie together."""
        return 1 if self.planes else self.samples

    @property
    def empty(self) -> float:
        """The value of pixels of strips and tiles that the file leaves out."""
        return self.nodata or 0.0

    def block(self, k: int) -> tuple[int, int, int, int]:
        """First band, first row, first column and stored rows of a strip or tile."""
        plane, place = divmod(k, self.across * self.down)
        row, column = divmod(place, self.across)
        return plane, row * self.high, column * self.wide, self.high if self.tiled else min(self.high, self.height - row * self.high)


def tiff_layout(fetch: Fetch) -> tuple[Layout, list[tuple[int, int]]]:
    """The layout of a TIFF, and the start and size in bytes of each of its strips or tiles."""
    order, tags = read_tags(fetch)
    packing, predictor, planar = tags.get(COMPRESSION, [1])[0], tags.get(PREDICTOR, [1])[0], tags.get(PLANAR, [1])[0]
    tiled = TILES in tags
    if packing not in (1, 5, 8, 32946) or predictor not in (1, 2, 3) or WIDTH not in tags or HEIGHT not in tags or not (tiled or STRIPS in tags):
        raise RasterException("This kind of TIFF cannot be read.")
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, [1])[0]
    letter, bits = {1: "u", 2: "i", 3: "f"}.get(tags.get(FORMAT, [1])[0]), tags.get(BITS, [8])[0]
    if letter is None or bits not in (8, 16, 32, 64) or (predictor == 3 and letter != "f"):
        raise RasterException("Samples of this kind cannot be read.")
    wide, high = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(height, tags.get(ROWS_PER_STRIP, [height])[0]))
    scale, tie = tags.get(SCALE, [1.0, 1.0]), tags.get(TIE, [0.0] * 6)
    nodata = float(tags[NODATA_TAG][0]) if NODATA_TAG in tags else None
    origin = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
    layout = Layout(width, height, samples, f"{order}{letter}{bits // 8}", packing, predictor, planar == 2, tiled, wide, high, nodata, origin, (scale[0], -scale[1]), srid_of(tags))
    return layout, list(zip(tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True))


#: Compressed bytes that are read at once.
CHUNK = 1 << 20


def unpacked(fetch: Fetch, layout: Layout, start: int, size: int, piece: int) -> Iterator[bytes]:
    """The bytes of a strip or tile in pieces of ``piece`` bytes; only LZW is unpacked as a whole."""
    if layout.packing == 5:
        raw = unpack_lzw(fetch(start, size))
        yield from (raw[k : k + piece] for k in range(0, len(raw), piece))
        return
    unpack = None if layout.packing == 1 else zlib.decompressobj()
    held = b""
    for at in range(start, start + size, CHUNK):
        raw = fetch(at, min(CHUNK, start + size - at))
        while raw:
            held += raw if unpack is None else unpack.decompress(raw, max(piece - len(held), 1))
            raw = b"" if unpack is None else unpack.unconsumed_tail
            while len(held) >= piece:
                yield held[:piece]
                held = held[piece:]
    held += b"" if unpack is None else unpack.flush()
    yield from (held[k : k + piece] for k in range(0, len(held), piece))


def block_rows(fetch: Fetch, layout: Layout, k: int, start: int, size: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and samples (rows, columns, samples) of parts of a strip or tile, of at most about ``most`` pixels each."""
    kind, per = np.dtype(layout.kind), layout.per
    row_bytes = layout.wide * per * kind.itemsize
    _, first, _, rows = layout.block(k)
    if size == 0:
        # A sparse file leaves out what holds nothing.
        step = max(1, most // (layout.wide * per))
        for at in range(0, rows, step):
            yield first + at, np.full((min(step, rows - at), layout.wide, per), layout.empty, kind.newbyteorder("="))
        return
    at = 0
    for raw in unpacked(fetch, layout, start, size, max(1, most // (layout.wide * per)) * row_bytes):
        n = min(len(raw) // row_bytes, rows - at)
        if n <= 0:
            return
        if layout.predictor == 3:
            # Bytes of a row are differences, the highest bytes of all its samples first.
            spread = np.cumsum(np.frombuffer(raw, np.uint8, n * row_bytes).reshape(n, -1, per), axis=1, dtype=np.uint8).reshape(n, kind.itemsize, -1)
            part = np.ascontiguousarray(spread.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(n, layout.wide, per)
        else:
            part = np.frombuffer(raw, kind, n * layout.wide * per).reshape(n, layout.wide, per)
        part = part.astype(kind.newbyteorder("="))
        yield first + at, np.cumsum(part, axis=1, dtype=part.dtype) if layout.predictor == 2 else part
        at += n


def decode_tiff(raw: bytes) -> Raster:
    """A TIFF or BigTIFF of strips or tiles, plain, deflated or LZW, with its georeference and nodata."""
    fetch = fetch_of(raw)
    layout, places = tiff_layout(fetch)
    planes = np.zeros((layout.samples, layout.down * layout.high, layout.across * layout.wide), np.dtype(layout.kind).newbyteorder("="))
    for k, (start, size) in enumerate(places):
        plane, _, column, _ = layout.block(k)
        for row, part in block_rows(fetch, layout, k, start, size, 1 << 20):
            planes[plane : plane + layout.per, row : row + len(part), column : column + layout.wide] = part.transpose(2, 0, 1)
    return Raster(list(planes[:, : layout.height, : layout.width]), layout.nodata, layout.origin, layout.scale, layout.srid)


def decode(raw: bytes) -> Raster:
    """A raster by its content; of an archive the first member that can be read."""
    if raw[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            for name in archive.namelist():
                try:
                    return decode(archive.read(name))
                except (RasterException, ValueError, IndexError, struct.error, zlib.error):
                    continue
        raise RasterException("The archive holds no raster that can be read.")
    return decode_tiff(raw) if raw[:2] in (b"II", b"MM") else decode_ascii(raw)


def checked_path(url: str) -> str:
    """The path that Spark reads; s3:// goes by its s3a:// file system."""
    scheme = urlparse(url).scheme
    if scheme not in SCHEMES:
        raise RasterException(f"Only file, http, https and s3 sources are supported, not {scheme!r}.")
    return "s3a" + url[2:] if scheme == "s3" else url


def s3_options(settings: Settings = DEFAULTS) -> dict[str, str]:
    """Options of a read from s3: the requester pays, at the endpoint of ``settings`` if it names one."""
    options = {"fs.s3a.requester.pays.enabled": "true"}
    if settings.s3_endpoint:
        options |= {"fs.s3a.endpoint": settings.s3_endpoint, "fs.s3a.path.style.access": "true"}
    return options


def read_rasters(spark: SparkSession, path: str, nodata: float | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per pixel of every file at ``path``, in the columns PIXELS; see ``windows.read_blocks``."""
    from gridloom.sources.windows import pixels_of_blocks, read_blocks  # the scan builds on this module

    return pixels_of_blocks(read_blocks(spark, path, nodata, settings=settings))


def without_nodata(pixels: DataFrame, nodata: float) -> DataFrame:
    """Pixels with NULL where the value is nodata."""
    return pixels.withColumn("value", drop_nodata(F.col("value"), nodata))


def raster_metadata(pixels: DataFrame) -> DataFrame:
    """Size, bands, origin and scale of each file."""
    return pixels.groupBy("path").agg((F.max("gx") + 1).alias("width"), (F.max("gy") + 1).alias("height"), (F.max("band") + 1).alias("numbands"),
                                      *[F.first(c).alias(c) for c in ("origin_x", "origin_y", "scale_x", "scale_y", "nodata")])
