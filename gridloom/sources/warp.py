"""Source blocks onto the tile grid, all zooms in one pass.

A task takes a block of source pixels, an array, and looks up, for every zoom, the
pixels of the tiles that the block meets: each target pixel takes the source pixel
under its centre, which lies in exactly one block. What a block gives to a tile is one
piece, a small array with its place, and the pieces of a tile meet in one
shuffle. Pixels are never rows, and the source is read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import projection, tilemath
from gridloom.operators.layers import tiles_from_pixels
from gridloom.sources.source import MERCATOR, Source

#: Pixels of the blocks that pixel rows are gathered in, on a side.
BLOCK_SIDE = 256

KEYS = "band int, tilez int, tilex int, tiley int"
PIECES = f"{KEYS}, px int, py int, width int, data array<double>"
TILES = f"{KEYS}, data array<double>"


def blocks_of_pixels(pixels: DataFrame, side: int = BLOCK_SIDE) -> DataFrame:
    """band, gx, gy, width, height, data of blocks of ``side`` pixels from pixel rows (gx, gy, value, band 0 unless there)."""
    band = F.col("band") if "band" in pixels.columns else F.lit(0)
    rows = pixels.select(band.alias("band"), F.floor(F.col("gx") / side).cast("int").alias("bx"), F.floor(F.col("gy") / side).cast("int").alias("by"), (F.col("gx") % side).alias("px"), (F.col("gy") % side).alias("py"), "value")
    made = tiles_from_pixels(rows, side, ["band", "bx", "by"])
    return made.select("band", (F.col("bx") * side).alias("gx"), (F.col("by") * side).alias("gy"), F.lit(side).alias("width"), F.lit(side).alias("height"), "data")


def target_box(source: Source, gx: int, gy: int, width: int, height: int, zoom: int, tile_size: int) -> tuple[int, int, int, int]:
    """Pixels of a zoom's grid (left, top, right, bottom) around those that a block can give a value to."""
    x, y = source.origin[0] + gx * source.scale[0], source.origin[1] + gy * source.scale[1]
    far_x, far_y = x + width * source.scale[0], y + height * source.scale[1]
    low, high = (-180.0, -89.99), (180.0, 89.99)
    corners = (min(x, far_x), min(y, far_y), max(x, far_x), max(y, far_y))
    if source.srid != MERCATOR and isinstance(projection.system(source.srid), projection.Degrees):
        corners = (max(corners[0], low[0] * 2), max(corners[1], low[1]), min(corners[2], high[0] * 2), min(corners[3], high[1]))
    left, bottom, right, top = projection.transform_bbox(corners, source.srid, MERCATOR)
    metres = tilemath.tile_scale(zoom, tile_size)
    # Between the points along a bent side it strays by far less than a hundredth of the box.
    slack = 2 if projection.separable(source.srid, MERCATOR) else 3 + 0.01 * max(right - left, top - bottom) / metres
    return int((left + tilemath.HALF) / metres - slack), int((tilemath.HALF - top) / metres - slack), int((right + tilemath.HALF) / metres + slack), int((tilemath.HALF - bottom) / metres + slack)


def pieces_of(block: tuple[int, int, int, int], values: np.ndarray, valid: np.ndarray, source: Source, max_zoom: int, zooms: list[int], tile_size: int) -> Iterator[tuple]:
    """tilez, tilex, tiley, px, py, pixels and their validity of all that a block (gx, gy, width, height) gives to tiles."""
    gx, gy, width, height = block
    width, height = min(width, source.width - gx), min(height, source.height - gy)
    if width <= 0 or height <= 0:
        return
    fine = tilemath.tile_scale(max_zoom, tile_size)
    low_x, low_y, high_x, high_y = tilemath.tile_index_range(source.extent(), max_zoom, 1e-6)
    bounds = np.array([low_x, low_y, high_x + 1, high_y + 1]) * tile_size
    box = target_box(source, gx, gy, width, height, max_zoom, tile_size)
    first, last = np.maximum(box[:2], bounds[:2]), np.minimum(box[2:], bounds[2:] - 1)
    for zoom in zooms:
        ratio = 2 ** (max_zoom - zoom)
        middle = ratio // 2
        # Pixels of this zoom whose pixel of the finest grid lies in the box.
        start, stop = -((middle - first) // ratio), (last - middle) // ratio
        for tx in range(start[0] // tile_size, stop[0] // tile_size + 1):
            xs = np.arange(max(start[0], tx * tile_size), min(stop[0], (tx + 1) * tile_size - 1) + 1)
            for ty in range(start[1] // tile_size, stop[1] // tile_size + 1):
                ys = np.arange(max(start[1], ty * tile_size), min(stop[1], (ty + 1) * tile_size - 1) + 1)
                if not len(xs) or not len(ys):
                    continue
                x, y = ((xs * ratio + middle + 0.5) * fine - tilemath.HALF)[None, :], (tilemath.HALF - (ys * ratio + middle + 0.5) * fine)[:, None]
                x, y = projection.transform(x, y, MERCATOR, source.srid, np)
                column, row = np.floor((x - source.origin[0]) / source.scale[0]) - gx, np.floor((y - source.origin[1]) / source.scale[1]) - gy
                inside = (column >= 0) & (column < width) & (row >= 0) & (row < height)
                if not inside.any():
                    continue
                rows, columns = np.flatnonzero(inside.any(axis=1)), np.flatnonzero(inside.any(axis=0))
                part = slice(rows[0], rows[-1] + 1), slice(columns[0], columns[-1] + 1)
                inside = inside[part]
                at = tuple(np.where(inside, np.broadcast_to(c, (len(ys), len(xs)))[part], 0).astype(np.int64) for c in (row, column))
                yield zoom, tx, ty, int(xs[columns[0]] - tx * tile_size), int(ys[rows[0]] - ty * tile_size), values[at], inside & valid[at]


def _listed(arrays: list[np.ndarray], masks: list[np.ndarray]) -> pa.ListArray:
    """Arrays as lists of doubles, null where a mask is false."""
    offsets = np.concatenate([[0], np.cumsum([a.size for a in arrays])]).astype(np.int32)
    flat = pa.array(np.concatenate([a.ravel() for a in arrays]), mask=~np.concatenate([m.ravel() for m in masks]))
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def numbers_of(lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Values and validity of each list of an array of lists of doubles."""
    found = []
    for k in range(len(lists)):
        flat = lists[k].values
        found.append((flat.fill_null(0.0).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)))
    return found


#: Pixels of the pieces that leave a task together.
SENT_PIXELS = 1 << 20


def pieces(blocks: DataFrame, source: Source, max_zoom: int, tile_size: int, zooms: range | None = None) -> DataFrame:
    """What each block (band, gx, gy, width, height, data) gives to the tiles of all zooms."""
    wanted = sorted(zooms if zooms is not None else range(max_zoom + 1), reverse=True)

    def batch(made: list[tuple]) -> pa.RecordBatch:
        fixed = [pa.array([m[k] for m in made], pa.int32()) for k in range(6)]
        widths = pa.array([m[6].shape[1] for m in made], pa.int32())
        return pa.RecordBatch.from_arrays([*fixed, widths, _listed([m[6] for m in made], [m[7] for m in made])], names=["band", "tilez", "tilex", "tiley", "px", "py", "width", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = [], 0
        for rows in batches:
            for k in range(rows.num_rows):
                band, gx, gy, width, height = (rows.column(c)[k].as_py() for c in range(5))
                ((values, valid),) = numbers_of(rows.column(5).slice(k, 1))
                for piece in pieces_of((gx, gy, width, height), values.reshape(height, width), valid.reshape(height, width), source, max_zoom, wanted, tile_size):
                    made.append((band, *piece))
                    held += piece[5].size
                    if held >= SENT_PIXELS:
                        yield batch(made)
                        made, held = [], 0
        if made:
            yield batch(made)

    return blocks.select("band", "gx", "gy", "width", "height", "data").mapInArrow(run, PIECES)


def tiles_of_blocks(blocks: DataFrame, source: Source, max_zoom: int, tile_size: int, nodata: float | None, zooms: range | None = None) -> DataFrame:
    """band, tilez, tilex, tiley, data of all zooms up to ``max_zoom`` from blocks in the source's own system.

    Tiles of nothing but nodata are left out. A tile has at most as many pieces as pixels, whatever the source's size.
    """
    def merge(rows: pa.Table) -> pa.Table:
        values, valid = np.zeros((tile_size, tile_size)), np.zeros((tile_size, tile_size), bool)
        lists = rows["data"].combine_chunks()
        for px, py, width, (own, there) in zip(*(rows[c].to_pylist() for c in ("px", "py", "width")), numbers_of(lists), strict=True):
            part = slice(py, py + len(own) // width), slice(px, px + width)
            own, there = own.reshape(-1, width), there.reshape(-1, width)
            values[part][there], valid[part][there] = own[there], True
        if nodata is not None:
            valid &= ~(np.abs(values - nodata) <= 1e-8 + 1e-5 * abs(nodata))
        keys = rows.slice(0, 1 if valid.any() else 0).select(["band", "tilez", "tilex", "tiley"])
        return keys.append_column("data", _listed([values], [valid]) if valid.any() else pa.array([], pa.list_(pa.float64())))

    return pieces(blocks, source, max_zoom, tile_size, zooms).groupBy("band", "tilez", "tilex", "tiley").applyInArrow(merge, TILES)
