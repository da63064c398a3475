"""Neighbourhood filters over whole layers: 3 x 3 windows that reach across the borders of tiles.

A tile sends each of its eight neighbours the row, column or pixel that borders on
them, and meets what it is sent by its key. So tiles move once and besides them
only borders do, four rows of pixels a tile; pixels are never joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.layers import TILE
from gridloom.sources.warp import _listed, numbers_of

#: The weights of the smoothing that sharpness is measured against.
SMOOTH = ((1.0, 1.0, 1.0), (1.0, 5.0, 1.0), (1.0, 1.0, 1.0))

BORDERS = "tilez int, tilex int, tiley int, dx int, dy int, border array<double>"


def borders(tiles: DataFrame, tile_size: int) -> DataFrame:
    """tilez, tilex, tiley, dx, dy, border: what each tile is sent by its neighbour at (dx, dy); only neighbours inside the world's grid are sent to."""
    sides = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]
    edge = {-1: slice(tile_size - 1, tile_size), 0: slice(0, tile_size), 1: slice(0, 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for z, x, y, (values, valid) in zip(*[batch.column(k).to_pylist() for k in range(3)], numbers_of(batch.column(3)), strict=True):
                values, valid = values.reshape(tile_size, tile_size), valid.reshape(tile_size, tile_size)
                # The tile at (x - dx, y - dy) has this one at (dx, dy), and sees the border nearest to it.
                made += [(z, x - dx, y - dy, dx, dy, values[edge[dy], edge[dx]], valid[edge[dy], edge[dx]]) for dx, dy in sides if 0 <= x - dx < 2**z and 0 <= y - dy < 2**z]
            if made:
                fixed = [pa.array([m[k] for m in made], pa.int32()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*fixed, _listed([m[5] for m in made], [m[6] for m in made])], names=["tilez", "tilex", "tiley", "dx", "dy", "border"])

    return tiles.select(*TILE, "data").mapInArrow(run, BORDERS)


def focal_mean(tiles: DataFrame, tile_size: int, weights: tuple[tuple[float, ...], ...] = SMOOTH) -> DataFrame:
    """tilez, tilex, tiley, data: the weighted mean of each pixel and its eight neighbours.

    Neighbours that are nodata, or outside all tiles, have no weight; a pixel that is nodata stays so.
    """
    sent = borders(tiles, tile_size).groupBy(*TILE).agg(F.collect_list(F.struct("dx", "dy", "border")).alias("sent"))  # eight at most
    met = tiles.select(*TILE, "data").join(sent, TILE, "left")
    inner = slice(1, tile_size + 1)
    place = {-1: slice(0, 1), 0: inner, 1: slice(tile_size + 1, tile_size + 2)}
    shape = {-1: 1, 0: tile_size, 1: 1}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, masks = [], []
            for (values, valid), around in zip(numbers_of(batch.column(3)), batch.column(4), strict=True):
                wide, there = np.zeros((tile_size + 2, tile_size + 2)), np.zeros((tile_size + 2, tile_size + 2), bool)
                wide[inner, inner], there[inner, inner] = values.reshape(tile_size, tile_size), valid.reshape(tile_size, tile_size)
                if around.is_valid:
                    parts = around.values
                    for dx, dy, (own, seen) in zip(parts.field("dx").to_pylist(), parts.field("dy").to_pylist(), numbers_of(parts.field("border")), strict=True):
                        wide[place[dy], place[dx]], there[place[dy], place[dx]] = own.reshape(shape[dy], shape[dx]), seen.reshape(shape[dy], shape[dx])
                total, weight = np.zeros((tile_size, tile_size)), np.zeros((tile_size, tile_size))
                for dy in range(3):
                    for dx in range(3):
                        seen = there[dy : dy + tile_size, dx : dx + tile_size]
                        total += np.where(seen, wide[dy : dy + tile_size, dx : dx + tile_size] * weights[dy][dx], 0.0)
                        weight += np.where(seen, weights[dy][dx], 0.0)
                kept = there[inner, inner] & (weight != 0)
                out.append(np.divide(total, weight, out=np.zeros_like(total), where=kept))
                masks.append(kept)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _listed(out, masks)], names=[*TILE, "data"])

    return met.mapInArrow(run, "tilez int, tilex int, tiley int, data array<double>")


def sharpened(tiles: DataFrame, tile_size: int, factor: float) -> DataFrame:
    """tilez, tilex, tiley, data of a channel 0 to 255: smoothed (0), as it is (1), or sharper beyond."""
    smooth = focal_mean(tiles, tile_size).withColumnRenamed("data", "smooth")
    mixed = F.zip_with("data", "smooth", lambda v, s: F.when(v.isNotNull(), F.floor(F.least(F.greatest(s + (v - s) * factor, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("double")))
    return tiles.select(*TILE, "data").join(smooth, TILE).select(*TILE, mixed.alias("data"))
