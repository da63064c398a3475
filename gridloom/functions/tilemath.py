"""Web-mercator tile arithmetic, as Columns and for plain numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.config import DEFAULTS
from gridloom.functions import projection
from gridloom.functions.projection import HALF, RADIUS  # noqa: F401 - names that callers use

WORLD = 2 * HALF


def tile_scale(zoom: int, tile_size: int = DEFAULTS.tile_size) -> float:
    """Metres of a pixel's side."""
    return WORLD / 2.0**zoom / tile_size


def tile_bounds(x: Column, y: Column, zoom: Column) -> list[Column]:
    """xmin, ymin, xmax, ymax of tiles in metres."""
    size = F.lit(WORLD) / F.pow(F.lit(2.0), zoom)
    return [(x * size - HALF).alias("xmin"), (F.lit(HALF) - (y + 1) * size).alias("ymin"), ((x + 1) * size - HALF).alias("xmax"), (F.lit(HALF) - y * size).alias("ymax")]


def tile_index(x: Column, y: Column, zoom: Column) -> tuple[Column, Column]:
    """Tile of points in metres; truncates toward zero."""
    size = F.lit(WORLD) / F.pow(F.lit(2.0), zoom)
    return ((x + HALF) / size).cast("int"), ((F.lit(HALF) - y) / size).cast("int")


def tile_index_range(bbox: tuple[float, float, float, float], zoom: int, tolerance: float = 0) -> tuple[int, int, int, int]:
    """Inclusive index box of a bounding box.

    An edge closer than ``tolerance``, in tiles, to one between two tiles counts
    as lying on it, and then only tiles that overlap the box are taken.
    """
    size = WORLD / 2.0**zoom
    xmin, ymin, xmax, ymax = bbox

    def tile(place: float, is_end: bool) -> int:
        edge = round(place)
        return edge - is_end if abs(place - edge) < tolerance else int(place)

    return tile((xmin + HALF) / size, False), tile((HALF - ymax) / size, False), tile((xmax + HALF) / size, True), tile((HALF - ymin) / size, True)


def closest_zoom(scale: Column, next_higher: bool = True, most: int = DEFAULTS.max_zoom, tile_size: int = DEFAULTS.tile_size) -> Column:
    """The first zoom from 1 on whose pixels are no larger than ``scale``, or the one before it.

    Scales finer than all zooms up to ``most`` have give the one above it.
    """
    finer = F.filter(F.array(*[F.lit(tile_scale(z, tile_size)) for z in range(1, most + 1)]), lambda size: size > scale)
    return F.size(finer) + F.lit(1 if next_higher else 0)


def zoom_of_scale(scale: float, next_higher: bool = True, most: int = DEFAULTS.max_zoom, tile_size: int = DEFAULTS.tile_size) -> int:
    """``closest_zoom`` of a plain number."""
    return sum(tile_scale(z, tile_size) > scale for z in range(1, most + 1)) + next_higher


def nr_of_tiles(bbox: tuple[float, float, float, float], zoom: int) -> int:
    """How many tiles of a zoom a bounding box in metres meets."""
    xmin, ymin, xmax, ymax = tile_index_range(bbox, zoom)
    return (xmax - xmin + 1) * (ymax - ymin + 1)


def project(x: float, y: float, from_srid: int, to_srid: int) -> tuple[float, float]:
    """A point in another system; see ``projection.system`` for those that are known."""
    return projection.transform(x, y, from_srid, to_srid)


def project_bbox(bbox: tuple[float, float, float, float], from_srid: int, to_srid: int) -> tuple[float, float, float, float]:
    """The box around a box in another system."""
    return projection.transform_bbox(bbox, from_srid, to_srid)


def quadrants(bbox: tuple[float, float, float, float], zoom: int, size: int = DEFAULTS.quadrant_size) -> list[tuple[int, int, int, int]]:
    """Index boxes of ``size`` tiles that together cover a bounding box."""
    low_x, low_y, high_x, high_y = tile_index_range(bbox, zoom)
    return [(x, y, min(x + size - 1, high_x), min(y + size - 1, high_y)) for x in range(low_x, high_x + 1, size) for y in range(low_y, high_y + 1, size)]


def quadrant_key(x: Column, y: Column, size: int = DEFAULTS.quadrant_size) -> tuple[Column, Column]:
    """The quadrant of a tile, to partition work by."""
    return F.floor(x / size).cast("int"), F.floor(y / size).cast("int")


def spread(n: Column) -> Column:
    """The bits of numbers below 2^31 with a zero before each."""
    n = n.cast("long")
    # The masks of halves, quarters and so on of a word.
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask))
    return n


def morton(x: Column, y: Column) -> Column:
    """The place of a tile on a curve along which near tiles are near: the bits of both indexes in turns."""
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to metres (EPSG:4326 to 3857)."""
    return projection.transform(lon, lat, 4326, 3857, F)


def degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """Metres to degrees (EPSG:3857 to 4326)."""
    return projection.transform(x, y, 3857, 4326, F)


def intersect(a: tuple, b: tuple) -> tuple | None:
    """Common part of two index boxes, or None."""
    box = (max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3]))
    return box if box[0] <= box[2] and box[1] <= box[3] else None


def unite(a: tuple, b: tuple) -> tuple:
    """Smallest index box around two."""
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])
