"""Point in polygon and box tests as Columns.

A shape is a literal ring, a list of (x, y), or a list of rings; rings inside
others are holes, and parts may lie apart (even-odd rule). Tables of polygons
hold arrays of rings and are joined by ``zones_of_pixels``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]
Shape = Ring | list[Ring]


def rings_of(shape: Shape) -> list[Ring]:
    return [shape] if shape and isinstance(shape[0][0], (int, float)) else shape


def _sides(shape: Shape) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    return [side for ring in rings_of(shape) for side in zip(ring, ring[1:] + ring[:1], strict=True)]


def bbox(shape: Shape) -> tuple[float, float, float, float]:
    xs, ys = zip(*(point for ring in rings_of(shape) for point in ring), strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def moved(shape: Shape, to: Callable[[float, float], tuple[float, float]]) -> list[Ring]:
    """The rings of a shape with every point put through ``to``."""
    return [[to(x, y) for x, y in ring] for ring in rings_of(shape)]


def in_ring(x: Column, y: Column, ring: Shape) -> Column:
    """Whether a point lies in the shape: the parity of sides that a ray to the right crosses."""
    crossed = [F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1))), 1).otherwise(0)
               for (x1, y1), (x2, y2) in _sides(ring) if y1 != y2]
    xmin, ymin, xmax, ymax = bbox(ring)
    near = x.between(xmin, xmax) & y.between(ymin, ymax)
    return near & (reduce(lambda a, b: a + b, crossed, F.lit(0)) % 2 == 1)


def side_meets_box(x: Column, y: Column, side) -> Column:
    """Whether a line segment touches the unit box whose lower corner is (x, y)."""
    (x1, y1), (x2, y2) = side
    overlap = (x <= max(x1, x2)) & (x + 1 >= min(x1, x2)) & (y <= max(y1, y2)) & (y + 1 >= min(y1, y2))
    turn = lambda cx, cy: (cy - y1) * (x2 - x1) - (cx - x1) * (y2 - y1)
    corners = [turn(x, y), turn(x + 1, y), turn(x, y + 1), turn(x + 1, y + 1)]
    return overlap & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def burned(gx: Column, gy: Column, ring: Shape, all_touched: bool = False) -> Column:
    """Whether a pixel of the global grid is covered: its centre, or with ``all_touched`` any part of it."""
    inside = in_ring(gx + 0.5, gy + 0.5, ring)
    return reduce(lambda a, b: a | b, [side_meets_box(gx, gy, s) for s in _sides(ring)], inside) if all_touched else inside


def rasterize(gx: Column, gy: Column, ring: Shape, burn: float = 1, all_touched: bool = False, add_to: Column | None = None) -> Column:
    """Burn value where covered and 0 elsewhere, or the base plus the burn value."""
    mask = F.when(burned(gx, gy, ring, all_touched), float(burn)).otherwise(0.0)
    return mask if add_to is None else add_to + mask


def index_box(ring: Shape, tile_size: int) -> tuple[int, int, int, int]:
    """Tiles that a ring in grid units can touch, as a predicate for tile scans."""
    xmin, ymin, xmax, ymax = bbox(ring)
    return int(xmin // tile_size), int(ymin // tile_size), int(xmax // tile_size), int(ymax // tile_size)


def in_box(tilex: Column, tiley: Column, box: tuple[int, int, int, int]) -> Column:
    return tilex.between(box[0], box[2]) & tiley.between(box[1], box[3])


def in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point lies in the polygon of a column of rings, by the parity of crossed sides."""
    def crossed(ring: Column) -> Column:
        after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        meets = lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + (y - a["y"]) * ((b["x"] - a["x"]) / F.when(b["y"] != a["y"], b["y"] - a["y"])))
        return F.aggregate(F.zip_with(ring, after, meets), F.lit(0), lambda n, hit: n + F.coalesce(hit, F.lit(False)).cast("int"))

    return F.aggregate(F.transform(rings, crossed), F.lit(0), lambda n, m: n + m) % 2 == 1
