"""Where a source raster lies, and how fine it is."""

from __future__ import annotations

from dataclasses import dataclass

from gridloom.config import DEFAULTS
from gridloom.functions import tilemath

MERCATOR = 3857


@dataclass(frozen=True)
class Source:
    """Where and how large a source raster is: pixels, upper left corner, pixel size, system."""

    width: int
    height: int
    origin: tuple[float, float]
    scale: tuple[float, float]
    srid: int = MERCATOR

    @property
    def bbox(self) -> tuple[float, float, float, float]:
        left, top = self.origin
        right, bottom = left + self.width * self.scale[0], top + self.height * self.scale[1]
        return min(left, right), min(top, bottom), max(left, right), max(top, bottom)

    def extent(self, srid: int = MERCATOR) -> tuple[float, float, float, float]:
        """The box around the raster's corners in another system."""
        return tilemath.project_bbox(self.bbox, self.srid, srid)

    def max_zoom(self, override: int | None = None, next_higher: bool = True, tile_size: int = DEFAULTS.tile_size) -> int:
        """The zoom whose pixels match the raster's: those at its centre, as long as they are in metres."""
        if override is not None:
            return override
        if self.srid == MERCATOR:
            metres = abs(self.scale[0])
        else:
            left, low, right, high = self.bbox
            x, y = (left + right) / 2, (low + high) / 2
            a, b = tilemath.project(x, y, self.srid, MERCATOR), tilemath.project(x + self.scale[0], y, self.srid, MERCATOR)
            metres = ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5
        return tilemath.zoom_of_scale(metres, True, tile_size=tile_size) - (0 if next_higher else 1)
