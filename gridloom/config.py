"""Settings of tiling, ingest and export."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Tile size in pixels, zoom limits, tiles of a quadrant side and the largest export."""

    tile_size: int = 256
    max_zoom: int = 18
    quadrant_size: int = 50
    export_max_pixels: int = 10_000 * 10_000
    s3_endpoint: str | None = None


DEFAULTS = Settings()
