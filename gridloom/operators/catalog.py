"""Layers, legends and colour maps as small tables, and what is derived from them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.errors import RasterException
from gridloom.functions.colors import Color, hex_to_rgba
from gridloom.functions.tilemath import WORLD

#: States of a layer's ingest, and fields whose change resets it.
STATES = {"UNPARSED": 0, "DOWNLOADING": 1, "REPROJECTING": 2, "CREATING": 3, "DROPPING_EMPTY": 4, "FINISHED": 5, "FAILED": 6}
INGEST_FIELDS = ["rasterfile", "source_url", "nodata", "srid", "max_zoom", "build_pyramid", "next_higher"]


def is_discrete(datatype: Column) -> Column:
    return datatype.isin("ca", "ma", "ro")


def legends_view(legends: DataFrame, entries: DataFrame, semantics: DataFrame) -> DataFrame:
    """legend_id, title and the entries as JSON, by code and then by name; derived, so it is never stale."""
    named = entries.join(semantics.select("semantics_id", "name"), "semantics_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("code", "name", "expression", "color"))), lambda e: F.struct(e["name"].alias("name"), e["expression"].alias("expression"), e["color"].alias("color")))
    gathered = named.groupBy("legend_id").agg(F.to_json(ordered).alias("json"))
    return legends.join(gathered, "legend_id").select("legend_id", "title", "json")


def legend_colormap(legend_json: str) -> dict[str, Color]:
    """Expression to RGBA; of equal expressions the last one counts."""
    return {e["expression"]: hex_to_rgba(e["color"]) for e in json.loads(legend_json)}


_session_colormaps: dict[tuple[str, str], dict] = {}


def set_session_colormap(session: str, key: str, colormap: dict) -> None:
    _session_colormaps[session, key] = colormap


def get_session_colormap(session: str, key: str) -> dict | None:
    return _session_colormaps.get((session, key))


def resolve_colormap(legends: DataFrame, colormap: dict | None = None, legend: str | None = None, session: str | None = None, layer_legend: str | None = None,
                     value_range: tuple[float, float] = (0.0, 255.0), entries: set[int] | None = None, band: tuple[DataFrame, int] | None = None) -> dict:
    """The colour map of a request.

    An explicit one comes first, then a legend by session key, id or title, then
    the layer's own, else grey from black to white over the range. An unknown
    title is an error. ``entries`` keeps only the entries at these places. A
    continuous map that names no range takes that of ``band``: the table of
    band statistics (layer_id, band, min, max) and a layer's id.
    """
    found = colormap
    if found is None and legend is not None:
        found = get_session_colormap(session, legend) if session else None
        if found is None:
            match = F.col("legend_id").cast("string") == legend if legend.isdigit() else F.lower("title") == legend.lower()
            row = legends.where(match).first()
            if row is None:
                raise RasterException(f"Legend {legend!r} does not exist.")
            found = legend_colormap(row["json"])
    if found is None and layer_legend is not None:
        found = legend_colormap(layer_legend)
    if found is None:
        return {"continuous": True, "from": (0, 0, 0, 255), "to": (255, 255, 255, 255), "range": value_range}
    if found.get("continuous") and "range" not in found and band is not None:
        found = found | band_range(*band)
    found = {k: hex_to_rgba(v) if isinstance(v, str) else v for k, v in found.items()}
    return {k: v for i, (k, v) in enumerate(found.items()) if i in entries} if entries is not None else found


def band_range(bands: DataFrame, layer_id: int, band: int = 0) -> dict[str, tuple[float, float]]:
    """The least and greatest value of a band as the ``range`` of a colour map; nothing for a band without statistics."""
    row = bands.where((F.col("layer_id") == layer_id) & (F.col("band") == band)).select("min", "max").first()
    return {} if row is None or row["min"] is None else {"range": (row["min"], row["max"])}


def ingest_fingerprint(layers: DataFrame) -> DataFrame:
    """A hash of the fields that decide a layer's tiles."""
    return layers.withColumn("fingerprint", F.xxhash64(*[F.col(c) for c in INGEST_FIELDS if c in layers.columns]))


def to_ingest(layers: DataFrame, status: DataFrame) -> DataFrame:
    """Layers that were never ingested or whose fields changed since (status: layer_id, fingerprint, state)."""
    done = status.where(F.col("state") == STATES["FINISHED"]).select("layer_id", "fingerprint")
    return ingest_fingerprint(layers).join(done, ["layer_id", "fingerprint"], "left_anti")


def zoom_and_pixelsize(tiles: DataFrame, tile_size: int) -> DataFrame:
    """The highest zoom of a layer and the side of its pixels in metres."""
    return tiles.agg(F.max("tilez").alias("max_zoom")).select("max_zoom", (F.lit(WORLD) / F.pow(F.lit(2.0), "max_zoom") / tile_size).alias("pixelsize"))


def find_layers(layers: DataFrame, key: str | int) -> DataFrame:
    """Layers by id, or by a part of their file name below ``rasters/``."""
    return layers.where(F.col("layer_id") == int(key)) if str(key).isdigit() else layers.where(F.col("rasterfile").contains(f"rasters/{key}"))


def default_zoom(layers: DataFrame, aggregation: bool) -> DataFrame:
    """One row: the lowest of the layers' highest zooms for aggregations, the highest for pixels and exports."""
    return layers.agg((F.min if aggregation else F.max)("max_zoom").alias("zoom"))
