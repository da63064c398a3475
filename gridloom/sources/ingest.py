"""The ingest of raster layers as jobs: read, override, reproject, tile, write, switch, and keep a log.

Everything that grows with the raster runs on Spark; the driver only sees one
row of metadata a band and the lines of the log. A source is read once, into blocks
of pixels in the store; all else is made from those, and they go when it is done.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import DEFAULTS, Settings
from gridloom.errors import RasterException
from gridloom.operators.catalog import STATES, ingest_fingerprint, to_ingest
from gridloom.operators.layers import drop_nodata, pixels_from_tiles
from gridloom.operators.pyramid import band_histogram, write_tiles
from gridloom.sources import tilestore
from gridloom.sources.source import MERCATOR, Source
from gridloom.sources.warp import blocks_of_pixels, tiles_of_blocks
from gridloom.sources.windows import read_blocks

LOG = "layer_id int, at timestamp, state int, zoom int, message string, fingerprint long"
METADATA = "width int, height int, upperleft_x double, upperleft_y double, scale_x double, scale_y double, skew_x double, skew_y double, numbands int, srid int, max_zoom int"


def source_of(rows: DataFrame, srid: int = MERCATOR) -> Source:
    """The Source of pixel rows or blocks as ``windows`` gives them."""
    ends = [F.col(c) + (F.col(s) if s in rows.columns else 1) for c, s in (("gx", "width"), ("gy", "height"))]
    row = rows.agg(F.max(ends[0]).alias("w"), F.max(ends[1]).alias("h"), *[F.first(c, True).alias(c) for c in ("origin_x", "origin_y", "scale_x", "scale_y")]).first()
    if row["w"] is None:
        raise RasterException("The source has no pixels.")
    return Source(row["w"], row["h"], (row["origin_x"], row["origin_y"]), (row["scale_x"], row["scale_y"]), srid)


def pyramid_of(pixels: DataFrame, source: Source, max_zoom: int, tile_size: int, nodata: float | None, zooms: range | None = None) -> DataFrame:
    """Tiles of all zooms up to ``max_zoom`` from source pixels (gx, gy, value) in the source's own system."""
    return tiles_of_blocks(blocks_of_pixels(pixels), source, max_zoom, tile_size, nodata, zooms).drop("band")


def _described(pixels: DataFrame, nodata: float | None) -> DataFrame:
    """One row of statistics of a band's values: those of valid ones, and the histogram of all."""
    valid = pixels.select(drop_nodata(F.col("value"), nodata).alias("value"))
    numbers = valid.agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return numbers.crossJoin(F.broadcast(band_histogram(pixels.select("value")))).withColumn("nodata_value", F.lit(nodata).cast("double"))  # one row beside one row


def ingest(spark: SparkSession, layer_id: int, source_rows: DataFrame, store: str, srid: int = MERCATOR, nodata: float | None = None, max_zoom: int | None = None,
           next_higher: bool = True, build_pyramid: bool = True, store_reprojected: bool = False, tile_size: int = DEFAULTS.tile_size,
           done: Callable[[int], None] | None = None, fingerprint: int | None = None) -> None:
    """Bring a raster into the tables below ``store``: tiles, metadata, bands, log (and reprojected).

    ``source_rows`` are the blocks of ``read_blocks`` or pixel rows with the same
    columns of place. ``nodata`` and ``max_zoom`` override what the raster says. The
    new tiles are written beside those of an earlier ingest, which stay in force
    until all are there; then one entry in the layer's manifest switches readers
    over. An ingest that fails changes nothing that readers see. The log gets a
    line for each step and at last FINISHED (with ``fingerprint``), or FAILED with the
    error, which is raised again. ``done`` is called with the layer's id after success.
    """

    def log(message: str, state: str | None = None, zoom: int | None = None) -> None:
        row = (layer_id, datetime.now(timezone.utc), None if state is None else STATES[state], zoom, message, fingerprint if state == "FINISHED" else None)
        spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{store}/log")

    version = uuid.uuid4().hex
    staged = f"{store}/staged/layer_id={layer_id}/{version}"
    try:
        log("Reading the raster.", "DOWNLOADING")
        place = [F.col(c) for c in ("origin_x", "origin_y", "scale_x", "scale_y", "nodata")]
        if "data" in source_rows.columns:
            source_rows.select("band", "gx", "gy", "width", "height", "data", *place).write.parquet(staged)
        else:
            described = source_rows.agg(*[F.first(c, True).alias(n) for c, n in zip(place, ("origin_x", "origin_y", "scale_x", "scale_y", "nodata"), strict=True)])
            size = source_rows.agg(F.max("gx").alias("gx"), F.max("gy").alias("gy")).first()
            made = blocks_of_pixels(source_rows).withColumns({"width": F.least("width", F.lit((size["gx"] or 0) + 1) - F.col("gx")), "height": F.least("height", F.lit((size["gy"] or 0) + 1) - F.col("gy"))})
            # Pixels beyond the raster's edge are cut off the blocks at its right and lower end.
            side = F.floor(F.sqrt(F.size("data"))).cast("int")
            cut = F.flatten(F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda row: F.slice("data", row * side + 1, F.col("width"))))
            made.withColumn("data", cut).crossJoin(F.broadcast(described)).write.parquet(staged)  # one row beside all
        blocks = spark.read.parquet(staged)
        source = source_of(blocks, srid)
        bands = sorted(r[0] for r in blocks.select("band").distinct().collect())
        stored = blocks.select(F.first("nodata", True)).first()[0]
        empty = nodata if nodata is not None else stored
        top = source.max_zoom(max_zoom, next_higher, tile_size)
        zooms = range(top + 1) if build_pyramid else range(top, top + 1)
        if srid != MERCATOR or store_reprojected:
            log(f"Transforming from {srid} to {MERCATOR}.", "REPROJECTING")
        log(f"Creating tiles of {len(bands)} bands.", "CREATING", top)
        target = tilestore.new_set(f"{store}/tiles", layer_id, version)
        if store_reprojected:
            raw = tiles_of_blocks(blocks, source, top, tile_size, None, range(top, top + 1))
            pixels = pixels_from_tiles(raw, tile_size).where("value is not null")
            grid = pixels.select("band", (F.col("tilex") * tile_size + F.col("px")).cast("int").alias("gx"), (F.col("tiley") * tile_size + F.col("py")).cast("int").alias("gy"), "value")
            grid.write.mode("overwrite").partitionBy("band").parquet(f"{store}/reprojected/layer_id={layer_id}")
        write_tiles(tiles_of_blocks(blocks, source, top, tile_size, empty, zooms), target, layer_id, tile_size=tile_size)
        log("Tiles of nothing but nodata are left out.", "DROPPING_EMPTY")
        opened = blocks.select("band", F.explode("data").alias("value"))
        statistics = [_described(opened.where(F.col("band") == band).where("value is not null"), empty).withColumn("band", F.lit(band)) for band in bands]
        for band, one in zip(bands, statistics, strict=True):
            one.coalesce(1).write.mode("overwrite" if band == bands[0] else "append").partitionBy("band").parquet(f"{store}/bands/layer_id={layer_id}")
        row = (source.width, source.height, *source.origin, *source.scale, 0.0, 0.0, len(bands), srid, source.max_zoom(max_zoom, True, tile_size))
        spark.createDataFrame([row], METADATA).coalesce(1).write.mode("overwrite").parquet(f"{store}/metadata/layer_id={layer_id}")
        tilestore.switch(spark, f"{store}/tiles", layer_id, version)
        log("Finished.", "FINISHED")
    except Exception as error:
        tilestore.discard(spark, f"{store}/tiles", layer_id, version)
        log(f"{type(error).__name__}: {error}"[:2000], "FAILED")
        raise
    finally:
        tilestore.delete(spark, staged)
    if done is not None:
        done(layer_id)


def parse_status(spark: SparkSession, store: str) -> DataFrame:
    """layer_id, state, tile_levels, fingerprint: the last state of each layer, the zooms it has worked on, in order, and what the last finished ingest was of."""
    log = spark.read.schema(LOG).parquet(f"{store}/log")
    return log.groupBy("layer_id").agg(F.max_by("state", F.when(F.col("state").isNotNull(), F.col("at"))).alias("state"), F.array_sort(F.collect_set("zoom")).alias("tile_levels"),
                                       F.max_by("fingerprint", F.when(F.col("state") == STATES["FINISHED"], F.col("at"))).alias("fingerprint"))


def changed_layers(spark: SparkSession, layers: DataFrame, store: str) -> DataFrame:
    """Layers that the store lacks, whose last ingest failed, or whose fields changed since; of the others nothing is read."""
    if not tilestore.exists(spark, f"{store}/log"):
        return ingest_fingerprint(layers)
    return to_ingest(layers, parse_status(spark, store))


def ingest_changed(spark: SparkSession, layers: DataFrame, store: str, settings: Settings = DEFAULTS, done: Callable[[int], None] | None = None) -> list[int]:
    """Ingest every layer that changed, and return the ids of those that finished.

    ``layers`` (layer_id, rasterfile or source_url, and any of nodata, srid,
    max_zoom, build_pyramid, next_higher, store_reprojected) is the catalog, a row a
    layer. A layer that fails is logged as such and does not stop the others.
    """
    finished = []
    for row in changed_layers(spark, layers, store).orderBy("layer_id").collect():
        fields = row.asDict()
        path = fields.get("source_url") or fields.get("rasterfile")
        given = {k: fields[k] for k in ("srid", "max_zoom", "next_higher", "build_pyramid", "store_reprojected") if fields.get(k) is not None}
        nodata = None if fields.get("nodata") in (None, "") else float(fields["nodata"])
        try:
            if not path:
                raise RasterException("No data source found. Provide a file or a URL.")
            ingest(spark, row["layer_id"], read_blocks(spark, path, settings=settings), store, nodata=nodata, tile_size=settings.tile_size, fingerprint=fields["fingerprint"], done=done, **given)
            finished.append(row["layer_id"])
        except Exception as error:
            failed = (row["layer_id"], datetime.now(timezone.utc), STATES["FAILED"], None, f"{type(error).__name__}: {error}"[:2000], None)
            spark.createDataFrame([failed], LOG).coalesce(1).write.mode("append").parquet(f"{store}/log")
    return finished
