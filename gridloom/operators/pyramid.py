"""Tiling of a source raster over zooms, mosaics, and layer metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.config import DEFAULTS
from gridloom.errors import RasterAlgebraException
from gridloom.functions import tilemath
from gridloom.operators.aggregate import edges, histogram
from gridloom.operators.layers import drop_empty, drop_nodata, is_sparse, sparse_from_pixels, tiles_from_pixels


#: Bytes of a row group of a tile table, some tens of tiles, so that a read of a few tiles skips most of a file. A reader opens whole
#: arrays of a row group together, and few bytes of a file may hold very many equal pixels, so tiles are counted as they are in memory.
ROW_GROUP = 16 << 20


def zooms_of_pixel(gx: Column, gy: Column, max_zoom: int, zooms: range | None = None) -> Column:
    """The zooms whose grids hold a pixel of the finest grid, as an array.

    Pixel i of a grid that is r = 2^k times coarser is the source pixel under its
    centre, r * i + r / 2. So besides the finest zoom a pixel serves at most one
    other: that of k = 1 + its trailing zero bits, if column and row have equally many.
    """
    def zeros(n: Column) -> Column:
        return F.bit_count(n.bitwiseAND(-n) - 1)

    coarser = F.when((zeros(gx) == zeros(gy)) & (gx > 0) & (gy > 0), F.lit(max_zoom - 1) - zeros(gx)).otherwise(-1)
    wanted = zooms if zooms is not None else range(max_zoom + 1)
    return F.filter(F.array(F.lit(max_zoom), coarser), lambda z: z.isin(*wanted) if wanted else F.lit(False))


def sampled(source: DataFrame, max_zoom: int, zooms: range | None = None) -> DataFrame:
    """Pixels of all zooms from the source grid (gx, gy, value at ``max_zoom``) by nearest neighbour, in one pass over it."""
    rows = source.select("gx", "gy", "value", F.explode(zooms_of_pixel(F.col("gx"), F.col("gy"), max_zoom, zooms)).alias("tilez"))
    step = F.lit(max_zoom) - F.col("tilez")
    shifted = [F.call_function("shiftright", F.col(c).cast("int"), step).alias(c) for c in ("gx", "gy")]
    return rows.select("tilez", *shifted, "value")


def create_tiles(source: DataFrame, max_zoom: int, tile_size: int, nodata: float | None, zooms: range | None = None, sparse: bool = False) -> DataFrame:
    """Tiles of all zooms from 0 to ``max_zoom``, ``sparse`` if wanted; tiles of nothing but nodata are left out. One scan and one shuffle make all zooms."""
    levels, ts = sampled(source, max_zoom, zooms), tile_size
    pixels = levels.select("tilez", F.floor(F.col("gx") / ts).cast("int").alias("tilex"), F.floor(F.col("gy") / ts).cast("int").alias("tiley"),
                           (F.col("gx") % ts).alias("px"), (F.col("gy") % ts).alias("py"), drop_nodata(F.col("value"), nodata).alias("value"))
    return drop_empty(sparse_from_pixels(pixels, ts, {"data": "value"}) if sparse else tiles_from_pixels(pixels, ts))


def write_tiles(tiles: DataFrame, path: str, layer_id: int, band: int = 0, batch: str | None = None, tile_size: int = DEFAULTS.tile_size) -> None:
    """Write tiles, whole or sparse, partitioned by layer, band and zoom, replacing that band's partitions of these zooms only.

    With ``batch``, below layer and band the partitions are also those of a batch, and
    only a batch of that name is replaced. A table is written either with batches or without.
    """
    keys = ["layer_id", "band", *(["batch"] if batch is not None else []), "tilez"]
    named = [F.lit(batch).alias("batch")] if batch is not None else []
    # Tiles that name their band keep it.
    own = F.col("band") if "band" in tiles.columns else F.lit(band)
    sparse = is_sparse(tiles)
    rows = tiles.select(F.lit(layer_id).alias("layer_id"), own.alias("band"), *named, "tilez", "tilex", "tiley", "data", *(["places", "size"] if sparse else []))
    by_quadrant = rows.repartition("band", "tilez", F.floor(F.col("tilex") / DEFAULTS.quadrant_size), F.floor(F.col("tiley") / DEFAULTS.quadrant_size))
    # The order begins with the keys of the folders, else the writer sorts anew.
    near = by_quadrant.sortWithinPartitions(*keys, tilemath.morton(F.col("tilex"), F.col("tiley")))
    most = {} if sparse else {"parquet.block.row.count.limit": max(ROW_GROUP // (8 * tile_size**2), 1)}
    near.write.mode("overwrite").options(**{"partitionOverwriteMode": "dynamic", "parquet.block.size": ROW_GROUP, **most}).partitionBy(*keys).parquet(path)


def band_metadata(pixels: DataFrame) -> DataFrame:
    """min, max, mean, std (of the population) of each layer and band."""
    return pixels.groupBy("layer_id", "band").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def band_histogram(raw: DataFrame, bins: int = 100) -> DataFrame:
    """One row of 100 counts and 101 edges over whole units; raw values count, nodata among them."""
    low, high = raw.agg(F.floor(F.min("value")).cast("double"), F.ceil(F.max("value")).cast("double")).first()
    bounds = edges(low or 0.0, high or 0.0, bins)
    counts = histogram(raw, bins, (bounds[0], bounds[-1]))
    return counts.agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "count"))), lambda b: b["count"]).alias("hist_values")).withColumn("hist_bins", F.array(*[F.lit(b) for b in bounds]))


def mosaic(tiles: DataFrame, box: tuple[int, int, int, int], zoom: int, tile_size: int) -> DataFrame:
    """gx, gy, value of one raster over an index box; what no tile covers is 0."""
    xmin, ymin, xmax, ymax = box
    if (xmax - xmin + 1) * (ymax - ymin + 1) * tile_size**2 > DEFAULTS.export_max_pixels:
        raise RasterAlgebraException(f"The mosaic has more than {DEFAULTS.export_max_pixels} pixels.")
    spark = tiles.sparkSession
    columns, rows = xmax - xmin + 1, ymax - ymin + 1
    cells = spark.range(columns * rows).select((F.col("id") % columns + xmin).cast("int").alias("tilex"), (F.floor(F.col("id") / columns) + ymin).cast("int").alias("tiley"))
    here = tiles.where((F.col("tilez") == zoom) & F.col("tilex").between(xmin, xmax) & F.col("tiley").between(ymin, ymax)).select("tilex", "tiley", "data")
    empty = F.array_repeat(F.lit(0.0), tile_size * tile_size)
    opened = cells.join(here, ["tilex", "tiley"], "left").select("tilex", "tiley", F.posexplode(F.coalesce("data", empty)).alias("pos", "value"))
    return opened.select((F.col("tilex") * tile_size + F.col("pos") % tile_size).alias("gx"), (F.col("tiley") * tile_size + F.floor(F.col("pos") / tile_size)).cast("int").alias("gy"), F.coalesce("value", F.lit(0.0)).alias("value"))


def reproject(source: DataFrame, width: int, height: int, bbox: tuple[float, float, float, float], target: DataFrame) -> DataFrame:
    """Nearest source pixel (EPSG:4326 grid: col, row, value) under each target pixel centre (x, y in metres).

    The source index follows from the inverse projection, so it is one equality
    join; targets outside the source are nodata.
    """
    from gridloom.functions.tilemath import degrees

    lon, lat = degrees(F.col("x"), F.col("y"))
    xmin, ymin, xmax, ymax = bbox
    placed = target.withColumn("col", F.floor((lon - xmin) / ((xmax - xmin) / width)).cast("int")).withColumn("row", F.floor((F.lit(ymax) - lat) / ((ymax - ymin) / height)).cast("int"))
    return placed.join(source, ["col", "row"], "left").drop("col", "row")
