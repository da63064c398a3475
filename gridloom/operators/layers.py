"""Layers as tiles and pixels, their alignment, and lookups between zooms.

tiles: layer_id, band, tilez, tilex, tiley, data (row-major array, NULL is nodata)
sparse tiles: the same with places, ascending, of the pixels that data holds, and size, the
pixels of the whole tile; all others are nodata
pixels: the same keys with px, py and value
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.errors import RasterAlgebraException, RasterException
from gridloom.plans.formula import NAME, Value

TILE = ["tilez", "tilex", "tiley"]


@dataclass(frozen=True)
class Layer:
    """Tiles of one band of a layer, with the number that stands for nodata (None: it has none).

    Bands that lie side by side in one table are layers of the same ``tiles``
    with different columns; they are read together and never joined.
    """

    tiles: DataFrame
    nodata: float | None = None
    column: str = "data"


def near(value: Column, number: float) -> Column:
    """Equality up to the tolerance with which nodata is recognised in floating-point data."""
    return F.abs(value - number) <= 1e-8 + 1e-5 * abs(number)


def drop_nodata(value: Column, nodata: float | None) -> Column:
    """NULL where ``value`` is nodata; nan is an ordinary value."""
    return value if nodata is None else F.when(~near(value, nodata) | F.isnan(value), value)


def tiles_from_pixels(pixels: DataFrame, tile_size: int, keys: list[str] = TILE, value: str = "value") -> DataFrame:
    """Dense tiles from pixel rows (px, py, value); missing pixels are nodata. See ``bands_from_pixels``."""
    return bands_from_pixels(pixels, tile_size, {"data": value}, keys)


def bands_from_pixels(pixels: DataFrame, tile_size: int, bands: dict[str, str], keys: list[str] = TILE) -> DataFrame:
    """Dense tiles from pixel rows, one array for each of ``bands`` (name to pixel column).

    The pixels of a tile are gathered once and sorted by place; each brings the
    gap before it as nodata, so the work grows with the pixels. Of rows at one
    place the first in the order of their values counts; places outside the
    tile are an error of the caller and are left out.
    """
    n = tile_size * tile_size
    sorted_ = _gathered(pixels, tile_size, bands, keys)

    def dense(i: int) -> Column:
        before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get("_rows", k - 1)["pos"])
        nothing = F.lit(None).cast("double")
        piece = lambda e, k: F.when(e["pos"] == before(k), F.array().cast("array<double>")).otherwise(F.concat(F.array_repeat(nothing, e["pos"] - before(k) - 1), F.array(e[f"v{i}"])))
        rest = F.array_repeat(nothing, F.lit(n - 1) - F.element_at("_rows", -1)["pos"])
        return F.concat(F.flatten(F.transform("_rows", piece)), rest)

    return sorted_.select(*keys, *[dense(i).alias(name) for i, name in enumerate(bands)])


def _gathered(pixels: DataFrame, tile_size: int, bands: dict[str, str], keys: list[str]) -> DataFrame:
    """The pixels of each tile as one array of pos, v0, v1 and so on, in their order."""
    inside = F.col("px").between(0, tile_size - 1) & F.col("py").between(0, tile_size - 1)
    place = (F.col("py") * tile_size + F.col("px")).cast("int")
    row = F.struct(place.alias("pos"), *[F.col(column).cast("double").alias(f"v{i}") for i, column in enumerate(bands.values())])
    return pixels.where(inside).groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_rows"))


def sparse_from_pixels(pixels: DataFrame, tile_size: int, bands: dict[str, str], keys: list[str] = TILE) -> DataFrame:
    """Sparse tiles from pixel rows: places, one array for each of ``bands``, and size.

    They hold what ``bands_from_pixels`` would, but for the pixels without a row, so
    their bytes grow with the pixels only, however few of a tile's are there.
    """
    # Of rows at one place the first counts.
    first = F.filter("_rows", lambda row, k: (k == 0) | (F.get("_rows", k - 1)["pos"] != row["pos"]))
    rows = _gathered(pixels, tile_size, bands, keys).select(*keys, first.alias("_rows"))
    return rows.select(*keys, F.col("_rows.pos").alias("places"), *[F.col(f"_rows.v{i}").alias(name) for i, name in enumerate(bands)], F.lit(tile_size * tile_size).alias("size"))


def is_sparse(tiles: DataFrame) -> bool:
    return "places" in tiles.columns


def whole_array(values: Column) -> Column:
    """The array of all pixels of a sparse tile; those that it does not hold are nodata."""
    nothing, places = F.lit(None).cast("double"), F.col("places")
    before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get(places, k - 1))
    piece = lambda v, k: F.concat(F.array_repeat(nothing, F.get(places, k) - before(k) - 1), F.array(v))
    rest = F.array_repeat(nothing, F.col("size") - 1 - F.coalesce(F.try_element_at(places, F.lit(-1)), F.lit(-1)))
    return F.concat(F.flatten(F.transform(values, piece)), rest)


def pixels_from_tiles(tiles: DataFrame, tile_size: int, column: str = "data") -> DataFrame:
    """One row per pixel, of sparse tiles per pixel that they hold; its place is pos = py * tile_size + px."""
    sparse = is_sparse(tiles)
    keys = [c for c in tiles.columns if c != column and not (sparse and c in ("places", "size"))]
    opened = F.inline(F.arrays_zip(F.col("places").alias("pos"), F.col(column).alias("value"))) if sparse else F.posexplode(column).alias("pos", "value")
    rows = tiles.select(*keys, opened)
    return rows.select(*keys, (F.col("pos") % tile_size).alias("px"), F.floor(F.col("pos") / tile_size).cast("int").alias("py"), "value")


def band_of(tiles: DataFrame, layer_id: int, band: int = 0) -> DataFrame:
    """Tiles of one band of one layer (the selector ``name:band``)."""
    return tiles.where((F.col("layer_id") == layer_id) & (F.col("band") == band)).select(*TILE, "data")


def parse_layers(text: str) -> dict[str, tuple[int, int]]:
    """``a=1,b:2=3`` to names with layer id and band."""
    found: dict[str, tuple[int, int]] = {}
    for part in filter(None, (text or "").split(",")):
        key, _, layer = part.partition("=")
        name, _, band = key.partition(":")
        if not NAME.fullmatch(name) or not layer.isdigit() or (band and not band.isdigit()):
            raise RasterException(f"Cannot read layer {part!r}.")
        if name in found:
            raise RasterException(f"Layer name {name!r} is given twice.")
        found[name] = (int(layer), int(band or 0))
    return found


def bind(tiles: DataFrame, layers: str, nodata: dict[int, float | None]) -> dict[str, Layer]:
    """Named layers of a tile table, as formulas use them."""
    return {name: Layer(band_of(tiles, layer, band), nodata.get(layer)) for name, (layer, band) in parse_layers(layers).items()}


def masked_array(data: Column, nodata: float | None) -> Column:
    return F.transform(data, lambda v: drop_nodata(v, nodata)) if nodata is not None else data


def aligned(layers: dict[str, Layer]) -> DataFrame:
    """Tiles that all layers have, one array column for each name, which is whole. Layers of one table of tiles are read together."""
    if not layers:
        raise RasterAlgebraException("No layers are bound.")

    def masked(layer: Layer) -> Column:
        data = F.col(layer.column)
        return masked_array(whole_array(data) if is_sparse(layer.tiles) else data, layer.nodata)

    tables: dict[int, dict[str, Layer]] = {}
    for name, layer in layers.items():
        tables.setdefault(id(layer.tiles), {})[name] = layer
    parts = [next(iter(own.values())).tiles.select(*TILE, *[masked(layer).alias(name) for name, layer in own.items()]) for own in tables.values()]
    return reduce(lambda a, b: a.join(b, TILE), parts)


def sparse_table(layers: dict[str, Layer]) -> DataFrame | None:
    """The table of sparse tiles whose bands the layers are; None if they lie in several tables or in whole arrays."""
    tables = {id(layer.tiles): layer.tiles for layer in layers.values()}
    table = next(iter(tables.values()), None)
    return table if len(tables) == 1 and is_sparse(table) else None


def aligned_sparse(layers: dict[str, Layer], rest: Column) -> DataFrame:
    """Sparse tiles of layers of one table, raw, one array column for each name, beside _places and _size.

    ``rest`` is a constant, what comes of a pixel that no layer has. Unless it is
    NULL, all pixels of a tile are in its arrays.
    """
    table, few = sparse_table(layers), rest.isNull()
    arrays = [F.when(few, F.col(layer.column)).otherwise(whole_array(F.col(layer.column))).alias(name) for name, layer in layers.items()]
    places = F.when(few, F.col("places")).otherwise(F.sequence(F.lit(0), F.col("size") - 1))
    return table.select(*TILE, F.col("size").alias("_size"), places.alias("_places"), *arrays)


def values_of(layers: dict[str, Layer], element: Column | None = None) -> dict[str, Value]:
    """Formula variables for the columns of ``aligned`` or of its pixels."""
    return {n: Value(F.col(n) if element is None else element[n], "double", layer.nodata is not None, layer.nodata) for n, layer in layers.items()}


def aligned_pixels(layers: dict[str, Layer], tile_size: int) -> DataFrame:
    """Pixel rows with one column for each layer; zipped arrays are opened, so pixels are never joined."""
    names = list(layers)
    rows = aligned(layers).select(*TILE, F.posexplode(F.arrays_zip(*names)).alias("pos", "_z"))
    return rows.select(*TILE, (F.col("pos") % tile_size).alias("px"), F.floor(F.col("pos") / tile_size).cast("int").alias("py"), *[F.col(f"_z.{n}").alias(n) for n in names])


def check_aligned(metadata: DataFrame, by: list[str]) -> DataFrame:
    """One row: whether all rasters agree in the columns ``by`` (srid and geotransform)."""
    return metadata.agg((F.count_distinct(F.struct(*by)) <= 1).alias("aligned"), F.count("*").alias("rasters"))


def index_ranges(tiles: DataFrame) -> DataFrame:
    """Index box of the tiles of every layer and zoom."""
    return tiles.groupBy("layer_id", "tilez").agg(F.min("tilex").alias("xmin"), F.min("tiley").alias("ymin"), F.max("tilex").alias("xmax"), F.max("tiley").alias("ymax"))


def common_range(ranges: DataFrame, union: bool = False) -> DataFrame:
    """Intersection of index boxes by zoom (empty ones drop out), or the box around them."""
    low, high = (F.min, F.max) if union else (F.max, F.min)
    box = ranges.groupBy("tilez").agg(low("xmin").alias("xmin"), low("ymin").alias("ymin"), high("xmax").alias("xmax"), high("ymax").alias("ymax"))
    return box.where((F.col("xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("ymax")))


def ancestors(requests: DataFrame, tiles: DataFrame) -> DataFrame:
    """For each requested tile the nearest existing one at its zoom or above, as ``foundz`` and its data.

    Each request looks for its ancestors by equality on zoom and index; tiles
    carry no data until the nearest is chosen.
    """
    asked = requests.select(*TILE, F.explode(F.sequence(F.lit(0), "tilez")).alias("foundz"))
    shift = F.col("tilez") - F.col("foundz")
    asked = asked.withColumn("_x", F.expr("shiftright(tilex, tilez - foundz)")).withColumn("_y", F.expr("shiftright(tiley, tilez - foundz)")).where(shift >= 0)
    there = tiles.select(F.col("tilez").alias("foundz"), F.col("tilex").alias("_x"), F.col("tiley").alias("_y"))
    best = asked.join(there, ["foundz", "_x", "_y"]).groupBy(*TILE).agg(F.max("foundz").alias("foundz"))
    best = best.withColumn("_x", F.expr("shiftright(tilex, tilez - foundz)")).withColumn("_y", F.expr("shiftright(tiley, tilez - foundz)"))
    data = tiles.select(F.col("tilez").alias("foundz"), F.col("tilex").alias("_x"), F.col("tiley").alias("_y"), "data")
    return best.join(data, ["foundz", "_x", "_y"]).select(*TILE, "foundz", "data")


def overzoom(found: DataFrame, tile_size: int) -> DataFrame:
    """Children resampled from their ancestors by nearest neighbour."""
    depth = F.col("tilez") - F.col("foundz")
    mask = (F.expr("shiftleft(1, tilez - foundz)") - 1).cast("int")
    off_x, off_y = F.col("tilex").bitwiseAND(mask) * tile_size, F.col("tiley").bitwiseAND(mask) * tile_size
    rows = found.withColumn("_d", F.expr("shiftleft(1, tilez - foundz)")).withColumn("_ox", off_x).withColumn("_oy", off_y)
    source = F.transform(F.sequence(F.lit(0), F.lit(tile_size * tile_size - 1)), lambda p: F.element_at(
        "data", (F.floor((F.col("_oy") + F.floor(p / tile_size)) / F.col("_d")) * tile_size + F.floor((F.col("_ox") + p % tile_size) / F.col("_d"))).cast("int") + 1))
    return rows.where(depth >= 0).select(*TILE, "foundz", source.alias("data"))


def with_default(requests: DataFrame, tiles: DataFrame, tile_size: int, value: float | None = None) -> DataFrame:
    """Requested tiles; one that a layer lacks is filled with ``value``."""
    empty = F.array_repeat(F.lit(value).cast("double"), tile_size * tile_size)
    return requests.select(*TILE).join(tiles.select(*TILE, "data"), TILE, "left").select(*TILE, F.coalesce("data", empty).alias("data"))


def drop_empty(tiles: DataFrame) -> DataFrame:
    """Tiles with at least one pixel that is not nodata."""
    return tiles.where(F.exists("data", lambda v: v.isNotNull()))


def pixel_lookup(points: DataFrame, tiles: DataFrame, zoom: int, tile_size: int) -> DataFrame:
    """Value under each point (x, y in metres); NULL where there is no tile."""
    from gridloom.functions.tilemath import HALF, WORLD

    scale = WORLD / 2.0**zoom / tile_size
    gx, gy = (F.col("x") + HALF) / scale, (F.lit(HALF) - F.col("y")) / scale
    last = 2**zoom * tile_size - 1
    placed = points.withColumn("_gx", F.least(gx.cast("int"), F.lit(last))).withColumn("_gy", F.least(gy.cast("int"), F.lit(last)))
    inside = (F.abs("x") <= HALF) & (F.abs("y") <= HALF)
    placed = placed.withColumn("tilez", F.lit(zoom)).withColumn("tilex", F.floor(F.col("_gx") / tile_size).cast("int")).withColumn("tiley", F.floor(F.col("_gy") / tile_size).cast("int"))
    joined = placed.where(inside).join(tiles.select(*TILE, "data"), TILE, "left")
    at = (F.col("_gy") % tile_size) * tile_size + F.col("_gx") % tile_size + 1
    return joined.withColumn("value", F.try_element_at("data", at)).drop("_gx", "_gy", "data")
