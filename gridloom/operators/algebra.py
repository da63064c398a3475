"""Formulas over layers: pixel rows and whole tiles."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.layers import TILE, Layer, aligned, aligned_pixels, aligned_sparse, drop_nodata, masked_array, sparse_table, values_of
from gridloom.plans.formula import REDUCERS, compile_arrays, compile_formula, names_in, parse


def _reduces(tree: tuple) -> bool:
    return tree[0] == "call" and tree[1] in REDUCERS or any(_reduces(part) for part in tree if isinstance(part, tuple))


def _at_rest(layers: dict[str, Layer], formula: str, remask: bool) -> Column:
    """What a formula makes of a pixel that no layer has, a constant."""
    nothing = {name: replace(value, column=F.lit(None).cast("double")) for name, value in values_of(layers).items()}
    value = compile_formula(formula, nothing)
    return drop_nodata(value.number, output_nodata(layers, value.fill)) if remask else value.number


def _sparse_pixels(layers: dict[str, Layer], formula: str, tile_size: int, remask: bool) -> DataFrame:
    """The pixels of sparse tiles; those that no layer has are among them only if the formula makes something of them."""
    tiles = aligned_sparse(layers, _at_rest(layers, formula, remask))
    zipped = F.arrays_zip(F.col("_places"), *[F.col(name) for name in layers])
    rows = tiles.select(*TILE, F.explode(zipped).alias("_z"))
    return rows.select(*TILE, (F.col("_z._places") % tile_size).alias("px"), F.floor(F.col("_z._places") / tile_size).cast("int").alias("py"),
                       *[drop_nodata(F.col("_z")[name], layer.nodata).alias(name) for name, layer in layers.items()])


def evaluate_pixels(layers: dict[str, Layer], formula: str, tile_size: int, remask: bool = True) -> DataFrame:
    """tilez, tilex, tiley, px, py, value of a formula over the tiles that all its layers have.

    Results equal to the output's nodata number are nodata again: the nodata of
    the first layer, or where a tile has nodata the number that its result is
    filled with. Of sparse tiles in one table, pixels that no layer has are left out
    if they come to nodata.
    """
    tree = parse(formula)
    unknown = names_in(tree)
    sparse = sparse_table(layers) is not None and not _reduces(tree)
    pixels = _sparse_pixels(layers, formula, tile_size, remask) if sparse else aligned_pixels(layers, tile_size)
    value = compile_formula(formula, values_of(layers), Window.partitionBy(*TILE) if _reduces(tree) else None)
    out = pixels.select(*TILE, "px", "py", value.number.alias("value")) if unknown or value else pixels
    return out.withColumn("value", drop_nodata(F.col("value"), output_nodata(layers, value.fill))) if remask else out


def output_nodata(layers: dict[str, Layer], fill: float | None) -> float | None:
    first = next(iter(layers.values())).nodata
    return fill if fill is not None else first


def evaluate_tiles(layers: dict[str, Layer], formula: str, remask: bool = True) -> DataFrame:
    """tilez, tilex, tiley, data: the formula over whole arrays, without opening them into rows.

    A formula without variables gives one value for the whole tile. Of sparse tiles
    in one table come sparse tiles, unless the formula looks at a tile as a whole.
    """
    sparse = sparse_table(layers) is not None and not _reduces(parse(formula))
    if sparse:
        tiles = aligned_sparse(layers, _at_rest(layers, formula, remask))
        joined = tiles.select(*TILE, "_places", "_size", *[masked_array(F.col(name), layer.nodata).alias(name) for name, layer in layers.items()])
    else:
        joined = aligned(layers)
    array, value = compile_arrays(formula, values_of(layers))
    size = F.size(next(iter(layers)))
    data = F.transform(array, lambda x: x.cast("double"))
    data = data if names_in(parse(formula)) & set(layers) and not _whole(parse(formula)) else F.array_repeat(F.element_at(data, 1), size)
    if remask:
        nodata = output_nodata(layers, value.fill)
        data = F.transform(data, lambda v: drop_nodata(v, nodata))
    return joined.select(*TILE, *([F.col("_places").alias("places"), F.col("_size").alias("size")] if sparse else []), data.alias("data"))


def _whole(tree: tuple) -> bool:
    """Whether a tree has one value for a tile, all its variables being inside reducers."""
    if tree[0] == "call" and tree[1] in REDUCERS:
        return True
    if tree[0] == "name":
        return tree[1] in ("E", "PI", "INF", "TRUE", "FALSE", "NULL")
    return all(_whole(part) for part in tree if isinstance(part, tuple))
