"""Value counts, histograms, legend classes and statistics of formulas.

Every count is a partial and a final hash aggregation over pixel rows; nothing
is gathered in one place.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.errors import RasterAggregationException
from gridloom.functions import geometry
from gridloom.functions.tilemath import HALF, project, tile_scale
from gridloom.operators.algebra import evaluate_pixels
from gridloom.operators.layers import Layer
from gridloom.plans.formula import Value, compile_formula

#: Fixed value: acres of a square metre.
ACRES = 0.000247105381


def grouping_of(datatypes: list[str]) -> str:
    """``auto``: discrete if every layer is categorical or a mask, else continuous."""
    return "discrete" if all(t in ("ca", "ma") for t in datatypes) else "continuous"


def value_count(pixels: DataFrame) -> DataFrame:
    """value, count of all pixels that are not nodata."""
    return pixels.where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("count"))


def edges(low: float, high: float, bins: int) -> list[float]:
    """Edges of equal bins; a constant spreads by half a unit to each side."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    return [low + step * k for k in range(bins)] + [high]


def bin_of(value: Column, bounds: list[float]) -> Column:
    """Bin of a value by comparison with the edges; the last bin is closed, NULL is outside."""
    low, high, bins = bounds[0], bounds[-1], len(bounds) - 1
    at = F.least(F.greatest(F.floor((value - low) / ((high - low) / bins)).cast("int"), F.lit(0)), F.lit(bins - 1))
    table = F.array(*[F.lit(b) for b in bounds])
    at = F.when(value < F.element_at(table, at + 1), at - 1).when((at < bins - 1) & (value >= F.element_at(table, at + 2)), at + 1).otherwise(at)
    return F.when((value >= low) & (value <= high), at)


def histogram(pixels: DataFrame, bins: int = 10, hist_range: tuple[float, float] | None = None) -> DataFrame:
    """bin, low, high, count with every bin present; the range is that of the data unless given."""
    there = pixels.where(F.col("value").isNotNull())
    if hist_range is None:
        low, high, nan = there.agg(F.min("value"), F.max("value"), F.max(F.isnan("value"))).first()
        if nan:
            raise RasterAggregationException("A range cannot be found in data with nan.")
        hist_range = (0.0, 1.0) if low is None else (low, high)
    bounds = edges(*hist_range, bins)
    counted = there.select(bin_of(F.col("value"), bounds).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    every = pixels.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    table = F.array(*[F.lit(b) for b in bounds])
    return every.join(counted, "bin", "left").select("bin", F.element_at(table, F.col("bin") + 1).alias("low"), F.element_at(table, F.col("bin") + 2).alias("high"), F.coalesce("n", F.lit(0).cast("long")).alias("count"))


def legend_classes(legend: str | list[dict]) -> list[dict]:
    """Entries of a legend given as JSON or as a list; an expression is a number or a formula in x."""
    try:
        found = json.loads(legend) if isinstance(legend, str) else legend
        return [{"name": str(e["name"]), "expression": str(e["expression"])} for e in found]
    except (ValueError, KeyError, TypeError) as error:
        raise RasterAggregationException("The legend cannot be read.") from error


def class_condition(expression: str, value: Column, masked: bool = False) -> Column:
    """Whether a value belongs to a legend class."""
    try:
        return F.coalesce(value == float(expression), F.lit(False)) & ~F.isnan(value)
    except ValueError:
        return F.coalesce(compile_formula(expression, {"x": Value(value, "double", masked)}).truth, F.lit(False))


def legend_count(pixels: DataFrame, legend: str | list[dict]) -> DataFrame:
    """name, count of each class in one pass; classes may overlap, empty ones count 0."""
    classes = legend_classes(legend)
    there = pixels.where(F.col("value").isNotNull())
    sums = [F.coalesce(F.sum(F.when(class_condition(c["expression"], F.col("value")), 1).otherwise(0)), F.lit(0)).cast("long").alias(f"c{i}") for i, c in enumerate(classes)]
    entries = F.array(*[F.struct(F.lit(c["name"]).alias("name"), F.col(f"c{i}").alias("count")) for i, c in enumerate(classes)])
    return there.agg(*sums).select(F.inline(entries))


def in_acres(counts: DataFrame, scale_x: float, scale_y: float) -> DataFrame:
    """Counts as acres of pixels of this size in metres."""
    return counts.withColumn("count", F.col("count") * F.lit(abs(scale_x * scale_y) * ACRES))


def lowest_zoom(layers: dict[str, Layer]) -> int:
    """The lowest of the layers' highest zooms; -1 if a layer has no tile."""
    tables = {id(layer.tiles): layer.tiles for layer in layers.values()}
    tops = [table.agg(F.max("tilez")).first()[0] for table in tables.values()]
    return min(-1 if top is None else top for top in tops)


def layer_value_count(layer: Layer, tile_size: int, datatype: str = "ca", zoom: int | None = None, geom: geometry.Shape | None = None, area: bool = False) -> DataFrame:
    """value, count of one layer of categories or masks; with ``area`` square metres of pixels."""
    if datatype not in ("ca", "ma"):
        raise TypeError(f"Values of a layer of type {datatype!r} cannot be counted, only those of categories and masks.")
    one = Aggregator({"a": layer}, "a", tile_size, grouping="discrete", zoom=zoom, geom=geom, all_touched=False, acres=False)
    counts = one.value_count()
    return counts.withColumn("count", F.col("count") * F.lit(tile_scale(one.zoom, tile_size) ** 2)) if area else counts


def statistics(pixels: DataFrame, hist_range: tuple[float, float] | None = None) -> DataFrame:
    """min, max, mean, std (of the population) and the moments t0, t1, t2 they rest on; NULLs without pixels."""
    value = F.col("value")
    there = pixels.where(value.isNotNull() if hist_range is None else value.between(*hist_range))
    return moments(there.agg(F.count("value").alias("t0"), F.sum("value").alias("t1"), F.sum(value * value).alias("t2"), F.min("value").alias("min"), F.max("value").alias("max")))


def moments(sums: DataFrame) -> DataFrame:
    """Mean and deviation from summed moments; moments of parts add up."""
    n = F.when(F.col("t0") > 0, F.col("t0"))
    spread = F.sqrt(F.greatest(n * F.col("t2") - F.col("t1") * F.col("t1"), F.lit(0.0))) / n
    return sums.withColumn("mean", F.col("t1") / n).withColumn("std", spread)


class Aggregator:
    """One formula over aligned layers at one zoom, counted in the ways the grouping names.

    ``grouping`` is auto, discrete, continuous, a legend as JSON or list, or the
    id of one in ``legends`` (legend_id, json). ``zoom`` defaults to the lowest
    of the layers' highest zooms. ``geom`` clips: a ring or list of rings in
    EPSG:3857, or in ``srid``; with ``all_touched`` a pixel counts if any part of
    it is covered, else if its centre is. Clipped counts are acres if ``acres``
    is set. ``mask`` is a further condition on tilez, tilex, tiley, px, py.
    """

    def __init__(self, layers: dict[str, Layer], formula: str, tile_size: int, datatypes: list[str] | None = None, grouping="auto",
                 mask: Column | None = None, hist_range: tuple[float, float] | None = None, pixel_scale: tuple[float, float] | None = None,
                 zoom: int | None = None, geom: geometry.Shape | None = None, srid: int = 3857, all_touched: bool = True, acres: bool = True, legends: DataFrame | None = None):
        self.grouping = self._grouping(grouping, datatypes, legends)
        self.zoom = lowest_zoom(layers) if zoom is None else zoom
        self.hist_range = hist_range
        at = F.col("tilez") == self.zoom
        self.pixel_scale = pixel_scale if mask is not None else None
        if geom is not None:
            scale = tile_scale(self.zoom, tile_size)
            shape = geometry.moved(geom, lambda x, y: project(x, y, srid, 3857))
            shape = geometry.moved(shape, lambda x, y: ((x + HALF) / scale, (HALF - y) / scale))
            at = at & geometry.in_box(F.col("tilex"), F.col("tiley"), geometry.index_box(shape, tile_size))
            inside = geometry.burned(F.col("tilex") * tile_size + F.col("px"), F.col("tiley") * tile_size + F.col("py"), shape, all_touched)
            mask = inside if mask is None else mask & inside
            self.pixel_scale = (scale, scale) if acres else pixel_scale
        tables = {id(layer.tiles): layer.tiles.where(at) for layer in layers.values()}
        self.pixels = evaluate_pixels({n: replace(layer, tiles=tables[id(layer.tiles)]) for n, layer in layers.items()}, formula, tile_size)
        if mask is not None:
            self.pixels = self.pixels.where(mask)

    @staticmethod
    def _grouping(grouping, datatypes: list[str] | None, legends: DataFrame | None):
        if grouping == "auto":
            return grouping_of(datatypes or ["co"])
        if isinstance(grouping, int) or isinstance(grouping, str) and grouping.isdigit():
            found = legends.where(F.col("legend_id") == int(grouping)).select("json").first() if legends is not None else None
            if found is None:
                raise RasterAggregationException(f"There is no legend {grouping}.")
            return found[0]
        if isinstance(grouping, str) and grouping not in ("discrete", "continuous"):
            legend_classes(grouping)
        return grouping

    def value_count(self) -> DataFrame:
        if self.grouping == "discrete":
            counts = value_count(self.pixels)
        elif self.grouping == "continuous":
            counts = histogram(self.pixels, hist_range=self.hist_range)
        else:
            counts = legend_count(self.pixels, self.grouping)
        return in_acres(counts, *self.pixel_scale) if self.pixel_scale else counts

    def statistics(self) -> DataFrame:
        return statistics(self.pixels, self.hist_range)
