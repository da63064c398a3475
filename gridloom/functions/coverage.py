"""Polygons of a table against the pixels of a grid, by spans and by cells of mixed zooms.

Sides are opened to the rows that they cross, so the sides of one large polygon are
spread over tasks. A row's crossings, sorted, pair up to spans of covered pixels. The
same at the size of tiles and of their ancestors gives a cover of full and
partial cells: tiles in full cells count as a whole, and only tiles that a side
touches look at spans. Work grows with the length of outlines, not with areas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sides(polygons: DataFrame) -> DataFrame:
    """polygon_id, x1, y1, x2, y2 of every side of polygons (polygon_id, rings of structs x, y)."""
    ring = F.explode("rings").alias("ring")
    after = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    pairs = F.zip_with("ring", after, lambda a, b: F.struct(a["x"].cast("double").alias("x1"), a["y"].cast("double").alias("y1"), b["x"].cast("double").alias("x2"), b["y"].cast("double").alias("y2")))
    return polygons.select("polygon_id", ring).where(F.size("ring") > 0).select("polygon_id", F.inline(pairs))


def _scaled(edges: DataFrame, unit: Column) -> DataFrame:
    return edges.withColumns({c: F.col(c) / unit for c in ("x1", "y1", "x2", "y2")})


def _opened(edges: DataFrame, first: Column, last: Column, most: Column) -> DataFrame:
    """Edges beside each row of the grid from ``first`` to ``last``."""
    low, high = F.greatest(first, F.lit(0)).cast("int"), F.least(last, most - 1).cast("int")
    return edges.withColumns({"low": low, "high": high}).where("low <= high").withColumn("row", F.explode(F.sequence("low", "high"))).drop("low", "high")


def spans(edges: DataFrame, unit: Column, most: Column, keys: list[str]) -> DataFrame:
    """Runs (first, last) of cells of a row whose centres lie inside, for each of ``keys`` and row.

    Cells are ``unit`` wide; there are ``most`` on a side of the grid.
    """
    scaled = _scaled(edges, unit)
    rows = _opened(scaled, F.ceil(F.least("y1", "y2") - 0.5), F.ceil(F.greatest("y1", "y2") - 0.5) - 1, most)
    crossing = F.col("x1") + (F.col("row") + 0.5 - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    sorted_ = rows.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(crossing)).alias("at"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("at") / 2).cast("int") - 1), lambda k: F.struct(F.greatest(F.ceil(F.get("at", k * 2) - 0.5), F.lit(0)).cast("int").alias("first"), F.least(F.ceil(F.get("at", k * 2 + 1) - 0.5) - 1, F.lit(2**31 - 1)).cast("int").alias("last")))
    return sorted_.where(F.size("at") > 1).select(*keys, "row", F.inline(pairs)).where("first <= last")


def touched(edges: DataFrame, unit: Column, most: Column, keys: list[str]) -> DataFrame:
    """Runs (first, last) of cells of a row that a side touches, borders and corners among them; runs may overlap."""
    scaled = _scaled(edges, unit)
    rows = _opened(scaled, F.ceil(F.least("y1", "y2")) - 1, F.floor(F.greatest("y1", "y2")), most)
    level = F.col("y1") == F.col("y2")

    def at(y: Column) -> Column:
        """Where a side is at a height; null for a level one, which is everywhere between its ends."""
        place = F.col("x1") + (y - F.col("y1")) * ((F.col("x2") - F.col("x1")) / F.when(~level, F.col("y2") - F.col("y1")))
        return F.when(~level, F.least(F.greatest(place, F.least("x1", "x2")), F.greatest("x1", "x2")))

    upper, lower = at(F.greatest(F.least("y1", "y2"), F.col("row").cast("double"))), at(F.least(F.greatest("y1", "y2"), F.col("row") + 1.0))
    ends = [F.coalesce(upper, "x1"), F.coalesce(lower, "x2")]
    first, last = F.greatest(F.ceil(F.least(*ends)) - 1, F.lit(0)).cast("int"), F.least(F.floor(F.greatest(*ends)), most - 1).cast("int")
    return rows.select(*keys, "row", first.alias("first"), last.alias("last")).where("first <= last").distinct()


def cover(polygons: DataFrame, zoom: int, tile_size: int) -> DataFrame:
    """polygon_id, level, cx, cy, full: tiles of ``zoom`` that a side touches, and cells of any zoom that lie inside as a whole.

    A full cell is one that no side touches, with its centre inside, below a cell that a side touches.
    """
    keys = ["polygon_id", "level"]
    edges = sides(polygons).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(zoom))))
    side = F.pow(F.lit(2.0), F.col("level"))
    unit, most = F.lit(float(tile_size * 2**zoom)) / side, side.cast("int")
    runs = touched(edges, unit, most, keys)
    partial = runs.select(*keys, F.explode(F.sequence("first", "last")).alias("cx"), F.col("row").alias("cy")).distinct()
    child = lambda c, bit: (F.col(c) * 2 + bit).alias(c)
    below = partial.where(F.col("level") < zoom).withColumn("corner", F.explode(F.array(*[F.lit(k) for k in range(4)]))).select("polygon_id", (F.col("level") + 1).alias("level"), child("cx", F.col("corner") % 2), child("cy", (F.col("corner") / 2).cast("int")))
    roots = polygons.select("polygon_id", F.lit(0).alias("level"), F.lit(0).alias("cx"), F.lit(0).alias("cy"))
    apart = below.unionByName(roots).join(partial, [*keys, "cx", "cy"], "left_anti")
    inside = spans(edges, unit, most, keys).withColumnRenamed("row", "cy")
    full = apart.join(inside, [*keys, "cy"]).where(F.col("cx").between(F.col("first"), F.col("last"))).select(*keys, "cx", "cy", F.lit(True).alias("full"))
    return partial.where(F.col("level") == zoom).select(*keys, "cx", "cy", F.lit(False).alias("full")).unionByName(full)


def tiles_of_polygons(polygons: DataFrame, tiles: DataFrame, zoom: int, tile_size: int) -> DataFrame:
    """polygon_id, tilex, tiley, full of the tiles (tilex, tiley) of a zoom that a polygon meets.

    Each tile looks for itself and its ancestors among the cells, by equality.
    """
    level = F.explode(F.sequence(F.lit(0), F.lit(zoom))).alias("level")
    up = tiles.select("tilex", "tiley", level)
    up = up.select("tilex", "tiley", "level", F.expr(f"shiftright(tilex, {zoom} - level)").alias("cx"), F.expr(f"shiftright(tiley, {zoom} - level)").alias("cy"))
    return up.join(cover(polygons, zoom, tile_size), ["level", "cx", "cy"]).select("polygon_id", "tilex", "tiley", "full")


def pixel_runs(polygons: DataFrame, zoom: int, tile_size: int, all_touched: bool = False) -> DataFrame:
    """polygon_id, row, first, last: covered pixels of the grid of a zoom; with ``all_touched`` runs may overlap."""
    edges, most = sides(polygons), F.lit(tile_size * 2**zoom)
    inside = spans(edges, F.lit(1.0), most, ["polygon_id"]).withColumn("last", F.least("last", most - 1)).where("first <= last")
    return inside.unionByName(touched(edges, F.lit(1.0), most, ["polygon_id"])) if all_touched else inside


def covered_pixels(polygons: DataFrame, zoom: int, tile_size: int, all_touched: bool = False) -> DataFrame:
    """polygon_id, gx, gy of every pixel that a polygon covers: by its centre, or in any part."""
    opened = pixel_runs(polygons, zoom, tile_size, all_touched).select("polygon_id", F.explode(F.sequence("first", "last")).alias("gx"), F.col("row").alias("gy"))
    return opened.distinct() if all_touched else opened


def zonal_count(polygons: DataFrame, tiles: DataFrame, tile_size: int, zoom: int | None = None, all_touched: bool = False) -> DataFrame:
    """polygon_id, value, count of the pixels of each polygon; nodata does not count.

    Rings hold structs x, y in pixels of the tiles' zoom, by default the highest
    of ``tiles``. A pixel counts if its centre is inside, or with ``all_touched`` if any part of it
    is covered. Values of a tile are counted once for all polygons that hold it as a whole.
    """
    at = zoom if zoom is not None else tiles.agg(F.max("tilez")).first()[0] or 0
    own = tiles.where(F.col("tilez") == at).select("tilex", "tiley", "data")
    shapes = polygons.select("polygon_id", "rings")
    met = tiles_of_polygons(shapes, own, at, tile_size)
    counts = own.select("tilex", "tiley", F.explode("data").alias("value")).where("value is not null").groupBy("tilex", "tiley", "value").agg(F.count("*").alias("n"))
    whole = counts.join(met.where("full"), ["tilex", "tiley"]).select("polygon_id", "value", "n")
    row_of_tiles = F.floor(F.col("row") / tile_size).cast("int")
    rows = pixel_runs(shapes, at, tile_size, all_touched).groupBy("polygon_id", row_of_tiles.alias("tiley"), "row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    part = met.where(~F.col("full")).join(rows, ["polygon_id", "tiley"])
    left, right = F.col("tilex") * tile_size, F.col("tilex") * tile_size + (tile_size - 1)
    clipped = F.filter(F.transform("runs", lambda r: F.struct(F.greatest(r["first"], left).alias("first"), F.least(r["last"], right).alias("last"))), lambda r: r["first"] <= r["last"])
    places = F.flatten(F.transform(clipped, lambda r: F.sequence(r["first"], r["last"])))
    places = F.array_distinct(places) if all_touched else places
    cells = part.select("polygon_id", "tilex", "tiley", (F.col("row") % tile_size).alias("py"), places.alias("places")).where(F.size("places") > 0)
    wanted = cells.groupBy("tilex", "tiley", "polygon_id").agg(F.flatten(F.collect_list(F.transform("places", lambda gx: F.col("py") * tile_size + gx % tile_size))).alias("at"))
    # A tile's array moves once for each polygon whose outline it meets, and gives only the places asked for.
    picked = wanted.join(own, ["tilex", "tiley"]).select("polygon_id", F.explode(F.transform("at", lambda p: F.get("data", p))).alias("value")).where("value is not null")
    edge = picked.groupBy("polygon_id", "value").agg(F.count("*").alias("n"))
    return whole.unionByName(edge).groupBy("polygon_id", "value").agg(F.sum("n").alias("count"))
