"""Raster queries over layers derived from the driver's tables, with their SQL.

The grid layer is 64 x 64 pixels at zoom 2 in tiles of 16 pixels: ``cnt``
(categorical, nodata 0) and ``qty`` (continuous, nodata -1) count and sum line
items by part and order key. Points come from events, array tiles from
embeddings.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import colors, coverage, geometry, projection, tilemath
from gridloom.operators import aggregate, catalog, focal, layers, pyramid
from gridloom.operators.algebra import evaluate_pixels, evaluate_tiles
from gridloom.operators.layers import TILE, Layer
from gridloom.sources import images, ingest, source, tilestore, windows

TS, ZOOM, SIDE = 16, 2, 64
BOX: geometry.Ring = [(8, 8), (24, 8), (24, 40), (8, 40)]
TRIANGLE: geometry.Ring = [(4.3, 5.2), (50.7, 10.4), (20.1, 58.9)]
TINY: geometry.Ring = [(3.1, 3.1), (3.4, 3.1), (3.4, 3.4), (3.1, 3.4)]
OUTSIDE: geometry.Ring = [(90, 90), (95, 90), (95, 95), (90, 95)]
LEGEND = [{"name": "two", "expression": "2"}, {"name": "mid", "expression": "(x >= 2) & (x < 5)"}, {"name": "none", "expression": "10"}]
OVERLAP = [{"name": "over1", "expression": "x > 1"}, {"name": "over3", "expression": "x > 3"}]
COLORMAP = {"2": colors.hex_to_rgba("#123456"), "(x >= 3) & (x < 6)": colors.hex_to_rgba("654321"), "5": (9, 8, 7, 100)}
PIXEL_AREA = tilemath.tile_scale(ZOOM, TS)

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(function: Query) -> Query:
        _queries[name or function.__name__] = function
        if sql:
            _sql[name or function.__name__] = sql
        return function

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gx, gy, cnt, qty and their tile and place."""
    counted = read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % SIDE).cast("int").alias("gx"), (F.col("l_orderkey") % SIDE).cast("int").alias("gy")).agg(
        (F.count("*") % 7).cast("double").alias("cnt"), F.sum("l_quantity").cast("double").alias("qty"))
    tile = lambda c: F.floor(F.col(c) / TS).cast("int")
    return counted.select(F.lit(ZOOM).alias("tilez"), tile("gx").alias("tilex"), tile("gy").alias("tiley"), (F.col("gx") % TS).alias("px"), (F.col("gy") % TS).alias("py"), "gx", "gy", "cnt", "qty")


def layer(spark: SparkSession, sf_dir: str, value: str, nodata: float | None) -> Layer:
    return Layer(layers.tiles_from_pixels(grid(spark, sf_dir), TS, TILE, value), nodata)


def cnt_qty(spark: SparkSession, sf_dir: str) -> dict[str, Layer]:
    tiles = layers.bands_from_pixels(grid(spark, sf_dir), TS, {"cnt": "cnt", "qty": "qty"})
    return {"a": Layer(tiles, 0.0, "cnt"), "q": Layer(tiles, -1.0, "qty")}


def placed(pixels: DataFrame, *more: str) -> DataFrame:
    return pixels.select((F.col("tilex") * TS + F.col("px")).cast("int").alias("gx"), (F.col("tiley") * TS + F.col("py")).cast("int").alias("gy"), F.round("value", 6).alias("value"), *more)


PIX = f"""
WITH cells AS (SELECT CAST(l_partkey % {SIDE} AS INT) AS gx, CAST(l_orderkey % {SIDE} AS INT) AS gy, CAST(count(*) % 7 AS DOUBLE) AS cnt, CAST(sum(l_quantity) AS DOUBLE) AS qty
  FROM lineitem GROUP BY 1, 2),
held AS (SELECT DISTINCT gx // {TS} AS tilex, gy // {TS} AS tiley FROM cells),
pix AS (SELECT CAST(tilex * {TS} + x.range AS INT) AS gx, CAST(tiley * {TS} + y.range AS INT) AS gy, CAST(tilex AS INT) AS tilex, CAST(tiley AS INT) AS tiley,
    CASE WHEN abs(cnt) > 1e-8 THEN cnt END AS a, qty AS q, cnt AS raw
  FROM held, range({TS}) x, range({TS}) y LEFT JOIN cells c ON c.gx = tilex * {TS} + x.range AND c.gy = tiley * {TS} + y.range)
"""


def remasked(expression: str, nodata: float | None, source: str = "pix") -> str:
    value = f"CAST({expression} AS DOUBLE)"
    if nodata is not None:
        value = f"CASE WHEN abs(v - {nodata}) > {1e-8 + 1e-5 * abs(nodata)} OR isnan(v) THEN v END"
        return f"{PIX} SELECT gx, gy, round({value}, 6) AS value FROM (SELECT *, CAST({expression} AS DOUBLE) AS v FROM {source})"
    return f"{PIX} SELECT gx, gy, round({value}, 6) AS value FROM {source}"


def strict(expression: str) -> str:
    return f"CASE WHEN a IS NULL OR q IS NULL THEN NULL ELSE CAST({expression} AS DOUBLE) END"


#: Formula, the same in SQL over pix, and the number that its result is masked with again.
ALGEBRA = {
    "algebra_arith": ("a * 2 + q / 4 - 1", "a * 2 + q / 4 - 1", 0.0),
    "algebra_precedence": ("a + q > 100", "a + CAST(q > 100 AS DOUBLE)", 0.0),
    "algebra_power": ("2 ^ a ^ 0.5 + -a ^ 2", "pow(2, pow(a, 0.5)) + pow(-a, 2)", 0.0),
    "algebra_compare_logic": ("(a > 2) & (q < 300) | (a == 1)", strict("((a > 2) AND (q < 300)) OR (a = 1)"), 0.0),
    "algebra_null_strict": ("(q > 0) | (a > 3)", strict("(q > 0) OR (a > 3)"), -1.0),
    "algebra_null_test": ("q * (a != NULL) + 99 * (a == NULL)", "q * CAST(a IS NOT NULL AS DOUBLE) + 99 * CAST(a IS NULL AS DOUBLE)", -1.0),
    "algebra_fill": ("~a + q", "coalesce(a, 0) + q", -1.0),
    "algebra_unary_plus": ("+a * 3 - q", "coalesce(a, 0) * 3 - q", -1.0),
    "algebra_log_div_domain": ("log(a - 3) + q / (a - 4)", "CASE WHEN a > 3 THEN ln(CASE WHEN a > 3 THEN a - 3 END) END + CASE WHEN a <> 4 THEN q / (CASE WHEN a <> 4 THEN a - 4 END) END", 0.0),
    "algebra_round_int_sign": ("round(q / 2) + int(q / 3) * sign(a - 3)", "round_even(q / 2, 0) + trunc(q / 3) * sign(a - 3)", -1.0),
    "algebra_trig": ("sin(a) + cos(q) * tan(a) + exp(a / 10) + abs(-a)", "sin(a) + cos(q) * tan(a) + exp(a / 10) + abs(-a)", 0.0),
    "algebra_bool_plus": ("((a > 1) + (a > 3)) * q", "CAST((a > 1) OR (a > 3) AS DOUBLE) * q", 0.0),
    "algebra_not": ("!(a > 2) * q", "CAST(NOT (a > 2) AS DOUBLE) * q", 0.0),
    "algebra_remask": ("a > 2", "CAST(a > 2 AS DOUBLE)", 0.0),
    "algebra_constants": ("PI * a + E - TRUE * q", "pi() * a + exp(1.0) - q", 0.0),
    "algebra_inf": ("(q < INF) + a / 2", "CAST(q IS NOT NULL AS DOUBLE) * CASE WHEN q IS NULL THEN NULL ELSE 1 END + a / 2", -1.0),
}

for _name, (_formula, _expression, _nodata) in ALGEBRA.items():
    query(remasked(_expression, _nodata), _name)(lambda spark, sf_dir, f=_formula: placed(evaluate_pixels(cnt_qty(spark, sf_dir), f, TS)))
    query(remasked(_expression, _nodata), _name.replace("algebra_", "algebra_tiles_"))(
        lambda spark, sf_dir, f=_formula: placed(layers.pixels_from_tiles(evaluate_tiles(cnt_qty(spark, sf_dir), f), TS)))


@query(remasked("a + a", 0.0))
def algebra_same_layer_twice(spark, sf_dir):
    one = layer(spark, sf_dir, "cnt", 0.0)
    return placed(evaluate_pixels({"x": one, "y": one}, "x + y", TS))


@query(remasked("CASE WHEN abs(raw - 3) > 3.001e-5 THEN raw END * 2", 3.0))
def algebra_nodata_three(spark, sf_dir):
    return placed(evaluate_pixels({"x": layer(spark, sf_dir, "cnt", 3.0)}, "x * 2", TS))


@query(f"{PIX} SELECT gx, gy, round(CASE WHEN raw - 2 = 0 THEN CASE WHEN q = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END ELSE q / (CASE WHEN raw = 2 THEN 1 ELSE raw - 2 END) END, 6) AS value FROM pix WHERE raw IS NOT NULL")
def algebra_plain_division(spark, sf_dir):
    rows = evaluate_pixels({"x": layer(spark, sf_dir, "cnt", None), "q": layer(spark, sf_dir, "qty", None)}, "q / (x - 2)", TS)
    return placed(rows.where(F.col("value").isNotNull()))


@query(f"{PIX} SELECT gx, gy, round(v, 6) AS value FROM (SELECT *, q % 50 + raw AS v FROM pix)")
def algebra_band_select(spark, sf_dir):
    rows = grid(spark, sf_dir)
    both = layers.tiles_from_pixels(rows.withColumn("v", F.col("qty") % 50), TS, TILE, "v").select(F.lit(2).alias("layer_id"), F.lit(1).alias("band"), *TILE, "data").unionByName(
        layers.tiles_from_pixels(rows, TS, TILE, "cnt").select(F.lit(1).alias("layer_id"), F.lit(0).alias("band"), *TILE, "data"))
    return placed(evaluate_pixels(layers.bind(both, "x=1,y:1=2", {}), "x + y", TS))


_TILE_STATS = f"""{PIX} SELECT gx, gy, round(CASE WHEN abs(v) > 1e-8 THEN v END, 6) AS value FROM (SELECT *,
  a / max(a) OVER t + min(q) OVER t + avg(q) OVER t - median(q) OVER t + stddev_pop(q) OVER t + sum(a) OVER t AS v FROM pix WINDOW t AS (PARTITION BY tilex, tiley))"""


@query(_TILE_STATS)
def algebra_tile_aggregates(spark, sf_dir):
    return placed(evaluate_pixels(cnt_qty(spark, sf_dir), "a / max(a) + min(q) + mean(q) - median(q) + std(q) + sum(a)", TS))


@query(_TILE_STATS)
def algebra_tiles_aggregates(spark, sf_dir):
    return placed(layers.pixels_from_tiles(evaluate_tiles(cnt_qty(spark, sf_dir), "a / max(a) + min(q) + mean(q) - median(q) + std(q) + sum(a)"), TS))


@query(f"{PIX} SELECT gx, gy, round(avg(a) OVER (PARTITION BY tilex, tiley), 6) AS value FROM pix")
def algebra_scalar_formula(spark, sf_dir):
    return placed(layers.pixels_from_tiles(evaluate_tiles({"a": layer(spark, sf_dir, "cnt", 0.0)}, "mean(a)"), TS))


@query("""SELECT vec_id, round(list_max(e) - list_min(e), 6) AS spread, round(list_avg(e), 6) AS mean, round(list_stddev_pop(e), 6) AS std, round(list_median(e), 6) AS median
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)""")
def array_tile_statistics(spark, sf_dir):
    """Embeddings as tiles of 8 x 8 pixels."""
    from gridloom.plans.formula import Value, compile_arrays

    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    value = lambda f: F.round(F.element_at(compile_arrays(f, {"x": Value(F.col("x"))})[0], 1), 6)
    return rows.select("vec_id", value("max(x) - min(x)").alias("spread"), value("mean(x)").alias("mean"), value("std(x)").alias("std"), value("median(x)").alias("median"))


def a_pixels(spark, sf_dir, formula: str = "a") -> DataFrame:
    return evaluate_pixels(cnt_qty(spark, sf_dir), formula, TS)


@query(f'{PIX} SELECT a AS value, count(*) AS "count" FROM pix WHERE a IS NOT NULL GROUP BY a')
def value_count_discrete(spark, sf_dir):
    return aggregate.Aggregator({"a": layer(spark, sf_dir, "cnt", 0.0)}, "a", TS, ["ca"], zoom=ZOOM).value_count()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.Aggregator({"a": layer(spark, sf_dir, "cnt", 0.0)}, "a * (a > 2)", TS, grouping="discrete", zoom=ZOOM).value_count()


@query(f'{PIX} SELECT v AS value, count(*) AS "count" FROM (SELECT a * CAST(a > 2 AS DOUBLE) AS v FROM pix) WHERE abs(v) > 1e-8 GROUP BY v')
def value_count_formula(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(f'{PIX} SELECT a * q AS value, count(*) AS "count" FROM pix WHERE abs(a * q) > 1e-8 GROUP BY 1')
def value_count_two_layers(spark, sf_dir):
    return aggregate.value_count(a_pixels(spark, sf_dir, "a * q"))


def _histogram_sql(value: str, low: str, high: str, bins: int = 10, extra: str = "") -> str:
    return f"""{PIX}, v AS (SELECT {value} AS v FROM pix WHERE {value} IS NOT NULL), r AS (SELECT {low} AS lo, {high} AS hi),
e AS (SELECT CAST(b.range AS INT) AS bin, lo + (hi - lo) / {bins} * b.range AS low, CASE WHEN b.range = {bins - 1} THEN hi ELSE lo + (hi - lo) / {bins} * (b.range + 1) END AS high FROM r, range({bins}) b)
SELECT bin, low, high, (SELECT count(*) FROM v WHERE v >= low AND (v < high OR bin = {bins - 1} AND v = high)) AS "count" FROM e{extra}"""


@query(_histogram_sql("q", "(SELECT min(q) FROM pix)", "(SELECT max(q) FROM pix)"))
def value_count_continuous(spark, sf_dir):
    return aggregate.Aggregator({"q": layer(spark, sf_dir, "qty", -1.0)}, "q", TS, ["co"], zoom=ZOOM).value_count()


@query(_histogram_sql("q", "100.0::DOUBLE", "400.0::DOUBLE"))
def value_count_hist_range(spark, sf_dir):
    return aggregate.Aggregator({"q": layer(spark, sf_dir, "qty", -1.0)}, "q", TS, grouping="continuous", hist_range=(100.0, 400.0), zoom=ZOOM).value_count()


def _legend_sql(entries: list[tuple[str, str]]) -> str:
    return PIX + " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) FILTER ({condition}) AS \"count\" FROM pix WHERE a IS NOT NULL" for name, condition in entries)


@query(_legend_sql([("two", "a = 2"), ("mid", "a >= 2 AND a < 5"), ("none", "a = 10")]))
def value_count_legend(spark, sf_dir):
    return aggregate.Aggregator({"a": layer(spark, sf_dir, "cnt", 0.0)}, "a", TS, grouping=LEGEND, zoom=ZOOM).value_count()


@query(_legend_sql([("over1", "a > 1"), ("over3", "a > 3")]))
def value_count_legend_overlap(spark, sf_dir):
    return aggregate.Aggregator({"a": layer(spark, sf_dir, "cnt", 0.0)}, "a", TS, grouping=json.dumps(OVERLAP), zoom=ZOOM).value_count()


def global_xy() -> tuple[Column, Column]:
    return F.col("tilex") * TS + F.col("px"), F.col("tiley") * TS + F.col("py")


def _d(number: float) -> str:
    """A number as a double in SQL."""
    return f"({float(number)!r}::DOUBLE)"


def _inside(ring: geometry.Ring, x: str = "gx + 0.5", y: str = "gy + 0.5") -> str:
    sides = zip(ring, ring[1:] + ring[:1], strict=True)
    return "(" + " + ".join(f"CAST(({_d(y1)} > {y}) <> ({_d(y2)} > {y}) AND {x} < {_d(x1)} + ({y} - {_d(y1)}) * {_d((x2 - x1) / (y2 - y1))} AS INT)" for (x1, y1), (x2, y2) in sides if y1 != y2) + ") % 2 = 1"


def clipped(spark, sf_dir, ring: geometry.Ring, grouping: str = "discrete", acres: bool = False) -> DataFrame:
    one = layer(spark, sf_dir, "cnt", 0.0)
    near = Layer(one.tiles.where(geometry.in_box(F.col("tilex"), F.col("tiley"), geometry.index_box(ring, TS))), one.nodata)
    return aggregate.Aggregator({"a": near}, "a", TS, grouping=grouping, mask=geometry.burned(*global_xy(), ring), pixel_scale=(PIXEL_AREA, PIXEL_AREA) if acres else None, zoom=ZOOM).value_count()


for _ring_name, _ring in (("box", BOX), ("triangle", TRIANGLE), ("tiny", TINY), ("outside", OUTSIDE)):
    query(f'{PIX} SELECT a AS value, count(*) AS "count" FROM pix WHERE a IS NOT NULL AND {_inside(_ring)} GROUP BY a', f"value_count_clipped_{_ring_name}")(lambda spark, sf_dir, r=_ring: clipped(spark, sf_dir, r))


@query(f'{PIX} SELECT a AS value, round(count(*) * {abs(PIXEL_AREA * PIXEL_AREA) * aggregate.ACRES!r}::DOUBLE, 3) AS "count" FROM pix WHERE a IS NOT NULL AND {_inside(TRIANGLE)} GROUP BY a')
def value_count_acres(spark, sf_dir):
    return clipped(spark, sf_dir, TRIANGLE, acres=True).withColumn("count", F.round("count", 3))


_STATS = "min(q) AS min, max(q) AS max, round(avg(q), 6) AS mean, round(stddev_pop(q), 4) AS std, count(q) AS t0, sum(q) AS t1, sum(q * q) AS t2"


@query(f"{PIX} SELECT {_STATS} FROM pix")
def layer_statistics(spark, sf_dir):
    return aggregate.statistics(evaluate_pixels({"q": layer(spark, sf_dir, "qty", -1.0)}, "q", TS)).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 4)})


@query(f"{PIX} SELECT {_STATS} FROM pix WHERE q BETWEEN 100 AND 400")
def layer_statistics_range(spark, sf_dir):
    return aggregate.statistics(evaluate_pixels({"q": layer(spark, sf_dir, "qty", -1.0)}, "q", TS), (100.0, 400.0)).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 4)})


@query(f"{PIX} SELECT round(sum(q) / count(q), 6) AS mean, round(stddev_pop(q), 4) AS std, count(q) AS t0 FROM pix")
def statistics_of_parts(spark, sf_dir):
    """Moments of single tiles, added up."""
    value = F.col("value")
    parts = evaluate_pixels({"q": layer(spark, sf_dir, "qty", -1.0)}, "q", TS).groupBy(*TILE).agg(F.count("value").alias("t0"), F.sum("value").alias("t1"), F.sum(value * value).alias("t2"))
    return aggregate.moments(parts.agg(*[F.sum(t).alias(t) for t in ("t0", "t1", "t2")])).select(F.round("mean", 6).alias("mean"), F.round("std", 4).alias("std"), "t0")


@query(f'{PIX} SELECT a AS value, count(*) AS "count" FROM pix WHERE a IS NOT NULL AND (tilex + tiley) % 2 = 0 GROUP BY a')
def tile_join_missing(spark, sf_dir):
    """Tiles that one of the layers lacks drop out."""
    both = cnt_qty(spark, sf_dir)
    half = Layer(both["q"].tiles.where((F.col("tilex") + F.col("tiley")) % 2 == 0), -1.0, "qty")
    return aggregate.value_count(evaluate_pixels({"a": both["a"], "q": half}, "a + 0 * q", TS))


@query(f"""{PIX} SELECT CAST(t.x.range AS INT) AS tilex, CAST(t.y.range AS INT) AS tiley, round(coalesce(s, 0), 6) AS total FROM (SELECT x, y FROM range(5) x, range(4) y) t
  LEFT JOIN (SELECT tilex, tiley, sum(q) AS s FROM pix GROUP BY 1, 2) p ON p.tilex = t.x.range AND p.tiley = t.y.range""".replace("t.x.range", "t.x").replace("t.y.range", "t.y").replace("SELECT x, y FROM range(5) x, range(4) y", "SELECT x.range AS x, y.range AS y FROM range(5) x, range(4) y"))
def tile_default(spark, sf_dir):
    """A requested tile that does not exist is empty."""
    asked = spark.range(20).select(F.lit(ZOOM).alias("tilez"), (F.col("id") % 5).cast("int").alias("tilex"), F.floor(F.col("id") / 5).cast("int").alias("tiley"))
    got = layers.with_default(asked, layer(spark, sf_dir, "qty", None).tiles, TS, 0.0)
    return got.select("tilex", "tiley", F.round(F.aggregate("data", F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))), 6).alias("total"))


def _requests(spark) -> DataFrame:
    return spark.range(64).select(F.lit(3).alias("tilez"), (F.col("id") % 8).cast("int").alias("tilex"), F.floor(F.col("id") / 8).cast("int").alias("tiley"))


def _sparse(spark, sf_dir) -> DataFrame:
    """Tiles at zoom 2 but for those with an odd sum of indexes, and one at zoom 0."""
    tiles = layer(spark, sf_dir, "qty", None).tiles
    root = tiles.where("tilex = 0 and tiley = 0").withColumn("tilez", F.lit(0))
    return tiles.where("(tilex + tiley) % 2 = 0").unionByName(root)


_ASKED = """asked AS (SELECT CAST(i.range % 8 AS INT) AS x, CAST(i.range // 8 AS INT) AS y FROM range(64) i),
there AS (SELECT x, y, EXISTS (SELECT 1 FROM pix WHERE tilex = x // 2 AND tiley = y // 2 AND (tilex + tiley) % 2 = 0) AS own FROM asked)"""


@query(f"{PIX}, {_ASKED} SELECT 3 AS tilez, x AS tilex, y AS tiley, CASE WHEN own THEN 2 ELSE 0 END AS foundz FROM there")
def tile_ancestor_lookup(spark, sf_dir):
    return layers.ancestors(_requests(spark), _sparse(spark, sf_dir)).drop("data")


@query(f"""{PIX}, {_ASKED} SELECT x AS tilex, y AS tiley, CAST(px.range AS INT) AS px, CAST(py.range AS INT) AS py,
  CASE WHEN own THEN (SELECT q FROM pix WHERE gx = (x * {TS} + px.range) // 2 AND gy = (y * {TS} + py.range) // 2)
       ELSE (SELECT q FROM pix WHERE gx = (x * {TS} + px.range) // 8 AND gy = (y * {TS} + py.range) // 8) END AS value FROM there, range({TS}) px, range({TS}) py""")
def overzoom_resample(spark, sf_dir):
    rows = layers.pixels_from_tiles(layers.overzoom(layers.ancestors(_requests(spark), _sparse(spark, sf_dir)), TS), TS)
    return rows.select("tilex", "tiley", F.col("px").cast("int").alias("px"), "py", "value")


def points(spark, sf_dir) -> DataFrame:
    lon, lat = (F.col("event_id") * 37 % 3600) / 10.0 - 180, (F.col("event_id") * 53 % 1700) / 10.0 - 85
    rows = read(spark, sf_dir, "events").select("event_id", lon.alias("lon"), lat.alias("lat"))
    x, y = tilemath.mercator(F.col("lon"), F.col("lat"))
    return rows.select("event_id", "lon", "lat", x.alias("x"), y.alias("y"))


_POINTS = f"""pts AS (SELECT event_id, lon, lat, lon * {tilemath.HALF / 180!r} AS x, ln(tan({math.pi / 4!r} + lat * {math.pi / 360!r})) * {tilemath.RADIUS!r} AS y
  FROM (SELECT event_id, (event_id * 37 % 3600) / 10.0::DOUBLE - 180 AS lon, (event_id * 53 % 1700) / 10.0::DOUBLE - 85 AS lat FROM events))"""
_SIZE = tilemath.WORLD / 2.0**ZOOM


@query(f"{PIX}, {_POINTS}, g AS (SELECT event_id, least(CAST(trunc((x + {tilemath.HALF!r}) / {_SIZE / TS!r}) AS INT), {SIDE - 1}) AS gx, least(CAST(trunc(({tilemath.HALF!r} - y) / {_SIZE / TS!r}) AS INT), {SIDE - 1}) AS gy FROM pts) SELECT event_id, q AS value FROM g LEFT JOIN pix ON pix.gx = g.gx AND pix.gy = g.gy")
def pixel_lookup(spark, sf_dir):
    return layers.pixel_lookup(points(spark, sf_dir), layer(spark, sf_dir, "qty", None).tiles, ZOOM, TS).select("event_id", "value")


@query(f"WITH {_POINTS} SELECT event_id, CAST(trunc((x + {tilemath.HALF!r}) / {_SIZE!r}) AS INT) AS tilex, CAST(trunc(({tilemath.HALF!r} - y) / {_SIZE!r}) AS INT) AS tiley FROM pts")
def tile_index(spark, sf_dir):
    x, y = tilemath.tile_index(F.col("x"), F.col("y"), F.lit(ZOOM))
    return points(spark, sf_dir).select("event_id", x.alias("tilex"), y.alias("tiley"))


@query(f"WITH {_POINTS} SELECT event_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM pts")
def degrees_round_trip(spark, sf_dir):
    lon, lat = tilemath.degrees(F.col("x"), F.col("y"))
    return points(spark, sf_dir).select("event_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(f"""{PIX} SELECT tilex, tiley, round(tilex * {_d(_SIZE)} - {_d(tilemath.HALF)}, 3) AS xmin, round({_d(tilemath.HALF)} - (tiley + 1) * {_d(_SIZE)}, 3) AS ymin,
  round((tilex + 1) * {_d(_SIZE)} - {_d(tilemath.HALF)}, 3) AS xmax, round({_d(tilemath.HALF)} - tiley * {_d(_SIZE)}, 3) AS ymax FROM (SELECT DISTINCT tilex, tiley FROM pix)""")
def tile_bounds(spark, sf_dir):
    rows = layer(spark, sf_dir, "cnt", 0.0).tiles
    box = rows.select("tilex", "tiley", *tilemath.tile_bounds(F.col("tilex"), F.col("tiley"), F.col("tilez")))
    return box.select("tilex", "tiley", *[F.round(c, 3).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


#: Scales on, above and below the pixel sizes of the zooms from 0 to 20, and others.
_SCALE = "CASE WHEN p_partkey % 4 = 3 THEN CAST(p_partkey % 4000 + 1 AS DOUBLE) ELSE {world} / pow(2.0, p_partkey % 21) / 256 * CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.001 ELSE 0.999 END END"


@query(f"""WITH sizes AS (SELECT i.range AS i, {_d(tilemath.WORLD)} / pow(2.0, i.range + 1) / 256 AS size FROM range(18) i),
scales AS (SELECT p_partkey, {_SCALE.format(world=_d(tilemath.WORLD))} AS scale FROM part), found AS (SELECT p_partkey, coalesce((SELECT min(i) FROM sizes WHERE scale - size >= 0), 18) AS zoom FROM scales)
SELECT p_partkey, CAST(zoom + 1 AS INT) AS zoom, CAST(zoom AS INT) AS lower FROM found""")
def closest_zoomlevel(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.expr(_SCALE.format(world=f"{tilemath.WORLD!r}D")).alias("scale"))
    return rows.select("p_partkey", tilemath.closest_zoom(F.col("scale")).alias("zoom"), tilemath.closest_zoom(F.col("scale"), False).alias("lower"))


@query(f'{PIX} SELECT CAST(tilex // 3 AS INT) AS qx, CAST(tiley // 3 AS INT) AS qy, count(*) AS "count" FROM (SELECT DISTINCT tilex, tiley FROM pix) GROUP BY 1, 2')
def quadrants(spark, sf_dir):
    qx, qy = tilemath.quadrant_key(F.col("tilex"), F.col("tiley"), 3)
    return layer(spark, sf_dir, "cnt", 0.0).tiles.groupBy(qx.alias("qx"), qy.alias("qy")).agg(F.count("*").alias("count"))


def source_grid(spark, sf_dir, value: str) -> DataFrame:
    return grid(spark, sf_dir).select("gx", "gy", F.col(value).alias("value"))


_LEVELS = """, lv AS (SELECT CAST(z.range AS INT) AS z, CAST(pow(2, 2 - z.range) AS INT) AS r FROM range(3) z),
px AS (SELECT z AS tilez, CAST(gx // r AS INT) AS x, CAST(gy // r AS INT) AS y, a AS value FROM pix, lv WHERE gx % r = r // 2 AND gy % r = r // 2)"""


@query(f'{PIX}{_LEVELS} SELECT tilez, count(*) AS tiles FROM (SELECT DISTINCT tilez, x // {TS}, y // {TS} FROM px WHERE value IS NOT NULL) GROUP BY 1')
def pyramid_counts(spark, sf_dir):
    return pyramid.create_tiles(source_grid(spark, sf_dir, "cnt"), ZOOM, TS, 0.0).groupBy("tilez").agg(F.count("*").alias("tiles"))


@query(f"{PIX}{_LEVELS} SELECT tilez, x, y, value FROM px WHERE value IS NOT NULL")
def pyramid_pixels(spark, sf_dir):
    rows = layers.pixels_from_tiles(pyramid.create_tiles(source_grid(spark, sf_dir, "cnt"), ZOOM, TS, 0.0), TS).where("value is not null")
    return rows.select("tilez", (F.col("tilex") * TS + F.col("px")).cast("int").alias("x"), (F.col("tiley") * TS + F.col("py")).cast("int").alias("y"), "value")


@query(f"{PIX} SELECT tilex, tiley FROM pix WHERE q > 180 AND tilex <> 1 GROUP BY 1, 2")
def drop_empty_tiles(spark, sf_dir):
    keep = F.when((F.col("qty") > 180) & (F.col("tilex") != 1), F.col("qty"))
    return layers.drop_empty(layers.tiles_from_pixels(grid(spark, sf_dir).withColumn("v", keep), TS, TILE, "v")).select("tilex", "tiley")


@query(f"{PIX} SELECT CAST(b.range AS INT) AS band, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT b, CASE WHEN b.range = 0 THEN q ELSE q % 50 END AS v FROM pix, range(2) b) GROUP BY 1".replace("SELECT b, CASE", "SELECT b.range AS b, CASE").replace("CAST(b.range AS INT) AS band, min", "CAST(b AS INT) AS band, min"))
def band_metadata(spark, sf_dir):
    rows = grid(spark, sf_dir)
    bands = rows.select(F.lit(2).alias("layer_id"), F.posexplode(F.array("qty", F.col("qty") % 50)).alias("band", "value"))
    return pyramid.band_metadata(bands).select("band", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(_histogram_sql("q", "(SELECT floor(min(q)) FROM pix)", "(SELECT ceil(max(q)) FROM pix)", 100))
def band_histogram_100(spark, sf_dir):
    one = pyramid.band_histogram(source_grid(spark, sf_dir, "qty"))
    rows = one.select(F.posexplode("hist_values").alias("bin", "count"), "hist_bins")
    return rows.select("bin", F.element_at("hist_bins", F.col("bin") + 1).alias("low"), F.element_at("hist_bins", F.col("bin") + 2).alias("high"), "count")


def _pixels(spark, sf_dir) -> DataFrame:
    """gx, gy of all pixels of the grid layer's tiles."""
    return placed(layers.pixels_from_tiles(layer(spark, sf_dir, "cnt", None).tiles, TS)).select("gx", "gy")


_FULL = f"{PIX}, f AS (SELECT gx, gy FROM pix)"


def _touched(ring: geometry.Ring) -> str:
    def side(a, b) -> str:
        (x1, y1), (x2, y2) = a, b
        turn = lambda cx, cy: f"(({cy}) - {_d(y1)}) * {_d(x2 - x1)} - (({cx}) - {_d(x1)}) * {_d(y2 - y1)}"
        turns = ", ".join(turn(cx, cy) for cx in ("gx", "gx + 1") for cy in ("gy", "gy + 1"))
        return f"(gx <= {max(x1, x2)} AND gx + 1 >= {min(x1, x2)} AND gy <= {max(y1, y2)} AND gy + 1 >= {min(y1, y2)} AND least({turns}) <= 0 AND greatest({turns}) >= 0)"

    return f"({_inside(ring)} OR " + " OR ".join(side(a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) + ")"


for _ring_name, _ring in (("box", BOX), ("polygon", TRIANGLE), ("tiny", TINY)):
    query(f"{_FULL} SELECT gx, gy, CASE WHEN {_inside(_ring)} THEN 99.0::DOUBLE ELSE 0 END AS value FROM f", f"rasterize_{_ring_name}")(
        lambda spark, sf_dir, r=_ring: _pixels(spark, sf_dir).select("gx", "gy", geometry.rasterize(F.col("gx"), F.col("gy"), r, 99).alias("value")))
    query(f"{_FULL} SELECT gx, gy, CASE WHEN {_touched(_ring)} THEN 1.0::DOUBLE ELSE 0 END AS value FROM f", f"rasterize_all_touched_{_ring_name}")(
        lambda spark, sf_dir, r=_ring: _pixels(spark, sf_dir).select("gx", "gy", geometry.rasterize(F.col("gx"), F.col("gy"), r, 1, all_touched=True).alias("value")))


@query(f"{_FULL} SELECT gx, gy, gx + CASE WHEN {_inside(TRIANGLE)} THEN 2.0::DOUBLE ELSE 0 END AS value FROM f")
def rasterize_add(spark, sf_dir):
    return _pixels(spark, sf_dir).select("gx", "gy", geometry.rasterize(F.col("gx"), F.col("gy"), TRIANGLE, 2, add_to=F.col("gx").cast("double")).alias("value"))


@query(f"{PIX} SELECT CAST(x.range AS INT) AS gx, CAST(y.range AS INT) AS gy, coalesce(q, 0) AS value FROM range(16, 96) x, range(16, 48) y LEFT JOIN pix ON gx = x.range AND gy = y.range")
def mosaic_export(spark, sf_dir):
    return pyramid.mosaic(layer(spark, sf_dir, "qty", None).tiles, (1, 1, 5, 2), ZOOM, TS)


_COLORS = ", ".join(f"CASE WHEN a = 5 THEN {COLORMAP['5'][k]} WHEN a >= 3 AND a < 6 THEN {COLORMAP['(x >= 3) & (x < 6)'][k]} WHEN a = 2 THEN {COLORMAP['2'][k]} ELSE 0 END AS {n}" for k, n in enumerate("rgba"))


@query(f"{PIX} SELECT gx, gy, {_COLORS} FROM pix".replace("AS a FROM", "AS alpha FROM"))
def colormap_discrete(spark, sf_dir):
    r, g, b, a = colors.discrete(F.col("_v"), COLORMAP)
    rows = placed(a_pixels(spark, sf_dir)).withColumnRenamed("value", "_v")
    return rows.select("gx", "gy", r, g, b, a.alias("alpha"))


_NORM = "((a - 1.0::DOUBLE) / 4.0::DOUBLE)"


def _channel_sql(start: float, stop: float, over: float) -> str:
    return f"coalesce(CAST(((CAST(trunc(CASE WHEN {_NORM} < 0.5 THEN {_NORM} * 2 * {float(over - start)} + {float(start)} ELSE ({_NORM} * 2 - 1) * {float(stop - over)} + {float(over)} END) AS BIGINT) % 256) + 256) % 256 AS INT), 0)"


@query(f"{PIX} SELECT gx, gy, {_channel_sql(10, 200, 90)} AS r, {_channel_sql(20, 100, 60)} AS g, {_channel_sql(0, 250, 30)} AS b, CASE WHEN {_NORM} BETWEEN 0 AND 1 THEN 255 ELSE 0 END AS alpha FROM pix")
def colormap_continuous(spark, sf_dir):
    r, g, b, a = colors.continuous(F.col("value"), 1.0, 5.0, (10, 20, 0, 255), (200, 100, 250, 255), (90, 60, 30, 255))
    return placed(a_pixels(spark, sf_dir)).select("gx", "gy", r, g, b, a.alias("alpha"))


@query(f"{PIX} SELECT tilex, tiley, count(*) FILTER (a = 2) AS two, count(*) FILTER (a >= 2 AND a < 5) AS mid FROM pix GROUP BY 1, 2")
def colormap_class_stats(spark, sf_dir):
    counted = lambda e: F.sum(F.when(aggregate.class_condition(e, F.col("value"), masked=True), 1).otherwise(0))
    return a_pixels(spark, sf_dir).groupBy("tilex", "tiley").agg(counted("2").alias("two"), counted("(x >= 2) & (x < 5)").alias("mid"))


@query("""SELECT n_nationkey, CAST('0x' || substr(h, 1, 2) AS INT) AS r, CAST('0x' || substr(h, 3, 2) AS INT) AS g, CAST('0x' || substr(h, 5, 2) AS INT) AS b
  FROM (SELECT n_nationkey, left(repeat(CASE n_nationkey % 4 WHEN 0 THEN d WHEN 1 THEN '7' || d WHEN 2 THEN '1' || d || 'f' ELSE '01a' || d || 'b2' END, 6), 6) AS h FROM (SELECT *, printf('%x', n_nationkey % 16) AS d FROM nation))""")
def hex_to_rgba(spark, sf_dir):
    d, k = F.lower(F.hex(F.col("n_nationkey") % 16)), F.col("n_nationkey") % 4
    text = F.when(k == 0, d).when(k == 1, F.concat(F.lit("#7"), d)).when(k == 2, F.concat(F.lit("1"), d, F.lit("f"))).otherwise(F.concat(F.lit("#01a"), d, F.lit("b2")))
    rows = read(spark, sf_dir, "nation").select("n_nationkey", text.alias("color"))
    return rows.select("n_nationkey", *colors.hex_columns(F.col("color"))[:3])


def _band_sql(v: str, low: float, high: float) -> str:
    return f"CAST(trunc(255.0::DOUBLE * (least(greatest({v}, {low}), {high}) - {low}) / {high}) AS INT)"


@query(f"{PIX}, c AS (SELECT gx, gy, coalesce({_band_sql('a', 0.0, 6.0)}, 0) AS r, coalesce({_band_sql('q', 100.0, 500.0)}, 0) AS g, coalesce({_band_sql('a + q', 50.0, 800.0)}, 0) AS b FROM pix) SELECT *, CASE WHEN r = 0 OR g = 0 OR b = 0 THEN 0 ELSE 255 END AS alpha FROM c")
def rgb_compose(spark, sf_dir):
    rows = layers.aligned_pixels(cnt_qty(spark, sf_dir), TS).select((F.col("tilex") * TS + F.col("px")).cast("int").alias("gx"), (F.col("tiley") * TS + F.col("py")).cast("int").alias("gy"), "a", "q")
    r, g, b, a = colors.compose(colors.rgb_channel(F.col("a"), 0.0, 6.0), colors.rgb_channel(F.col("q"), 100.0, 500.0), colors.rgb_channel(F.col("a") + F.col("q"), 50.0, 800.0))
    return rows.select("gx", "gy", r, g, b, a.alias("alpha"))


@query("""SELECT r_regionkey AS legend_id, r_name AS title, CAST(to_json(list(struct_pack(name := n_name, expression := CAST(n_nationkey AS VARCHAR), color := '#123456') ORDER BY n_nationkey % 3, n_name)) AS VARCHAR) AS json
  FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def legend_json(spark, sf_dir):
    entries = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("legend_id"), F.col("n_nationkey").alias("semantics_id"), F.col("n_nationkey").cast("string").alias("expression"),
                                                   F.lit("#123456").alias("color"), (F.col("n_nationkey") % 3).alias("code"))
    semantics = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("semantics_id"), F.col("n_name").alias("name"))
    legends = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("legend_id"), F.col("r_name").alias("title"))
    return catalog.legends_view(legends, entries, semantics)


def _two_layers(spark, sf_dir) -> DataFrame:
    tiles = layer(spark, sf_dir, "qty", None).tiles.select(*TILE)
    return tiles.where("tilex < 3").select(F.lit(1).alias("layer_id"), *TILE).unionByName(tiles.where("tiley > 0 and tilex > 0").select(F.lit(2).alias("layer_id"), *TILE))


_RANGES = f"{PIX}, t AS (SELECT DISTINCT tilex, tiley FROM pix), l AS (SELECT 1 AS layer_id, * FROM t WHERE tilex < 3 UNION ALL SELECT 2, * FROM t WHERE tiley > 0 AND tilex > 0), r AS (SELECT layer_id, 2 AS tilez, min(tilex) AS xmin, min(tiley) AS ymin, max(tilex) AS xmax, max(tiley) AS ymax FROM l GROUP BY 1)"


@query(f"{_RANGES} SELECT * FROM r")
def index_range_minmax(spark, sf_dir):
    return layers.index_ranges(_two_layers(spark, sf_dir))


@query(f"{_RANGES} SELECT tilez, max(xmin) AS xmin, max(ymin) AS ymin, min(xmax) AS xmax, min(ymax) AS ymax FROM r GROUP BY 1")
def index_range_intersection(spark, sf_dir):
    return layers.common_range(layers.index_ranges(_two_layers(spark, sf_dir)))


@query(f"{_RANGES} SELECT tilez, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM r GROUP BY 1")
def index_range_union(spark, sf_dir):
    return layers.common_range(layers.index_ranges(_two_layers(spark, sf_dir)), union=True)


@query("SELECT count(DISTINCT (n_regionkey, n_nationkey % 2)) <= 1 AS aligned, count(*) AS rasters FROM nation")
def alignment_check(spark, sf_dir):
    return layers.check_aligned(read(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey") % 2), ["n_regionkey", "k"])


@query(f"{PIX} SELECT max(2) AS max_zoom, {_d(tilemath.tile_scale(ZOOM, TS))} AS pixelsize FROM pix")
def layer_zoom_and_pixelsize(spark, sf_dir):
    return catalog.zoom_and_pixelsize(layer(spark, sf_dir, "cnt", 0.0).tiles, TS)


@query(f"{PIX} SELECT 0 AS band, gx, gy, raw AS value FROM pix WHERE raw IS NOT NULL UNION ALL SELECT 1, gx, gy, q FROM pix WHERE q IS NOT NULL")
def write_read_tiles(spark, sf_dir):
    """Two bands of a layer written as a tile table, one after the other, and read again."""
    path = tilestore.scratch(spark, "tiles")
    both = cnt_qty(spark, sf_dir)
    for band, one in enumerate(both.values()):
        pyramid.write_tiles(one.tiles.select(*TILE, F.col(one.column).alias("data")), path, 7, band)
    opened = [layers.pixels_from_tiles(tilestore.read_tiles(spark, path, 7, band, ZOOM), TS).select(F.lit(band).alias("band"), *TILE, "px", "py", "value") for band in (0, 1)]
    return placed(opened[0].unionByName(opened[1]).where("value is not null"), "band").select("band", "gx", "gy", "value")


#: The grid as a raster in degrees: upper left corner, pixel size, and the zoom that fits.
DEGREES = source.Source(SIDE, SIDE, (-10.0, 62.0), (0.5, -0.5), 4326)
_TOP = DEGREES.max_zoom(tile_size=TS)


def _snapped_sql(top: int) -> str:
    """The grid's raster in degrees on the pixels of a zoom."""
    box, metres = tilemath.tile_index_range(DEGREES.extent(), top, 1e-6), tilemath.tile_scale(top, TS)
    return f"""{PIX}, target AS (SELECT x.range AS tx, y.range AS ty, (x.range + 0.5::DOUBLE) * {_d(metres)} - {_d(tilemath.HALF)} AS x, {_d(tilemath.HALF)} - (y.range + 0.5::DOUBLE) * {_d(metres)} AS y
  FROM range({box[0] * TS}, {(box[2] + 1) * TS}) x, range({box[1] * TS}, {(box[3] + 1) * TS}) y),
found AS (SELECT tx, ty, CAST(floor((x * {_d(180 / tilemath.HALF)} + 10) / 0.5) AS INT) AS gx, CAST(floor(((atan(exp(y / {_d(tilemath.RADIUS)})) * 2 - pi() / 2) * {_d(180 / math.pi)} - 62) / -0.5) AS INT) AS gy FROM target),
snapped AS (SELECT tx, ty, raw, q FROM found JOIN pix USING (gx, gy) WHERE raw IS NOT NULL)"""


def _zooms_sql(top: int, value: str) -> str:
    return f"""{_snapped_sql(top)}, lv AS (SELECT CAST(z.range AS INT) AS z, CAST(pow(2, {top} - z.range) AS INT) AS r FROM range({top + 1}) z)
SELECT z AS tilez, CAST(tx // r AS INT) AS x, CAST(ty // r AS INT) AS y, {value} AS value FROM snapped, lv WHERE tx % r = r // 2 AND ty % r = r // 2"""


@query(f"{_zooms_sql(_TOP, 'raw')} AND abs(raw) > 1e-8")
def ingest_pyramid(spark, sf_dir):
    """A raster in degrees, projected, snapped to the tile grid and tiled over all zooms."""
    tiles = ingest.pyramid_of(source_grid(spark, sf_dir, "cnt"), DEGREES, _TOP, TS, 0.0)
    rows = layers.pixels_from_tiles(tiles, TS).where("value is not null")
    return rows.select("tilez", (F.col("tilex") * TS + F.col("px")).cast("int").alias("x"), (F.col("tiley") * TS + F.col("py")).cast("int").alias("y"), "value")


@query(f"""{PIX} SELECT 9 AS layer_id, 5 AS state, {_TOP} AS max_zoom, {SIDE} AS width, {SIDE} AS height, 4326 AS srid, min(raw) AS min, max(raw) AS max, round(avg(raw), 6) AS mean, round(stddev_pop(raw), 6) AS std
  FROM (SELECT CASE WHEN abs(raw) > 1e-8 THEN raw END AS raw FROM pix)""")
def ingest_status(spark, sf_dir):
    """The whole ingest of a raster: its last state, metadata and band statistics."""
    store = tilestore.scratch(spark, "ingest")
    rows = source_grid(spark, sf_dir, "cnt").withColumns({"band": F.lit(0), "nodata": F.lit(0.0), "origin_x": F.lit(-10.0), "origin_y": F.lit(62.0), "scale_x": F.lit(0.5), "scale_y": F.lit(-0.5)})
    ingest.ingest(spark, 9, rows, store, srid=4326, build_pyramid=False, tile_size=TS)
    meta, band = spark.read.parquet(f"{store}/metadata"), spark.read.parquet(f"{store}/bands")
    joined = ingest.parse_status(spark, store).join(meta, "layer_id").join(band.drop("band"), "layer_id")
    return joined.select("layer_id", "state", "max_zoom", "width", "height", "srid", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


#: Polygons around each nation's place on the grid: a box with a hole, and a triangle apart from it.
def _zones(spark, sf_dir) -> DataFrame:
    point = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    ring = lambda *points: F.array(*[point(*p) for p in points])
    placed_ = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("polygon_id"), (F.col("n_nationkey") * 7 % 50).cast("double").alias("x"), (F.col("n_nationkey") * 11 % 45).cast("double").alias("y"))
    return placed_.select("polygon_id", F.array(*[ring(*r) for r in _ZONE]).alias("rings"))


_ZONE = [[(0.2, 0.2), (9.7, 0.2), (9.7, 8.4), (0.2, 8.4)], [(3.1, 2.2), (6.6, 2.2), (6.6, 5.9), (3.1, 5.9)], [(10.3, 1.1), (15.2, 9.7), (10.3, 14.6)]]


def _zone_sql(x: str, y: str) -> str:
    sides = [side for ring in _ZONE for side in zip(ring, ring[1:] + ring[:1], strict=True)]
    return "(" + " + ".join(f"CAST((({y1} + zy) > {y}) <> (({y2} + zy) > {y}) AND {x} < ({x1} + zx) + ({y} - ({y1} + zy)) * ((({x2} + zx) - ({x1} + zx)) / (({y2} + zy) - ({y1} + zy))) AS INT)"
                            for (x1, y1), (x2, y2) in ((tuple(map(_d, p)), tuple(map(_d, q))) for p, q in sides) if y1 != y2) + ") % 2 = 1"


@query(f"""{PIX}, zones AS (SELECT n_nationkey AS polygon_id, CAST(n_nationkey * 7 % 50 AS DOUBLE) AS zx, CAST(n_nationkey * 11 % 45 AS DOUBLE) AS zy FROM nation)
SELECT polygon_id, raw AS value, count(*) AS "count" FROM pix, zones WHERE raw IS NOT NULL AND {_zone_sql('(gx + 0.5::DOUBLE)', '(gy + 0.5::DOUBLE)')} GROUP BY 1, 2""")
def zonal_value_count(spark, sf_dir):
    """Counts of values in each polygon of a table, with holes and parts that lie apart."""
    return coverage.zonal_count(_zones(spark, sf_dir), layer(spark, sf_dir, "cnt", None).tiles, TS, ZOOM)


def _zone_touched_sql(x: str, y: str) -> str:
    sides = [side for ring in _ZONE for side in zip(ring, ring[1:] + ring[:1], strict=True)]

    def meets(a, b) -> str:
        x1, y1, x2, y2 = (f"({_d(v)} + {z})" for v, z in zip((*a, *b), ("zx", "zy", "zx", "zy"), strict=True))
        turns = ", ".join(f"({cy} - {y1}) * ({x2} - {x1}) - ({cx} - {x1}) * ({y2} - {y1})" for cx in (x, f"({x} + 1)") for cy in (y, f"({y} + 1)"))
        return f"({x} <= greatest({x1}, {x2}) AND {x} + 1 >= least({x1}, {x2}) AND {y} <= greatest({y1}, {y2}) AND {y} + 1 >= least({y1}, {y2}) AND least({turns}) <= 0 AND greatest({turns}) >= 0)"

    return "(" + " OR ".join([_zone_sql(f"({x} + 0.5::DOUBLE)", f"({y} + 0.5::DOUBLE)"), *(meets(a, b) for a, b in sides)]) + ")"


_ZONES_SQL = "zones AS (SELECT n_nationkey AS polygon_id, CAST(n_nationkey * 7 % 50 AS DOUBLE) AS zx, CAST(n_nationkey * 11 % 45 AS DOUBLE) AS zy FROM nation)"
_CELLS_SQL = f"cells AS (SELECT CAST(x.range AS INT) AS gx, CAST(y.range AS INT) AS gy FROM range({SIDE}) x, range({SIDE}) y)"


@query(f"{PIX}, {_ZONES_SQL} SELECT polygon_id, raw AS value, count(*) AS \"count\" FROM pix, zones WHERE raw IS NOT NULL AND {_zone_touched_sql('gx', 'gy')} GROUP BY 1, 2")
def zonal_all_touched(spark, sf_dir):
    """Counts of values in each polygon of a table, of all pixels that it touches."""
    return coverage.zonal_count(_zones(spark, sf_dir), layer(spark, sf_dir, "cnt", None).tiles, TS, ZOOM, all_touched=True)


@query(f"WITH {_ZONES_SQL}, {_CELLS_SQL} SELECT polygon_id, gx, gy FROM cells, zones WHERE {_zone_sql('(gx + 0.5::DOUBLE)', '(gy + 0.5::DOUBLE)')}")
def rasterize_zones(spark, sf_dir):
    """Pixels whose centres lie in polygons of a table, by runs of rows."""
    return coverage.covered_pixels(_zones(spark, sf_dir), ZOOM, TS)


@query(f"WITH {_ZONES_SQL}, {_CELLS_SQL} SELECT polygon_id, gx, gy FROM cells, zones WHERE {_zone_touched_sql('gx', 'gy')}")
def rasterize_zones_touched(spark, sf_dir):
    """Pixels that polygons of a table touch."""
    return coverage.covered_pixels(_zones(spark, sf_dir), ZOOM, TS, all_touched=True)


@query(f"{PIX}, {_ZONES_SQL} SELECT zx AS polygon_id, CAST(count(*) AS BIGINT) AS pixels, sum(q) AS total FROM pix, (SELECT DISTINCT CAST(n_regionkey AS INT) AS zx FROM nation) WHERE q IS NOT NULL AND gx + 0.5 >= zx AND gx + 0.5 < 60 - zx AND gy + 0.5 >= 2 * zx AND gy + 0.5 < 50 GROUP BY 1")
def zonal_wide(spark, sf_dir):
    """Totals in boxes over most of the grid, one for each region: most of their tiles lie in cells inside."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    r = F.col("polygon_id")
    boxes = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("int").alias("polygon_id")).distinct()
    boxes = boxes.select("polygon_id", F.array(F.array(point(r, r * 2), point(60 - r, r * 2), point(60 - r, F.lit(50)), point(r, F.lit(50)))).alias("rings"))
    counts = coverage.zonal_count(boxes, layer(spark, sf_dir, "qty", None).tiles, TS, ZOOM)
    return counts.groupBy("polygon_id").agg(F.sum("count").alias("pixels"), F.sum(F.col("value") * F.col("count")).alias("total"))


def _metres(ring: geometry.Ring) -> geometry.Shape:
    return geometry.moved(ring, lambda x, y: (x * PIXEL_AREA - tilemath.HALF, tilemath.HALF - y * PIXEL_AREA))


@query(f'{PIX} SELECT a AS value, round(count(*) * {abs(PIXEL_AREA * PIXEL_AREA) * aggregate.ACRES!r}::DOUBLE, 3) AS "count" FROM pix WHERE a IS NOT NULL AND {_touched(TRIANGLE)} GROUP BY a')
def value_count_geom_all_touched(spark, sf_dir):
    """A geometry in metres: every pixel that it touches, in acres."""
    made = aggregate.Aggregator({"a": layer(spark, sf_dir, "cnt", 0.0)}, "a", TS, grouping="discrete", zoom=ZOOM, geom=_metres(TRIANGLE))
    return made.value_count().withColumn("count", F.round("count", 3))


@query(_legend_sql([("two", "a = 2"), ("mid", "a >= 2 AND a < 5"), ("none", "a = 10")]))
def value_count_legend_id(spark, sf_dir):
    legends = spark.createDataFrame([(1, json.dumps(OVERLAP)), (2, json.dumps(LEGEND))], "legend_id int, json string")
    return aggregate.Aggregator({"a": layer(spark, sf_dir, "cnt", 0.0)}, "a", TS, grouping="2", zoom=ZOOM, legends=legends).value_count()


@query(f'{PIX} SELECT a AS value, round(count(*) * {_d(PIXEL_AREA * PIXEL_AREA)}, 1) AS "count" FROM pix WHERE a IS NOT NULL AND {_inside(BOX)} GROUP BY a')
def layer_value_count_area(spark, sf_dir):
    got = aggregate.layer_value_count(layer(spark, sf_dir, "cnt", 0.0), TS, "ca", ZOOM, _metres(BOX), area=True)
    return got.withColumn("count", F.round("count", 1))


#: A grid of tiles of the default size that grows with the table: parts by orders. A few of a hundred of its pixels are there, so its tiles are sparse.
WIDE_ZOOM = 12


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = tilemath.DEFAULTS.tile_size
    cells = read(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_partkey") / 4).cast("int").alias("gx"), F.floor(F.col("l_orderkey") / 32).cast("int").alias("gy")).agg(
        (F.count("*") % 5).cast("double").alias("cnt"), F.sum("l_quantity").cast("double").alias("qty"))
    return cells.select(F.lit(WIDE_ZOOM).alias("tilez"), F.floor(F.col("gx") / ts).cast("int").alias("tilex"), F.floor(F.col("gy") / ts).cast("int").alias("tiley"), (F.col("gx") % ts).alias("px"), (F.col("gy") % ts).alias("py"), "gx", "gy", "cnt", "qty")


_WIDE = "WITH cells AS (SELECT l_partkey // 4 AS gx, l_orderkey // 32 AS gy, CAST(count(*) % 5 AS DOUBLE) AS cnt, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY 1, 2)"


def wide_layers(spark, sf_dir) -> dict[str, Layer]:
    tiles = layers.sparse_from_pixels(wide(spark, sf_dir), tilemath.DEFAULTS.tile_size, {"cnt": "cnt", "qty": "qty"})
    return {"a": Layer(tiles, 0.0, "cnt"), "q": Layer(tiles, -1.0, "qty")}


@query(f'{_WIDE} SELECT cnt * (CASE WHEN qty > 30 THEN 1 ELSE 0 END) AS value, count(*) AS "count" FROM cells WHERE cnt > 0 AND qty > 30 GROUP BY 1')
def wide_value_count(spark, sf_dir):
    """Value counts of a formula over tiles of 256 pixels."""
    return aggregate.value_count(evaluate_pixels(wide_layers(spark, sf_dir), "a * (q > 30)", tilemath.DEFAULTS.tile_size))


@query(f'{_WIDE} SELECT CAST(gx // 256 AS INT) AS tilex, CAST(gy // 256 AS INT) AS tiley, round(sum(v), 3) AS total, count(*) AS pixels FROM (SELECT gx, gy, cnt * 2 + qty / 4 - 1 AS v FROM cells WHERE cnt > 0) WHERE abs(v) > 1e-8 GROUP BY 1, 2')
def wide_tiles_arith(spark, sf_dir):
    """Whole-array algebra over tiles of 256 pixels."""
    tiles = evaluate_tiles(wide_layers(spark, sf_dir), "a * 2 + q / 4 - 1")
    there = F.filter("data", lambda v: v.isNotNull())
    return tiles.select("tilex", "tiley", there.alias("v")).where(F.size("v") > 0).select("tilex", "tiley", F.round(F.aggregate("v", F.lit(0.0), lambda s, v: s + v), 3).alias("total"), F.size("v").cast("long").alias("pixels"))


@query(f"""{_WIDE}, lv AS (SELECT CAST(z.range AS INT) AS z, CAST(pow(2, {WIDE_ZOOM} - z.range) AS INT) AS r FROM range({WIDE_ZOOM + 1}) z)
SELECT z AS tilez, count(*) AS pixels, sum(qty) AS total FROM cells, lv WHERE gx % r = r // 2 AND gy % r = r // 2 GROUP BY 1""")
def wide_pyramid(spark, sf_dir):
    """A pyramid of tiles of 256 pixels over thirteen zooms."""
    source = wide(spark, sf_dir).select("gx", "gy", F.col("qty").alias("value"))
    pixels = layers.pixels_from_tiles(pyramid.create_tiles(source, WIDE_ZOOM, tilemath.DEFAULTS.tile_size, -1.0, sparse=True), tilemath.DEFAULTS.tile_size).where("value is not null")
    return pixels.groupBy("tilez").agg(F.count("*").alias("pixels"), F.sum("value").alias("total"))


#: Sides of the cells and of the tiles of a raster file that grows with the table.
_FILE_TS = 64
_FILE = "WITH cells AS (SELECT l_partkey // 16 AS gx, l_orderkey // 128 AS gy, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2)"


def raster_file(spark: SparkSession, sf_dir: str) -> str:
    """A GeoTIFF of the quantities of line items by part and order, in tiles; cells without any are 0, and tiles without any take no bytes."""
    items = read(spark, sf_dir, "lineitem")
    cells = items.groupBy(F.floor(F.col("l_partkey") / 16).cast("int").alias("gx"), F.floor(F.col("l_orderkey") / 128).cast("int").alias("gy")).agg(F.sum("l_quantity").cast("double").alias("value"))
    placed_ = cells.select(F.lit(0).alias("tilez"), F.floor(F.col("gx") / _FILE_TS).cast("int").alias("tilex"), F.floor(F.col("gy") / _FILE_TS).cast("int").alias("tiley"), (F.col("gx") % _FILE_TS).alias("px"), (F.col("gy") % _FILE_TS).alias("py"), "value")
    part, order = items.agg(F.max("l_partkey"), F.max("l_orderkey")).first()
    box = (0, 0, (part or 0) // 16 // _FILE_TS, (order or 0) // 128 // _FILE_TS)
    path = f"{tilestore.scratch(spark, 'file')}.tif"
    images.write_tiff(layers.sparse_from_pixels(placed_, _FILE_TS, {"data": "value"}), box, _FILE_TS, path, (500_000.0, 5_000_000.0), (30.0, -30.0))
    return path


@query(f'{_FILE} SELECT CAST(gx // 50 AS INT) AS x, CAST(gy // 50 AS INT) AS y, sum(value) AS total, max(value) AS most, count(*) AS filled FROM cells GROUP BY 1, 2')
def windowed_scan(spark, sf_dir):
    """A raster file read by windows of some tiles each, summed over squares of 50 pixels."""
    pixels = windows.read_pixels(spark, raster_file(spark, sf_dir), 0.0, pixels=1 << 14)
    return pixels.groupBy(F.floor(F.col("gx") / 50).cast("int").alias("x"), F.floor(F.col("gy") / 50).cast("int").alias("y")).agg(F.sum("value").alias("total"), F.max("value").alias("most"), F.count("*").alias("filled"))


@query(f"{_FILE} SELECT CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy, value FROM cells WHERE gx BETWEEN 7 AND 40 AND gy BETWEEN 11 AND 30")
def windowed_scan_box(spark, sf_dir):
    """A box of a raster file; windows outside it are not fetched."""
    blocks = windows.read_blocks(spark, raster_file(spark, sf_dir), box=(7, 11, 40, 30), band=0)
    return windows.pixels_of_blocks(blocks).where("value <> 0").select("gx", "gy", "value")


#: The grid as a raster in a UTM zone, and that zone's projection as SQL: Krueger's series.
UTM = source.Source(SIDE, SIDE, (466_400.0, 5_030_000.0), (1_000.0, -1_000.0), 32633)
_UTM_TOP = UTM.max_zoom(tile_size=TS)
_UTM_BOX = tilemath.tile_index_range(UTM.extent(), _UTM_TOP, 1e-6)
_UTM_METRES = tilemath.tile_scale(_UTM_TOP, TS)
_N3 = "(1::DOUBLE / 298.257223563 / (2 - 1::DOUBLE / 298.257223563))"
_UTM_XY = f"""k AS (SELECT *, {_N3} AS n FROM degrees_),
u AS (SELECT *, 2 * sqrt(n) / (1 + n) AS c, sin(radians(lat)) AS s, radians(lon - 15) AS away FROM k),
v AS (SELECT *, sinh(atanh(s) - c * atanh(c * s)) AS t FROM u),
w AS (SELECT *, atan2(t, cos(away)) AS xi, atanh(sin(away) / sqrt(1 + t * t)) AS eta, 0.9996 * 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS scaled,
      [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440, 61 * n ** 3 / 240 - 103 * n ** 4 / 140, 49561 * n ** 4 / 161280] AS a FROM v),
utm AS (SELECT *, 500000 + scaled * (eta + list_sum(list_transform([1, 2, 3, 4], lambda j: a[j] * cos(2 * j * xi) * sinh(2 * j * eta)))) AS east,
        scaled * (xi + list_sum(list_transform([1, 2, 3, 4], lambda j: a[j] * sin(2 * j * xi) * cosh(2 * j * eta)))) AS north FROM w)"""


@query(f"""{PIX}, degrees_ AS (SELECT tx, ty, x * {_d(180 / tilemath.HALF)} AS lon, (atan(exp(y / {_d(tilemath.RADIUS)})) * 2 - pi() / 2) * {_d(180 / math.pi)} AS lat FROM (
  SELECT x.range AS tx, y.range AS ty, (x.range + 0.5::DOUBLE) * {_d(_UTM_METRES)} - {_d(tilemath.HALF)} AS x, {_d(tilemath.HALF)} - (y.range + 0.5::DOUBLE) * {_d(_UTM_METRES)} AS y
  FROM range({_UTM_BOX[0] * TS}, {(_UTM_BOX[2] + 1) * TS}) x, range({_UTM_BOX[1] * TS}, {(_UTM_BOX[3] + 1) * TS}) y)),
{_UTM_XY}, found AS (SELECT tx, ty, CAST(floor((east - {UTM.origin[0]}) / 1000) AS INT) AS gx, CAST(floor((north - {UTM.origin[1]}) / -1000) AS INT) AS gy FROM utm),
snapped AS (SELECT tx, ty, raw AS value FROM found JOIN pix USING (gx, gy) WHERE abs(raw) > 1e-8),
lv AS (SELECT CAST(z.range AS INT) AS z, CAST(pow(2, {_UTM_TOP} - z.range) AS INT) AS r FROM range({_UTM_TOP + 1}) z)
SELECT z AS tilez, CAST(tx // r AS INT) AS x, CAST(ty // r AS INT) AS y, value FROM snapped, lv WHERE tx % r = r // 2 AND ty % r = r // 2""")
def ingest_utm(spark, sf_dir):
    """A raster in a UTM zone, warped block by block onto the tile grid of all zooms."""
    tiles = ingest.pyramid_of(source_grid(spark, sf_dir, "cnt"), UTM, _UTM_TOP, TS, 0.0)
    rows = layers.pixels_from_tiles(tiles, TS).where("value is not null")
    return rows.select("tilez", (F.col("tilex") * TS + F.col("px")).cast("int").alias("x"), (F.col("tiley") * TS + F.col("py")).cast("int").alias("y"), "value")


@query(f"""WITH degrees_ AS (SELECT event_id, 12 + event_id * 37 % 600 / 100.0::DOUBLE AS lon, event_id * 53 % 8000 / 100.0::DOUBLE AS lat FROM events), {_UTM_XY}
SELECT event_id, round(east, 3) AS east, round(north, 3) AS north, round(lon, 9) AS lon, round(lat, 9) AS lat FROM utm""")
def utm_round_trip(spark, sf_dir):
    """Points to metres of a UTM zone and back to degrees."""
    places = read(spark, sf_dir, "events").select("event_id", (F.lit(12) + F.col("event_id") * 37 % 600 / 100.0).alias("lon"), (F.col("event_id") * 53 % 8000 / 100.0).alias("lat"))
    east, north = projection.transform(F.col("lon"), F.col("lat"), 4326, 32633, F)
    metres = places.select("event_id", east.alias("east"), north.alias("north"))
    lon, lat = projection.transform(F.col("east"), F.col("north"), 32633, 4326, F)
    return metres.select("event_id", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query(_zooms_sql(_TOP - 1, "q"))
def ingest_again(spark, sf_dir):
    """A layer ingested to one zoom, and then other values of it to the zoom below only: nothing of the first is left."""
    store = tilestore.scratch(spark, "again")
    place = {"band": F.lit(0), "nodata": F.lit(-1.0), "origin_x": F.lit(-10.0), "origin_y": F.lit(62.0), "scale_x": F.lit(0.5), "scale_y": F.lit(-0.5)}
    for value, zoom in (("cnt", _TOP), ("qty", _TOP - 1)):
        ingest.ingest(spark, 3, source_grid(spark, sf_dir, value).withColumns(place), store, srid=4326, max_zoom=zoom, tile_size=TS)
    rows = layers.pixels_from_tiles(tilestore.read_tiles(spark, f"{store}/tiles", 3), TS).where("value is not null")
    return rows.select("tilez", (F.col("tilex") * TS + F.col("px")).cast("int").alias("x"), (F.col("tiley") * TS + F.col("py")).cast("int").alias("y"), "value")


@query("""SELECT CAST(n_nationkey AS INT) AS layer_id FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 5 = 1 OR n_nationkey > 20""")
def layers_to_ingest(spark, sf_dir):
    """Layers of a catalog that changed since their last ingest, failed in it, or never had one."""
    store = tilestore.scratch(spark, "catalog")
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("layer_id"), F.concat(F.lit("rasters/"), "n_name").alias("rasterfile"), F.col("n_regionkey").cast("string").alias("nodata"))
    before = catalog.ingest_fingerprint(nation).where("layer_id <= 20")
    line = lambda at, state, mark: before.select("layer_id", F.to_timestamp(F.lit(at)).alias("at"), state.alias("state"), F.lit(None).cast("int").alias("zoom"), F.lit("").alias("message"), mark.alias("fingerprint"))
    state = F.when(F.col("layer_id") % 5 == 1, catalog.STATES["FAILED"]).otherwise(catalog.STATES["FINISHED"])
    log = line("2024-01-01", F.lit(catalog.STATES["DOWNLOADING"]), F.lit(None).cast("long")).unionByName(line("2024-01-02", state, F.when(state == catalog.STATES["FINISHED"], F.col("fingerprint"))))
    log.write.parquet(f"{store}/log")
    now = nation.withColumn("nodata", F.when(F.col("layer_id") % 3 == 0, "99").otherwise(F.col("nodata")))
    return ingest.changed_layers(spark, now, store).select("layer_id")


@query(f"{_WIDE} SELECT CAST(gx // 256 AS INT) AS tilex, CAST(gy // 256 AS INT) AS tiley, count(*) AS pixels, sum(qty) AS total FROM cells WHERE gx // 256 BETWEEN 0 AND 1 AND gy // 256 BETWEEN 1 AND 2 GROUP BY 1, 2")
def tiles_in_box(spark, sf_dir):
    """Tiles of a box from a stored table, whose files lie along a curve."""
    path = tilestore.scratch(spark, "tiles")
    pyramid.write_tiles(wide_layers(spark, sf_dir)["q"].tiles.select(*TILE, "places", "size", F.col("qty").alias("data")), path, 1)
    there = F.filter("data", lambda v: v.isNotNull())
    found = tilestore.read_tiles(spark, path, 1, zoom=WIDE_ZOOM, box=(0, 1, 1, 2)).select("tilex", "tiley", there.alias("v"))
    return found.select("tilex", "tiley", F.size("v").cast("long").alias("pixels"), F.aggregate("v", F.lit(0.0), lambda s, v: s + v).alias("total"))


@query(f"""{PIX}, near AS (SELECT p.gx, p.gy, o.q, CASE WHEN o.gx = p.gx AND o.gy = p.gy THEN 5 ELSE 1 END AS w FROM pix p JOIN pix o ON abs(o.gx - p.gx) <= 1 AND abs(o.gy - p.gy) <= 1 WHERE p.q IS NOT NULL AND o.q IS NOT NULL)
SELECT gx, gy, round(sum(q * w) / sum(w), 6) AS value FROM near GROUP BY 1, 2""")
def focal_smooth(spark, sf_dir):
    """The weighted mean of each pixel and its neighbours, across the borders of tiles."""
    made = focal.focal_mean(layer(spark, sf_dir, "qty", None).tiles, TS)
    return placed(layers.pixels_from_tiles(made, TS).where("value is not null")).select("gx", "gy", F.round("value", 6).alias("value"))


@query(f"""{PIX}, v AS (SELECT gx, gy, least(q, 255) AS q FROM pix WHERE q IS NOT NULL),
near AS (SELECT p.gx, p.gy, p.q AS own, sum(o.q * CASE WHEN o.gx = p.gx AND o.gy = p.gy THEN 5 ELSE 1 END) / sum(CASE WHEN o.gx = p.gx AND o.gy = p.gy THEN 5 ELSE 1 END) AS smooth FROM v p JOIN v o ON abs(o.gx - p.gx) <= 1 AND abs(o.gy - p.gy) <= 1 GROUP BY 1, 2, 3)
SELECT gx, gy, floor(least(greatest(smooth + (own - smooth) * 2.3::DOUBLE, 0), 255) + 0.5::DOUBLE) AS value FROM near""")
def focal_sharpness(spark, sf_dir):
    """A channel made sharper."""
    tiles = layer(spark, sf_dir, "qty", None).tiles
    channel = tiles.select(*TILE, F.transform("data", lambda v: F.when(v.isNotNull(), F.least(v, F.lit(255.0)))).alias("data"))
    made = focal.sharpened(channel, TS, 2.3)
    return placed(layers.pixels_from_tiles(made, TS).where("value is not null")).select("gx", "gy", "value")


@query(f"{PIX} SELECT tilex, tiley, count(*) FILTER (a = 2) AS two, count(*) FILTER (a >= 3 AND a < 6) AS mid, count(*) FILTER (a = 5) AS five, true AS png FROM pix GROUP BY 1, 2")
def rendered_tiles(spark, sf_dir):
    """PNGs of tiles and the pixels of each class of the colour map, from one evaluation."""
    masked = layer(spark, sf_dir, "cnt", 0.0)
    tiles = masked.tiles.select(*TILE, F.transform(masked.column, lambda v: layers.drop_nodata(v, 0.0)).alias("data"))
    made = images.rendered(tiles, COLORMAP, TS)
    count = lambda name: F.element_at("statistics", name)
    return made.select("tilex", "tiley", count("2").alias("two"), count("(x >= 3) & (x < 6)").alias("mid"), count("5").alias("five"), (F.substring("png", 2, 3) == F.lit(b"PNG")).alias("png"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
