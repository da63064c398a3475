import io
import json
import math
import struct
import zipfile
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.config import Settings
from gridloom.errors import RasterAggregationException, RasterException
from gridloom.functions import colors, geometry, tilemath
from gridloom.operators import aggregate, catalog, layers, pyramid
from gridloom.operators.algebra import evaluate_pixels, evaluate_tiles
from gridloom.operators.layers import Layer
from gridloom.sources import images, rasterfile


def tiles(spark, *data):
    return spark.createDataFrame([(0, 0, 0, list(map(float, d))) for d in data], "tilez int, tilex int, tiley int, data array<double>")


def values(df):
    return [r.value for r in df.orderBy("py", "px").collect()]


@pytest.mark.parametrize("formula, nodata, want", [
    ("x*(x>11) + 2*y + 3*z*(z==30)", 10.0, [10, 10, 14, 15]), ("x * (z != NULL) + 99 * (z == NULL)", 10.0, [10, 99, 12, 13]), ("z", None, [30, 31, 32, 33]),
])
def test_two_by_two_rasters(spark, formula, nodata, want):
    # x is 10..13 with nodata 10, y is 1, z is 30..33 with nodata 31.
    bound = {"x": Layer(tiles(spark, range(10, 14)), nodata), "y": Layer(tiles(spark, [1] * 4), nodata), "z": Layer(tiles(spark, range(30, 34)), 31.0 if nodata else None)}
    if formula == "z":
        bound = {"z": bound["z"]}
    got = values(evaluate_pixels(bound, formula, 2))
    filled = [v if v is not None else 10 for v in got]
    assert [w for g, w in zip(got, want, strict=True) if g is not None] == [g for g in got if g is not None]
    assert filled == want or [f for f, g in zip(filled, got, strict=True) if g is None] == [10] * got.count(None)
    again = layers.pixels_from_tiles(evaluate_tiles(bound, formula), 2)
    assert values(again) == got


# Counts and statistics of a known layer that must come out.
PIXELS = {0: 21741, 1: 695, 2: 56, 3: 4131, 4: 31490, 8: 1350, 9: 2977}


@pytest.fixture(scope="module")
def categorical(spark):
    rows = spark.createDataFrame([(float(k), v) for k, v in PIXELS.items()], "value double, n int")
    return rows.select("value", F.explode(F.sequence(F.lit(1), "n"))).select("value")


def test_counts_and_statistics_of_a_known_layer(spark, categorical):
    assert {r.value: r["count"] for r in aggregate.value_count(categorical).collect()} == PIXELS
    want, bounds = np.histogram(np.repeat(list(PIXELS), list(PIXELS.values())), bins=10)
    got = aggregate.histogram(categorical).orderBy("bin").collect()
    assert [r["count"] for r in got] == want.tolist() and [r.low for r in got] == pytest.approx(bounds[:-1])
    ranged = aggregate.statistics(categorical, (0.5, 8)).first()
    assert (ranged.t0, ranged.t1, ranged.t2, ranged.min, ranged.max) == (37722, 149960, 628338, 1, 8)
    one = pyramid.band_histogram(categorical).first()
    assert len(one.hist_values) == 100 and len(one.hist_bins) == 101 and sum(one.hist_values) == 62440
    legend = [{"name": n, "expression": e} for n, e in (("four", "4"), ("some", "(x >= 2) & (x < 5)"), ("none", "77"))]
    assert {r.name: r["count"] for r in aggregate.legend_count(categorical, json.dumps(legend)).collect()} == {"four": 31490, "some": 35677, "none": 0}


def test_empty_and_odd_aggregations(spark):
    none = spark.createDataFrame([], "value double")
    assert aggregate.statistics(none).first().mean is None and aggregate.value_count(none).count() == 0
    assert [r["count"] for r in aggregate.histogram(none).collect()] == [0] * 10
    same = aggregate.histogram(spark.createDataFrame([(3.0,)] * 4, "value double")).orderBy("bin").collect()
    assert same[0].low == 2.5 and same[-1].high == 3.5 and same[5]["count"] == 4
    with pytest.raises(RasterAggregationException):
        aggregate.histogram(spark.createDataFrame([(float("nan"),)], "value double"))
    with pytest.raises(RasterAggregationException):
        aggregate.legend_classes("not json")
    assert aggregate.grouping_of(["ca", "ma"]) == "discrete" and aggregate.grouping_of(["ca", "ro"]) == "continuous"
    with pytest.raises(RasterAggregationException):
        aggregate.Aggregator({"x": Layer(tiles(spark, range(4)))}, "x", 2, grouping="wrong")


def test_rasterize_on_two_by_two(spark):
    cells = spark.createDataFrame([(0, 0, 0.0), (1, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)], "gx int, gy int, base double")
    burn = lambda ring, **k: [r[0] for r in cells.select(geometry.rasterize(F.col("gx"), F.col("gy"), ring, **k).alias("v"), "gx", "gy").orderBy("gy", "gx").collect()]
    whole, low, tiny = [(-1, -1), (3, -1), (3, 3), (-1, 3)], [(-1, 1.2), (3, 1.2), (3, 3), (-1, 3)], [(0.1, 0.1), (0.2, 0.1), (0.2, 0.2), (0.1, 0.2)]
    assert burn(whole) == [1] * 4 and burn(low) == [0, 0, 1, 1] and burn(low, burn=99) == [0, 0, 99, 99]
    assert burn(tiny) == [0] * 4 and burn(tiny, all_touched=True) == [1, 0, 0, 0]
    assert burn(low, burn=99, add_to=F.col("base")) == [0, 1, 101, 102]


def test_zooms_of_scales_on_and_beside_each_size(spark):
    size = tilemath.tile_scale
    for k in range(1, 19):
        assert (tilemath.zoom_of_scale(size(k)), tilemath.zoom_of_scale(size(k), False)) == (k, k - 1)
        assert tilemath.zoom_of_scale(size(k) * 0.999) == min(k + 1, 19) and tilemath.zoom_of_scale(size(k) * 1.001) == k
    assert (tilemath.zoom_of_scale(size(0)), tilemath.zoom_of_scale(size(0) * 9, False), tilemath.zoom_of_scale(1e-9), tilemath.zoom_of_scale(1e-9, False)) == (1, 0, 19, 18)
    scales = [size(k) * f for k in range(21) for f in (0.999, 1, 1.001)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(scales)], "i int, s double").orderBy("i")
    for higher in (True, False):
        assert [r[0] for r in rows.select(tilemath.closest_zoom(F.col("s"), higher)).collect()] == [tilemath.zoom_of_scale(s, higher) for s in scales]


def test_dense_tiles_of_gaps_repeats_and_several_bands(spark):
    rows = [(0, 0, 0, 1, 0, 5.0, 1.0), (0, 0, 0, 3, 3, None, 2.0), (0, 0, 0, 2, 1, 7.0, 3.0), (0, 0, 0, 2, 1, 6.0, 4.0), (0, 0, 0, 4, 0, 9.0, 9.0), (0, 1, 0, 0, 0, 8.0, 8.0)]
    pixels = spark.createDataFrame(rows, "tilez int, tilex int, tiley int, px int, py int, a double, b double")
    got = {r.tilex: (r.x, r.y) for r in layers.bands_from_pixels(pixels, 4, {"x": "a", "y": "b"}).collect()}
    first, second = [None] * 16, [None] * 16
    first[1], first[6], second[1], second[6], second[15] = 5.0, 6.0, 1.0, 4.0, 2.0
    assert got == {0: (first, second), 1: ([8.0] + [None] * 15, [8.0] + [None] * 15)}
    assert layers.tiles_from_pixels(pixels.limit(0), 4, value="a").count() == 0


def test_a_whole_tile_of_the_default_size_is_built_in_linear_time(spark):
    import time

    side = 256
    pixels = spark.range(side * side).where("id % 3 != 0").select(F.lit(0).alias("tilez"), F.lit(0).alias("tilex"), F.lit(0).alias("tiley"), (F.col("id") % side).cast("int").alias("px"),
                                                                 F.floor(F.col("id") / side).cast("int").alias("py"), F.col("id").cast("double").alias("value"))
    layers.tiles_from_pixels(pixels.limit(10), side).count()
    begun = time.time()
    (tile,) = layers.tiles_from_pixels(pixels, side).collect()
    assert tile.data == [None if i % 3 == 0 else float(i) for i in range(side * side)] and time.time() - begun < 10


@pytest.mark.parametrize("formula", ["a * 2 + b / 4 - 1", "~a + b", "(a == NULL) * 3 + 1", "a * (b > 2)", "a / max(b) + mean(a)", "7", "log(a - 5)", "max(a)"])
def test_sparse_tiles_give_what_whole_ones_give(spark, formula):
    rows = [(0, 0, 0, 1, 0, 5.0, 1.0), (0, 0, 0, 3, 3, None, 2.0), (0, 0, 0, 2, 1, 7.0, 3.0), (0, 0, 0, 2, 1, 6.0, 4.0), (0, 0, 0, 4, 0, 9.0, 9.0), (0, 1, 0, 0, 0, 8.0, 8.0)]
    pixels = spark.createDataFrame(rows, "tilez int, tilex int, tiley int, px int, py int, x double, y double")
    made = [build(pixels, 4, {"x": "x", "y": "y"}) for build in (layers.bands_from_pixels, layers.sparse_from_pixels)]
    there = lambda df: sorted(tuple(r) for r in df.select("tilex", "px", "py", "value").where("value is not null").collect())
    for nodata in (8.0, None):
        if nodata is None and "~" in formula:
            continue
        bound = [{"a": Layer(t, nodata, "x"), "b": Layer(t, -1.0, "y")} for t in made]
        whole, sparse = (there(evaluate_pixels(b, formula, 4)) for b in bound)
        assert sparse == whole
        whole, sparse = (there(layers.pixels_from_tiles(evaluate_tiles(b, formula), 4)) for b in bound)
        assert sparse == whole


def test_pixels_that_a_sparse_tile_lacks_are_no_rows(spark):
    rows = spark.range(3).select(F.lit(2).alias("tilez"), F.lit(1).alias("tilex"), F.lit(0).alias("tiley"), (F.col("id") * 80).alias("px"), F.lit(255).alias("py"), F.col("id").cast("double").alias("v"))
    bound = {"a": Layer(layers.sparse_from_pixels(rows, 256, {"v": "v"}), 9.0, "v")}
    assert evaluate_pixels(bound, "a * 2", 256).count() == 3 and evaluate_pixels(bound, "a == NULL", 256).count() == 65536
    assert [(r.tilex, r.places, r.data, r["size"]) for r in evaluate_tiles(bound, "a * 2").collect()] == [(1, [65280, 65360, 65440], [0.0, 2.0, 4.0], 65536)]


def test_a_pyramid_of_sparse_tiles(spark):
    source = spark.range(900).select((F.col("id") % 30).alias("gx"), F.floor(F.col("id") / 30).alias("gy"), (F.col("id") % 11).cast("double").alias("value")).where("gx * gy % 3 < 2")
    opened = lambda sparse: sorted(tuple(r) for r in layers.pixels_from_tiles(pyramid.create_tiles(source, 3, 4, 0.0, sparse=sparse), 4).where("value is not null").collect())
    assert opened(True) == opened(False)
    assert pyramid.create_tiles(source, 3, 4, 0.0, sparse=True).agg(F.sum(F.size("data"))).first()[0] == pyramid.sampled(source, 3).count()


def test_layers_of_one_table_are_never_joined(spark):
    both = spark.createDataFrame([(0, 0, 0, [1.0, 2.0, 3.0, 0.0], [5.0, -1.0, 7.0, 8.0])], "tilez int, tilex int, tiley int, a array<double>, b array<double>")
    made = evaluate_pixels({"x": Layer(both, 0.0, "a"), "y": Layer(both, -1.0, "b")}, "x + y", 2)
    assert values(made) == [6.0, None, 10.0, None] and "Join" not in made._jdf.queryExecution().toString()


def test_tile_arithmetic():
    edge = tilemath.WORLD / 2**11
    bbox = (552.0001 * edge - tilemath.HALF, tilemath.HALF - 860.99999 * edge, 555.00001 * edge - tilemath.HALF, tilemath.HALF - 857.99999 * edge)
    assert tilemath.tile_index_range(bbox, 11) == (552, 857, 555, 860)
    assert tilemath.tile_index_range(bbox, 11, 1e-3) == (552, 858, 554, 860) and tilemath.tile_index_range(bbox, 11, 2e-5) == (552, 858, 554, 860)
    assert tilemath.nr_of_tiles(bbox, 11) == 16
    assert tilemath.project_bbox((-10, 20, 30, 40), 4326, 3857) == pytest.approx((-1113194.9079, 2273030.9270, 3339584.7238, 4865942.2795))
    assert tilemath.project(*tilemath.project(12.5, 41.9, 4326, 3857), 3857, 4326) == pytest.approx((12.5, 41.9))
    with pytest.raises(RasterException):
        tilemath.project_bbox((0, 0, 1, 1), 4326, 27700)
    assert tilemath.tile_index_range((-9218229 - 1, 3229269 - 1, -9218229 + 1, 3229269 + 1), 11)[:2] == (552, 858)
    assert tilemath.tile_scale(11) ** 2 * aggregate.ACRES == pytest.approx(1.44374266645)
    size = tilemath.WORLD / 2**8
    bounds = (43 * size - tilemath.HALF, tilemath.HALF - 68 * size, 44 * size - tilemath.HALF, tilemath.HALF - 67 * size)
    low_x, low_y, high_x, high_y = tilemath.tile_index_range(bounds, 11, tolerance=1e-3)
    assert (high_x - low_x, high_y - low_y) == (7, 7)
    assert tilemath.intersect((0, 0, 3, 3), (2, 1, 5, 2)) == (2, 1, 3, 2) and tilemath.intersect((0, 0, 1, 1), (2, 2, 3, 3)) is None
    assert tilemath.unite((0, 0, 3, 3), (2, 1, 5, 2)) == (0, 0, 5, 3)
    assert len(tilemath.quadrants((-tilemath.HALF, -tilemath.HALF, tilemath.HALF * 0.999, tilemath.HALF), 7)) >= 9


def test_colours(spark):
    assert colors.hex_to_rgba("#123456") == (18, 52, 86, 255) and colors.hex_to_rgba("f") == (255, 255, 255, 255) and colors.hex_to_rgba("abc", 7) == (171, 202, 188, 7)
    for wrong in ("abcd", "zz", "", "1-"):
        with pytest.raises(RasterException):
            colors.hex_to_rgba(wrong)
    texts = ["#7", "a1", "##abc", "01A2b3", "abcd", "zz"]
    got = [r[:3] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(*colors.hex_columns(F.col("t"))).collect()]
    assert got == [colors.hex_to_rgba(t)[:3] for t in texts[:4]] + [(None, None, None)] * 2
    norms = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "n double")
    assert [r[0] for r in norms.select(colors.channel(F.col("n"), 50, 40)).collect()] == [50, 45, 40]
    assert [r[0] for r in norms.select(colors.channel(F.col("n"), 0, 40, 10)).collect()] == [0, 10, 40]


def test_catalog(spark):
    legends = spark.createDataFrame([(1, "Algebra", '[{"name":"a","expression":"2","color":"#123456"}]')], "legend_id int, title string, json string")
    assert catalog.resolve_colormap(legends, legend="algebra") == {"2": (18, 52, 86, 255)} == catalog.resolve_colormap(legends, legend="1")
    assert catalog.resolve_colormap(legends)["continuous"] and catalog.resolve_colormap(legends, colormap={"3": "f", "4": "0"}, entries={1}) == {"4": (0, 0, 0, 255)}
    catalog.set_session_colormap("s", "mine", {"9": (1, 2, 3, 4)})
    assert catalog.resolve_colormap(legends, legend="mine", session="s") == {"9": (1, 2, 3, 4)}
    with pytest.raises(RasterException):
        catalog.resolve_colormap(legends, legend="nothing")
    known = spark.createDataFrame([(1, "rasters/x.tif", 5, 11), (2, "rasters/y.tif", 6, 9)], "layer_id int, rasterfile string, nodata int, max_zoom int")
    done = catalog.ingest_fingerprint(known).where("layer_id = 1").select("layer_id", "fingerprint", F.lit(5).alias("state"))
    assert [r.layer_id for r in catalog.to_ingest(known, done).collect()] == [2]
    assert catalog.find_layers(known, "y").first().layer_id == 2 and catalog.default_zoom(known, True).first().zoom == 9
    assert layers.parse_layers("a=1,b:2=3") == {"a": (1, 0), "b": (3, 2)}
    with pytest.raises(RasterException):
        layers.parse_layers("x:0=1,x:1=2")


def test_files_round_trip(spark, tmp_path):
    band = np.arange(9, dtype=np.float64).reshape(3, 3)
    tiff = images.encode_tiff([band, band * 2], (500000.0, 400000.0), (100.0, -100.0), 8.0)
    (tmp_path / "a.tif").write_bytes(tiff)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as archive:
        archive.writestr("readme.txt", "no raster")
        archive.writestr("grid.asc", "ncols 2\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 5\nNODATA_value -9\n1 2\n-9 4\n")
    pixels = rasterfile.read_rasters(spark, str(tmp_path)).cache()
    got = {(r.path[-5:], r.band, r.gx, r.gy): r.value for r in pixels.collect()}
    assert got["a.tif", 1, 2, 1] == 10 and got["b.zip", 0, 0, 1] == -9 and len(got) == 22
    meta = {r.path[-5:]: r for r in rasterfile.raster_metadata(pixels).collect()}
    assert (meta["a.tif"].numbands, meta["a.tif"].scale_y, meta["b.zip"].origin_y, meta["a.tif"].nodata) == (2, -100.0, 30.0, 8.0)
    made = pyramid.create_tiles(pixels.where("band = 0 and nodata = 8.0"), 1, 2, 0.0)
    assert made.where("tilez = 1").count() == 4
    pyramid.write_tiles(made, str(tmp_path / "tiles"), 7)
    assert spark.read.parquet(str(tmp_path / "tiles")).where("layer_id = 7 and tilez = 1").count() == 4
    with pytest.raises(RasterException):
        rasterfile.checked_path("ftp://x/y.tif")
    assert rasterfile.checked_path("s3://bucket/key") == "s3a://bucket/key"
    assert rasterfile.s3_options() == {"fs.s3a.requester.pays.enabled": "true"}
    assert rasterfile.s3_options(Settings(s3_endpoint="http://store:9000"))["fs.s3a.endpoint"] == "http://store:9000"


def test_images_and_export(spark):
    png = images.encode_png(np.full((2, 2, 4), 7))
    at = png.index(b"IDAT") + 4
    assert zlib.decompress(png[at : at + int.from_bytes(png[at - 8 : at - 4], "big")]) == (b"\0" + b"\7" * 8) * 2
    rgba = spark.createDataFrame([(0, 0, 0, [1] * 4, [2] * 4, [3] * 4, [255] * 4)], "tilez int, tilex int, tiley int, r array<int>, g array<int>, b array<int>, a array<int>")
    assert images.png_tiles(rgba, 2).first().png[:4] == b"\x89PNG"
    mosaic = pyramid.mosaic(tiles(spark, range(4)), (0, 0, 1, 1), 0, 2)
    now = datetime(2024, 3, 5, 7, 9)
    shades = {"continuous": True, "from": (0, 0, 0, 255), "to": (255, 255, 255, 255), "range": (0.0, 5.0)}
    name, raw = images.export_archive(mosaic, (0, 0, 1, 1), 2, (0.0, 0.0), (1.0, -1.0), "x * 2", shades, "My Änd (1)/x", 3, {"x": (5, "Rain")}, (-1, 2, 3, 4), "http://h/e", "Some words.", now=now)
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        names = archive.namelist()
        grid = rasterfile.decode(archive.read(names[0])).bands[0]
        colours, readme = archive.read("COLORMAP.txt").decode(), archive.read("README.txt").decode()
    assert name == "algebra_export_my-and-1x_2024_03_05_07_09.zip" and names == [name[:-3] + "tif", "README.txt", "COLORMAP.txt"]
    assert grid.tolist() == [[0, 1, 0, 0], [2, 3, 0, 0], [0] * 4, [0] * 4]
    assert colours.splitlines() == ["# Raster Algebra Colormap", "INTERPOLATION: CONTINUOUS", "from,0,0,0,255,from", "to,255,255,255,255,to", "range,0.0,5.0,range"] and shades["continuous"]
    assert images.colormap_text({"2": (1, 2, 3, 4)}).splitlines()[1:] == ["INTERPOLATION: DISCRETE", "2,1,2,3,4,2"]
    assert all(x in readme for x in ("x * 2", "Zoom: 3", "x: 0 - 1", "-1,2,3,4", "http://h/e", '5 "Rain" (in the formula: x)', "Some words.", "2024-03-05 at 07:09"))
    assert images.export_name("", now) == "algebra_export_2024_03_05_07_09" and len(images.slug("a" * 300)) == 100
    half = tilemath.HALF
    assert images.export_range([(-half * 0.9, 0.1, -1, half * 0.9), (1, -half * 0.9, half * 0.9, -1)], [1, 2]) == (2, (0, 0, 3, 3))
    assert images.export_range([], [4], 1, (-170, -80, -10, -10)) == (1, (0, 1, 0, 1))
    with pytest.raises(RasterException):
        pyramid.mosaic(tiles(spark, range(4)), (0, 0, 99999, 99999), 0, 256)


def test_reproject_and_lookup(spark):
    source = spark.createDataFrame([(c, r, float(r * 2 + c)) for r in range(2) for c in range(2)], "col int, row int, value double")
    x, y = tilemath.mercator(F.col("lon"), F.col("lat"))
    target = spark.createDataFrame([(-90.0, 40.0), (90.0, -40.0), (10.0, 84.0)], "lon double, lat double").select("lon", x.alias("x"), y.alias("y"))
    got = {r.lon: r.value for r in pyramid.reproject(source, 2, 2, (-180, -80, 180, 80), target).collect()}
    assert got == {-90.0: 0.0, 90.0: 3.0, 10.0: None}
    points = spark.createDataFrame([(-tilemath.HALF, tilemath.HALF), (tilemath.HALF, -tilemath.HALF), (tilemath.HALF * 2, 0.0)], "x double, y double")
    assert sorted(r.value for r in layers.pixel_lookup(points, tiles(spark, range(4)), 0, 2).collect()) == [0.0, 3.0]


def test_streams(spark, tmp_path):
    from gridloom.streaming.ingest import running_counts, running_statistics, store_stream

    shape = "layer_id int, tilez int, tilex int, tiley int, data array<double>"
    spark.createDataFrame([(1, 0, 0, 0, [1.0, 2.0, 0.0, 2.0]), (1, 1, 0, 0, [2.0, 5.0, 5.0, None])], shape).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
    for name, df in (("counts", running_counts(stream(), 0.0)), ("stats", running_statistics(stream(), 0.0))):
        started = df.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        started.awaitTermination(120)
    assert {r.value: r["count"] for r in spark.table("counts").collect()} == {1.0: 1, 2.0: 3, 5.0: 2}
    assert spark.table("stats").first().t0 == 6
    store_stream(stream(), str(tmp_path / "out"), 1, str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_micro_batches_and_bands_add_up(spark, tmp_path):
    from gridloom.streaming.ingest import store_stream

    shape = "tilez int, tilex int, tiley int, data array<double>"
    arrive = lambda x: spark.createDataFrame([(0, x, 0, [1.0]), (1, x, 0, [2.0])], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = lambda: sorted((r.band, r.tilez, r.tilex) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    arrive(0)
    arrive(1)
    store_stream(stream(), str(tmp_path / "out"), 1, str(tmp_path / "check")).awaitTermination(120)
    assert kept() == [(0, z, x) for z in (0, 1) for x in (0, 1)]
    arrive(2)
    store_stream(stream(), str(tmp_path / "out"), 1, str(tmp_path / "check")).awaitTermination(120)
    store_stream(stream(), str(tmp_path / "out"), 1, str(tmp_path / "check 1"), band=1).awaitTermination(120)
    assert kept() == [(b, z, x) for b in (0, 1) for z in (0, 1) for x in range(3)]


def test_a_batch_that_runs_again_replaces_itself_and_bands_stay(spark, tmp_path):
    tiles = spark.createDataFrame([(0, 0, 0, [1.0]), (1, 0, 0, [2.0])], "tilez int, tilex int, tiley int, data array<double>")
    for batch in ("a-0", "a-1", "a-1"):
        pyramid.write_tiles(tiles, str(tmp_path / "batches"), 1, 0, batch)
    assert spark.read.parquet(str(tmp_path / "batches")).count() == 4
    for band in (0, 1, 1):
        pyramid.write_tiles(tiles, str(tmp_path / "bands"), 1, band)
    assert sorted((r.band, r.tilez) for r in spark.read.parquet(str(tmp_path / "bands")).collect()) == [(b, z) for b in (0, 1) for z in (0, 1)]


def tiff(order, big, tags):
    """A TIFF of tags (tag, type letter, values), with ``blocks`` of bytes as strips or tiles."""
    size, number = ("Q", 8) if big else ("I", 4)
    blocks = next(v for t, k, v in tags if k == "blocks")
    head = 16 if big else 8
    step, count = (20, 8) if big else (12, 2)
    free = head + sum(map(len, blocks))
    starts = [head + sum(map(len, blocks[:i])) for i in range(len(blocks))]
    rows, tail = b"", b""
    entries = [(t, size, starts) if k == "blocks" else (t, k, v) for t, k, v in tags]
    body = free + count + step * len(entries) + number
    for tag, kind, values in entries:
        raw = values if kind == "s" else struct.pack(f"{order}{len(values)}{kind}", *values)
        held = raw.ljust(number, b"\0") if len(raw) <= number else struct.pack(order + size, body + len(tail))
        tail += raw if len(raw) > number else b""
        rows += struct.pack(order + "HH" + size, tag, {"s": 2, "H": 3, "I": 4, "d": 12, "Q": 16}[kind], len(values)) + held
    start = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, free) if big else struct.pack(order + "HI", 42, free))
    return start + b"".join(blocks) + struct.pack(order + ("Q" if big else "H"), len(entries)) + rows + struct.pack(order + size, 0) + tail


def lzw(data):
    """A plain encoder of the same codes."""
    bits, table, width, word = [], {bytes([b]): b for b in range(256)}, 9, b""
    put = lambda code, w: bits.append(format(code, f"0{w}b"))
    put(256, 9)
    number = 258
    for byte in data:
        longer = word + bytes([byte])
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer], number = number, number + 1
        width = min(12, max(9, number.bit_length()))
        if number == 4094:
            put(256, 12)
            table, width, number = {bytes([b]): b for b in range(256)}, 9, 258
        word = bytes([byte])
    put(table[word], width)
    number += 1
    put(257, min(12, max(9, number.bit_length())))
    text = "".join(bits)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8))


@pytest.mark.parametrize("order, big, packing, predictor, tiled, planar", [
    ("<", False, 1, 1, False, 1), (">", False, 5, 2, False, 1), ("<", True, 8, 2, True, 1), (">", True, 5, 1, True, 2), ("<", False, 8, 1, False, 2)])
def test_tiffs_of_strips_and_tiles(order, big, packing, predictor, tiled, planar):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 60000, (2, 37, 45)).astype(np.uint16) // rng.integers(1, 900, (2, 1, 1)).astype(np.uint16)
    wide, high = (16, 32) if tiled else (45, 10)
    blocks = []
    for part in ([image] if planar == 1 else [image[:1], image[1:]]):
        for top in range(0, 37, high):
            for left in range(0, 45, wide):
                block = part[:, top : top + high, left : left + wide]
                if tiled:
                    block = np.pad(block, ((0, 0), (0, high - block.shape[1]), (0, wide - block.shape[2])))
                block = block.transpose(1, 2, 0)
                if predictor == 2:
                    block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
                raw = block.astype(order + "u2").tobytes()
                blocks.append({1: raw, 5: lzw(raw), 8: zlib.compress(raw)}[packing])
    layout = [(322, "H", [wide]), (323, "H", [high]), (324, "blocks", blocks), (325, "I", [len(b) for b in blocks])] if tiled else [(273, "blocks", blocks), (278, "H", [high]), (279, "I", [len(b) for b in blocks])]
    keys = [1, 1, 0, 1, 3072, 0, 1, 3857]
    tags = sorted([(256, "H", [45]), (257, "I", [37]), (258, "H", [16, 16]), (259, "H", [packing]), (277, "H", [2]), (284, "H", [planar]), (317, "H", [predictor]), (339, "H", [1, 1]), *layout,
                   (33550, "d", [2.0, 3.0, 0.0]), (33922, "d", [1.0, 1.0, 0.0, 100.0, 200.0, 0.0]), (34735, "H", keys), (42113, "s", b"7\0")])
    got = rasterfile.decode(tiff(order, big, tags))
    assert np.array_equal(np.array(got.bands), image) and (got.nodata, got.origin, got.scale, got.srid) == (7.0, (98.0, 203.0), (2.0, -3.0), 3857)


def test_odd_tiffs():
    for raw in (b"II*\0", b"MM\0\x07aaaabbbb", tiff("<", False, [(256, "H", [1]), (259, "H", [7]), (273, "blocks", [b"x"])])):
        with pytest.raises(RasterException):
            rasterfile.decode(raw)


def test_ingest_of_a_file_in_degrees(spark, tmp_path):
    from gridloom.sources import ingest, tilestore

    band = np.arange(64, dtype=np.float64).reshape(8, 8)
    (tmp_path / "a.tif").write_bytes(images.encode_tiff([band, band + 100], (0.0, 40.0), (5.0, -5.0), 9.0))
    pixels = rasterfile.read_rasters(spark, str(tmp_path / "a.tif"))
    store, called = str(tmp_path / "store"), []
    for _ in range(2):
        ingest.ingest(spark, 4, pixels, store, srid=4326, nodata=3.0, store_reprojected=True, tile_size=4, done=called.append)
    assert called == [4, 4]
    (state,) = ingest.parse_status(spark, store).collect()
    source = ingest.source_of(pixels, 4326)
    top = source.max_zoom(tile_size=4)
    assert (state.layer_id, state.state) == (4, 5) and state.tile_levels == [top] and top == source.max_zoom(next_higher=False, tile_size=4) + 1
    (meta,) = spark.read.parquet(store + "/metadata").collect()
    assert (meta.width, meta.numbands, meta.srid, meta.max_zoom, meta.layer_id) == (8, 2, 4326, top, 4)
    bands = {r.band: r for r in spark.read.parquet(store + "/bands").collect()}
    assert (bands[0].min, bands[0].max, bands[1].min, bands[1].nodata_value, sum(bands[1].hist_values)) == (0, 63, 100, 3.0, 64)
    tiles = tilestore.read_tiles(spark, store + "/tiles", 4, 0)
    metres = tilemath.tile_scale(top, 4)
    want = {}
    for tx in range(4 * 2**top):
        for ty in range(4 * 2**top):
            lon, lat = tilemath.project((tx + 0.5) * metres - tilemath.HALF, tilemath.HALF - (ty + 0.5) * metres, 3857, 4326)
            column, row = math.floor(lon / 5), math.floor((40 - lat) / 5)
            if 0 <= column < 8 and 0 <= row < 8 and band[row, column] != 3:
                want[tx, ty] = band[row, column]
    opened = layers.pixels_from_tiles(tiles.where(F.col("tilez") == top), 4).where("value is not null").collect()
    assert {(r.tilex * 4 + r.px, r.tiley * 4 + r.py): r.value for r in opened} == want
    kept = spark.read.parquet(store + "/reprojected").where("band = 1")
    assert kept.where("value != 103").count() == len(want) and kept.where("value = 103").count() > 0
    (deepest,) = tiles.where(F.col("tilez") == top).limit(1).collect()
    child = tilestore.tile_at(tiles, top + 2, deepest.tilex * 4 + 1, deepest.tiley * 4 + 2, 4)
    assert child == [deepest.data[2 * 4 + 1]] * 16 and tilestore.tile_at(tiles.where("tilez > 0"), 0, 0, 0, 4) is None
    assert tilestore.drop_tiles(spark, store + "/tiles", 4) and not tilestore.drop_tiles(spark, store + "/tiles", 4)
    with pytest.raises(RasterException):
        ingest.ingest(spark, 5, pixels, store, srid=27700, tile_size=4)
    assert {r.layer_id: r.state for r in ingest.parse_status(spark, store).collect()} == {4: 5, 5: 6}
    with pytest.raises(RasterException):
        ingest.ingest(spark, 6, pixels.limit(0), store)


def test_aggregator_arguments(spark):
    scale = tilemath.tile_scale(1, 2)
    two = tiles(spark, [1, 2, 2, 0]).unionByName(tiles(spark, [5, 5, 5, 5]).withColumn("tilez", F.lit(1)))
    layer = {"x": Layer(two, 0.0)}
    counts = lambda **k: {r.value: r["count"] for r in aggregate.Aggregator(layer, "x", 2, grouping="discrete", **k).value_count().collect()}
    assert counts() == {5.0: 4} and counts(zoom=0) == {1.0: 1, 2.0: 2} and counts(zoom=7) == {}
    tiny = [(-tilemath.HALF + scale * a, tilemath.HALF - scale * b) for a, b in ((0.1, 0.1), (0.2, 0.1), (0.2, 0.2))]
    assert counts(geom=tiny, acres=False) == {5.0: 1} and counts(geom=tiny, acres=False, all_touched=False) == {}
    assert counts(geom=tiny) == {5.0: pytest.approx(scale**2 * aggregate.ACRES)}
    degrees = [tilemath.project(*p, 3857, 4326) for p in tiny]
    assert counts(geom=[degrees], srid=4326, acres=False) == {5.0: 1}
    far = [(x + tilemath.WORLD * 3, y) for x, y in tiny]
    assert counts(geom=far) == {}
    legends = spark.createDataFrame([(3, json.dumps([{"name": "five", "expression": "x > 4"}]))], "legend_id int, json string")
    for key in (3, "3"):
        assert [tuple(r) for r in aggregate.Aggregator(layer, "x", 2, grouping=key, legends=legends).value_count().collect()] == [("five", 4)]
    for wrong in (4, "4"):
        with pytest.raises(RasterAggregationException):
            aggregate.Aggregator(layer, "x", 2, grouping=wrong, legends=legends)
    assert [tuple(r) for r in aggregate.layer_value_count(layer["x"], 2).collect()] == [(5.0, 4)]
    with pytest.raises(TypeError):
        aggregate.layer_value_count(layer["x"], 2, "co")
