"""Windowed scans, web sources, projections, warps and versioned ingests."""

import http.server
import os
import re
import struct
import threading
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.errors import RasterException
from gridloom.functions import projection, tilemath
from gridloom.operators import catalog, layers, pyramid
from gridloom.sources import images, ingest, rasterfile, tilestore, warp, windows
from gridloom.sources.source import Source


def big_tiff(path, width, height, tile, value, packing=8):
    """A BigTIFF of float32 tiles, written tile by tile; ``value(rows, columns)`` gives the pixels."""
    across, down = -(-width // tile), -(-height // tile)
    places = []
    with open(path, "wb") as out:
        out.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, 0))
        for row in range(down):
            for column in range(across):
                ys, xs = np.mgrid[row * tile : (row + 1) * tile, column * tile : (column + 1) * tile]
                raw = value(ys, xs).astype("<f4").tobytes()
                raw = zlib.compress(raw, 1) if packing == 8 else raw
                places.append((out.tell(), len(raw)))
                out.write(raw)
        arrays = {}
        for name, numbers in (("starts", [p[0] for p in places]), ("sizes", [p[1] for p in places])):
            arrays[name] = out.tell()
            out.write(struct.pack(f"<{len(numbers)}Q", *numbers))
        arrays["scale"] = out.tell()
        out.write(struct.pack("<3d", 2.0, 2.0, 0.0))
        arrays["tie"] = out.tell()
        out.write(struct.pack("<6d", 0, 0, 0, 1000.0, 9000.0, 0))
        at, n = out.tell(), len(places)
        tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 32), (259, 3, 1, packing), (277, 3, 1, 1), (322, 3, 1, tile), (323, 3, 1, tile),
                (324, 16, n, arrays["starts"] if n > 1 else places[0][0]), (325, 16, n, arrays["sizes"] if n > 1 else places[0][1]), (339, 3, 1, 3), (33550, 12, 3, arrays["scale"]), (33922, 12, 6, arrays["tie"])]
        out.write(struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", *t) for t in tags) + struct.pack("<Q", 0))
        out.seek(8)
        out.write(struct.pack("<Q", at))


def test_a_large_tiff_is_read_by_windows(spark, tmp_path):
    path = str(tmp_path / "big.tif")
    big_tiff(path, 2100, 1500, 256, lambda y, x: x * 3 + y)
    blocks = windows.read_blocks(spark, path, pixels=1 << 17)
    # Two tiles of 256 pixels make a window, and no row holds more than a tile.
    assert blocks.rdd.getNumPartitions() == 27
    got = blocks.agg(F.max(F.size("data")).alias("most"), F.sum(F.size("data")).alias("all"), F.count("*").alias("n"), F.max("origin_y").alias("y")).first()
    assert tuple(got) == (256 * 256, 2100 * 1500, 54, 9000.0)
    pixels = windows.pixels_of_blocks(blocks)
    assert pixels.where(F.col("value") != F.col("gx") * 3 + F.col("gy")).count() == 0 and pixels.select("gx", "gy").distinct().count() == 2100 * 1500
    part = windows.read_blocks(spark, path, box=(300, 260, 600, 270), pixels=1 << 16)
    assert part.rdd.getNumPartitions() == 2
    seen = windows.pixels_of_blocks(part).agg(F.min("gx"), F.max("gx"), F.min("gy"), F.max("gy"), F.count("*")).first()
    assert tuple(seen) == (300, 600, 260, 270, 301 * 11)


@pytest.mark.parametrize("nodata", [None, -3.0])
@pytest.mark.parametrize("box, kept", [((1, 0, 3, 2), "tilex != 2"), ((1, 0, 1, 0), "true"), ((1, 0, 2, 0), "false")])
def test_a_tiff_written_by_tasks_leaves_out_empty_tiles(spark, tmp_path, monkeypatch, nodata, box, kept):
    monkeypatch.setattr(images, "PACKED", 2 * 8 * 16)
    rows = spark.range(400).select(F.lit(0).alias("tilez"), *[F.floor(c / 4).cast("int").alias(n) for c, n in ((F.col("id") % 20, "tilex"), (F.floor(F.col("id") / 20), "tiley"))], (F.col("id") % 4).alias("px"),
                                   (F.floor(F.col("id") / 20) % 4).alias("py"), F.when(F.col("id") % 7 != 0, F.col("id").cast("double")).alias("value")).where(f"px != 3 and {kept}")
    empty = 0.0 if nodata is None else nodata
    want = np.full((20, 20), empty)
    for r in rows.where("value is not null").collect():
        want[r.tiley * 4 + r.py, r.tilex * 4 + r.px] = r.value
    want = want[box[1] * 4 : box[3] * 4 + 4, box[0] * 4 : box[2] * 4 + 4]
    for name, tiles in (("whole", layers.tiles_from_pixels(rows, 4)), ("sparse", layers.sparse_from_pixels(rows, 4, {"data": "value"}))):
        path = str(tmp_path / f"{name}.tif")
        images.write_tiff(tiles, box, 4, path, (100.0, 900.0), (2.0, -2.0), nodata)
        found = rasterfile.decode((tmp_path / f"{name}.tif").read_bytes())
        assert np.array_equal(found.bands[0], want) and (found.nodata, found.origin, found.scale) == (nodata, (100.0, 900.0), (2.0, -2.0))
        assert os.listdir(tmp_path).count(f"{name}.tif.packed") == 0
        blocks = windows.pixels_of_blocks(windows.read_blocks(spark, path, pixels=40))
        assert sorted((r.gy, r.gx, r.value) for r in blocks.collect()) == [(y, x, v) for (y, x), v in np.ndenumerate(want)]
        few = windows.read_pixels(spark, path, empty, pixels=40, box=(1, 0, 9, 6))
        assert sorted(few.collect()) == sorted(blocks.where(f"value != {empty} and gx between 1 and 9 and gy <= 6").collect()) and few.columns == blocks.columns


def test_one_strip_of_a_whole_raster_is_unpacked_in_pieces(spark, tmp_path, monkeypatch):
    band = np.arange(600 * 400, dtype=np.float64).reshape(600, 400)
    (tmp_path / "a.tif").write_bytes(images.encode_tiff([band, -band], (0.0, 0.0), (1.0, -1.0), 7.0))
    blocks = windows.read_blocks(spark, str(tmp_path), pixels=8000)
    assert blocks.agg(F.max("height")).first()[0] == 20
    assert windows.pixels_of_blocks(blocks).where(F.abs("value") != F.col("gy") * 400 + F.col("gx")).count() == 0
    only = windows.read_blocks(spark, str(tmp_path), band=1, nodata=-5.0)
    assert {tuple(r) for r in only.select("band", "nodata").distinct().collect()} == {(1, -5.0)} and only.rdd.getNumPartitions() == 1
    monkeypatch.setattr(rasterfile, "CHUNK", 1000)
    assert np.array_equal(rasterfile.decode((tmp_path / "a.tif").read_bytes()).bands[1], -band)


def test_floating_point_differences():
    rng = np.random.default_rng(1)
    image = rng.normal(size=(5, 8)).astype(">f4")
    spread = image.view(np.uint8).reshape(5, 8, 4).transpose(0, 2, 1).reshape(5, 32)
    raw = np.concatenate([spread[:, :1], np.diff(spread, axis=1)], axis=1).astype(np.uint8).tobytes()
    layout = rasterfile.Layout(8, 5, 1, "<f4", 8, 3, False, False, 8, 5, None, (0.0, 0.0), (1.0, -1.0), None)
    packed = zlib.compress(raw)
    rows = [part for _, part in rasterfile.block_rows(rasterfile.fetch_of(packed), layout, 0, 0, len(packed), 16)]
    assert len(rows) == 3 and np.array_equal(np.concatenate(rows)[:, :, 0], image)


@pytest.fixture
def server(tmp_path):
    """A web server over tmp_path that knows ranges below /ranges and sends all else as a whole."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            kind, _, name = self.path.lstrip("/").partition("/")
            file = tmp_path / name
            if not name or not file.exists():
                return self.send_error(404)
            raw, wanted = file.read_bytes(), re.fullmatch(r"bytes=(\d+)-(\d+)", self.headers.get("Range") or "")
            if kind == "ranges" and wanted:
                start, end = int(wanted[1]), min(int(wanted[2]), len(raw) - 1)
                asked.append(end - start + 1)
                self.send_response(206)
                self.send_header("Content-Range", f"bytes {start}-{end}/{len(raw)}")
                raw = raw[start : end + 1]
            else:
                self.send_response(200)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_):
            pass

    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", asked
    made.shutdown()
    made.server_close()


def test_web_sources(spark, tmp_path, server):
    url, asked = server
    big_tiff(str(tmp_path / "a.tif"), 600, 500, 128, lambda y, x: x + 1000 * y, packing=1)
    for kind in ("ranges", "plain"):
        pixels = rasterfile.read_rasters(spark, f"{url}/{kind}/a.tif")
        assert pixels.count() == 300_000 and pixels.where(F.col("value") != F.col("gx") + 1000 * F.col("gy")).count() == 0
    asked.clear()
    one = windows.read_blocks(spark, f"{url}/ranges/a.tif", box=(0, 0, 5, 5))
    assert one.agg(F.sum(F.size("data"))).first()[0] == 36 and sum(asked) < 128 * 128 * 4 + 20_000
    (tmp_path / "b.asc").write_text("ncols 2\nnrows 1\ncellsize 1\n5 6\n")
    assert sorted(r.value for r in rasterfile.read_rasters(spark, f"{url}/ranges/b.asc").collect()) == [5, 6]
    for wrong in ("/ranges/none.tif", "/plain/none.tif"):
        with pytest.raises(RasterException, match="404"):
            rasterfile.read_rasters(spark, url + wrong)
    with pytest.raises(RasterException, match="cannot be read"):
        rasterfile.read_rasters(spark, "http://127.0.0.1:9/x.tif")


@pytest.mark.parametrize("srid, lons, lats", [(32633, (12, 18), (0, 84)), (32733, (12, 18), (-80, 0)), (26917, (-84, -78), (20, 60)), (3086, (-88, -79), (24, 32)), (5070, (-125, -66), (24, 50)), (3577, (112, 155), (-45, -9))])
def test_projections_round_trip_within_a_millimetre(spark, srid, lons, lats):
    lon, lat = (a.ravel() for a in np.meshgrid(np.linspace(*lons, 40), np.linspace(*lats, 40)))
    x, y = projection.transform(lon, lat, 4326, srid, np)
    back = projection.transform(x, y, srid, 4326, np)
    assert max(np.abs(back[0] - lon).max(), np.abs(back[1] - lat).max()) * 111_320 < 1e-3
    assert projection.transform(float(lon[7]), float(lat[7]), 4326, srid) == pytest.approx((x[7], y[7]), abs=1e-6)
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x[:50], y[:50])], "x double, y double")
    got = frame.select(*projection.transform(F.col("x"), F.col("y"), srid, 4326, F)).collect()
    assert np.abs(np.array(got) - np.array([lon[:50], lat[:50]]).T).max() < 1e-8


def test_known_places():
    # A tower in Toronto, published to the metre.
    assert projection.transform(-(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600, 4326, 32617) == pytest.approx((630084, 4833438), abs=1)
    assert projection.transform(-84, 24, 4326, 3086) == pytest.approx((400000, 0), abs=1e-6)
    assert projection.transform(15, 0, 4326, 32633) == pytest.approx((500000, 0), abs=1e-6) and projection.transform(15, 0, 4326, 32733)[1] == pytest.approx(1e7)
    with pytest.raises(RasterException):
        projection.transform(0, 0, 27700, 3857)


def plain_warp(values, source, zoom, top, tile_size):
    """Every pixel of a zoom whose source pixel exists, by plain numbers."""
    low_x, low_y, high_x, high_y = tilemath.tile_index_range(source.extent(), top, 1e-6)
    ratio, metres, found = 2 ** (top - zoom), tilemath.tile_scale(top, tile_size), {}
    for fx in range(low_x * tile_size, (high_x + 1) * tile_size):
        for fy in range(low_y * tile_size, (high_y + 1) * tile_size):
            if fx % ratio == ratio // 2 and fy % ratio == ratio // 2:
                x, y = tilemath.project((fx + 0.5) * metres - tilemath.HALF, tilemath.HALF - (fy + 0.5) * metres, 3857, source.srid)
                column, row = int(np.floor((x - source.origin[0]) / source.scale[0])), int(np.floor((y - source.origin[1]) / source.scale[1]))
                if 0 <= column < source.width and 0 <= row < source.height and values[row, column] != -1:
                    found[fx // ratio, fy // ratio] = values[row, column]
    return found


@pytest.mark.parametrize("source", [Source(45, 38, (-30.0, 60.0), (1.0, -1.0), 4326), Source(45, 38, (430_000.0, 6_400_000.0), (3_000.0, -3_000.0), 32633), Source(30, 30, (700_000.0, 700_000.0), (-9_000.0, -9_000.0), 3086), Source(40, 40, (-5e5, 5e5), (2e4, -2e4), 3857)])
def test_blocks_warp_as_pixels_do(spark, source):
    values = np.arange(source.width * source.height, dtype=float).reshape(source.height, source.width)
    values[3, 4], values[5, 6] = -1, np.nan
    rows = [(x, y, float(values[y, x])) for y in range(source.height) for x in range(source.width)]
    blocks = warp.blocks_of_pixels(spark.createDataFrame(rows, "gx int, gy int, value double"), 16)
    top = source.max_zoom(tile_size=16)
    made = warp.tiles_of_blocks(blocks, source, top, 16, -1.0)
    got = {}
    for r in layers.pixels_from_tiles(made, 16).where("value is not null").collect():
        got.setdefault(r.tilez, {})[r.tilex * 16 + r.px, r.tiley * 16 + r.py] = r.value
    for zoom in range(top + 1):
        want = plain_warp(values, source, zoom, top, 16)
        assert got.get(zoom, {}).keys() == want.keys()
        assert all(v == want[k] or (np.isnan(v) and np.isnan(want[k])) for k, v in got.get(zoom, {}).items())
    plan = made._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_one_pass_makes_all_zooms(spark):
    source = spark.range(64 * 64).select((F.col("id") % 64).cast("int").alias("gx"), F.floor(F.col("id") / 64).cast("int").alias("gy"), F.col("id").cast("double").alias("value"))
    plan = pyramid.create_tiles(source, 5, 4, None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and plan.count("Exchange") == 1
    counts = {r.tilez: r.n for r in pyramid.create_tiles(source, 5, 4, None, range(2, 5)).groupBy("tilez").agg(F.count("*").alias("n")).collect()}
    assert counts == {4: 64, 3: 16, 2: 4}
    assert pyramid.create_tiles(source, 5, 4, None, range(0)).count() == 0


def scanned_rows(frame):
    """Rows that the file scan of a collected plan gave out."""
    frame.collect()
    leaf = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_a_read_of_one_tile_skips_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pyramid, "ROW_GROUP", 1 << 20)
    tiles = spark.range(48 * 48).select(F.lit(7).alias("tilez"), (F.col("id") % 48).cast("int").alias("tilex"), F.floor(F.col("id") / 48).cast("int").alias("tiley"), F.transform(F.sequence(F.lit(1), F.lit(1024)), lambda k: F.rand(5) + k).alias("data"))
    pyramid.write_tiles(tiles, str(tmp_path), 1)
    one = tilestore.read_tiles(spark, str(tmp_path), 1, zoom=7, box=(11, 13, 11, 13))
    assert one.count() == 1 and scanned_rows(one) <= 48 * 48 / 4
    assert "PushedFilters: [IsNotNull(tilex), IsNotNull(tiley), GreaterThanOrEqual(tilex,11)" in one._jdf.queryExecution().executedPlan().toString()
    curve = spark.range(64).select(tilemath.morton(F.col("id") % 8, F.floor(F.col("id") / 8)).alias("m"), (F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y")).collect()
    assert all(r.m == sum(((r.x >> k) & 1) << 2 * k | ((r.y >> k) & 1) << 2 * k + 1 for k in range(3)) for r in curve)


def test_a_tile_table_of_nearly_empty_tiles_is_read_in_bounded_memory(spark, tmp_path):
    rows = spark.range(100).select(F.lit(7).alias("tilez"), F.col("id").cast("int").alias("tilex"), F.lit(0).alias("tiley"), F.lit(5).alias("px"), F.lit(9).alias("py"), (F.col("id") + 0.5).alias("value"))
    whole, sparse = layers.tiles_from_pixels(rows, 256), layers.sparse_from_pixels(rows, 256, {"data": "value"})
    for name, tiles in (("whole", whole), ("sparse", sparse)):
        pyramid.write_tiles(tiles, str(tmp_path / name), 1)
        held = []
        for file in (tmp_path / name).rglob("*.parquet"):
            opened = pq.ParquetFile(file)
            held += [sum(map(len, opened.read_row_group(k).column("data").to_pylist())) for k in range(opened.num_row_groups)]
        # A reader opens a row group's arrays together; their pixels, not their bytes on disk, take its memory.
        assert max(held) <= pyramid.ROW_GROUP / 8 and (name == "whole" or sum(held) == 100)
        read = tilestore.read_tiles(spark, str(tmp_path / name), 1, zoom=7, box=(3, 0, 4, 0))
        assert sorted((r.tilex, len(r.data), r.data[9 * 256 + 5], sum(v is not None for v in r.data)) for r in read.collect()) == [(3, 65536, 3.5, 1), (4, 65536, 4.5, 1)]


def write(path, values):
    path.write_bytes(images.encode_tiff([np.full((8, 8), v) for v in values], (0.0, 40.0), (5.0, -5.0), 9.0))


def test_versions_of_a_layer(spark, tmp_path):
    store, file = str(tmp_path / "store"), tmp_path / "a.tif"
    write(file, [1.0, 2.0])

    def again(**options):
        ingest.ingest(spark, 1, windows.read_blocks(spark, str(file)), store, srid=4326, tile_size=4, **options)

    def zooms(band=0):
        return sorted({r.tilez for r in tilestore.read_tiles(spark, store + "/tiles", 1, band).collect()})

    again(max_zoom=3)
    assert zooms() == [1, 2, 3] == zooms(1)
    reader = tilestore.read_tiles(spark, store + "/tiles", 1)
    write(file, [5.0])
    again(max_zoom=1)
    assert zooms() == [1] and zooms(1) == [] and [r.band for r in spark.read.parquet(store + "/bands").collect()] == [0]
    assert reader.where("tilez = 3").count() > 0  # who began before the switch still has the old tiles
    kept = [r.data for r in tilestore.read_tiles(spark, store + "/tiles", 1).collect()]
    with pytest.raises(RasterException):
        ingest.ingest(spark, 1, windows.read_blocks(spark, str(file)), store, srid=27700, tile_size=4)
    broken = windows.read_blocks(spark, str(file)).withColumn("width", F.lit(3))
    with pytest.raises(Exception):  # noqa: B017, PT011 - any error of a task
        ingest.ingest(spark, 1, broken, store, srid=4326, tile_size=4)
    assert [r.data for r in tilestore.read_tiles(spark, store + "/tiles", 1).collect()] == kept
    assert ingest.parse_status(spark, store).first().state == catalog.STATES["FAILED"]
    again(max_zoom=2)
    sets = os.listdir(tmp_path / "store/tiles/_sets/layer_id=1")
    assert len(sets) == 2 and zooms() == [1, 2] and not any(files for *_, files in os.walk(tmp_path / "store/staged"))


def test_only_changed_layers_are_ingested(spark, tmp_path):
    from gridloom.config import Settings

    store, settings, read = str(tmp_path / "store"), Settings(tile_size=4), []
    for name, value in (("a", 1.0), ("b", 2.0)):
        write(tmp_path / f"{name}.tif", [value])

    def layers_of(*nodata):
        rows = [(k, str(tmp_path / f"{name}.tif"), n, 4326, 1) for k, (name, n) in enumerate(zip("abc", nodata))]
        return spark.createDataFrame(rows, "layer_id int, rasterfile string, nodata string, srid int, max_zoom int")

    assert ingest.ingest_changed(spark, layers_of("", "", ""), store, settings, read.append) == [0, 1] == read  # c.tif is missing
    states = {r.layer_id: r.state for r in ingest.parse_status(spark, store).collect()}
    assert states == {0: 5, 1: 5, 2: 6}
    write(tmp_path / "c.tif", [3.0])
    assert ingest.ingest_changed(spark, layers_of("", "2", ""), store, settings) == [1, 2]
    assert ingest.ingest_changed(spark, layers_of("", "2", ""), store, settings) == []
    assert tilestore.read_tiles(spark, store + "/tiles", 1).count() == 0 and tilestore.read_tiles(spark, store + "/tiles", 2).count() > 0


def polygons_of(spark, shapes):
    rows = [(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, rings in shapes.items()]
    return spark.createDataFrame(rows, "polygon_id int, rings array<array<struct<x:double,y:double>>>")


def even_odd(rings, x, y):
    hits = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            hits += (y1 > y) != (y2 > y) and x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1))
    return hits % 2 == 1


def test_cells_and_runs_cover_what_points_say(spark):
    from gridloom.functions import coverage

    rng = np.random.default_rng(4)
    shapes = {k: [[tuple(p) for p in rng.uniform(-20, 84, (int(n), 2))]] for k, n in enumerate(rng.integers(3, 9, 6))}
    shapes[7] = [[(-100, -100), (200, -100), (200, 200), (-100, 200)]]  # holds the whole grid; no side touches it
    shapes[8] = [[(90, 90), (95, 90), (95, 95)]]
    shapes[9] = [[(16, 16), (48, 16), (48, 48), (16, 48)], [(20, 20), (30, 20), (30, 30), (20, 30)]]
    shapes[10] = [[]]
    table = polygons_of(spark, shapes)
    want = {(k, x, y) for k, rings in shapes.items() for x in range(64) for y in range(64) if even_odd(rings, x + 0.5, y + 0.5)}
    assert {tuple(r) for r in coverage.covered_pixels(table, 3, 8).collect()} == want
    # Full cells are the largest that no side touches, and with partial tiles they hold every covered pixel once.
    cells = coverage.cover(table, 3, 8).collect()
    of = {}
    for r in cells:
        side = 64 >> r.level
        for x in range(r.cx * side, (r.cx + 1) * side):
            for y in range(r.cy * side, (r.cy + 1) * side):
                assert (r.polygon_id, x, y) not in of
                of[r.polygon_id, x, y] = r.full
    assert all(p in want for p, full in of.items() if full) and want <= set(of)
    assert [(r.level, r.full) for r in cells if r.polygon_id == 7] == [(0, True)] and not [r for r in cells if r.polygon_id in (8, 10)]
    data = rng.integers(0, 4, 64 * 64)
    rows = [(3, x // 8, y // 8, x % 8, y % 8, float(data[y * 64 + x]) if data[y * 64 + x] else None) for x in range(64) for y in range(64)]
    tiles = layers.tiles_from_pixels(spark.createDataFrame(rows, "tilez int, tilex int, tiley int, px int, py int, value double"), 8)
    counts = {}
    for k, x, y in want:
        if data[y * 64 + x]:
            counts[k, float(data[y * 64 + x])] = counts.get((k, float(data[y * 64 + x])), 0) + 1
    assert {(r.polygon_id, r.value): r["count"] for r in coverage.zonal_count(table, tiles, 8).collect()} == counts


def test_a_huge_polygon_opens_only_tiles_on_its_outline(spark):
    from gridloom.functions import coverage

    n = 256 * 2**12
    table = polygons_of(spark, {1: [[(10, 10), (n / 2, 10), (n / 2, n - 10), (10, n - 10)]]})
    cells = coverage.cover(table, 12, 256)
    full = cells.where("full").agg(F.sum(F.pow(F.lit(4.0), 12 - F.col("level"))).alias("tiles"), F.count("*").alias("cells")).first()
    # Sides run along the first tiles and along the border in the middle, which belongs to tiles of both sides.
    assert full.tiles == 2046 * 4094 and full.cells < 40_000
    assert cells.where("not full").count() == 2 * 4096 + 4096 + 2 * 2046
    tiles = spark.createDataFrame([(12, 700, 900, [1.0] * 16), (12, 0, 0, [2.0] * 16), (12, 3000, 5, [3.0] * 16)], "tilez int, tilex int, tiley int, data array<double>")
    met = coverage.tiles_of_polygons(table, tiles, 12, 256).collect()
    assert sorted((r.tilex, r.tiley, r.full) for r in met) == [(0, 0, False), (700, 900, True)]


def test_a_filter_equals_that_of_the_joined_mosaic(spark):
    from gridloom.operators import focal

    rng = np.random.default_rng(2)
    image = rng.integers(0, 255, (24, 24)).astype(float)
    image[rng.random((24, 24)) < 0.1] = np.nan
    rows = [(2, x // 8, y // 8, x % 8, y % 8, None if np.isnan(image[y, x]) else float(image[y, x])) for x in range(24) for y in range(24) if (x // 8, y // 8) != (1, 1)]
    tiles = layers.tiles_from_pixels(spark.createDataFrame(rows, "tilez int, tilex int, tiley int, px int, py int, value double"), 8)
    image[8:16, 8:16] = np.nan
    weights = ((1.0, 2.0, 0.0), (3.0, 4.0, 5.0), (0.0, 6.0, 7.0))
    got = {(r.tilex * 8 + r.px, r.tiley * 8 + r.py): r.value for r in layers.pixels_from_tiles(focal.focal_mean(tiles, 8, weights), 8).where("value is not null").collect()}
    wide = np.pad(image, 1, constant_values=np.nan)
    for y in range(24):
        for x in range(24):
            if np.isnan(image[y, x]):
                assert (x, y) not in got
                continue
            part, w = wide[y : y + 3, x : x + 3], np.array(weights)
            seen = ~np.isnan(part)
            assert got[x, y] == pytest.approx((part[seen] * w[seen]).sum() / w[seen].sum(), rel=1e-12)
    same = focal.sharpened(tiles, 8, 1.0)
    assert same.join(tiles.withColumnRenamed("data", "own"), ["tilez", "tilex", "tiley"]).where("data is distinct from own").count() == 0


def test_rendered_tiles_and_ranges(spark):
    tiles = spark.createDataFrame([(0, 0, 0, [1.0, 5.0, None, float("nan")])], "tilez int, tilex int, tiley int, data array<double>")
    row = images.rendered(tiles, {"x > 0": (1, 2, 3, 255), "5": (9, 9, 9, 9)}, 2).first()
    assert row.statistics == {"x > 0": 2, "5": 1}
    at = row.png.index(b"IDAT") + 4
    pixels = zlib.decompress(row.png[at : at + int.from_bytes(row.png[at - 8 : at - 4], "big")])
    assert pixels == b"\0" + bytes([1, 2, 3, 255, 9, 9, 9, 9]) + b"\0" + bytes(8)
    bands = spark.createDataFrame([(4, 0, 2.0, 7.0)], "layer_id int, band int, min double, max double")
    shades = {"continuous": True, "from": (0, 0, 0, 255), "to": (9, 9, 9, 255)}
    legends = spark.createDataFrame([], "legend_id int, title string, json string")
    assert catalog.resolve_colormap(legends, shades, band=(bands, 4))["range"] == (2.0, 7.0)
    assert "range" not in catalog.resolve_colormap(legends, shades, band=(bands, 5)) and catalog.resolve_colormap(legends, shades | {"range": (0, 1)}, band=(bands, 4))["range"] == (0, 1)
