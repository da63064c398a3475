"""Tile tables on disk: reading by layer, band and zoom, single tiles, and dropping a layer's tiles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import DEFAULTS
from gridloom.operators.layers import TILE, ancestors, overzoom, whole_array


#: Columns of a tile table; places and size are those of sparse tiles, and NULL for others.
TABLE = "tilex int, tiley int, data array<double>, places array<int>, size int, layer_id int, band int, tilez int"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's checkpoint folder; a temporary folder only where none is set and the session is local."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        known = context.getConf().get("spark.checkpoint.dir")
        if known is None and not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        context.setCheckpointDir(known or tempfile.mkdtemp(prefix="gridloom-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    """A path of Spark's file systems, and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, system = _path(spark, path)
    return system.exists(found)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; whether there was one."""
    found, system = _path(spark, path)
    return system.delete(found, True)


def new_set(path: str, layer_id: int, version: str) -> str:
    """Where the tiles of a version of a layer are written; Spark's readers of ``path`` itself do not see them."""
    return f"{path}/_sets/layer_id={layer_id}/version={version}"


def _entries(spark: SparkSession, path: str, layer_id: int) -> list[str]:
    """The versions of a layer that came into force, in order. An entry is an empty file, so it is there as a whole or not at all."""
    found, system = _path(spark, f"{path}/_manifest/layer_id={layer_id}")
    return sorted(f.getPath().getName() for f in system.listStatus(found)) if system.exists(found) else []


def in_force(spark: SparkSession, path: str, layer_id: int) -> str | None:
    """Where the tiles of a layer are that readers should take; None if the layer was not written in versions."""
    entries = _entries(spark, path, layer_id)
    return new_set(path, layer_id, entries[-1].partition("-")[2]) if entries else None


def switch(spark: SparkSession, path: str, layer_id: int, version: str) -> None:
    """Put a version in force. The one before stays for those who are reading it; older ones go."""
    entries = _entries(spark, path, layer_id)
    number = int(entries[-1].partition("-")[0]) + 1 if entries else 0
    found, system = _path(spark, f"{path}/_manifest/layer_id={layer_id}/{number:010d}-{version}")
    system.create(found, False).close()
    for old in entries[:-1]:
        discard(spark, path, layer_id, old.partition("-")[2])
        delete(spark, f"{path}/_manifest/layer_id={layer_id}/{old}")


def discard(spark: SparkSession, path: str, layer_id: int, version: str) -> None:
    """Delete the tiles of a version that is not in force."""
    delete(spark, new_set(path, layer_id, version))


def read_tiles(spark: SparkSession, path: str, layer_id: int, band: int = 0, zoom: int | None = None, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """tilez, tilex, tiley, data of one band of a layer, whole; only its partitions are listed and read.

    ``box`` (of tile indexes, ends inside) also reaches the files: tiles lie in the
    order of a curve, so most row groups outside it are skipped.
    """
    there = (F.col("layer_id") == layer_id) & (F.col("band") == band)
    if zoom is not None:
        there = there & (F.col("tilez") == zoom)
    if box is not None:
        there = there & F.col("tilex").between(box[0], box[2]) & F.col("tiley").between(box[1], box[3])
    rows = spark.read.schema(TABLE).parquet(in_force(spark, path, layer_id) or path).where(there)
    data = F.when(F.col("places").isNull(), F.col("data")).otherwise(whole_array(F.col("data")))
    return rows.select(F.col("tilez").cast("int").alias("tilez"), "tilex", "tiley", data.alias("data"))


def tiles_at(requests: DataFrame, tiles: DataFrame, tile_size: int = DEFAULTS.tile_size) -> DataFrame:
    """The requested tiles (tilez, tilex, tiley) of a layer; one that it lacks is resampled from its nearest ancestor."""
    return overzoom(ancestors(requests, tiles), tile_size)


def tile_at(tiles: DataFrame, zoom: int, x: int, y: int, tile_size: int = DEFAULTS.tile_size) -> list[float | None] | None:
    """The pixels of one tile, from the nearest zoom that has it; None if none has."""
    asked = tiles.sparkSession.createDataFrame([(zoom, x, y)], "tilez int, tilex int, tiley int")
    chain = [(F.col("tilez") == z) & (F.col("tilex") == x >> (zoom - z)) & (F.col("tiley") == y >> (zoom - z)) for z in range(zoom + 1)]
    near = chain[0]
    for one in chain[1:]:
        near = near | one
    found = tiles_at(asked, tiles.select(*TILE, "data").where(near), tile_size).first()
    return found["data"] if found else None


def drop_tiles(spark: SparkSession, path: str, layer_id: int) -> bool:
    """Delete all tiles of a layer in all versions; whether there were any."""
    # The manifest goes first, so that no reader is sent to tiles that are going.
    there = [delete(spark, f"{path}/{part}layer_id={layer_id}") for part in ("_manifest/", "_sets/", "")]
    return any(there)
