"""Tiles that keep arriving: running value counts and moments by layer."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.aggregate import moments
from gridloom.operators.layers import drop_nodata
from gridloom.operators.pyramid import write_tiles


def running_counts(tiles: DataFrame, nodata: float | None) -> DataFrame:
    """layer_id, value, count of a stream of tiles; the state holds one number for each value."""
    pixels = tiles.select("layer_id", F.explode("data").alias("value")).select("layer_id", drop_nodata(F.col("value"), nodata).alias("value"))
    return pixels.where("value is not null").groupBy("layer_id", "value").agg(F.count("*").alias("count"))


def running_statistics(tiles: DataFrame, nodata: float | None) -> DataFrame:
    """Moments, mean and deviation of each layer of a stream of tiles."""
    pixels = tiles.select("layer_id", F.explode("data").alias("value")).select("layer_id", drop_nodata(F.col("value"), nodata).alias("value"))
    value = F.col("value")
    return moments(pixels.groupBy("layer_id").agg(F.count("value").alias("t0"), F.sum("value").alias("t1"), F.sum(value * value).alias("t2"), F.min("value").alias("min"), F.max("value").alias("max")))


def store_stream(tiles: DataFrame, path: str, layer_id: int, checkpoint: str, band: int = 0) -> StreamingQuery:
    """Append a stream of tiles to a tile table, a micro-batch at a time.

    A micro-batch has its own partitions, named by the checkpoint and its number,
    so one that runs again replaces itself and no other. A tile that arrives
    again is a further row.
    """
    name = sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def store(batch: DataFrame, number: int) -> None:
        write_tiles(batch, path, layer_id, band, f"s{name}-{number}")

    return tiles.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
