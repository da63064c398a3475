"""Uniform sharding with exact shard sizes (operator 10).

A global random shuffle is planned as a communication matrix: how many rows of
each source cell go to each block of each shard is drawn from the exact
hypergeometric law on counts alone. Every cell then permutes its rows locally,
hands out consecutive runs of them as the matrix says, and every receiving
block permutes what it got. Each arrangement of rows over slots is equally
likely under the seed, and shard sizes differ by at most one row.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one cell or one block should hold, and the most of either.
ROWS_PER_CELL = 20_000
MOST_CELLS = 1024


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows taken without replacement are good ones.

    Inverts the distribution outward from its mode; the weights come from the
    ratio of neighbouring terms, so populations of any size keep full precision.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    share = good / (good + bad)
    spread = int(14 * np.sqrt(draws * share * (1 - share)) + 40)
    x = np.arange(max(low, mode - spread), min(high, mode + spread) + 1, dtype=np.float64)
    ratio = (good - x[:-1]) * (draws - x[:-1]) / ((x[:-1] + 1) * (bad - draws + x[:-1] + 1))
    log_weight = np.concatenate([[0.0], np.cumsum(np.log(ratio))])
    cumulative = np.cumsum(np.exp(log_weight - log_weight.max()))
    at = np.searchsorted(cumulative, rng.random() * cumulative[-1], side="right")
    return int(x[min(at, len(x) - 1)])


def communication_matrix(sources: list[int], targets: list[int], seed: int) -> np.ndarray:
    """Exact counts from each source to each target; both sums are met."""
    rng = np.random.default_rng(seed)
    left = np.array(targets, dtype=np.int64)
    matrix = np.zeros((len(sources), len(targets)), dtype=np.int64)
    for i, count in enumerate(sources):
        need, rest = int(count), int(left.sum())
        for j, room in enumerate(left.tolist()):
            rest -= room
            take = draw_hypergeometric(rng, room, rest, need) if need else 0
            matrix[i, j] = take
            need -= take
        left -= matrix[i]
    return matrix


def _even(total: int, parts: int) -> list[int]:
    return [total // parts + (k < total % parts) for k in range(parts)]


def _interval(limits: Column, rank: Column) -> Column:
    """Index of the run of ``limits`` (running totals) that holds ``rank``."""
    return F.size(F.filter(limits, lambda limit: limit < rank)).cast("int")


def assign_shards(df: DataFrame, identity: list[str], n_shards: int = 8, seed: int = 7,
                  rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """All columns of ``df`` plus ``shard`` int and ``slot`` long.

    ``identity`` names the columns that tell rows apart; the first is the key
    whose hash deals rows into cells. Rows alike in all of them may swap slots
    with each other and nothing else changes. Nulls form ordinary values. An
    empty table gives no rows. Columns of the input named ``shard`` or ``slot``
    are replaced.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    keyed = df.select(*[F.col(f"`{c}`") for c in kept])
    total = keyed.count()
    cells = max(1, min(MOST_CELLS, -(-total // rows_per_cell)))
    cell = F.pmod(F.xxhash64(F.lit(seed), F.col(identity[0])), F.lit(cells)).cast("int")
    counted = {r["cell"]: r["n"] for r in keyed.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}
    sources = [counted.get(i, 0) for i in range(cells)]

    blocks = max(1, min(-(-MOST_CELLS // n_shards), -(-total // (n_shards * rows_per_cell))))
    sizes = [_even(n, blocks) for n in _even(total, n_shards)]
    matrix = communication_matrix(sources, [n for shard in sizes for n in shard], seed)
    runs = np.cumsum(matrix, axis=1).reshape(cells, n_shards, blocks)
    plan = [{"cell": i, "ends": [[int(v) for v in shard] for shard in runs[i]]} for i in range(cells)]
    starts = [[0, *np.cumsum(s)[:-1].tolist()] for s in sizes]

    # The plan has at most MOST_CELLS squared numbers whatever the input's size.
    planned = spark.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps(plan)), "array<struct<cell:int,ends:array<array<bigint>>>>"))
    ).select(F.col("cell").alias("_cell"), F.col("ends").alias("_ends"))
    ties = [F.col(f"`{c}`") for c in identity]
    local = Window.partitionBy("_cell").orderBy(F.xxhash64(F.lit(seed + 1), *ties), *ties)
    ranked = keyed.withColumn("_cell", cell).join(planned, "_cell").withColumn("_rank", F.row_number().over(local).cast("long"))
    last = F.transform("_ends", lambda runs: F.element_at(runs, -1))
    sent = ranked.withColumn("shard", _interval(last, F.col("_rank")))
    sent = sent.withColumn("_block", _interval(F.element_at("_ends", F.col("shard") + 1), F.col("_rank")))
    start = F.from_json(F.lit(json.dumps(starts)), "array<array<bigint>>")
    again = Window.partitionBy("shard", "_block").orderBy(F.xxhash64(F.lit(seed + 2), *ties), *ties)
    placed = sent.drop("_ends", "_rank", "_cell").withColumn(
        "slot", F.element_at(F.element_at(start, F.col("shard") + 1), F.col("_block") + 1) + F.row_number().over(again) - 1
    )
    return placed.select(*[F.col(f"`{c}`") for c in kept], "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int = 8, seed: int = 7) -> DataFrame:
    """Documents dealt into shards under the law ``rows``.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; a null text has none),
    text_crc32, law, shard, slot and grown_shard (null under this law).
    """
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = assign_shards(narrow, ["doc_id", "text_crc32", "size"], n_shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, identity: list[str], n_shards: int = 8, seed: int = 7) -> None:
    """Write whole rows as Parquet, one folder a shard, rows in slot order within files."""
    placed = assign_shards(df, identity, n_shards, seed)
    ordered = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.mode("overwrite").partitionBy("shard").parquet(path)
