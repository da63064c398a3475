"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch where rows hold whole texts.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session's Arrow batches are bounded by bytes, unless the session has a bound of its own.

    A worker holds a batch several times over, and the default bound is 64 MB. The
    setting is read when a plan runs, so it stays for the session.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "1") == "1":  # what a setting that is unset gives
        conf.set(key, str(BATCH_BYTES))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, ``spark.checkpoint.dir``.

    A temporary folder is set only where that is unset and the session is local,
    as in tests; on a cluster its absence is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        known = context.getConf().get("spark.checkpoint.dir")
        if known is None and not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        context.setCheckpointDir(known or tempfile.mkdtemp(prefix="gridloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a compressed table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of what is run go when it ends, and not when the driver happens to collect its garbage.

    Only for DataFrames that are built inside and run once, as those given to ``cut``
    and ``stored``: one that runs again makes its shuffles anew.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def listed(df: DataFrame, most: int, weight: Column | None = None) -> DataFrame:
    """``df``, to be broadcast if its rows weigh at most ``most`` together (1 each, if no weight is given).

    ``df`` should be cut, as it is summed up here.
    """
    total = df.count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though lambdas inside ``body`` use it for each of their elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The totals under ``combine``, from 0 on, of all heads of an array of longs, the empty one first.

    Totals run within blocks of about the root of the size, so cost grows with
    the power 1.5 of it.
    """
    zero = F.lit(0).cast("long")

    def heads(first: Column, part: Column) -> Column:
        return F.aggregate(part, F.array(first), lambda seen, x: F.concat(seen, F.array(combine(F.element_at(seen, -1), x))))

    def of_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda part: F.aggregate(part, zero, combine))
        inner = bound(heads(zero, sums), lambda ends: F.flatten(F.transform(blocks, lambda part, k: F.slice(heads(F.element_at(ends, k + 1), part), 2, F.size(part)))))
        return F.concat(F.array(zero), inner)

    def of(whole: Column, block: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(whole) / block) - 1, F.lit(0)).cast("int"))
        return bound(F.transform(starts, lambda k: F.slice(whole, k * block + 1, block)), of_blocks)

    return bound(numbers, lambda whole: bound(F.greatest(F.ceil(F.sqrt(F.size(whole))), F.lit(1)).cast("int"), lambda block: of(whole, block)))
