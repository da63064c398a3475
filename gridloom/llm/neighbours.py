"""Approximate nearest neighbours by shifted Hilbert curves (operator 5).

Every curve projects the vectors on a few random directions, shifts the grid
and orders the cells along a Hilbert curve. Curve keys are range-partitioned
into buckets of about equal size. A query meets the rows of the buckets around
its own on every curve; what the windows of all curves find is merged and ranked
by the inner product of the original vectors. The width of the windows is
measured: the least that holds the wanted share of the true neighbours of a
bounded sample of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import cut

CURVES, AXES, BITS = 16, 8, 7
ROWS_PER_BUCKET, MOST_BUCKETS = 1024, 4096
#: Rows that fit the grid and the buckets, queries that fit the windows, and the share of neighbours to hold.
FIT_ROWS, FIT_QUERIES, FIT_RECALL = 20_000, 96, 0.97
TIE_BITS = 63 - AXES * BITS


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of grid cells (n, axes), by Skilling's transform over whole columns."""
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(len(axes)):
            high = (axes[i] & bit) > 0
            swap = np.where(high, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(high, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
        bit >>= 1
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros_like(axes[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip = np.where((axes[-1] & bit) > 0, flip ^ (bit - 1), flip)
        bit >>= 1
    key = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ flip) >> b) & 1)
    return key


@dataclass
class Curve:
    directions: np.ndarray
    low: np.ndarray
    span: np.ndarray
    shift: np.ndarray
    bounds: np.ndarray

    def keys(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Hilbert keys; a few bits of the id part the rows of one cell."""
        places = np.clip((vectors @ self.directions - self.low) / self.span, 0, 1) / 1.5 + self.shift
        cells = np.minimum((places * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
        ties = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TIE_BITS)
        return (hilbert_keys(cells, BITS) << TIE_BITS) | ties.astype(np.int64)

    def buckets(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, self.keys(vectors, ids), side="right")


def fit_curves(vectors: np.ndarray, ids: np.ndarray, buckets: int, seed: int = 3) -> list[Curve]:
    """Random curves whose grid and bucket bounds come from sample rows."""
    rng = np.random.default_rng(seed)
    curves = []
    for _ in range(CURVES):
        axes = min(AXES, vectors.shape[1])
        directions = np.linalg.qr(rng.normal(size=(vectors.shape[1], axes)))[0]
        places = vectors @ directions
        low, high = np.quantile(places, [0.005, 0.995], axis=0)
        curve = Curve(directions, low, np.maximum(high - low, 1e-12), rng.random(axes) / 3, np.empty(0))
        keys = np.sort(curve.keys(vectors, ids))
        curve.bounds = keys[(np.arange(1, buckets) * len(keys)) // buckets]
        curves.append(curve)
    return curves


def lifted(vectors: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """One more component that turns the largest inner product into the smallest distance."""
    if query:
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.concatenate([vectors * (longest / norm), np.zeros((len(vectors), 1))], axis=1)
    rest = longest**2 - np.einsum("ij,ij->i", vectors, vectors)
    return np.concatenate([vectors, np.sqrt(np.maximum(rest, 0))[:, None]], axis=1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1) if raw else np.empty((0, 0))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``_id`` and ``_vector`` array<double>: no nulls, nothing non-finite, not all zero, of the commonest length."""
    v = F.col("_vector")
    fine = v.isNotNull() & F.col("_id").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    # Adding 0.0 gives both zeros one form, so that equal vectors group.
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.transform(vector_col, lambda x: x.cast("double") + F.lit(0.0)).alias("_vector")).where(fine)
    common = rows.groupBy(F.size("_vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return rows.where(F.size("_vector") == (common["n"] if common else 0))


def _top(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> pa.Table:
    """The k best rows of each query in this block; ties to the smaller id."""
    found_q, found_i, found_s = [], [], []
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    for begin in range(0, len(queries), 256):
        scores = queries[begin : begin + 256] @ rows.T
        if scores.shape[1] > k:
            least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
            at_q, at_r = np.nonzero(scores >= least)
        else:
            at_q, at_r = np.nonzero(np.ones_like(scores, dtype=bool))
        score = scores[at_q, at_r]
        best = np.lexsort((ids[at_r], -score, at_q))
        at_q, at_r, score = at_q[best], at_r[best], score[best]
        rank = np.arange(len(at_q)) - np.searchsorted(at_q, at_q)
        kept = rank < k
        found_q.append(query_ids[begin + at_q[kept]])
        found_i.append(ids[at_r[kept]])
        found_s.append(score[kept])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return pa.table({"_query": pa.array(join(found_q, np.int64), pa.int64()), "_row": pa.array(join(found_i, np.int64), pa.int64()),
                     "score": pa.array(join(found_s, np.float64), pa.float64())})


FOUND = "_query long, _row long, score double"


def _best(found: DataFrame, k: int, per: str = "_query", row: str = "_row") -> DataFrame:
    order = Window.partitionBy(per).orderBy(F.desc("score"), row)
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)


def exact_in_blocks(rows: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int) -> DataFrame:
    """Brute force of a bounded set of queries against all rows (_row long, _packed binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _top(queries, query_ids, _matrix(batch.column(1)), batch.column(0).to_numpy(), k).to_batches()

    return _best(rows.select("_row", "_packed").mapInArrow(run, FOUND), k)


def pack_vectors(rows: DataFrame) -> DataFrame:
    """``_row`` and the vector as little-endian doubles in ``_packed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.asarray(v, dtype="<f8").tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["_row", "_packed"])

    return rows.select("_row", "_vector").mapInArrow(run, "_row long, _packed binary")


def window_width(curves: list[Curve], queries: np.ndarray, query_ids: np.ndarray, found: list, longest: float, share: float) -> int:
    """The least bucket distance that holds ``share`` of the true neighbours on some curve."""
    at = {int(q): i for i, q in enumerate(query_ids)}
    vectors = np.array([np.frombuffer(r["_packed"], "<f8") for r in found])
    rows = np.array([r["_row"] for r in found])
    mine = np.array([at[r["_query"]] for r in found])
    near, far = lifted(vectors, longest, False), lifted(queries, longest, True)
    apart = [np.abs(c.buckets(near, rows) - c.buckets(far, query_ids)[mine]) for c in curves]
    return int(np.quantile(np.min(apart, axis=0), share, method="higher"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows found for each query row.

    Nearness is the largest inner product in double precision; ties go to the
    smaller id; a row is no neighbour of itself. Vectors that are null, zero, of
    an uncommon length, or hold null or non-finite components take no part, nor
    do null ids. ``is_query`` is a condition on ``id_col``. Equal vectors are
    searched once: only the k+1 smallest ids of a group of copies can be among
    the k nearest of anything. Repeated rows of one id count once.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).dropDuplicates(["_id", "_vector"])
    first = Window.partitionBy("_vector").orderBy("_id")
    few = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    kinds = cut(few.groupBy("_vector").agg(F.min("_id").alias("_row"), F.sort_array(F.collect_list("_id")).alias("_ids")))
    asked = rows.where(is_query.isNotNull() & is_query) if id_col == "_id" else rows.withColumnRenamed("_id", id_col).where(is_query).withColumnRenamed(id_col, "_id")
    asked = cut(asked.join(kinds.select("_vector", "_row"), "_vector").select(F.col("_id").alias("query_id"), F.col("_row").alias("_query")))
    packed = cut(pack_vectors(kinds))
    total = packed.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total:
        return empty

    def sample(df: DataFrame, most: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        chosen = df.where(F.pmod(F.xxhash64(F.lit(23), "_row"), F.lit(1 << 30)) < int(min(1.0, most / max(1, n)) * (1 << 30))).collect()
        chosen.sort(key=lambda r: r["_row"])
        return np.array([np.frombuffer(r["_packed"], "<f8") for r in chosen]), np.array([r["_row"] for r in chosen], dtype=np.int64)

    wanted = asked.select(F.col("_query").alias("_row")).distinct()
    targets = cut(packed.join(wanted, "_row"))
    n_targets = targets.count()
    if not n_targets:
        return empty
    buckets = max(1, min(MOST_BUCKETS, -(-total // rows_per_bucket)))
    longest = float(kinds.agg(F.max(F.aggregate("_vector", F.lit(0.0), lambda a, x: a + x * x))).first()[0]) ** 0.5
    trained, trained_ids = sample(packed, FIT_ROWS, total)
    tried, tried_ids = sample(targets, FIT_QUERIES, n_targets)
    if not len(trained) or not len(tried):
        buckets, curves, width = 1, [], 0
    else:
        curves = fit_curves(lifted(trained, longest, False), trained_ids, buckets)
        true = exact_in_blocks(packed, tried, tried_ids, k).join(packed, "_row").select("_query", "_row", "_packed").collect()
        width = window_width(curves, tried, tried_ids, true, longest, FIT_RECALL)

    def place(batches: Iterator[pa.RecordBatch], query: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, raw = batch.column(0).to_numpy(), batch.column(1)
            at = lifted(_matrix(raw), longest, query)
            for number, curve in enumerate(curves):
                own = curve.buckets(at, ids)
                for step in range(-width, width + 1) if query else (0,):
                    inside = np.flatnonzero((own + step >= 0) & (own + step < buckets))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(inside), number), pa.int32()), pa.array(own[inside] + step, pa.int32()), pa.array(ids[inside]), raw.take(pa.array(inside))],
                        names=["curve", "bucket", "_row", "_packed"])
            if not curves:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n), pa.int32()), pa.array(np.zeros(n), pa.int32()), batch.column(0), raw],
                                                 names=["curve", "bucket", "_row", "_packed"])

    shape = "curve int, bucket int, _row long, _packed binary"
    stored = packed.mapInArrow(lambda b: place(b, False), shape)
    seeking = targets.mapInArrow(lambda b: place(b, True), shape)

    def search(queries: pa.Table, block: pa.Table) -> pa.Table:
        if not queries.num_rows or not block.num_rows:
            return _top(np.empty((0, 1)), np.empty(0, np.int64), np.empty((0, 1)), np.empty(0, np.int64), k)
        return _top(_matrix(queries["_packed"]), queries["_row"].to_numpy(), _matrix(block["_packed"]), block["_row"].to_numpy(), k + 1)

    met = seeking.groupBy("curve", "bucket").cogroup(stored.groupBy("curve", "bucket")).applyInArrow(search, FOUND)
    merged = _best(met.groupBy("_query", "_row").agg(F.max("score").alias("score")), k + 1)
    members = merged.join(kinds.select("_row", "_ids"), "_row").select("_query", "score", F.explode("_ids").alias("vec_id"))
    pairs = asked.join(members, "_query").where(F.col("vec_id") != F.col("query_id"))
    ranked = _best(pairs, k, "query_id", "vec_id")
    return ranked.select("query_id", F.col("_rank").cast("int").alias("rank"), "vec_id", "score")


def search_embeddings(embeddings: DataFrame, k: int = 20) -> DataFrame:
    """Rows whose vec_id is divisible by 20 against all rows of ``embeddings``."""
    return nearest(embeddings, F.col("vec_id") % 20 == 0, k)
