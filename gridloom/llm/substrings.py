"""Exact repeated passages by suffix arrays over shards (operator 7).

A byte goes if a string of ``length`` bytes that covers it also starts earlier:
in a document of a smaller id, or earlier in the same one. To bring equal
strings together, every string of that length is dealt by the smallest hash of
the short runs of bytes inside it; neighbouring starts with one such run form a
piece. Only pieces whose run occurs again go on. Equal pieces fold into their
first occurrence, and the differing ones are sorted: each shard builds the
suffix array of its pieces by induced sorting and reads repeated strings off
the permuted common prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import small_batches, stored
from gridloom.llm.suffix_array import permuted_prefixes, suffix_array

LENGTH, RUN = 100, 20
CHUNK_BYTES = 1 << 18
#: Bytes of pieces in one shard, and the most differing pieces of one run that are sorted together.
SHARD_BYTES, MOST_PIECES = 1 << 20, 10_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(12345)
_BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = np.uint64(pow(int(_ODD), -1, 2**64))
        _powers[size] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)])) for base in (_ODD, inverse))
    return _powers[size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any ranges of one byte string."""

    def __init__(self, raw: np.ndarray):
        self.powers, self.inverses = _power_tables(len(raw))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_VALUES[raw] * self.powers[: len(raw)])])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.inverses[start])

    def runs(self, size: int) -> np.ndarray:
        n = len(self.sums) - 1
        return _mix((self.sums[size:] - self.sums[:-size]) * self.inverses[: n - size + 1])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    least, reach = values, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return np.minimum(least[: len(values) - width + 1], least[width - reach :]) if width > reach else least


def pieces_of(texts: list[bytes], length: int = LENGTH, run: int = RUN) -> tuple[np.ndarray, ...]:
    """All pieces of the texts: index of the text, first start, number of starts, run hash, hash of the bytes.

    A string belongs to the leftmost of its least run hashes, so that equal
    strings belong to equal runs at equal places; a piece is a longest stretch
    of starts with one such run. Of a run's hash 40 bits are kept: runs that
    share them by chance only meet in vain.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(raw) < length:
        return tuple(np.empty(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    rolling = Rolling(raw)
    runs = rolling.runs(run)
    least = _sliding_least(runs, length - run + 1)
    ends = np.cumsum(sizes)
    valid = np.zeros(len(least) + 1, dtype=np.int64)
    whole = sizes >= length
    np.add.at(valid, (ends - sizes)[whole], 1)
    np.add.at(valid, (ends - length + 1)[whole], -1)
    valid = np.cumsum(valid[:-1]) > 0
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (runs[: len(least) - 1] == least[:-1])
    start = np.flatnonzero(fresh)
    owner = np.searchsorted(ends, start, side="right")
    stop = np.minimum(np.append(start[1:], len(raw)), ends[owner] - length + 1)
    return owner, start - (ends - sizes)[owner], stop - start, least[start] >> np.uint64(24), rolling.of(start, stop + length - 1)


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for k, text in enumerate(texts):
        if k > begin and size + len(text) > most:
            yield begin, k
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def all_pieces(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every piece of every document: doc_id, at, starts, run, content (two hashes). Null ids take no part."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), _bytes(batch.column(1))
            for begin, end in chunks(texts):
                owner, at, starts, run, content = pieces_of(texts[begin:end], length, min(RUN, length))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[begin + owner], pa.int64()), pa.array(at, pa.int32()), pa.array(starts, pa.int32()), pa.array(run.view(np.int64)), pa.array(content.view(np.int64))],
                    names=["doc_id", "at", "starts", "run", "content"])

    usable = small_batches(docs).where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).select("doc_id", "text")
    return usable.mapInArrow(scan, "doc_id long, at int, starts int, run long, content long")


PLACE = 2**32


def _place() -> Column:
    """Document and start as one number in reading order."""
    return (F.col("doc_id").cast("decimal(20,0)") * PLACE + F.col("at")).cast("decimal(38,0)")


def repeated_in_shard(doc_ids: np.ndarray, starts_at: np.ndarray, starts: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts (doc_id, first, number) whose string also starts earlier in this shard."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"\xff".join(texts), dtype=np.uint8)  # no UTF-8 text holds this byte
    array = suffix_array(np.append(raw.astype(np.int64) + 1, 0), 258)
    shared = permuted_prefixes(raw, array)
    begins = np.cumsum(sizes + 1) - sizes - 1
    piece = np.repeat(np.arange(len(texts)), starts)
    within = np.arange(len(piece)) - np.repeat(np.cumsum(starts) - starts, starts)
    slot = np.full(len(array), -1, dtype=np.int64)
    slot[begins[piece] + within] = np.arange(len(piece))
    group = np.cumsum(shared[array] < length)
    there = slot[array] >= 0
    group, candidate = group[there], slot[array[there]]
    doc, at = doc_ids[piece[candidate]], starts_at[piece[candidate]] + within[candidate]
    order = np.lexsort((at, doc, group))
    group, doc, at = group[order], doc[order], at[order]
    head = np.concatenate([[True], group[1:] != group[:-1]])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0))
    later = (doc != doc[lead]) | (at != at[lead])
    doc, at = doc[later], at[later]
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)])) if len(doc) else np.empty(0, np.int64)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    return doc[first], at[first], at[last] - at[first] + 1


SPAN = "doc_id long, at int, starts int"


def repeated_starts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, at, starts: runs of starts in each document whose string also starts earlier."""
    pieces = all_pieces(docs, length)
    # Kept by itself, so that the join below can split the pieces of a run that very many documents share.
    again = stored(pieces.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run"))
    matched = stored(pieces.join(again, "run", "left_semi"))
    kinds = stored(matched.groupBy("run", "content", "starts").agg(F.min(_place()).alias("first"), F.count("*").alias("n")))
    copies = (matched.withColumn("place", _place()).join(kinds.where("n > 1").select("run", "content", "starts", "first"), ["run", "content", "starts"])
              .where(F.col("place") != F.col("first")).select("doc_id", "at", "starts"))

    # Differing pieces of one run: their bytes are read from the documents they first occur in.
    variety = kinds.groupBy("run").agg(F.count("*").alias("kinds")).where("kinds > 1")
    first = kinds.join(variety, "run").select(
        F.expr(f"cast(floor(first / {PLACE}) as bigint)").alias("doc_id"), F.expr(f"cast(first - floor(first / {PLACE}) * {PLACE} as int)").alias("at"),
        "starts", "run", (F.col("kinds") > MOST_PIECES).alias("crowded"))
    wanted = stored(first.groupBy("doc_id").agg(F.collect_list(F.struct("at", "starts", "run", "crowded")).alias("pieces")))
    total = wanted.agg(F.sum(F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["starts"] + length))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, found in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                found = [p for p in found if p["at"] + p["starts"] + length - 1 <= len(text)]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id] * len(found), pa.int64()), pa.array([p["at"] for p in found], pa.int32()), pa.array([p["starts"] for p in found], pa.int32()),
                         pa.array([p["run"] for p in found], pa.int64()), pa.array([p["crowded"] for p in found], pa.bool_()),
                         pa.array([text[p["at"] : p["at"] + p["starts"] + length - 1] for p in found], pa.binary())],
                        names=["doc_id", "at", "starts", "run", "crowded", "bytes"])

    located = docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id").mapInArrow(bring, SPAN + ", run long, crowded boolean, bytes binary")
    located = stored(located)

    def sort_shard(table: pa.Table) -> pa.Table:
        doc, at, n = repeated_in_shard(table["doc_id"].to_numpy(), table["at"].to_numpy().astype(np.int64), table["starts"].to_numpy().astype(np.int64), table["bytes"].to_pylist(), length)
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "at": pa.array(at, pa.int32()), "starts": pa.array(n, pa.int32())})

    shard = F.pmod(F.xxhash64(F.lit(5), "run"), F.lit(shards))
    sorted_ = located.where(~F.col("crowded")).withColumn("shard", shard).groupBy("shard").applyInArrow(sort_shard, SPAN)
    # A run with very many differing pieces is shared by strings that mostly differ: each
    # string becomes a piece of its own, and equal ones fold before they are sent.
    single = located.where("crowded").select("doc_id", "at", F.explode(F.sequence(F.lit(0), F.col("starts") - 1)).alias("i"), "bytes")
    single = single.select("doc_id", (F.col("at") + F.col("i")).alias("at"), F.expr(f"substring(bytes, i + 1, {length})").alias("bytes"))
    single = single.select("doc_id", "at", F.xxhash64("bytes").alias("h1"), F.xxhash64(F.lit(3), "bytes").alias("h2")).withColumn("place", _place())
    heads = single.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    alone = single.join(heads, ["h1", "h2"]).where(F.col("place") != F.col("first")).select("doc_id", "at", F.lit(1).alias("starts"))
    return copies.union(sorted_).union(alone)


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and ``spans``: the document's runs of starts, [at, starts], gathered for each document."""
    return repeated_starts(docs, length).groupBy("doc_id").agg(F.collect_list(F.array("at", "starts")).alias("spans"))


def merged(spans: list, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that the spans cover."""
    out: list[list[int]] = []
    for at, starts in sorted(spans or ()):
        stop = min(at + starts + length - 1, size)
        if at < stop:
            if out and at <= out[-1][1]:
                out[-1][1] = max(out[-1][1], stop)
            else:
                out.append([at, stop])
    return [(a, b) for a, b in out]


def kept_bytes(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for pair in gone for x in pair), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _with_spans(docs: DataFrame, length: int) -> tuple[DataFrame, str]:
    """``docs`` with the spans of each document, and the name of their column, which no column of ``docs`` has."""
    taken, key, name = {c.lower() for c in docs.columns}, "span doc_id", "span list"
    while key in taken or name in taken:
        key, name = key + "_", name + "_"
    # Merged at every size, as spans grow with the documents.
    spans = stored(removed_spans(small_batches(docs), length).withColumnRenamed("doc_id", key).withColumnRenamed("spans", name))
    return docs.join(spans.hint("merge"), F.col("doc_id") == F.col(f"`{key}`"), "left").drop(key), name


def report_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every whole text (null: empty).

    Rows with a null doc_id stay whole. Rows that share a doc_id never count as
    earlier than each other at the same place, and lose the same places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                gone = merged(spans, len(text), length)
                rows.append((len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept_bytes(text, gone)).hexdigest()))
            n_bytes, n_removed, n_spans, digest = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined, name = _with_spans(docs.select("doc_id", "text"), length)
    return joined.select("doc_id", "text", name).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; bytes of characters cut in part are dropped.

    A null text stays null, and rows with a null doc_id stay whole. Rows that
    share a doc_id lose the same places. Other columns stay as they are, whatever
    their names, and an empty table gives an empty one.
    """
    names = docs.columns
    joined, name = _with_spans(docs, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(name).to_pylist(), strict=True):
                raw = (text or "").encode()
                gone = merged(spans, len(raw), length)
                texts.append(kept_bytes(raw, gone).decode("utf-8", "ignore") if gone else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)

    return joined.mapInArrow(run, docs.schema)


#: The same over all strings of 100 bytes; bytes are written as two hexadecimal digits.
ORACLE_SQL = r"""
WITH raw AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
sized AS (SELECT doc_id, h, len(h) // 2 AS n FROM raw),
strings AS (SELECT doc_id, u.p AS p, substr(h, 2 * u.p + 1, 200) AS s FROM sized, LATERAL (SELECT unnest(generate_series(0, n - 100)) AS p) u WHERE n >= 100),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY md5(s), s ORDER BY doc_id, p) AS k FROM strings) WHERE k > 1),
gaps AS (SELECT doc_id, p, coalesce(p > max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100, true) AS fresh FROM later),
runs AS (SELECT doc_id, p, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM gaps),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY 1, 2),
cuts AS (
  SELECT s.doc_id, s.a, s.b, coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0) AS before FROM spans s
), kept AS (
  SELECT c.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS ended, string_agg(substr(z.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM cuts c JOIN sized z ON z.doc_id = c.doc_id GROUP BY c.doc_id
)
SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k.head, '') || substr(z.h, 2 * coalesce(k.ended, 0) + 1))) AS kept_sha256
FROM sized z LEFT JOIN kept k ON k.doc_id = z.doc_id
"""
