"""Best-fit packing of token sequences (operator 9).

Whole texts become token ids in the tasks that read them; only lengths travel.
The packing is planned on the histogram of piece lengths, at most one number
for each length up to the capacity, so the plan does not grow with the data.
Every piece then takes a planned place by its rank among pieces of its length.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import cut, small_batches

CAPACITY = 2048
#: Pieces that one cell of a length should hold.
ROWS_PER_CELL = 10_000
#: Words that a task keeps with their ids before it starts anew.
WORDS_KEPT = 400_000
#: Letters that Unicode composition leaves as they are and that have one lower-case letter, then ASCII punctuation but for the apostrophe of contractions.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u02af]+)([!-&(-/:-@\[-`{-~]*)")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.cache
def loaded(path: str):
    """One tokenizer for each worker process; words are kept for one task only."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds(dict):
    """Ids of words between ASCII blanks as little-endian bytes, found by the tokenizer when a word is first asked for.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its words in turn. A word of plain letters and punctuation
    behind them is two of its pieces; its letters, in lower case and as the
    byte characters of the vocabulary, go to the tokenizer's model as they are.
    """

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = loaded(path)
        self.model, shown = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {c: shown.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x2B0)}

    def __missing__(self, word: str) -> bytes:
        plain = PLAIN.fullmatch(word)
        if plain is None:
            found = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        else:
            letters, marks = plain.groups()
            letters = letters.lower()
            if marks or letters != word:
                found = self[letters] + (self._marks(marks) if marks else b"")
            else:
                shown = letters if letters.isascii() else letters.translate(self.shown)
                found = array("I", [token.id for token in self.model.tokenize(shown)]).tobytes()
        self[word] = found
        return found

    def _marks(self, marks: str) -> bytes:
        if marks not in self:
            self[marks] = array("I", self.tokenizer.encode(marks, add_special_tokens=False).ids).tobytes()
        return self[marks]

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text (null: empty)."""
        if len(self) > WORDS_KEPT:
            self.clear()
        return b"".join(map(self.__getitem__, split_words(text or "")))


def split_words(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").split(" ")


def pieces_of(doc_id, ids: bytes, capacity: int) -> Iterator[tuple]:
    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
        part = ids[4 * start : 4 * (start + capacity)]
        yield doc_id, piece, start, len(part) // 4, zlib.crc32(part)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A document is its ids and then id 0 (a null text is empty: id 0 alone).
    Only documents longer than ``capacity`` are cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(tokenizer_path)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            rows = [p for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in pieces_of(d, known.ids(t) + b"\0\0\0\0", capacity)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, PIECES)


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts.

    Returns runs (length, first rank, pieces, first sequence, offset): so many
    pieces of a length, by rank, go one each into consecutive sequences at an
    offset. Sequences alike in their free room are held as ranges.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []
    plan, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                free = rooms[at]
                first, count = room[free].pop()
                if not room[free]:
                    del rooms[at], room[free]
                used = min(count, left)
                if used < count:
                    if free not in room:
                        insort(rooms, free)
                    room[free].append((first + used, count - used))
                per, offset = 1, capacity - free
            else:
                free, offset = capacity, 0
                per = capacity // length
                used = max(1, left // per) if left >= per else 1
                per = min(per, left)
                first, sequences = sequences, sequences + used
            for k in range(per):
                plan.append((length, rank, used, first, offset + k * length))
                rank += used
            left -= per * used
            rest = free - per * length
            if rest:
                if rest not in room:
                    insort(rooms, rest)
                room[rest].append((first, used))
    return plan


def ranked(pieces: DataFrame, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """``pieces`` with ``_rank``, gapless from 0 within each length.

    A length is dealt into cells by a hash, so one that holds most pieces is
    ranked by many tasks; running totals over the cells join the ranks.
    """
    n = pieces.count()
    cells = max(1, -(-n // rows_per_cell))
    dealt = pieces.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)))
    counts = dealt.groupBy("length", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_cell").orderBy("doc_id", "piece", "ids_crc32")
    return (dealt.withColumn("_at", F.row_number().over(inside)).join(starts, ["length", "_cell"])
            .withColumn("_rank", F.col("_before") + F.col("_at") - 1).drop("_at", "_before", "_cell"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Nothing is cut or dropped; sequences are filled without gaps and hold at
    most ``capacity`` tokens. ``pieces`` should be cheap to read again.
    """
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    plan = plan_best_fit({r["length"]: r["n"] for r in counted}, capacity)
    runs = defaultdict(list)
    for length, rank, count, first, offset in plan:
        runs[length].append({"_from": rank, "_to": rank + count, "_first": first, "_offset": offset})
    planned = spark.range(1).select(F.inline(F.from_json(
        F.lit(json.dumps([{"length": k, "runs": v} for k, v in runs.items()])),
        "array<struct<length:bigint,runs:array<struct<_from:bigint,_to:bigint,_first:bigint,_offset:bigint>>>>",
    )))
    placed = ranked(pieces).join(F.broadcast(planned), "length")  # one row a length: at most ``capacity``
    run = F.element_at(F.filter("runs", lambda r: (r["_from"] <= F.col("_rank")) & (F.col("_rank") < r["_to"])), 1)
    placed = placed.withColumn("_run", run)
    return placed.select(*pieces.columns, (F.col("_run._first") + F.col("_rank") - F.col("_run._from")).alias("sequence_id"),
                         F.col("_run._offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents packed into sequences of at most ``capacity`` tokens; one row per piece.

    Repeated rows are packed as often as they occur. An empty table gives no
    rows; null ids are kept.
    """
    return pack(cut(token_pieces(docs, tokenizer_path, capacity)), capacity)


def packed_sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str) -> DataFrame:
    """The token ids of every sequence: sequence_id, ids array<int>.

    Pieces bring their ids; a sequence gathers its pieces by offset, at most the
    capacity of tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(tokenizer_path)
        for batch in batches:
            columns = batch.to_pydict()
            out = []
            for text, start, length in zip(columns["text"], columns["start"], columns["length"], strict=True):
                out.append(np.frombuffer(known.ids(text) + b"\0\0\0\0", dtype="<u4")[start : start + length].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), batch.column("offset"), pa.array(out, pa.list_(pa.int32()))],
                                             names=["sequence_id", "offset", "ids"])

    texts = small_batches(packed).join(docs.select("doc_id", "text"), "doc_id")
    parts = texts.select("sequence_id", "offset", "text", "start", "length").mapInArrow(run, "sequence_id long, offset long, ids array<int>")
    gathered = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return gathered.select("sequence_id", F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("ids"))
