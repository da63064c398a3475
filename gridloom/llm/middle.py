"""Fill-in-the-middle transformation of whole texts (operator 12).

A text is cut at two code points drawn from a hash of its id, and its three
parts are put in another order behind markers. One numpy kernel works on the
UTF-8 buffer of a whole Arrow batch: a table gives the class of every byte, the
classes of adjacent bytes say where a code point starts, running totals less
those at a document's start count code points in it, and one binary search
in the totals finds the cuts of all rows. The output buffer is gathered from
the pieces of all rows at once. Rows never meet, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import small_batches

#: Markers of prefix, suffix and middle, and the shares of plain and of suffix-first texts in a hundred.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
FORMS = ("plain", "psm", "spm")
#: Class of a byte: 0 continues a code point, 1 is ASCII, 2 leads a longer code point.
CLASSES = np.ones(256, np.uint8)
CLASSES[0x80:0xC0], CLASSES[0xC0:] = 0, 2
#: Whether a unit starts between bytes of two classes (rows: the byte before); code points start wherever a byte does not continue one.
STARTS = np.array([[False, True, True]] * 3)

MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the n + 1 places where they begin and end; a null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, places, data = texts.buffers()
    bounds = np.frombuffer(places, np.int64, len(texts) + 1, texts.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def unit_totals(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many units start at or before each byte; a document's first byte always starts one."""
    if not len(data):
        return np.zeros(0, np.int64)
    kinds = CLASSES[data]
    first = np.ones(len(data), bool)
    first[1:] = STARTS[kinds[:-1], kinds[1:]]
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    return np.cumsum(first, dtype=np.int64)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces of ``data`` of these starts and lengths, one after the other."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return data[np.arange(lengths.sum()) + np.repeat(shift, lengths)]


def rearrange(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Units, units of the prefix and of the middle, and the output of all rows; ``form`` indexes FORMS."""
    data, bounds = buffer_of(texts)
    totals = unit_totals(data, bounds)
    begins, ends = bounds[:-1], bounds[1:]
    padded = np.concatenate([[0], totals])
    before = padded[begins]
    n = padded[ends] - before
    low, high = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    # The byte that starts unit k of a document is the first whose total passes those before it by k + 1.
    cuts = [np.where(k < n, np.searchsorted(totals, before + k + 1), ends) for k in (low, high)]
    marks = np.frombuffer((PREFIX + SUFFIX + MIDDLE).encode(), np.uint8)
    source = np.concatenate([data, marks])
    mark = {PREFIX: len(data), SUFFIX: len(data) + 3, MIDDLE: len(data) + 6}
    parts = {"prefix": (begins, cuts[0] - begins), "middle": (cuts[0], cuts[1] - cuts[0]), "suffix": (cuts[1], ends - cuts[1])}
    orders = {1: [PREFIX, "prefix", SUFFIX, "suffix", MIDDLE, "middle"], 2: [SUFFIX, "suffix", PREFIX, "prefix", MIDDLE, "middle"]}
    starts, lengths = np.zeros((2, len(n), 6), np.int64)
    starts[:, 0], lengths[:, 0] = begins, ends - begins
    for kind, order in orders.items():
        rows = form == kind
        for place, piece in enumerate(order):
            at, size = (mark[piece], 3) if piece in mark else (parts[piece][0][rows], parts[piece][1][rows])
            starts[rows, place], lengths[rows, place] = at, size
    made = gather(source, starts.ravel(), lengths.ravel())
    offsets = np.concatenate([[0], np.cumsum(lengths.sum(axis=1))])
    output = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(made)])
    return n, low, high - low, output


def draws(id_: Column, seed: int = 1) -> list[Column]:
    """The first four 8-digit groups of the SHA-256 of ``seed:id`` as numbers; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def form_of(text: Column, h3: Column, h4: Column) -> Column:
    """plain for an empty text, one that holds a marker, and one text in ten; of the rest one in five is spm, others psm."""
    holds = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    return F.when((text == "") | holds | (h3 % 100 >= PLAIN_FROM), FORMS[0]).when(h4 % 100 < SPM_BELOW, FORMS[2]).otherwise(FORMS[1])


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row of ``docs``.

    ``n`` counts code points; prefix_chars and middle_chars are null for plain
    rows, whose output is the text. A null text is empty, and an empty one is
    plain; a null doc_id draws as an empty string. Equal ids draw equal numbers,
    and repeated rows come out repeatedly. An empty table gives no rows. Columns
    other than doc_id and text are not read, whatever they are called. A batch
    holds a bounded number of bytes, or one text.
    """
    text = F.coalesce("text", F.lit(""))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    rows = docs.select("doc_id", text.alias("text"), h1.alias("h1"), h2.alias("h2"), form_of(text, h3, h4).alias("form"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)]
            named = batch.column(4)
            form = np.searchsorted(FORMS, named.to_numpy(zero_copy_only=False).astype(str))
            n, prefix, middle, output = rearrange(batch.column(1), *numbers, form)
            plain = form == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), named, pa.array(prefix, mask=plain), pa.array(middle, mask=plain), output.cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return small_batches(rows).mapInArrow(run, f"doc_id {kind}, {MADE}")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from.

    A marker is found for certain: the text holds none, and no marker overlaps another.
    """
    body = F.substring(output, 4, 2**31 - 1)

    def halves(whole: Column, mark: str) -> tuple[Column, Column]:
        return F.substring_index(whole, mark, 1), F.substring_index(whole, mark, -1)

    prefix, rest = halves(body, SUFFIX)
    suffix, middle = halves(rest, MIDDLE)
    suffix_first, rest_after = halves(body, PREFIX)
    prefix_after, middle_after = halves(rest_after, MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_after, middle_after, suffix_first)).otherwise(output)


def report_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and digests of the output and of the text restored from it."""
    made = fill_in_middle(docs, seed)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_SQL = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
           list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), k, 8))::BIGINT) AS h
    FROM documents),
formed AS (
    SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                   WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
           least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high
    FROM drawn),
cut AS (SELECT *, substr(text, 1, low) AS prefix, substr(text, low + 1, high - low) AS middle, substr(text, high + 1) AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
