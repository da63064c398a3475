"""Canonical exact document fingerprints (operator 2).

A text is brought to a canonical form - compatibility-composed Unicode, folded
case, runs of white space as one space, trimmed - and digested by two seeded
64-bit xxhashes, 128 bits together. Documents with equal digests share a
bucket; inside buckets of two or more the canonical bytes are compared, so a
class never rests on the digest alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import cut

#: Documents that one cell of the id order should hold.
ROWS_PER_CELL = 1000
#: Ranges between quantiles of the ids, and cells whose followers are found together.
PIECES, CELLS_PER_BLOCK = 256, 4096
#: Buckets of two or more that are broadcast; with none, one way is taken at every size: texts are shuffled to them.
BROADCAST_ROWS = 0


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, white space folded to single spaces, trimmed; null counts as empty.

    Normaliser and folding are those of the ICU library that Spark itself ships,
    called as SQL functions.
    """
    def composed(value: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), value, F.lit(True))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(composed(folded), r"[\s\p{Z}\x85\x1c-\x1f]+", " "))


def digest(canonical_text: Column) -> Column:
    """128 bits of seeded xxhash as 32 lowercase hex digits."""
    half = [F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canonical_text))), 16, "0") for seed in (11, 29)]
    return F.concat(*half)


def third(canonical_text: Column) -> Column:
    """A further hash, to name the kinds inside a bucket whose bytes differ."""
    return F.xxhash64(F.lit(53), canonical_text)


def likeness(a: Column, b: Column) -> Column:
    """Exact digests are alike (1) or not (0)."""
    return F.when(a == b, 1.0).otherwise(0.0)


def class_ids(prints: DataFrame, keyed: DataFrame) -> DataFrame:
    """``prints`` with ``class_id``, the smallest doc_id with the same canonical bytes.

    ``prints`` has doc_id, fingerprint and ``_third``, a further hash that names
    the kinds inside a bucket; ``keyed`` has doc_id, fingerprint and the
    canonical ``_text``. Only buckets of two or more are compared byte by byte.
    """
    buckets = prints.groupBy("fingerprint").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_first"))
    crowd = cut(buckets.where("_n > 1").select("fingerprint"))
    # Within a checked size the list of buckets goes to the texts, else the texts to the buckets.
    listed = F.broadcast(crowd) if crowd.count() <= BROADCAST_ROWS else crowd
    shared = keyed.join(listed, "fingerprint", "left_semi")
    # Grouping by key and bytes compares the bytes; copies fold before the shuffle.
    kinds = shared.select(F.reverse("fingerprint").alias("_key"), "_text", "doc_id").groupBy("_key", "_text").agg(F.min("doc_id").alias("_own"))
    # Read twice below: one short row for each kind is kept, so whole texts move once.
    kinds = cut(kinds.select("_key", "_own", third(F.col("_text")).alias("_third")))
    clashing = kinds.groupBy("_key").agg(F.count("*").alias("_kinds")).where("_kinds > 1").select("_key")
    split = kinds.join(clashing, "_key", "left_semi").select(F.reverse("_key").alias("fingerprint"), "_third", "_own")
    first = buckets.select("fingerprint", "_first")
    return (prints.join(first, "fingerprint").join(split, ["fingerprint", "_third"], "left")
            .withColumn("class_id", F.coalesce("_own", "_first")).drop("_own", "_first", "_third"))


def _followers(cells: DataFrame) -> DataFrame:
    """For each filled cell of the id order the next filled one downwards; the lowest meets the highest.

    Cells follow each other inside blocks of ``CELLS_PER_BLOCK``; only the
    blocks' highest cells meet in one window.
    """
    blocks = cells.distinct().withColumn("_block", F.expr(f"_cell div {CELLS_PER_BLOCK}"))
    inside = blocks.withColumn("_inner", F.lead("_cell").over(Window.partitionBy("_block").orderBy(F.desc("_cell"))))
    heads = blocks.groupBy("_block").agg(F.max("_cell").alias("_top"))
    order = Window.orderBy(F.desc("_block"))
    first = F.max("_top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = heads.select("_block", F.coalesce(F.lead("_top").over(order), first).alias("_after"))
    return inside.join(after, "_block").select("_cell", F.coalesce("_inner", "_after").alias("_next"))


def _pieces(rows: DataFrame, rows_per_cell: int) -> list[tuple[bool, int, int, int]]:
    """Ranges of the id order that hold about as many rows each: whether of null ids, lowest value, width of its cells, number of its first cell."""
    shares = [k / PIECES for k in range(1, PIECES)]
    found = rows.groupBy("_null").agg(F.min("_value").alias("low"), F.max("_value").alias("high"), F.count("*").alias("n"),
                                      F.percentile_approx("_value", shares, F.lit(10 * PIECES)).alias("bounds")).collect()
    pieces, number = [], 0
    for row in sorted(found, key=lambda r: not r["_null"]):
        edges = sorted({row["low"], *(row["bounds"] or []), row["high"] + 1})
        cells = max(1, -(-row["n"] // (rows_per_cell * (len(edges) - 1))))
        for low, end in zip(edges, edges[1:]):
            width = -(-(end - low) // cells)
            pieces.append((row["_null"], low, width, number))
            number += (end - low - 1) // width + 1
    return pieces


def _cell(pieces: list[tuple[bool, int, int, int]]) -> Column:
    """The cell of a row: the number of its piece is that of the lowest values up to its own."""

    def listed(values: list[int], kind: str) -> Column:
        # One folded literal, so that plans stay small.
        return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")

    null, other = ([p[1] for p in pieces if p[0] == side] for side in (True, False))
    below = lambda lows: F.size(F.filter(listed(lows, "bigint"), lambda low: low <= F.col("_value")))
    # Null ids come before all others.
    piece = F.when(F.col("_null"), below(null)).otherwise(below(other) + len(null))
    found = F.struct(piece.alias("at"), F.col("_value").cast("decimal(20,0)").alias("value"))
    low, width, first = (listed([p[k] for p in pieces], kind) for k, kind in ((1, "decimal(20,0)"), (2, "decimal(20,0)"), (3, "bigint")))
    place = lambda f: F.element_at(first, f["at"]) + F.floor((f["value"] - F.element_at(low, f["at"])) / F.element_at(width, f["at"])).cast("long")
    return F.element_at(F.transform(F.array(found), place), 1)


def with_next_text(docs: DataFrame, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """doc_id, text (null: empty) and ``next_text``: that of the document next in descending doc_id.

    The last document is followed by the first. Ids are dealt into cells: ranges
    between quantiles of the ids, each cut evenly, so that neither gaps nor
    outlying ids crowd a cell. A row finds its follower inside its cell, and the
    last row of a cell takes the first row of the next filled cell. Null ids come
    last, in the order of a hash of their text; rows with one id follow each
    other by text. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_null", F.col("doc_id").isNull())
    rows = rows.withColumn("_value", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    pieces = _pieces(rows, rows_per_cell)
    if not pieces:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"))
    placed = rows.withColumn("_cell", _cell(pieces))
    order = Window.partitionBy("_cell").orderBy("_null", F.desc("_value"), "text")
    inside = placed.withColumn("_inside", F.lead("text").over(order)).withColumn("_at", F.row_number().over(order))
    heads = inside.where("_at = 1").select(F.col("_cell").alias("_next"), F.col("text").alias("_head"))
    bridge = _followers(placed.select("_cell")).join(heads, "_next").select("_cell", "_head")
    joined = inside.join(bridge, "_cell")
    return joined.select("doc_id", "text", F.coalesce("_inside", "_head").alias("next_text"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text, of its edited form and of the next document.

    The edited form has the last half of its code points replaced by as many, or
    all, of the next document's first ones. A null text counts as empty. A null
    id stays null and never names a class unless all of the class have none.
    Repeated rows give repeated rows; further columns play no part.
    """
    near = with_next_text(docs)
    n = F.char_length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(char_length(text) - floor(char_length(text) / 2) as int))"),
                      F.substring(F.col("next_text"), F.lit(1), half))
    seen = near.withColumn("_edited", edited).select(
        "doc_id", n.alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("_a"), canonical(F.col("_edited")).alias("_b"), canonical(F.col("next_text")).alias("_c"))
    prints = cut(seen.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("_a")).alias("fingerprint"), third(F.col("_a")).alias("_third"),
        digest(F.col("_b")).alias("edited_fingerprint"), digest(F.col("_c")).alias("_next")))
    keyed = docs.select("doc_id", canonical(F.col("text")).alias("_text"))
    keyed = keyed.select("doc_id", "_text", digest(F.col("_text")).alias("fingerprint"))
    return class_ids(prints, keyed).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"), "class_id")
