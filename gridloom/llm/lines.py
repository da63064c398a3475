"""Near-duplicate lines by a deletion neighbourhood (operator 1).

Edits are counted in words: one word added, removed or replaced. A line and all
forms of it with one word left out are hashed; lines that share a form are
joined, their edit distance is verified on the words, and a line goes if an
earlier one lies within the bound. Earlier means a smaller doc_id, then a
smaller line number; all lines are judged on the input.

Only lines that can have a partner emit their forms. Of two lines one edit
apart either the first or the last words agree (any number below half of them),
so a line that shares neither with another is left alone. Copies fold into one
row first, and a form is joined to its earliest holder, never in all pairs.
The hash of a form is the exclusive or of the hashes of its words with their
places, so all forms of a line follow from two running totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bound, cut, listed, running, stored

#: Lines of fewer words take no part: one edit must leave a similarity of 0.8.
MIN_WORDS = 5
#: Forms and lines that are broadcast up to this many; with none, one way is taken at every size: the other side is shuffled to them.
BROADCAST_ROWS = 0
#: Document and line number as one number in reading order.
PLACE = 2**32


def normal_words(line: Column) -> Column:
    """Lower-cased words of letters, marks and digits; every digit counts as 0."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(line), r"\p{N}", "0"), r"[^\p{L}\p{M}0]+"), "")


def _place(id_: Column, at: Column) -> Column:
    return (id_.cast("decimal(20,0)") * PLACE + at).cast("decimal(38,0)")


def _part(n: Column) -> Column:
    """How many first or last words make a key: the largest of 2, 3, 4, 6, 8, 12, ... below half of ``n``."""
    half = F.floor((n - 1) / 2).cast("int")
    power = F.pow(F.lit(2.0), F.floor(F.log2(half) + 1e-9)).cast("int")
    return F.when((power >= 2) & (half * 2 >= power * 3), (power * 3 / 2).cast("int")).otherwise(power)


def keyed_lines(docs: DataFrame) -> DataFrame:
    """id, at, n, two hashes of the words and ``keys`` of every line; a line that takes no part has none.

    Keys are hashes of the first and of the last words; where that part grows
    with ``n``, also those of the shorter part.
    """
    lines = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    hashed = lines.select("id", "at", F.transform(normal_words(F.col("line")), lambda w: F.xxhash64(w)).alias("words")).withColumn("n", F.size("words"))
    sized = hashed.withColumn("own", _part(F.col("n"))).withColumn("less", _part(F.col("n") - 1))

    def keys(part: str) -> Column:
        size = F.col(part)
        return F.array(F.xxhash64(F.lit(0), size, F.slice("words", F.lit(1), size)), F.xxhash64(F.lit(1), size, F.slice("words", F.col("n") - size + 1, size)))

    both = F.when((F.col("n") > MIN_WORDS) & (F.col("own") != F.col("less")), F.concat(keys("own"), keys("less"))).otherwise(keys("own"))
    # Short lines stay, without keys: a filter here would be pushed down and split every line twice.
    none = F.array().cast("array<bigint>")
    return sized.select("id", "at", "n", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(7), "words").alias("h2"), F.when(F.col("n") >= MIN_WORDS, both).otherwise(none).alias("keys"))


def sharing_lines(docs: DataFrame) -> DataFrame:
    """Lines that share a key with another.

    id, at, n, two hashes of the words, and whether some line of other words and
    of as many words, one less or one more shares a key (same, less, more).
    """
    lines = stored(keyed_lines(docs))
    keyed = lines.select("id", "at", "n", "h1", "h2", F.explode("keys").alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("held"), F.min("h1").alias("low"), F.max("h1").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
                 .where("held > 1").select("key", (F.col("low") != F.col("high")).alias("other"), "least", "most"))
    met = keyed.join(shared, "key")
    return met.groupBy("id", "at", "n", "h1", "h2").agg(
        F.max("other").alias("same"), F.max(F.col("other") & (F.col("least") < F.col("n"))).alias("less"), F.max(F.col("other") & (F.col("most") > F.col("n"))).alias("more"))


def forms(lines: DataFrame) -> DataFrame:
    """Every form of ``lines`` (line, words, n, same, less, more) as a hashed key.

    A form with one word left out is keyed by its place too (role 1), for lines
    that differ in that word, and without it (role 2), for a line that is this
    form (role 0).
    """
    def totals_of(shift: int) -> Column:
        return running(F.transform("words", lambda w, j: F.xxhash64(w, j - shift)), lambda a, x: a.bitwiseXOR(x))

    totals = lines.withColumn("left", totals_of(0)).withColumn("right", totals_of(1))
    end = F.element_at("right", -1)
    rest = lambda i: F.element_at("left", i + 1).bitwiseXOR(end).bitwiseXOR(F.element_at("right", i + 2))
    n = F.col("n")
    places = F.sequence(F.lit(0), n - 1)
    replaced = F.when(F.col("same"), F.transform(places, lambda i: F.xxhash64(F.lit(2), n, i, rest(i))))
    shorter = F.when(F.col("less"), F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.lit(3), n - 1, rest(i)))))
    whole = F.when(F.col("more"), F.array(F.xxhash64(F.lit(3), n, F.element_at("left", -1))))
    emitted = totals.select("line", F.explode(F.array(F.struct(F.lit(0).alias("role"), whole.alias("keys")), F.struct(F.lit(1).alias("role"), replaced.alias("keys")), F.struct(F.lit(2).alias("role"), shorter.alias("keys")))).alias("made"))
    return emitted.select("line", "made.role", F.explode("made.keys").alias("key"))


def within_one_edit(a: Column, b: Column) -> Column:
    """True if one word added, removed or replaced at most turns array ``a`` into ``b``.

    The first difference is found once; past it the rests must be equal, without
    the differing word of the longer one, or of both if they are as long.
    """
    longer, shorter = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    seen = F.struct(longer.alias("long"), shorter.alias("short"), F.array_position(F.zip_with(longer, shorter, lambda x, y: ~x.eqNullSafe(y)), True).cast("int").alias("first"))
    rest = lambda words, start: F.slice(words, start, F.greatest(F.size(words) - start + 1, F.lit(0)))

    def check(s: Column) -> Column:
        more = F.size(s["long"]) - F.size(s["short"])
        after = rest(s["long"], s["first"] + 1)
        return F.when(s["first"] == 0, more <= 1).otherwise((more <= 1) & (after == rest(s["short"], s["first"] + 1 - more)))

    return F.element_at(F.transform(F.array(seen), check), 1)


def removed_lines(docs: DataFrame) -> DataFrame:
    """``id`` and ``at`` of every line with an earlier line within the bound."""
    sharing = cut(sharing_lines(docs).withColumn("line", _place(F.col("id"), F.col("at"))))
    kinds = cut(sharing.groupBy("h1", "h2", "n").agg(F.min("line").alias("first"), F.max("same").alias("same"), F.max("less").alias("less"), F.max("more").alias("more"), F.count("*").alias("copies")))
    later = sharing.join(kinds.where("copies > 1").select("h1", "h2", "n", "first"), ["h1", "h2", "n"]).where(F.col("line") != F.col("first"))

    # The words of the lines that may have a partner are read again from their documents.
    partners = kinds.where(F.col("same")).select(
        F.expr(f"cast(floor(first / {PLACE}) as bigint)").alias("doc_id"), F.expr(f"cast(first - floor(first / {PLACE}) * {PLACE} as int)").alias("at"), "same", "less", "more")
    wanted = cut(partners.groupBy("doc_id").agg(F.collect_list(F.struct("at", "same", "less", "more")).alias("places")))
    texts = docs.select("doc_id", "text").join(listed(wanted, BROADCAST_ROWS, F.size("places") + 1), "doc_id")
    lines = F.split("text", "\n")
    picked = F.transform(F.filter("places", lambda p: p["at"] < F.size("lines")), lambda p: F.struct(F.element_at("lines", p["at"] + 1).alias("line"), p.alias("place")))
    found = texts.select("doc_id", lines.alias("lines"), "places").select("doc_id", F.explode(picked).alias("found"))
    found = found.select(_place(F.col("doc_id"), F.col("found.place.at")).alias("line"), normal_words(F.col("found.line")).alias("words"), "found.place.same", "found.place.less", "found.place.more")
    lines = cut(found.withColumn("n", F.size("words")))

    emitted = stored(forms(lines))
    holders = cut(emitted.groupBy("key").agg(
        F.count("*").alias("held"), F.min(F.when(F.col("role") == 0, F.col("line"))).alias("whole"),
        F.min(F.when(F.col("role") != 0, F.col("line"))).alias("left_out")).where("held > 1").drop("held"))
    joined = emitted.join(listed(holders, BROADCAST_ROWS), "key")
    earlier = F.when(F.col("role") == 2, F.col("whole")).otherwise(F.col("left_out"))
    pairs = joined.select("line", earlier.alias("earlier")).where(F.col("earlier") < F.col("line")).distinct()
    words = lines.select(F.col("line").alias("earlier"), F.col("words").alias("earlier_words"))
    near = pairs.join(lines.select("line", "words"), "line").join(words, "earlier").where(within_one_edit(F.col("words"), F.col("earlier_words")))
    near = near.select(F.expr(f"cast(floor(line / {PLACE}) as bigint)").alias("id"), F.expr(f"cast(line - floor(line / {PLACE}) * {PLACE} as int)").alias("at"))
    return later.select("id", "at").union(near).distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with near-duplicate lines taken out of ``text``; adds ``n_lines`` and ``n_removed``.

    Lines are parted by newlines. Those of fewer than ``MIN_WORDS`` words stay
    and take no part. A null text stays null and has no lines; rows with a null
    doc_id stay as they are. Rows that share a doc_id count as one document and
    lose the same line numbers. Input columns named ``n_lines`` or ``n_removed``
    are replaced.
    """
    gone = cut(removed_lines(docs).groupBy(F.col("id").alias("gone doc_id")).agg(F.collect_list("at").alias("gone lines")))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined = docs.select(*[F.col(f"`{c}`") for c in kept]).join(gone, F.col("doc_id") == F.col("gone doc_id"), "left")
    lines = F.split("text", "\n")
    # Places that stay are a difference of sets: no line is looked up among all that go.
    staying = bound(lines, lambda own: F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), "gone lines"), lambda i: F.get(own, i)))
    left = F.when(F.col("gone lines").isNull(), lines).otherwise(staying)
    counted = joined.withColumn("all lines", lines).withColumn("left lines", left)
    size = lambda column: F.when(F.col("text").isNull(), 0).otherwise(F.size(column))
    counted = counted.withColumn("n_lines", size("all lines")).withColumn("n_removed", size("all lines") - size("left lines"))
    return counted.withColumn("text", F.array_join("left lines", "\n")).select(*[F.col(f"`{c}`") for c in kept], "n_lines", "n_removed")


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the text that is left, for every document."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, CAST(u.pos - 1 AS INT) AS pos, string_split(text, chr(10))[u.pos] AS line
  FROM documents, LATERAL (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos) u
), normal AS (
  SELECT doc_id, pos, string_split(trim(regexp_replace(regexp_replace(lower(line), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'), '\p{N}', '0', 'g')), ' ') AS w
  FROM lines
), usable AS (SELECT doc_id, pos, w, len(w) AS n, row(doc_id, pos) AS line FROM normal WHERE len(w) >= 5),
kinds AS (SELECT w, n, min(line) AS line FROM usable GROUP BY w, n),
cut AS (
  SELECT line, n, i, list_concat(w[1:i], w[i + 2:]) AS rest FROM kinds, LATERAL (SELECT unnest(generate_series(0, n - 1)) AS i) g
),
same_length AS (SELECT n, i, rest, min(line) AS first FROM cut GROUP BY n, i, rest HAVING count(*) > 1),
shorter AS (SELECT k.line AS whole, c.line AS long FROM kinds k JOIN cut c ON c.n = k.n + 1 AND c.rest = k.w),
near AS (
  SELECT c.line FROM cut c JOIN same_length s ON c.n = s.n AND c.i = s.i AND c.rest = s.rest WHERE s.first < c.line
  UNION SELECT long FROM shorter WHERE whole < long
  UNION SELECT whole FROM shorter WHERE long < whole
),
gone AS (
  SELECT line FROM near UNION SELECT u.line FROM usable u JOIN kinds k ON u.w = k.w WHERE k.line < u.line
),
marked AS (SELECT l.doc_id, l.pos, l.line, g.line IS NOT NULL AS gone FROM lines l LEFT JOIN gone g ON g.line = row(l.doc_id, l.pos))
SELECT d.doc_id, CAST(count(m.pos) AS INT) AS n_lines, CAST(count(*) FILTER (m.gone) AS INT) AS n_removed,
       sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (NOT m.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""
