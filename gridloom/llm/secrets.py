"""Secrets in whole texts, found through an inverted index of trigrams (operator 11).

Every rule is a regular expression. What a match must hold is read off the
expression as a Boolean query over trigrams: an OR of clauses, each an AND of
trigrams. The index maps a trigram to the rows whose lower-cased text holds it;
it is built for the trigrams that the rules ask for, stored in trigram order, and
a clause's postings are intersected by counting, for each row, how many of its
trigrams were met. Rows that meet a clause are verified by the expression on the
whole text. A rule without mandatory trigrams is matched on every text.

Only column functions run on Spark; the queries are read off the few rules in the driver.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as ops
from re import _parser as reader

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bound, running, stored

#: Strings that a part of an expression is spelt out into, and clauses of a query; beyond, a part is left out of the query, which only admits more rows.
MOST_SPELT, MOST_CLAUSES = 64, 64
#: Parts that the postings of one trigram are dealt to.
SALTS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least number of characters of a group; shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of 24 or more: shorter runs are no match, and no part of one
)
#: Public formats of further secrets.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES

#: An OR of ANDs of trigrams; no clause at all can be met by nothing, an empty clause by everything.
Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset([frozenset()])


def _least(query: set[frozenset[str]]) -> Query:
    """Without clauses that ask for more than another one does."""
    return frozenset(c for c in query if not any(d < c for d in query))


def _both(a: Query, b: Query) -> Query:
    """What satisfies both queries; the narrower of the two alone, if that has too many clauses."""
    if len(a) * len(b) > MOST_CLAUSES:
        return min(a, b, key=lambda q: (q == ANYTHING, len(q)))
    return _least({x | y for x, y in itertools.product(a, b)})


def _either(parts: list[Query]) -> Query:
    met = _least(set().union(*parts))
    return met if len(met) <= MOST_CLAUSES else ANYTHING


def _of_strings(strings: frozenset[str]) -> Query:
    """The trigrams of one of these strings."""
    return _either([frozenset([frozenset(s[k : k + 3] for k in range(len(s) - 2))]) for s in strings])


def _read(items) -> tuple[frozenset[str] | None, Query]:
    """All strings that a sequence matches, if they are few, else None; and the query of what else it must hold."""
    spelt, query = frozenset([""]), ANYTHING

    def flush(again: frozenset[str]) -> None:
        nonlocal spelt, query, broken
        query, spelt, broken = _both(query, _of_strings(spelt)), again, True

    broken = False
    for op, value in items:
        strings, inner = _strings(op, value)
        query = _both(query, inner)
        if strings is None:
            flush(frozenset([""]))
        elif len(strings) * len(spelt) > MOST_SPELT:
            flush(strings)
        else:
            spelt = frozenset(a + b for a, b in itertools.product(spelt, strings))
    if broken:
        flush(frozenset([""]))
        return None, query
    return spelt, query


def _strings(op, value) -> tuple[frozenset[str] | None, Query]:
    """What one node of an expression spells, in lower case, and the query of what it must hold besides."""
    if op is ops.LITERAL:
        return frozenset([chr(value).lower() if value < 128 else chr(value)]), ANYTHING
    if op is ops.IN:
        found = set()
        for kind, one in value:
            codes = [one] if kind is ops.LITERAL else range(one[0], one[1] + 1) if kind is ops.RANGE and one[1] - one[0] < MOST_SPELT else None
            if codes is None:
                return None, ANYTHING
            found |= {chr(c).lower() for c in codes}
        # A wide class names no trigram worth asking for.
        return (frozenset(found), ANYTHING) if len(found) <= 8 and all(len(c) == 1 and c.isascii() for c in found) else (None, ANYTHING)
    if op is ops.SUBPATTERN:
        return _read(value[3])
    if op is ops.BRANCH:
        read = [_read(branch) for branch in value[1]]
        if all(strings is not None for strings, _ in read):
            union = frozenset().union(*(strings for strings, _ in read))
            if len(union) <= MOST_SPELT:
                return union, ANYTHING
        return None, _either([query if strings is None else _both(query, _of_strings(strings)) for strings, query in read])
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
        low, high, inner = value
        strings, query = _read(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ANYTHING
        if low == 0:
            return None, ANYTHING
        if low == high and low <= 4 and strings is not None and len(strings) ** low <= MOST_SPELT:
            return frozenset("".join(p) for p in itertools.product(strings, repeat=low)), ANYTHING
        return None, query if strings is None else _both(query, _of_strings(strings))
    if op is ops.AT:
        return frozenset([""]), ANYTHING
    return None, ANYTHING


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text of any match must hold; ANYTHING if the expression has no mandatory trigram."""
    strings, query = _read(reader.parse(pattern))
    return query if strings is None else _both(query, _of_strings(strings))


def _key() -> Column:
    """Names a row in the index. Rows that share a key by chance share postings, which only admits more of them to the check."""
    return F.xxhash64("doc_id", "text")


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The postings (trigram, key) of ``trigrams`` in ``docs`` (doc_id, text), stored in the order of trigrams.

    The postings of a trigram that many rows hold are spread over files.
    """
    held = bound(F.lower("text"), lambda lower: F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(lower, t)))
    postings = docs.select(_key().alias("key"), F.explode(held).alias("trigram"))
    return stored(postings.repartition("trigram", F.pmod("key", F.lit(SALTS))).sortWithinPartitions("trigram", "key"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """key, kinds: the rows that meet a clause of the queries, with the kinds whose clauses they meet."""
    clauses = [(kind, number, trigram, len(clause)) for kind, query in queries.items() for number, clause in enumerate(sorted(map(sorted, query))) for trigram in clause]
    asked = index.sparkSession.createDataFrame(clauses, "kind string, clause int, trigram string, wanted int")
    # The clauses are those of the rules, whatever the documents.
    met = index.join(F.broadcast(asked), "trigram").groupBy("key", "kind", "clause", "wanted").agg(F.count_distinct("trigram").alias("met"))
    return met.where("met = wanted").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The matches of a rule in a text as structs (first, order, last): code points, end exclusive; null for a null text."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda s: F.char_length(s).cast("long"))
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda s: F.char_length(s).cast("long"))
    measured = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda s: F.char_length(s).cast("long"))
    # Gap, match, gap, match: both ends of a match are totals of what stands before.
    steps = F.flatten(F.zip_with(gaps, sizes, lambda gap, size: F.array(gap, F.coalesce(size, F.lit(0).cast("long")))))

    def found(places: Column) -> Column:
        return F.transform(measured, lambda size, k: F.struct(F.element_at(places, 2 * k + 2).alias("first"), F.lit(order).alias("order"), F.element_at(places, 2 * k + 3).alias("last"), size.alias("size")))

    kept = F.filter(bound(running(steps, lambda a, x: a + x), found), lambda m: m["size"] >= rule.least)
    return F.transform(kept, lambda m: F.struct(m["first"].alias("first"), m["order"].alias("order"), m["last"].alias("last")))


def written(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans as kind:start:end, comma-joined, by start and then by the order of the rules."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(F.array_sort(spans), lambda m: F.concat_ws(":", F.element_at(kinds, m["order"] + 1), m["first"].cast("string"), m["last"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text and ``spans`` (array of structs first, order, last) of every row of ``docs``.

    ``order`` is the rule's place in ``rules``. Matches of one rule are leftmost
    and do not overlap; those of different rules may. A null text is empty and
    has no spans; a null doc_id is an id like others; repeated rows come out
    repeatedly; an empty table gives no rows. Columns other than doc_id and text
    are not read, whatever they are called.

    Texts move once, to meet their candidate kinds by key. Rows of one key are
    equal rows (or clash by chance); adaptive execution splits them if they are many.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {kind: query for kind, query in queries.items() if query != ANYTHING}
    trigrams = sorted(set().union(*itertools.chain.from_iterable(asked.values()))) if asked else []
    if trigrams:
        found = candidates(build_index(rows, trigrams), asked)
        met = rows.withColumn("key", _key()).join(found.hint("shuffle_hash"), "key", "left")
    else:
        met = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<struct<first:bigint,order:int,last:bigint>>")
    each = [spans_of(F.col("text"), r, k) if r.kind not in asked else F.when(F.array_contains("kinds", r.kind), spans_of(F.col("text"), r, k)) for k, r in enumerate(rules)]
    return met.select("doc_id", "text", F.concat(*[F.coalesce(one, empty) for one in each]).alias("spans"))


def report_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; see ``find_secrets`` for odd rows."""
    found = find_secrets(docs, RULES)
    base = F.filter("spans", lambda m: m["order"] < len(BASE_RULES))

    def count(order: int) -> Column:
        return F.size(F.filter("spans", lambda m: m["order"] == order)).cast("long")

    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(written(base, RULES), 256).alias("base_sha256"), written(F.col("spans"), RULES).alias("spans"))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL of ``report_secrets``; letters in either case are spelt out, as there more than ASCII letters have two cases."""

    def plain(pattern: str) -> str:
        words = {w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")}
        spelt = pattern.replace("(?i:password|passwd|secret|token|api_?key)", "|".join(words.values())).replace(r"\x20", " ")
        return spelt.replace("'", "''")

    parts = [f"""SELECT id, '{r.kind}' AS kind, {k} AS ord, {r.least} AS least, string_split_regex(text, '{plain(r.pattern)}') AS gaps,
        regexp_extract_all(text, '{plain(r.pattern)}', 0) AS whole, regexp_extract_all(text, '{plain(r.pattern)}', {r.group}) AS part FROM docs""" for k, r in enumerate(rules)]
    return f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
matched AS ({" UNION ALL ".join(parts)}),
opened AS (SELECT id, kind, ord, least, gaps, whole, part, unnest(range(1, len(whole) + 1)) AS k FROM matched WHERE len(whole) > 0),
placed AS (
    SELECT id, kind, ord, len(whole[k]) AS size,
           list_sum(list_transform(gaps[1:k], lambda s: len(s)))::BIGINT + coalesce(list_sum(list_transform(whole[1:k - 1], lambda s: len(s))), 0)::BIGINT AS first
    FROM opened WHERE len(part[k]) >= least),
listed AS (
    SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(kind || ':' || first || ':' || (first + size), ',' ORDER BY first, ord) AS spans,
           string_agg(kind || ':' || first || ':' || (first + size), ',' ORDER BY first, ord) FILTER (ord < {len(BASE_RULES)}) AS base
    FROM placed GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (id)
"""
