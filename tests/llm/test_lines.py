import hashlib
import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from gridloom.llm import lines as L


def words_of(line):
    kept = "".join("0" if unicodedata.category(c)[0] == "N" else c if unicodedata.category(c)[0] in "LM" else " " for c in line.lower())
    return re.sub(" +", " ", kept).strip(" ").split(" ")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    lines = sorted({(i, at, line) for i, t in rows if t is not None and i is not None for at, line in enumerate(t.split("\n"))})
    out = {}
    usable = [(i, at, words_of(line)) for i, at, line in lines if len(words_of(line)) >= 5]
    gone = {(i, at) for k, (i, at, w) in enumerate(usable) if any(distance(w, v) <= 1 for *_, v in usable[:k])}
    for i, t in rows:
        own = [] if t is None else t.split("\n")
        left = [x for at, x in enumerate(own) if (i, at) not in gone]
        out[i] = (len(own), len(own) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def made(seed, n=40):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefg") + str(rng.choice(["", "é", "x"])) for _ in range(rng.randrange(2, 14))] for _ in range(12)]

    def line():
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = [rng.choice("pqrs")] * rng.randrange(2)
        return rng.choice([" ", ", "]).join(w)

    return [(i * 3, "\n".join(line() for _ in range(rng.randrange(5)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_lines string")
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in L.dedup_report(docs).collect()} == brute(rows)


def test_parts_meet_for_neighbouring_lengths(spark):
    got = {r.n: r.p for r in spark.range(5, 300).selectExpr("cast(id as int) n").select("n", L._part(F.col("n")).alias("p")).collect()}
    assert [got[n] for n in (5, 6, 7, 8, 9, 12, 13, 17, 25)] == [2, 2, 3, 3, 4, 4, 6, 8, 12]
    assert all(2 * p <= n - 1 for n, p in got.items())


def test_edit_check(spark):
    cases = [("a b c", "a b c"), ("a b c", "a x c"), ("a b c", "a b"), ("a b", "x a b"), ("a b c", "b a c"), ("a b c d", "a b"), ("a a b", "a b"), ("a", "b c")]
    frame = spark.createDataFrame([(a.split(), b.split()) for a, b in cases], "a array<string>, b array<string>")
    got = [r[0] for r in frame.select(L.within_one_edit(F.col("a"), F.col("b"))).collect()]
    assert got == [distance(a.split(), b.split()) <= 1 for a, b in cases]


def test_odd_rows_and_both_ways_of_reading_words(spark, monkeypatch):
    long = " ".join(f"w{i}q" for i in range(3000))
    same = "one two three four five six"
    rows = [(1, None), (2, ""), (3, f"{same}\n\n{long} end"), (4, f"{same.upper()}!\n{long}"), (5, "Year 2019 was a fine year"), (6, "Year 2020 was a fine year\nshort one")]
    docs = spark.createDataFrame([*rows, (None, same)], "doc_id long, text string")
    want = brute(rows)
    for most in (10, 0):
        monkeypatch.setattr(L, "BROADCAST_ROWS", most)
        got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in L.dedup_report(docs).collect()}
        assert got.pop(None) == (1, 0, hashlib.sha256(same.encode()).hexdigest()) and got == want
    twice = docs.union(docs)
    assert sorted(r.n_removed for r in L.dedup_report(twice).collect()) == sorted(2 * [r.n_removed for r in L.dedup_report(docs).collect()])
    assert L.dedup_report(docs.limit(0)).count() == 0


def test_extra_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 7, "x"), (2, "a b c d e\nq", 8, "y")], "doc_id long, text string, _id int, _gone string")
    got = sorted(L.dedup_lines(docs).collect())
    assert [(r.doc_id, r.text, r._id, r._gone, r.n_lines, r.n_removed) for r in got] == [(1, "a b c d e", 7, "x", 1, 0), (2, "q", 8, "y", 2, 1)]


def test_long_lines_and_many_removed_lines_take_linear_time(spark):
    long = [f"w{k}q" for k in range(64_000)]
    many = "\n".join(f"line {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)} holds some more words" for k in range(15_000))
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(["other", *long[1:]])), (3, many), (4, many + "\nthe last line stays where it is")], "doc_id long, text string")
    begun = time.time()
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in L.dedup_report(docs).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (15_000, got[3][1]), 4: (15_001, 15_000)} and time.time() - begun < 60
