import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import secrets as S


def brute(text):
    """Spans by Python's own matcher, base rules as the contract words them."""
    text, spans = text or "", []
    words = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    base = [(0, words, 2, 6), (1, r"AKIA[A-Z0-9]+", 0, 20), (2, r"[0-9a-f]+", 0, 24)]
    more = [(k, r.pattern, r.group, r.least) for k, r in enumerate(S.RULES) if k >= len(base)]
    for order, pattern, group, least in base + more:
        spans += [(m.start(), order, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m.group(group)) >= least]
    return sorted(spans)


def made(seed, n=300):
    rng = random.Random(seed)
    pieces = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "pass word", "\"", "'", " ", "  ", ":", "=", "=", "abc", "abcdef", "x+/_.=-y", "AKIA", "AKIA" + "Z9" * 8, "AKIA" + "Q" * 30,
              "0123456789abcdef" * 2, "deadbeef", "é", "🙂", "\n", "ſecret", "toKen", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "gho_short", "xoxb-12345-abcdefg",
              "AIza" + "k" * 35, "eyJhb.eyJzdWI.sig_", "İ"]
    return [(k, "".join(rng.choices(pieces, k=rng.choice([0, 1, 3, 8, 20])))) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    got = {r.doc_id: [tuple(m) for m in r.spans] for r in S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: sorted(m) for i, m in got.items()} == {i: brute(t) for i, t in rows}
    assert {order for m in got.values() for _, order, _ in m} == set(range(len(S.RULES)))


def test_queries_read_off_expressions():
    def q(pattern):
        return {tuple(sorted(c)) for c in S.trigram_query(pattern)}

    assert q("AKIA[A-Z0-9]+") == {("aki", "kia")}
    assert q("[0-9a-f]{24,}") == {()}
    assert q("(?i:tokens?|api_?key)") == {("ken", "oke", "tok"), ("_ke", "api", "i_k", "key", "pi_"), ("api", "ike", "key", "pik")}
    assert q("gh[ps]_.+") == {("ghp", "hp_"), ("ghs", "hs_")}
    assert q("abc.*xyz") == {("abc", "xyz")} and q("(abc)?def") == {("def",)} and q("(abc)+d") == {("abc",)} and q("ab|cde") == {()}
    assert q("abc(x*|yyy)def") == {("abc", "def")} and q("^abc$") == {("abc",)} and q("a{3}b") == {("aaa", "aab")} and q(r"\d\d\d") == {()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_match_always_meets_the_query(seed):
    texts = [t for _, t in made(seed, 2000)]
    for rule in S.RULES:
        query = S.trigram_query(rule.pattern)
        for text in texts:
            if re.search(rule.pattern, text, re.ASCII):
                assert any(all(t in text.lower() for t in clause) for clause in query)


def test_only_candidates_are_verified(spark):
    docs = spark.createDataFrame([(1, "tok oke ken"), (2, "token = abcdef"), (3, "nothing"), (4, "AKI KIA")], "doc_id long, text string")
    queries = {r.kind: S.trigram_query(r.pattern) for r in S.BASE_RULES[:2]}
    trigrams = sorted({t for q in queries.values() for c in q for t in c})
    index = S.build_index(docs, trigrams)
    keys = {r.key: r.doc_id for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key")).collect()}
    assert {keys[r.key]: r.kinds for r in S.candidates(index, queries).collect()} == {1: ["assign"], 2: ["assign"], 4: ["access"]}
    assert sorted({r.trigram for r in index.collect()}) == ["aki", "ken", "kia", "oke", "tok"]


def test_odd_rows(spark):
    long = "x token=abcdef1 " * 20_000
    rows = [(1, None, 5), (2, "", 5), (None, "secret: 123456", 5), (None, "secret: 123456", 5), (4, long, 5), (5, "AKIA" * 5, 5), (5, "AKIA" * 5, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = S.report_secrets(docs).collect()
    names = [r.kind for r in S.RULES]
    want = []
    for i, t, _ in rows:
        spans = brute(t)
        text = ",".join(f"{names[o]}:{a}:{b}" for a, o, b in spans)
        want.append((i, *[sum(o == k for _, o, _ in spans) for k in range(3)], hashlib.sha256(text.encode()).hexdigest(), text))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert S.report_secrets(docs.limit(0)).count() == 0
    no_query = (S.BASE_RULES[2],)
    assert [r.spans for r in S.find_secrets(docs, no_query).collect()] == [[]] * len(rows)


def test_running_total(spark):
    for n in (0, 1, 2, 3, 10, 101):
        row = spark.range(1).select(F.array(*[F.lit(k) for k in range(n)]).cast("array<bigint>").alias("x")).select(S.running(F.col("x"), lambda a, x: a + x).alias("t")).first()
        assert row.t == [sum(range(k)) for k in range(n + 1)]


def test_plan_is_native(spark):
    docs = spark.createDataFrame(made(1, 5), "doc_id long, text string")
    plan = S.report_secrets(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
