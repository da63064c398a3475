import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import substrings as S
from gridloom.llm import suffix_array as A

FIELDS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(raw[p : p + length])
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(raw) else 0
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])).hexdigest())
    return out


def made(seed, n=30, alphabet="abcé "):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [text(rng.randrange(60, 300)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [rng.choice([text(rng.randrange(0, 80)), rng.choice(shared), rng.choice(shared)[10:150]]) for _ in range(rng.randrange(0, 5))]
        rows.append((i * 7, "".join(parts)))
    return rows + [(10_000 + k, rows[3][1]) for k in range(3)] + [(20_000, "z" * 700), (20_001, "xy" * 300), (20_002, None), (20_003, "")]


def check(spark, rows, length=100):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in S.report_repeats(docs, length).collect()}
    assert got == brute(rows, length)


def test_documents_against_brute_force(spark):
    check(spark, made(1))


def test_crowded_runs_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_PIECES", 2)
    monkeypatch.setattr(S, "SHARD_BYTES", 500)
    check(spark, made(2) + [(30_000 + k, f"{k} left of it " + "the common passage that all of these documents hold in their midst, word for word, " * 2 + f" {k}") for k in range(30)])


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "q" * 300), (1, "q" * 300)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in S.report_repeats(docs).collect()) == [(0, 0), (1, 299)]
    assert S.report_repeats(docs.limit(0)).count() == 0
    rows = S.remove_repeats(spark.createDataFrame([(1, "é" * 200, 5), (2, "é" * 200 + "end", 6)], "doc_id long, text string, n_chars int")).collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in rows) == [(1, "é", 5), (2, "end", 6)]
    named = spark.createDataFrame([(1, "é" * 200, 5, "a"), (2, "é" * 200 + "end", 6, "b")], "doc_id long, text string, `Span List` int, `span doc_id` string")
    kept = S.remove_repeats(named)
    assert kept.columns == named.columns and sorted(map(tuple, kept.collect())) == [(1, "é", 5, "a"), (2, "end", 6, "b")]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab", max_size=80) | st.text(alphabet="abcdef", max_size=120), st.booleans())
def test_suffix_array_and_prefixes(text, recurse):
    raw = np.frombuffer(text.encode(), np.uint8)
    kept, A.RECURSE_BELOW = A.RECURSE_BELOW, 1024 if recurse else 0
    try:
        symbols = np.append(raw.astype(np.int64) + 1, 0)
        array = A.suffix_array(symbols, 258)
    finally:
        A.RECURSE_BELOW = kept
    assert array.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
    shared = A.permuted_prefixes(raw, array)
    for x, y in zip(array[:-1], array[1:], strict=True):
        k = 0
        while max(x, y) + k < len(raw) and raw[x + k] == raw[y + k]:
            k += 1
        assert shared[y] == k


@pytest.mark.parametrize("seed", range(4))
def test_pieces_cover_every_start_once_and_depend_on_content(seed):
    texts = [(t or "").encode() for _, t in made(seed)]
    owner, at, starts, run, content = S.pieces_of(texts)
    keys = {}
    for o, a, n, r, c in zip(owner, at, starts, run, content, strict=True):
        for p in range(a, a + n):
            keys.setdefault(texts[o][p : p + 100], set()).add(int(r))
            assert 0 <= p <= len(texts[o]) - 100
    assert sum(starts) == sum(max(0, len(t) - 99) for t in texts)
    assert all(len(v) == 1 for v in keys.values())


def test_long_repeats_are_fully_ordered():
    rng = random.Random(3)
    block = "".join(rng.choice("abcdefgh ") for _ in range(700))
    text = "|".join(block[rng.randrange(300) : rng.randrange(400, 700)] for _ in range(40)).encode()
    raw = np.frombuffer(text, np.uint8)
    array = A.suffix_array(np.append(raw.astype(np.int64) + 1, 0), 258)
    assert array.tolist() == sorted(range(len(text) + 1), key=lambda i: text[i:])
    shared = A.permuted_prefixes(raw, array)
    for x, y in zip(array[:-1:7].tolist(), array[1::7].tolist(), strict=False):
        k = 0
        while max(x, y) + k < len(text) and text[x + k] == text[y + k]:
            k += 1
        assert shared[y] == k


def test_extra_columns_stay(spark):
    docs = spark.createDataFrame([(1, "w" * 99 + "v", 7, "x"), (2, "w" * 99 + "v" + "!", 8, "y")], "doc_id long, text string, _id int, spans string")
    assert sorted(map(tuple, S.remove_repeats(docs).collect())) == [(1, "w" * 99 + "v", 7, "x"), (2, "!", 8, "y")]
