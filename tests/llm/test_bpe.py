import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm.bpe import Merges, decode_tokens, encode_documents, replay, token_ids

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def merges():
    return Merges(PATH)


def test_random_words(encoding, merges):
    rng = random.Random(3)
    words = ["".join(rng.choice("aabénthe ") for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    words += ["a" * k for k in range(60)] + ["ha" * k + "a" for k in range(30)]
    for word, ids in zip(words, replay([w.encode() for w in words], merges), strict=True):
        assert ids.tolist() == (encoding._encode_single_piece(word) if word else [])
    assert replay([], merges) == [] and [len(x) for x in replay([b"", b""], merges)] == [0, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=12), max_size=8))
def test_any_bytes(encoding, merges, words):
    for word, ids in zip(words, replay(words, merges), strict=True):
        assert ids.tolist() == (encoding._encode_single_piece(word) if word else [])


def test_a_merge_can_make_a_lower_pair(tmp_path):
    path = tmp_path / "ranks"
    tokens = [bytes([b]) for b in range(256)] + [b"abab", b"ab", b"aba"]
    path.write_bytes(b"".join(base64.b64encode(t) + b" " + str(r).encode() + b"\n" for r, t in enumerate(tokens)))
    ranks = {t: r for r, t in enumerate(tokens)}
    own = tiktoken.Encoding("x", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    words = ["ab" * k + "a" * j for k in range(1, 9) for j in range(3)]
    for word, ids in zip(words, replay([w.encode() for w in words], Merges(str(path))), strict=True):
        assert ids.tolist() == own.encode_ordinary(word)


def test_documents_round_trip(spark, encoding):
    texts = [None, "", "It's  12 naïve\n\n 𝔘nits  ", "x" * 5000, "the the", "the the", " \t "]
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    for r in encode_documents(docs, PATH, P.PATTERN).collect():
        text = texts[r.doc_id] or ""
        ids = encoding.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = {r.doc_id: r.text for r in decode_tokens(token_ids(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert encode_documents(docs.limit(0), PATH, P.PATTERN).count() == 0
