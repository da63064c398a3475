import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers

from gridloom.llm.packing import WordIds, pack, pack_documents, packed_sequences, plan_best_fit, ranked

PATH = public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def whole(text):
    return [*tokenizer().encode(text, add_special_tokens=False).ids, 0]


def check_filled(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_words_encode_as_whole_texts_do():
    known = WordIds(PATH)
    rng = random.Random(3)
    odd = "aA'zéÉß ÄİıǰJ\u030cKK.,;<>!?-_`~[]\\^{}|\x01\n\t\r   0123ſŉʼªº×÷ƒɐʯʰ日本"
    made = ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 14))) for _ in range(2000)]
    for text in ("It's  Thé á x y\n\tZ's't. ,,", "a\x01b \x01", "", "  \r\n", "ÀΣ İstanbul 12 345", "a<|endoftext|>b.", "Word. wOrd.,; word", *made):
        assert np.frombuffer(known.ids(text) + b"\0\0\0\0", "<u4").tolist() == whole(text)
    assert known.ids(None) == b""


def test_plan_uses_every_piece_once():
    rng = random.Random(5)
    histogram = {n: rng.randrange(1, 60) for n in rng.sample(range(1, 65), 40)}
    taken = defaultdict(list)
    room = defaultdict(int)
    for length, rank, count, first, offset in plan_best_fit(histogram, 64):
        taken[length] += range(rank, rank + count)
        for s in range(first, first + count):
            assert offset == room[s]
            room[s] += length
    assert {k: sorted(v) for k, v in taken.items()} == {k: list(range(v)) for k, v in histogram.items()}
    least = -(-sum(k * v for k, v in histogram.items()) // 64)
    assert max(room.values()) <= 64 and len(room) <= least * 1.05 + 1


def test_documents(spark):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (4, "The cat, the dog."), (4, "The cat, the dog."), (None, "x " * 2047)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    got = pack_documents(docs, PATH).collect()
    check_filled(got, 2048)
    pieces = sorted(((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got))
    want = []
    for i, t in rows:
        ids = whole(t or "")
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append((i or 0, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert pieces == sorted(want)
    assert pack_documents(docs.limit(0), PATH).count() == 0


def test_hot_length_is_ranked_in_cells(spark):
    pieces = spark.range(3000).selectExpr("id doc_id", "0 piece", "0L start", "if(id % 3 = 0, 7L, 5L) length", "id ids_crc32")
    got = ranked(pieces, rows_per_cell=100).collect()
    for length, n in ((7, 1000), (5, 2000)):
        assert sorted(r._rank for r in got if r.length == length) == list(range(n))
    assert check_filled(pack(pieces, 12).collect(), 12) == 1000 + 500


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, f"some words {i} " * (i % 9)) for i in range(40)], "doc_id long, text string")
    packed = pack_documents(docs, PATH, capacity=32)
    got = {r.sequence_id: r.ids for r in packed_sequences(docs, packed, PATH).collect()}
    for r in packed.collect():
        assert zlib.crc32(np.array(got[r.sequence_id][r.offset : r.offset + r.length], "<u4").tobytes()) == r.ids_crc32
