from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from gridloom.llm.sharding import assign_shards, communication_matrix, draw_hypergeometric, shard_documents


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, shard string")


def test_hypergeometric_matches_its_law():
    rng = np.random.default_rng(1)
    drawn = np.array([draw_hypergeometric(rng, 30, 70, 20) for _ in range(4000)])
    assert abs(drawn.mean() - 6) < 0.12
    assert abs(drawn.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    assert draw_hypergeometric(rng, 3, 0, 2) == 2
    big = draw_hypergeometric(rng, 10**12, 10**12, 10**6)
    assert abs(big - 5 * 10**5) < 10**4


def test_matrix_meets_both_sums():
    m = communication_matrix([5, 0, 17, 3], [9, 8, 8], seed=3)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 3] and m.sum(axis=0).tolist() == [9, 8, 8]


@pytest.mark.parametrize("n", [0, 1, 7, 100])
def test_sizes_and_slots(spark, n):
    docs = rows_of(spark, [(i, f"text {i % 3}", "x") for i in range(n)])
    got = shard_documents(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    sizes = Counter(r.shard for r in got)
    assert all(n // 8 <= sizes[k] <= -(-n // 8) for k in range(8))
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
    for r in got:
        assert r.size == len(f"text {r.doc_id % 3}") + 1 and r.text_crc32 == crc32(f"text {r.doc_id % 3}".encode())


def test_nulls_repeats_and_many_cells(spark):
    docs = rows_of(spark, [(None, None, None), (1, "", "x"), (1, "", "x"), (2, "é", "y")] * 25)
    got = assign_shards(docs.select("doc_id", "text"), ["doc_id", "text"], n_shards=3, rows_per_cell=7).collect()
    assert Counter(r.shard for r in got) == {0: 34, 1: 33, 2: 33}
    for k in range(3):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    sizes = Counter((r.doc_id, r.size) for r in shard_documents(docs).collect())
    assert sizes == {(None, 1): 25, (1, 1): 50, (2, 3): 25}


def test_shuffle_looks_uniform(spark):
    docs = rows_of(spark, [(i, "t", None) for i in range(4000)])
    got = assign_shards(docs, ["doc_id"], n_shards=4, rows_per_cell=300).select("doc_id", "shard", "slot").collect()
    by_half = Counter((r.doc_id < 2000, r.shard) for r in got)
    assert all(430 < by_half[True, k] < 570 for k in range(4))
    early = sum(r.doc_id < 2000 for r in got if r.slot < 500)
    assert 900 < early < 1100
