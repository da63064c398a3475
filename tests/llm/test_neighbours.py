import numpy as np
from pyspark.sql import functions as F

from gridloom.llm.neighbours import hilbert_keys, nearest, search_embeddings

SHAPE = "vec_id long, embedding array<float>, score string"


def brute(rows, k=20):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for i, v in zip(ids, vectors, strict=True):
        if i % 20 == 0:
            scores = vectors @ v
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), scores[j]) for j in order]
    return out


def test_hilbert_is_a_walk_through_all_cells():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    keys = hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_recall_and_ranks_on_random_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(3000, 24)).astype(np.float32).tolist())]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SHAPE)
    got = nearest(docs, F.col("vec_id") % 20 == 0, rows_per_bucket=64).collect()
    want = brute(rows)
    by = {}
    for r in got:
        by.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert by.keys() == want.keys() and all(sorted(v) == list(range(1, 21)) for v in by.values())
    hits = np.mean([len({i for i, _ in by[q].values()} & {i for i, _ in want[q]}) / 20 for q in want])
    assert hits >= 0.9, hits
    vectors = dict(rows)
    for q, found in by.items():
        for i, s in found.values():
            assert abs(np.dot(np.float64(vectors[q]), np.float64(vectors[i])) - s) < 1e-9
        assert [found[k] for k in range(1, 21)] == sorted(found.values(), key=lambda x: (-x[1], x[0]))


def test_copies_ties_and_bad_vectors(spark):
    one, two = [1.0, 0.0], [0.0, 2.0]
    rows = [(i, one, "c") for i in range(100)] + [(i, two, "c") for i in range(100, 140)] + [(40, one, "again")]
    rows += [(200, None, ""), (220, [0.0, 0.0], ""), (240, [float("nan"), 1.0], ""), (260, [None, 1.0], ""), (280, [1.0], ""), (None, one, ""), (300, [float("inf"), 0.0], "")]
    got = {}
    for r in search_embeddings(spark.createDataFrame(rows, SHAPE)).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(got) == [0, 20, 40, 60, 80, 100, 120]
    assert [got[40][k] for k in range(1, 21)] == [(i, 1.0) for i in range(20)]
    assert [got[0][k][0] for k in range(1, 21)] == list(range(1, 21))
    assert [got[120][k] for k in range(1, 21)] == [(i, 4.0) for i in range(100, 120)]


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], ""), (1, [2.0, 1.0], ""), (2, [-1.0, 0.0], "")], SHAPE)
    assert [(r.rank, r.vec_id, r.score) for r in search_embeddings(few).orderBy("rank").collect()] == [(1, 1, 4.0), (2, 2, -1.0)]
    assert search_embeddings(few.limit(0)).count() == 0
    assert search_embeddings(few.where("vec_id > 0")).count() == 0


def test_windows_stay_narrow_where_vectors_have_structure(spark, monkeypatch):
    """Many clusters, and many more rows than a few buckets: most neighbours are found, most rows are never met."""
    from gridloom.llm import neighbours as N

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(300, 24))
    made = centres[rng.integers(0, 300, 12000)] + rng.normal(scale=0.15, size=(12000, 24))
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    rows = [(i, v) for i, v in enumerate(made.astype(np.float32).tolist())]
    widths = []
    measured = N.window_width
    monkeypatch.setattr(N, "window_width", lambda *a: widths.append(measured(*a)) or widths[-1])
    got = {}
    for r in nearest(spark.createDataFrame([(*r, "x") for r in rows], SHAPE), F.col("vec_id") % 20 == 0, rows_per_bucket=32).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    buckets = -(-len(rows) // 32)
    assert N.CURVES * (2 * widths[0] + 1) / buckets < 0.5, widths
