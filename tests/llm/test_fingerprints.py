import hashlib

from pyspark.sql import functions as F

from gridloom.llm.fingerprints import canonical, class_ids, fingerprint_documents, with_next_text


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    return out


def test_against_brute_force(spark):
    rows = [(i * 37, ("Ébène 𝔘 x" * (i % 5) + str(i % 7)) if i % 6 else None) for i in range(60)]
    docs = docs_of(spark, [(*r, "clash") for r in rows])
    got = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all((got[i].n_chars, got[i].edited_sha256) == want[i] for i in want)
    for i, a in rows:
        for j, b in rows:
            assert (got[i].fingerprint == got[j].fingerprint) == ((a or "") == (b or ""))
    assert got[0].near_edited == 1.0 and got[37].near_edited in (0.0, 1.0)


def test_small_cells_give_the_same_followers(spark):
    rows = [(i * i, f"t{i}") for i in range(40)]
    docs = docs_of(spark, [(*r, None) for r in rows])
    got = {r.doc_id: r.next_text for r in with_next_text(docs, rows_per_cell=3).collect()}
    assert all(got[i * i] == f"t{(i - 1) % 40}" for i in range(40))


def test_folding_and_classes(spark):
    docs = docs_of(spark, [(5, "Café  x\n", None), (3, "café X", None), (9, "ＣAFÉ x", None), (4, "cafe x", None)])
    got = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    assert len({got[i].fingerprint for i in (5, 3, 9)}) == 1 and got[4].fingerprint != got[3].fingerprint
    assert {i: got[i].class_id for i in got} == {5: 3, 3: 3, 9: 3, 4: 4}


def test_bytes_split_a_clashing_bucket(spark):
    keyed = spark.createDataFrame([(1, "f", "a"), (2, "f", "b"), (3, "f", "a"), (4, "f", "b"), (5, "g", "c")], "doc_id long, fingerprint string, _text string")
    prints = keyed.select("doc_id", "fingerprint", F.xxhash64(F.lit(53), "_text").alias("_third"))
    assert {r.doc_id: r.class_id for r in class_ids(prints, keyed).collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}


def test_empty_null_ids_and_repeats(spark):
    assert fingerprint_documents(docs_of(spark, [])).count() == 0
    docs = docs_of(spark, [(None, "n", None), (1, "a", None), (1, "a", None), (1, None, None)])
    assert fingerprint_documents(docs).count() == 4
    alone = fingerprint_documents(docs_of(spark, [(7, "abcd", None)])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone.near_next == 1.0


def test_extreme_outlying_and_null_ids_follow_each_other(spark, monkeypatch):
    from gridloom.llm import fingerprints as P

    ids = [-(2**63), 2**63 - 1, 10**15, *range(1, 60), *range(1000, 1200, 7)]
    docs = docs_of(spark, [(i, f"t{i}", None) for i in ids] + [(None, f"n{k}", None) for k in range(30)])
    order = [f"t{i}" for i in sorted(ids, reverse=True)]
    for pieces, block in ((256, 4096), (4, 2), (1, 1)):
        monkeypatch.setattr(P, "PIECES", pieces)
        monkeypatch.setattr(P, "CELLS_PER_BLOCK", block)
        got = {r.text: r.next_text for r in with_next_text(docs, rows_per_cell=4).collect()}
        seen, text = [], order[0]
        for _ in range(len(got)):
            seen.append(text)
            text = got[text]
        assert text == order[0] and seen[: len(order)] == order and sorted(seen[len(order) :]) == sorted(f"n{k}" for k in range(30))


def test_an_outlying_id_leaves_cells_small(spark):
    from gridloom.llm import fingerprints as P

    docs = spark.range(1, 20001).select("id").union(spark.createDataFrame([(10**15,)], "id long")).select(F.col("id").alias("_value"), F.lit(False).alias("_null"))
    cells = docs.select(P._cell(P._pieces(docs, 100)).alias("c")).groupBy("c").count()
    assert cells.agg(F.max("count")).first()[0] < 1000


def test_case_is_folded_in_full(spark):
    pairs = [("STRASSE", "Straße"), ("ΟΔΟΣ", "οδος"), ("ΟΔΟΣ", "οδοσ"), ("ﬁne  É", "FINE é"), ("İ", "i̇")]
    frame = spark.createDataFrame(pairs, "a string, b string").select(canonical(F.col("a")).alias("a"), canonical(F.col("b")).alias("b"))
    assert all(r.a == r.b for r in frame.collect())
