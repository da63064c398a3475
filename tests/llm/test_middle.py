import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import middle as M


def brute(doc_id, text):
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    text = text or ""
    n = len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts(seed, n):
    rng = random.Random(seed)
    letters = ["a", "é", "ß", "中", "🙂", "é", "\n", "<", ">", "P", "S", "M", " ", "‍", "\U0010ffff", "\x00"]
    return ["".join(rng.choices(letters, k=rng.choice([0, 1, 2, 3, 7, 40, 300]))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = list(enumerate(texts(seed, 400), seed * 1000))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: brute(i, t) for i, t in rows}
    assert {r.doc_id: tuple(r)[1:] for r in M.fill_in_middle(docs).collect()} == want
    forms = {w[1] for w in want.values()}
    assert forms == set(M.FORMS)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.doc_id: (r.output_sha256, r.restored_sha256) for r in M.report_middle(docs).collect()}
    assert got == {i: (digest(want[i][4]), digest(t)) for i, t in rows}


def test_odd_rows(spark):
    long = "wörd 🙂 " * 300_000
    rows = [(1, None, 5), (2, "", 5), (3, "a <S> b", 5), (None, "null id", 5), (None, None, 5), (5, long, 5), (5, "twice", 5), (5, "twice", 5), (6, "<", 5), (7, "<<P", 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, output int").repartition(2)
    got = sorted(((r.doc_id or 0, *tuple(r)[1:]) for r in M.fill_in_middle(docs).collect()), key=repr)
    assert got == sorted(((i or 0, *brute(i, t)) for i, t, _ in rows), key=repr)
    assert M.report_middle(docs).count() == len(rows) and M.report_middle(docs.limit(0)).count() == 0
    assert all(r.restored_sha256 == hashlib.sha256(long.encode()).hexdigest() for r in M.report_middle(docs).where("n > 1000").collect())


def test_kernel_on_slices_and_without_bytes():
    texts = pa.array(["skip", "ab", None, "é🙂", ""])[1:]
    h = np.array([2, 0, 1, 0]), np.array([1, 0, 2, 0])
    n, prefix, middle, output = M.rearrange(texts, *h, np.array([1, 0, 2, 0]))
    assert n.tolist() == [2, 0, 2, 0] and prefix.tolist() == [1, 0, 1, 0] and middle.tolist() == [1, 0, 1, 0]
    assert output.to_pylist() == ["<P>a<S><M>b", "", "<S><P>é<M>🙂", ""]
    n, *_, output = M.rearrange(pa.array([None, ""], pa.string()), np.array([3, 4]), np.array([1, 1]), np.array([0, 0]))
    assert n.tolist() == [0, 0] and output.to_pylist() == ["", ""]
