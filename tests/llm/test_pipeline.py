import random

import pytest

import corpus_pipeline as P
from tests.llm import test_jaccard, test_lines
from tests.llm.test_packing import check_filled, whole

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def strip_repeats(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows):
        raw = t.encode()
        gone = set()
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone.update(range(p, p + length))
            seen.add(raw[p : p + length])
        left = bytes(b for p, b in enumerate(raw) if p not in gone).decode("utf-8", "ignore")
        if left:
            out.append((i, left))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    sentence = lambda k: " ".join(rng.choice(["the", "of", "thing", "été", "que", "and"]) + rng.choice("abcdefgh") for _ in range(k))
    made = [(i, "\n".join(sentence(rng.randrange(3, 40)) for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    passage = sentence(40)
    made += [(100 + i, made[i][1].replace("thea", "theb", 1)) for i in range(5)] + [(200 + i, f"{sentence(30)} {passage} {sentence(25)}") for i in range(6)]
    return made + [(300, None), (301, ""), (302, "12 34\n--"), (303, made[0][1])]


def test_stages_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    want = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    stages = dict(P.STAGES)
    kept = stages["language_id"](spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == want

    usable = [(i, at, test_lines.words_of(x)) for i, t in want for at, x in enumerate(t.split("\n")) if len(test_lines.words_of(x)) >= 5]
    gone = {(i, at) for k, (i, at, w) in enumerate(usable) if any(test_lines.distance(w, v) <= 1 for *_, v in usable[:k])}
    want = [(i, "\n".join(x for at, x in enumerate(t.split("\n")) if (i, at) not in gone)) for i, t in want]
    want = [(i, t) for i, t in want if t]
    kept = stages["line_dedup"](spark, kept, "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == want and kept.columns == docs.columns

    linked = test_jaccard.brute(want)
    want = [(i, t) for i, t in want if linked[i][1] == i]
    kept = stages["jaccard_join"](spark, kept, "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == want and kept.columns == docs.columns

    want = strip_repeats(want)
    kept = stages["suffix_dedup"](spark, kept, "")
    got = kept.collect()
    assert sorted((r.doc_id, r.text) for r in got) == want and kept.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in got)

    packed = stages["packing"](spark, kept, "").collect()
    check_filled(packed, 2048)
    assert {r.doc_id: r.length for r in packed} == {i: len(whole(t)) for i, t in want}


def test_run_on_tables_and_on_none(spark, rows, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    docs.write.parquet(str(tmp_path / "some/documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert P.run(spark, str(tmp_path / "some")).count() > 30
    assert P.run(spark, str(tmp_path / "none")).count() == 0


def test_unlabelled_rows_stay(spark, rows, tmp_path):
    odd = [(400, "½ ① ²"), (401, "²a")]
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows + odd], COLUMNS)
    want = sorted((i, t) for i, t in rows + odd if t and any(c.isalpha() for c in t))
    kept = dict(P.STAGES)["language_id"](spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == want and kept.columns == docs.columns
    labelled = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + odd], COLUMNS)
    assert sorted((r.doc_id, r.text) for r in dict(P.STAGES)["language_id"](spark, labelled, "").collect()) == want
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() > 30
