import random
import zlib

import numpy as np

from gridloom.llm import language
from gridloom.llm.language import (WINDOW, ByteNetwork, fit, identify, identify_documents, keep_identified, log_softmax, train,
                                   windows_of)

WORDS = {"en": ["the", "thing", "and", "with", "wholly", "ing"], "fr": ["été", "que", "eaux", "leçon", "aux", "oui"], "de": ["für", "schön", "und", "nicht", "größe"]}


def made(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(4, 150))), lang) for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(n))]


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = ByteNetwork.fresh(["a", "b"], rng)
    windows, targets = rng.integers(0, 256, (5, WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0, 1])
    loss = lambda: -log_softmax(np.maximum(net.pooled(windows), 0).astype(np.float64) @ net.dense + net.dense_bias)[np.arange(5), targets].mean()
    for p, g in zip(net.parameters(), net.gradients(windows, targets), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = p[at], 1e-3
        p[at] = kept + step
        up = loss()
        p[at] = kept - step
        down = loss()
        p[at] = kept
        assert abs((up - down) / (2 * step) - g[at]) < 2e-2 * max(1, abs(g[at]))


def test_windows_cover_whole_texts():
    texts = [b"", b"x" * 10, b"y" * (2 * WINDOW + 1)]
    windows, owner, weight = windows_of(texts)
    assert owner.tolist() == [1, 2, 2, 2] and weight.tolist() == [10, WINDOW, WINDOW, 1]
    assert b"".join(windows[owner == 2].tobytes().split(b"\0")) == texts[2]


def test_held_out_accuracy_and_contract(spark):
    docs = spark.createDataFrame([(*r, "s") for r in made(900)], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in identify_documents(docs).collect()}
    true = {i: lang for i, _, lang in made(900)}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i in true if got[i].held_out]
    assert len(got) == 900 and np.mean([got[i].lang_pred == true[i] for i in held]) > 0.97


def test_odd_rows(spark):
    net = train([t.encode()[:WINDOW] for _, t, _ in made(200)], [lang for _, _, lang in made(200)], steps=80)
    rows = [(1, None, None), (2, "", "en"), (3, "123 -- ??", None), (3, "123 -- ??", None), (None, "the thing and", None), (5, "the thing " * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id or 0, r.lang_pred) for r in identify(docs, net).collect())
    assert got == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (3, "und"), (5, "en")]
    assert keep_identified(docs, net).count() == 2
    assert fit(docs.limit(0)) is None and identify_documents(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in identify(docs, None).collect()} == {"und"}


def test_forward_pass_against_a_plain_one(spark):
    """The same network written as loops over one text's bytes, on whole texts of several windows."""
    from gridloom.llm.language import EMBEDDING, FILTERS, WIDTHS, predict

    net = train([t.encode()[:WINDOW] for _, t, _ in made(120)], [lang for _, _, lang in made(120)], steps=60)

    def plain(text):
        raw = text.encode()
        logs, weights = [], []
        for at in range(0, len(raw), WINDOW):
            part = raw[at : at + WINDOW]
            window = part + bytes(WINDOW - len(part))
            hidden = []
            for kernel, width in zip(net.kernels, WIDTHS, strict=True):
                for f in range(FILTERS):
                    hidden.append(max(sum(float(net.embedding[window[k + j]] @ kernel[j * EMBEDDING : (j + 1) * EMBEDDING, f]) for j in range(width)) for k in range(WINDOW - width + 1)))
            hidden = np.maximum(np.array(hidden) + net.bias, 0)
            logits = hidden @ net.dense + net.dense_bias
            logs.append(logits - logits.max() - np.log(np.exp(logits - logits.max()).sum()))
            weights.append(len(part))
        mean = np.average(logs, axis=0, weights=weights)
        chance = np.exp(mean) / np.exp(mean).sum()
        return net.labels[int(chance.argmax())], chance.max()

    texts = ["the thing and", "été que " * 45, "schön und nicht größe", "oui the für"]
    langs, scores = predict(net, texts)
    want = [plain(t) for t in texts]
    assert langs == [lang for lang, _ in want] and np.allclose(scores, [score for _, score in want], atol=1e-4)


def test_texts_that_no_language_claims_go(spark):
    net = train([t.encode()[:WINDOW] for _, t, _ in made(200)], [lang for _, _, lang in made(200)], steps=80)
    docs = spark.createDataFrame([(1, "the thing and with the thing", "en"), (2, "xq", None), (3, "12", None)], "doc_id long, text string, lang string")
    scores = {r.doc_id: r.score for r in identify(docs, net).collect()}
    for least in (0.0, scores[2], scores[2] + 1e-9, 1.1):
        assert {r.doc_id for r in keep_identified(docs, net, least).collect()} == {i for i in (1, 2) if scores[i] >= least}
    assert {r.doc_id for r in keep_identified(docs, None).collect()} == {1, 2}


def test_rows_that_share_an_id_keep_to_the_bound(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(language, "train", lambda windows, langs: seen.update(n=len(windows)))
    rows = [(None if k % 2 else 7, f"some text {k % 3000} of words", "en") for k in range(20_000)]
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100)
    assert 0 < seen["n"] <= 200
