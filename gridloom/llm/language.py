"""Language identification by a byte-level convolutional network (operator 4).

Bytes are embedded, filters of several widths slide over them, each filter's
maximum over a fixed-length window is kept and a softmax over these maxima
names the language. The network is trained in numpy on windows of a bounded,
hash-chosen sample of labelled rows; every window of every whole text is scored
and a text's windows are averaged in log probability, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import small_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
#: Bounds of the training sample: rows of one language, windows of one row.
ROWS_PER_LANGUAGE = 1500
WINDOWS_PER_ROW = 4
BATCH = 128
#: Probability of its likeliest language that a text needs to be kept: more than all others have together.
LEAST_SCORE = 0.5

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def has_letter(text: str | None) -> bool:
    """Whether a text holds a letter; digits of any kind (², ½, ①) are none."""
    return any(map(str.isalpha, text or ""))


@dataclass
class ByteNetwork:
    """Weights: byte embeddings, one (width * EMBEDDING, FILTERS) kernel per width, dense layer."""

    labels: list[str]
    embedding: np.ndarray
    kernels: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], rng: np.random.Generator) -> ByteNetwork:
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        features = FILTERS * len(WIDTHS)
        return cls(labels, draw(256, EMBEDDING, scale=0.5), [draw(w * EMBEDDING, FILTERS, scale=(w * EMBEDDING) ** -0.5) for w in WIDTHS],
                   np.zeros(features, np.float32), draw(features, len(labels), scale=0.3), np.zeros(len(labels), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.kernels, self.bias, self.dense, self.dense_bias]

    def pooled(self, windows: np.ndarray, with_places: bool = False):
        """Maxima of all filters over each window, and where they lie."""
        n, length = windows.shape
        embedded = self.embedding[windows]
        side = np.concatenate([k.reshape(-1, EMBEDDING, FILTERS).transpose(1, 0, 2).reshape(EMBEDDING, -1) for k in self.kernels], axis=1)
        products = (embedded.reshape(-1, EMBEDDING) @ side).reshape(n, length, -1)
        maxima, places, at = [], [], 0
        for width in WIDTHS:
            valid = length - width + 1
            response = products[:, :valid, at : at + FILTERS].copy()
            for k in range(1, width):
                response += products[:, k : k + valid, at + k * FILTERS : at + (k + 1) * FILTERS]
            if with_places:
                places.append(response.argmax(axis=1))
            maxima.append(response.max(axis=1))
            at += width * FILTERS
        features = np.concatenate(maxima, axis=1) + self.bias
        return (features, places, embedded) if with_places else features

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.labels)), np.float64)
        for k in range(0, len(windows), BATCH):
            logits = np.maximum(self.pooled(windows[k : k + BATCH]), 0) @ self.dense + self.dense_bias
            out[k : k + BATCH] = log_softmax(logits.astype(np.float64))
        return out

    def gradients(self, windows: np.ndarray, targets: np.ndarray) -> list[np.ndarray]:
        features, places, embedded = self.pooled(windows, with_places=True)
        hidden = np.maximum(features, 0)
        error = np.exp(log_softmax(hidden @ self.dense + self.dense_bias))
        error[np.arange(len(targets)), targets] -= 1
        error = (error / len(targets)).astype(np.float32)
        back = (error @ self.dense.T) * (features > 0)
        d_embedding, d_kernels, rows = np.zeros_like(self.embedding), [], np.arange(len(windows))[:, None]
        for j, width in enumerate(WIDTHS):
            flow = back[:, j * FILTERS : (j + 1) * FILTERS]
            kernel, d_kernel = self.kernels[j], np.zeros_like(self.kernels[j])
            for k in range(width):
                part = slice(k * EMBEDDING, (k + 1) * EMBEDDING)
                d_kernel[part] = np.einsum("nfe,nf->ef", embedded[rows, places[j] + k], flow)
                np.add.at(d_embedding, windows[rows, places[j] + k], flow[:, :, None] * kernel[part].T[None])
            d_kernels.append(d_kernel)
        return [d_embedding, *d_kernels, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]


def log_softmax(logits: np.ndarray) -> np.ndarray:
    shifted = logits - logits.max(axis=1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))


def train(windows: list[bytes], langs: list[str], seed: int = 5, steps: int = 700, rate: float = 0.01) -> ByteNetwork | None:
    """Fit by Adam on random crops of the windows; None without labels."""
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    pairs = sorted(zip(langs, windows, strict=True))
    labels = sorted({lang for lang, _ in pairs})
    texts = np.zeros((len(pairs), WINDOW), np.uint8)
    sizes = np.empty(len(pairs), np.int64)
    for i, (_, window) in enumerate(pairs):
        sizes[i] = len(window)
        texts[i, : len(window)] = np.frombuffer(window, np.uint8)
    targets = np.array([labels.index(lang) for lang, _ in pairs])
    share = 1 / np.bincount(targets)[targets]
    net = ByteNetwork.fresh(labels, rng)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1):
        chosen = rng.choice(len(pairs), size=64, p=share / share.sum())
        batch = texts[chosen]
        # Half of the crops are short, so that short texts are known too.
        cut = np.where(rng.random(64) < 0.5, WINDOW, rng.integers(6, WINDOW, 64))
        batch[np.arange(WINDOW)[None, :] >= cut[:, None]] = 0
        pace = rate * (1 - step / (steps + 1))
        for p, g, m, v in zip(net.parameters(), net.gradients(batch, targets[chosen]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, the last of each filled with zeros; the text of each and its bytes."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = -(-sizes // WINDOW)
    padded = b"".join(t + bytes(int(c) * WINDOW - len(t)) for t, c in zip(texts, counts, strict=True))
    owner = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.frombuffer(padded, np.uint8).reshape(-1, WINDOW), owner, np.minimum(WINDOW, sizes[owner] - within * WINDOW)


def predict(net: ByteNetwork | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and probability of each text; ``und`` and 0 without a letter."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if net and has_letter(t)]
    begin = 0
    while begin < len(known):
        end, size = begin, 0
        while end < len(known) and (end == begin or size < 1 << 22):
            size += len(texts[known[end]])
            end += 1
        part = known[begin:end]
        windows, owner, weight = windows_of([texts[i].encode("utf-8", "surrogatepass") for i in part])
        scored = net.log_probabilities(windows) * weight[:, None]
        total = np.zeros((len(part), len(net.labels)))
        np.add.at(total, owner, scored)
        mean = total / np.bincount(owner, weights=weight, minlength=len(part))[:, None]
        chance = np.exp(log_softmax(mean))
        for i, row in zip(part, chance, strict=True):
            langs[i], scores[i] = net.labels[int(row.argmax())], float(row.max())
        begin = end
    return langs, scores


def held_out_column():
    """True where crc32 of the id as text leaves 2 by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> ByteNetwork | None:
    """Train on a sample of at most about ``rows_per_language`` rows of each language.

    Rows are chosen by a hash of id and text among those not held out; rows of one
    language and text count once, so many rows of one id, or of none, keep to the
    bound. Each brings ``WINDOWS_PER_ROW`` windows spread over its whole text.
    """
    usable = small_batches(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out_column())
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()
    share = F.lit(0.0)
    for row in counts:
        share = F.when(F.col("lang") == row["lang"], min(1.0, rows_per_language / row["n"])).otherwise(share)
    chosen = usable.where(F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text").distinct()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, windows = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                pieces = -(-len(raw) // WINDOW)
                for k in sorted({pieces * j // WINDOWS_PER_ROW for j in range(WINDOWS_PER_ROW)} if has_letter(text) else ()):
                    langs.append(lang)
                    windows.append(raw[k * WINDOW : (k + 1) * WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], names=["lang", "window"])

    rows = chosen.mapInArrow(spread, "lang string, window binary").collect()
    return train([bytes(r["window"]) for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, net: ByteNetwork | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text; see ``predict`` for nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(net, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    return small_batches(docs).select("doc_id", held_out_column().alias("held_out"), "text").mapInArrow(run, PREDICTED)


def keep_identified(docs: DataFrame, net: ByteNetwork | None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with all their columns.

    A null text and one without a letter go, and so does a text whose likeliest
    language has a probability below ``least``: the network can't tell it from
    the others. Where no row is labelled there is no network, and every text with
    a letter stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            langs, scores = predict(net, texts)
            kept = [has_letter(t) for t in texts] if net is None else [lang != "und" and score >= least for lang, score in zip(langs, scores, strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


def identify_documents(docs: DataFrame) -> DataFrame:
    """Fit on the rows of ``docs`` that may be learnt from, then identify all of them.

    doc_id, held_out, lang_pred and score, one row for each row. A text that is
    null, empty or without a letter is ``und`` with score 0, and so is every text
    where no row may be learnt from. A null id is not held out. Repeated rows get
    equal answers; of languages as likely the first by name is taken. An empty
    table gives no rows; further columns play no part.
    """
    return identify(docs, fit(docs))
