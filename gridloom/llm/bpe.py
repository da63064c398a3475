"""Byte-level BPE by replaying merges over many words at once (operator 6).

The distinct words of a block of documents lie end to end in one array of token
ids. An inverted index leads from every pair of neighbouring tokens that has a
rank to its positions. The lowest rank present is applied to all its positions
in one step; only the tokens left and right of a merge form new pairs, and only
those enter the index. When no pair is left, every word holds its final tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import small_batches

#: Distinct words that a worker keeps with their ids, and characters of one block.
WORDS_KEPT = 400_000
BLOCK_CHARS = 12_000_000

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Merges:
    """The ranks of a vocabulary and the pairs of tokens that they join."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        self.size = max(ranks.values()) + 1
        self.vocabulary: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[p] for p in self.pairs.tolist()], dtype=np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of token ids, or -1."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], -1)


def replay(words: list[bytes], merges: Merges) -> list[np.ndarray]:
    """Final token ids of each word.

    Ranks are taken from a heap: a merge may make a pair whose rank is lower
    than its own, and that pair then comes next. Within a word, occurrences of
    one pair merge from the left; where the first of several makes a pair of
    lower rank, the others wait.
    """
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    total = int(sizes.sum())
    token = merges.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    after = np.arange(1, total + 1)
    before = np.arange(-1, total - 1)
    ends = np.cumsum(sizes)
    filled = sizes > 0
    after[ends[filled] - 1] = -1
    before[(ends - sizes)[filled]] = -1
    alive = np.ones(total, dtype=bool)

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
        found = ranks >= 0
        positions, ranks = positions[found], ranks[found]
        if not len(positions):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        starts = np.concatenate([[0], cuts])
        for rank, part in zip(ranks[starts].tolist(), np.split(positions, cuts), strict=True):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(heap, rank)

    def pair_ranks(positions: np.ndarray) -> np.ndarray:
        return merges.ranks_of(token[positions], token[after[positions]])

    first = np.flatnonzero(after >= 0)
    enter(first, pair_ranks(first))
    while heap:
        rank = heapq.heappop(heap)
        at = index.pop(rank)
        at = at[0] if len(at) == 1 else np.concatenate(at)
        at = at[alive[at]]
        at = at[after[at] >= 0]
        if not len(at):
            continue
        at = np.unique(at) if len(at) > 1 else at
        at = at[pair_ranks(at) == rank]
        waiting = at[:0]
        if len(at) > 1:
            # Of touching occurrences (as in "aaa") every other one merges, from the left.
            touching = np.concatenate([[False], after[at[:-1]] == at[1:]])
            if touching.any():
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(touching, 0, np.arange(len(at))))
                at = at[run % 2 == 0]
            again = np.concatenate([[False], word[at[1:]] == word[at[:-1]]])
            if again.any():
                # Leftmost ones whose merge would make a lower pair hold back the rest of their word.
                left, right = before[at], after[after[at]]
                low = np.full(len(at), np.iinfo(np.int64).max)
                for side, pair in ((left, lambda k: merges.ranks_of(token[left[k]], np.full(k.sum(), rank))),
                                   (right, lambda k: merges.ranks_of(np.full(k.sum(), rank), token[right[k]]))):
                    k = side >= 0
                    made = pair(k)
                    low[k] = np.minimum(low[k], np.where(made >= 0, made, low[k]))
                lower = word[at[low <= rank]]
                held = again & np.isin(word[at], lower)
                waiting, at = at[held], at[~held]
        if not len(at):
            continue
        gone = after[at]
        beyond = after[gone]
        token[at] = rank
        alive[gone] = False
        after[at] = beyond
        linked = beyond >= 0
        before[beyond[linked]] = at[linked]
        lefts = before[at]
        touched = np.concatenate([lefts[lefts >= 0], at[linked]])
        if len(touched):
            enter(touched, pair_ranks(touched))
        if len(waiting):
            enter(waiting, np.full(len(waiting), rank))
    counts = np.bincount(word[alive], minlength=len(words)) if total else np.zeros(len(words), dtype=np.int64)
    return np.split(token[alive].astype("<u4"), np.cumsum(counts)[:-1]) if len(words) else []


class WordCodes(dict):
    """Token ids of words, as little-endian bytes, filled by replaying merges."""

    def __init__(self, path: str, pattern: str):
        import regex

        super().__init__()
        self.merges = Merges(path)
        self.find = regex.compile(pattern).findall

    def learn(self, words: set[str]) -> None:
        fresh = list(words.difference(self))
        if len(self) + len(fresh) > WORDS_KEPT:
            self.clear()
            fresh = list(words)
        coded = replay([w.encode("utf-8", "surrogatepass") for w in fresh], self.merges)
        self.update((w, c.tobytes()) for w, c in zip(fresh, coded, strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = [self.find(t) for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        vocabulary = self.merges.vocabulary
        return b"".join(map(vocabulary.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_loaded: dict[tuple[str, str], WordCodes] = {}


def word_codes(path: str, pattern: str) -> WordCodes:
    """One table of words for each worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = WordCodes(path, pattern)
    return _loaded[path, pattern]


def blocks(texts: list[str], most_chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of together about ``most_chars``; a longer text has its own."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        if k > begin and size + len(text) > most_chars:
            yield begin, k
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def gathered(batches: Iterator[pa.RecordBatch], most: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches joined until they hold about ``most`` bytes, as words repeat more in larger blocks."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of every whole text's ids and of their decoded bytes.

    Ids are those of a tiktoken encoding with the same ranks and pattern,
    without special tokens. A null text is empty and has no tokens. Words live
    in the task that reads them; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = word_codes(path, pattern)
        for batch in gathered(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, end in blocks(texts):
                coded = codes.encode_all(texts[begin:end])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[begin:end],
                     pa.array([len(c) // 4 for c in coded], pa.int64()),
                     pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                     pa.array([hashlib.sha256(codes.decode(c)).hexdigest() for c in coded], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, ENCODED)


def token_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids`` array<int> of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = word_codes(path, pattern)
        for batch in gathered(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, end in blocks(texts):
                coded = codes.encode_all(texts[begin:end])
                ids = pa.array([np.frombuffer(c, dtype="<u4").astype(np.int32) for c in coded], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:end], ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_tokens(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``text`` of ``ids``; ids outside the vocabulary raise, null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = word_codes(path, pattern)
        for batch in batches:
            texts = [None if i is None else codes.decode(np.array(i, dtype="<u4").tobytes()).decode("utf-8", "replace") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
