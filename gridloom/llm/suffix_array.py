"""Suffix arrays by induced sorting, over whole numpy columns.

Suffixes are classified as larger or smaller than their right neighbour. The
leftmost-smaller substrings are sorted by one induction, named, and the string
of their names is sorted recursively; a second induction orders all suffixes.
An induction walks the buckets of the first symbol; within a bucket whole runs
of entries are placed at once.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size recurse; strings of more names are ranked by doubling.
RECURSE_BELOW = 1024


def _smaller(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one to its right (and at the end)."""
    n = len(text)
    kinds = np.ones(n, dtype=bool)
    differ = text[:-1] != text[1:]
    at = np.where(differ, np.arange(n - 1), n - 2)
    at = np.minimum.accumulate(at[::-1])[::-1]
    kinds[:-1] = text[at] < text[at + 1]
    return kinds


class _Buckets:
    def __init__(self, text: np.ndarray, smaller: np.ndarray, symbols: int):
        self.text, self.smaller = text, smaller
        counts = np.bincount(text, minlength=symbols)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.larger_ends = self.starts + np.bincount(text[~smaller], minlength=symbols)
        self.used = np.flatnonzero(counts)

    def _group(self, suffixes: np.ndarray):
        symbols = self.text[suffixes]
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        first = np.concatenate([[0], np.flatnonzero(symbols[1:] != symbols[:-1]) + 1])
        return suffixes[order], symbols[first].astype(np.int64), first, np.diff(np.append(first, len(symbols)))

    def induce(self, leftmost: np.ndarray) -> np.ndarray:
        """All suffixes in order, from leftmost-smaller ones in the order given within each bucket."""
        array = np.full(len(self.text), -1, dtype=np.int64)
        seeds, symbols, first, sizes = self._group(leftmost)
        array[np.repeat(self.ends[symbols] - sizes - first, sizes) + np.arange(len(seeds))] = seeds
        seeded = self.ends.copy()
        seeded[symbols] -= sizes

        head = self.starts.copy()
        for c in self.used.tolist():
            at = int(self.starts[c])
            while at < head[c]:
                stop = int(head[c])
                self._place_larger(array, head, array[at:stop])
                at = stop
            self._place_larger(array, head, array[seeded[c] : self.ends[c]])

        tail = self.ends.copy()
        array[0] = len(self.text) - 1  # the end mark has no right neighbour to be induced from
        tail[0] = 0
        for c in self.used[::-1].tolist():
            at = int(self.ends[c])
            while at > tail[c]:
                stop = int(tail[c])
                self._place_smaller(array, tail, array[stop:at][::-1])
                at = stop
            self._place_smaller(array, tail, array[self.starts[c] : self.larger_ends[c]][::-1])
        return array

    def _place_larger(self, array: np.ndarray, head: np.ndarray, entries: np.ndarray) -> None:
        left = entries - 1
        left = left[left >= 0]
        left = left[~self.smaller[left]]
        if len(left):
            left, symbols, first, sizes = self._group(left)
            array[np.repeat(head[symbols] - first, sizes) + np.arange(len(left))] = left
            head[symbols] += sizes

    def _place_smaller(self, array: np.ndarray, tail: np.ndarray, entries: np.ndarray) -> None:
        left = entries - 1
        left = left[left >= 0]
        left = left[self.smaller[left]]
        if len(left):
            left, symbols, first, sizes = self._group(left)
            array[np.repeat(tail[symbols] - 1 + first, sizes) - np.arange(len(left))] = left
            tail[symbols] -= sizes


def _names(text: np.ndarray, ordered: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """A name for each leftmost-smaller substring, in ``ordered``'s order; equal ones share it."""
    stop = np.zeros(len(text), dtype=np.int64)
    stop[leftmost[:-1]] = leftmost[1:]
    stop[leftmost[-1]] = leftmost[-1]
    size = stop[ordered] - ordered + 1
    a, b = ordered[:-1], ordered[1:]
    fresh = size[:-1] != size[1:]
    open_ = np.flatnonzero(~fresh)
    offset = 0
    while len(open_):
        unequal = text[a[open_] + offset] != text[b[open_] + offset]
        fresh[open_[unequal]] = True
        offset += 1
        open_ = open_[~unequal]
        open_ = open_[size[open_] > offset]
    return np.concatenate([[0], np.cumsum(fresh)])


def _double(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by ranks of their first 1, 2, 4, ... symbols."""
    rank, reach = text.astype(np.int64), 1
    while True:
        following = np.zeros_like(rank)
        following[:-reach] = rank[reach:] + 1
        key = rank * (rank.max() + 2) + following
        order = np.argsort(key)
        fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank[order] = fresh
        if fresh[-1] == len(text) - 1:
            return order
        reach *= 2


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes of ``text`` in order.

    ``text`` ends in 0, which occurs nowhere else; its symbols are below
    ``symbols``.
    """
    if len(text) == 1:
        return np.zeros(1, dtype=np.int64)
    smaller = _smaller(text)
    is_leftmost = np.concatenate([[False], smaller[1:] & ~smaller[:-1]])
    leftmost = np.flatnonzero(is_leftmost)
    buckets = _Buckets(text, smaller, symbols)
    roughly = buckets.induce(leftmost)
    ordered = roughly[is_leftmost[roughly]]
    names = _names(text, ordered, leftmost)
    if names[-1] + 1 < len(ordered):
        reduced = np.empty(len(text), dtype=np.int64)
        reduced[ordered] = names
        reduced = reduced[leftmost]
        count = int(names[-1]) + 1
        ordered = leftmost[suffix_array(reduced, count) if count <= RECURSE_BELOW else _double(reduced)]
    return buckets.induce(ordered)


def permuted_prefixes(raw: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each suffix, the bytes it shares with the one before it in ``array``.

    Only where the symbols to the left differ is a length compared byte by byte,
    eight at a time; everywhere else it is one less than its left neighbour's.
    ``raw`` has the text's bytes; the last entry of ``array``'s text may lie past it.
    """
    n = len(array)
    before = np.full(n, -1, dtype=np.int64)
    before[array[1:]] = array[:-1]
    padded = np.concatenate([raw, np.zeros(n + 8 - len(raw), dtype=np.uint8)])
    at = np.flatnonzero(before >= 0)
    inner = at[(at > 0) & (before[at] > 0)]
    reducible = np.zeros(n, dtype=bool)
    reducible[inner] = padded[inner - 1] == padded[before[inner] - 1]
    start = at[~reducible[at]]
    words = np.ndarray((n,), dtype="<u8", buffer=padded.tobytes(), strides=(1,)).copy()
    length = np.zeros(n, dtype=np.int64)
    limit = n - np.maximum(start, before[start])
    open_, offset = np.arange(len(start)), 0
    a, b = start, before[start]
    while len(open_):
        apart = words[a[open_] + offset] ^ words[b[open_] + offset]
        done = apart != 0
        low = apart[done] & (~apart[done] + np.uint64(1))
        length[start[open_[done]]] = offset + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        open_, offset = open_[~done], offset + 8
        over = limit[open_] <= offset
        length[start[open_[over]]] = limit[open_[over]]
        open_ = open_[~over]
    length[start] = np.minimum(length[start], limit)
    reach = np.where(reducible, 0, length + np.arange(n))
    return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)
