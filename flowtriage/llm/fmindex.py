"""Compressed FM-index over sequences of whole numbers, read by many queries at once."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle


class WaveletTree:
    """Rank in a sequence of numbers below `size`: a bit vector per binary digit, with the ones before each 64 bits.

    At each digit the zeros go left and the ones go right, in order; all nodes of a level lie in one bit vector.
    """

    def __init__(self, values: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            digit = ((values >> level) & 1).astype(np.uint8)
            padded = np.zeros(-(-(len(digit) + 1) // 64) * 64, np.uint8)
            padded[: len(digit)] = digit
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.bits.append(words)
            self.ones.append(before.astype(np.int32))
            self.zeros.append(int(len(digit) - digit.sum()))
            values = np.concatenate([values[digit == 0], values[digit == 1]])

    def _ones(self, at: int, place: np.ndarray) -> np.ndarray:
        block = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[at][block] + np.bitwise_count(self.bits[at][block] & below)

    def rank(self, value: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each value stands before start, and before end."""
        node = np.zeros(len(value), np.int64)
        for at, level in enumerate(reversed(range(self.levels))):
            one = ((value >> level) & 1).astype(bool)
            places = []
            for place in (node, start, end):
                ones = self._ones(at, place)
                places.append(np.where(one, self.zeros[at] + ones, place - ones))
            node, start, end = places
        return start - node, end - node


class FMIndex:
    """Backward search over texts, with every match cut off at `most` symbols.

    texts: the symbols (64-bit numbers) of all texts, one after another, with their lengths. Suffixes are sorted by more
    than `most` symbols, which is all that matches of that length can tell apart.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, most: int):
        self.most = most
        self.known, coded = np.unique(symbols, return_inverse=True)
        # a zero ends each text
        ends = np.cumsum(lengths) + np.arange(len(lengths))
        text = np.zeros(len(symbols) + len(lengths), np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = coded + 1
        n = self.size = len(text)
        rank, width = text, 1
        while width <= most:
            later = np.zeros(n, np.int64)
            later[: max(n - width, 0)] = rank[width:] + 1
            rank = np.unique(rank * (n + 2) + later, return_inverse=True)[1].astype(np.int64)
            width *= 2
        self.suffix = np.argsort(rank, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.known) + 1))])
        self.tree = WaveletTree(text[self.suffix - 1], len(self.known) + 1)
        common, same = np.zeros(n, np.int64), np.arange(n) > 0
        padded = np.concatenate([text, np.zeros(most + 1, np.int64)])
        for at in range(most):
            here = padded[self.suffix + at]
            same[1:] &= here[1:] == here[:-1]
            common += same
        #: Where groups of suffixes begin that agree in their first symbols, by the number of symbols; the last entry is the end.
        self.starts = {l: np.append(np.flatnonzero(common < l), n) for l in range(1, most + 1)}
        self.starts[0] = np.array([0, n])
        self.text_of = (np.cumsum(~inside) - ~inside)[self.suffix]

    def code(self, symbols: np.ndarray) -> np.ndarray:
        """The index's numbers of symbols; 0 for those it does not have."""
        at = np.minimum(np.searchsorted(self.known, symbols), max(len(self.known) - 1, 0))
        return np.where(self.known[at] == symbols, at + 1, 0) if len(self.known) else np.zeros(len(symbols), np.int64)

    def group(self, place: np.ndarray, length: int) -> np.ndarray:
        """Which of the groups of suffixes that agree in their first `length` symbols a place is in."""
        return np.searchsorted(self.starts[length], place, "right") - 1

    def _shorten(self, start: np.ndarray, end: np.ndarray, lanes: np.ndarray, lengths: np.ndarray) -> None:
        """Widens the matches of lanes to all suffixes that agree in their first symbols, as many as `lengths` says."""
        for l in np.unique(lengths):
            of = lanes[lengths == l]
            group = self.group(start[of], int(l))
            start[of], end[of] = self.starts[int(l)][group], self.starts[int(l)][group + 1]

    def matching_statistics(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the queries the length of the longest match that starts there, `most` at most, and the first
        suffix of those that match (in sorted order).

        Queries are read from right to left, all at once: a match grows by the symbol on its left; where the index lacks
        the longer match, it loses symbols on its right until it has it.
        """
        coded, ends = self.code(symbols), np.cumsum(lengths)
        found, where = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        start, end, length = (np.full(len(lengths), x, np.int64) for x in (0, self.size, 0))
        for step in range(int(lengths.max(initial=0))):
            lanes = np.flatnonzero(lengths > step)
            while len(lanes):
                at = ends[lanes] - 1 - step
                c = coded[at]
                low, high = self.tree.rank(c, start[lanes], end[lanes])
                low, high = low + self.first[c], high + self.first[c]
                fits = (low < high) & (c > 0)
                done = lanes[fits]
                start[done], end[done] = low[fits], high[fits]
                length[done] += 1
                over = done[length[done] > self.most]
                length[over] = self.most
                self._shorten(start, end, over, length[over])
                found[at[fits]], where[at[fits]] = length[done], start[done]
                none = ~fits & ((length[lanes] == 0) | (c == 0))
                start[lanes[none]], end[lanes[none]], length[lanes[none]] = 0, self.size, 0
                lanes = lanes[~fits & ~none]
                length[lanes] -= 1
                self._shorten(start, end, lanes, length[lanes])
        return found, where


cloudpickle.register_pickle_by_value(sys.modules[__name__])
