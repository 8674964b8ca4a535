"""FM-index over a sequence of word codes (numpy, used inside Spark tasks)."""
from __future__ import annotations

import numpy as np

END, BREAK, FIRST = 0, 1, 2  # codes: end of text, break between runs, first word


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Full suffix order by prefix doubling; ``text`` ends with a unique END."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[:max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletTree:
    """Pointerless wavelet tree: rank(c, i) = occurrences of c before place i."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(i), i.copy()
        for depth, level in enumerate(reversed(range(self.bits))):
            ones, one = self.ones[depth], ((c >> level) & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(one, self.zeros[depth] + lo1, lo - lo1)
            hi = np.where(one, self.zeros[depth] + hi1, hi - hi1)
        return hi - lo


class FMIndex:
    """Burrows-Wheeler text behind a wavelet tree, with every ``sample``-th
    suffix position kept."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 16):
        order = suffix_array(text)
        self.n = len(text)
        self.bwt = text[order - 1]
        self.tree = WaveletTree(self.bwt, symbols)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64)
        self.known = order % sample == 0
        self.place = np.cumsum(self.known) - 1
        self.samples = order[self.known]

    def find(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of all patterns (rows, left-aligned)."""
        lo = np.zeros(len(patterns), dtype=np.int64)
        hi = np.full(len(patterns), self.n, dtype=np.int64)
        for step in range(patterns.shape[1]):
            at = np.flatnonzero((lengths > step) & (hi > lo))
            if not len(at):
                break
            c = patterns[at, lengths[at] - 1 - step]
            lo[at] = self.less[c] + self.tree.rank(c, lo[at])
            hi[at] = self.less[c] + self.tree.rank(c, hi[at])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: LF steps to the next sampled row."""
        out = np.zeros(len(rows), dtype=np.int64)
        left, at, walked = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            hit = self.known[at]
            out[left[hit]] = self.samples[self.place[at[hit]]] + walked
            left, at = left[~hit], at[~hit]
            c = self.bwt[at]
            at = self.less[c] + self.tree.rank(c, at)
            walked += 1
        return out
