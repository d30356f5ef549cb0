"""FM-index over integer symbols: wavelet-matrix ranks and sampled suffixes.

Symbol 0 separates runs; separators sort below all else and by position, so a
comparison of two suffixes ends at the first separator."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; `text` ends with a separator."""
    n = len(text)
    seps = text == 0
    rank = np.where(seps, np.cumsum(seps) - 1, text.astype(np.int64) + int(seps.sum()))
    k = 1
    while True:
        nxt = np.zeros(n, np.int64)
        if k < n:
            nxt[: n - k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2 if k == 1 else n + 2) + nxt if k > 1 else rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class Bits:
    """Bit vector with ranks from 64-bit words."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for b in range(self.depth - 1, -1, -1):
            bit = (seq >> b) & 1
            self.levels.append((Bits(bit.astype(np.uint8)), int(len(seq) - bit.sum())))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        self.first = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            one = (c >> (self.depth - 1 - k)) & 1
            ones = bits.ones(i)
            i = np.where(one == 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c[k] before position i[k]."""
        return self._down(c, i) - self.first[c]

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it occurs before i."""
        c = np.zeros(len(i), np.int64)
        for bits, zeros in self.levels:
            one = bits.get(i)
            ones = bits.ones(i)
            i = np.where(one, zeros + ones, i - ones)
            c = c << 1 | one
        return c, i - self.first[c]


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8) -> None:
        """text: symbols below sigma, 0 at the end of every run and of the whole."""
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.n = len(text)
        self.tree = WaveletMatrix(bwt.astype(np.int64), sigma)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        starts = np.zeros(self.n, bool)
        starts[0] = True
        starts[1:] = text[:-1] == 0
        kept = (sa % sample == 0) | starts[sa]  # a walk never crosses a separator
        self.kept = Bits(kept.astype(np.uint8))
        self.samples = sa[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all rows of `patterns` at once, aligned at the right end.
        Gives the rows that occur with their ranges of suffixes."""
        width = patterns.shape[1]
        row = np.arange(len(patterns))
        lo, hi = np.zeros(len(row), np.int64), np.full(len(row), self.n, np.int64)
        done = []
        for k in range(width):
            ended = lengths[row] == k
            if ended.any():
                done.append((row[ended], lo[ended], hi[ended]))
                row, lo, hi = row[~ended], lo[~ended], hi[~ended]
            c = patterns[row, width - 1 - k]
            both = self.tree.rank(np.concatenate((c, c)), np.concatenate((lo, hi)))
            lo, hi = self.less[c] + both[: len(c)], self.less[c] + both[len(c) :]
            live = lo < hi
            row, lo, hi = row[live], lo[live], hi[live]
        done.append((row, lo, hi))
        return tuple(np.concatenate(x) for x in zip(*done))  # type: ignore[return-value]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk left until a sampled suffix."""
        out = np.zeros(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            known = self.kept.get(at)
            out[todo[known]] = self.samples[self.kept.ones(at[known])] + steps
            todo, at = todo[~known], at[~known]
            if len(todo):
                c, r = self.tree.access_rank(at)
                at = self.less[c] + r
            steps += 1
        return out
