"""A compressed full-text index over a sequence of symbols, worked in whole arrays.

The Burrows-Wheeler transform of the sequence lies in a wavelet matrix: one bit
vector per bit of a symbol, packed, with counts per 64 bits. A backward step over
it takes the rows of the suffixes that begin with a pattern to those of the
pattern with one symbol more in front. Suffixes are sorted by their first 64
symbols, which is enough for patterns of up to 64.
"""

from __future__ import annotations

import numpy as np

#: Symbols by which suffixes are sorted, at least; a power of two.
DEPTH = 64


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word, low = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FMIndex:
    """``text``: symbols from 0 on; 0 stands between texts and behind the last, and is never searched."""

    def __init__(self, text: np.ndarray):
        text = np.append(text, 0).astype(np.int64)
        n = len(text)
        self.size = n
        ranks = [np.append(text, 0)]  # by the first 1, 2, 4, ... symbols; the end counts as 0
        width = 1
        while width < DEPTH:
            r = ranks[-1]
            second = np.zeros(n + 1, np.int64)
            second[: max(n + 1 - width, 0)] = r[width:]
            ranks.append(np.unique(r * (int(r.max()) + 1) + second, return_inverse=True)[1])
            width *= 2
        self.suffixes = np.argsort(ranks[-1][:n], kind="stable")
        self._lcp(ranks)
        self.bits_in_symbol = max(1, int(text.max()).bit_length())
        self._wavelet(np.where(self.suffixes > 0, text[self.suffixes - 1], 0))
        counts = np.bincount(text, minlength=1 << self.bits_in_symbol)
        self.first = np.concatenate(([0], np.cumsum(counts)))[:-1]
        self.begin = self._descend(np.arange(1 << self.bits_in_symbol), np.zeros(1 << self.bits_in_symbol, np.int64))
        self._edges: dict[int, np.ndarray] = {}

    def _lcp(self, ranks: list[np.ndarray]) -> None:
        """Common symbols of each suffix and the one sorted before it, up to DEPTH; 0 at both ends."""
        n = self.size
        a, b = self.suffixes[:-1], self.suffixes[1:]
        length = np.zeros(n - 1, np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            same = ranks[level][np.minimum(a + length, n)] == ranks[level][np.minimum(b + length, n)]
            length += np.where(same & (length + (1 << level) <= DEPTH), 1 << level, 0)
        self.lcp = np.concatenate(([0], length, [0]))

    def _wavelet(self, symbols: np.ndarray) -> None:
        self.levels = []
        for shift in range(self.bits_in_symbol - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(self.levels):
            ones = level.ones(at)
            at = np.where(symbols >> (self.bits_in_symbol - 1 - i) & 1, level.zeros + ones, at - ones)
        return at

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of patterns -> rows of each pattern with its symbol in front."""
        base = self.first[symbols] - self.begin[symbols]
        return base + self._descend(symbols, low), base + self._descend(symbols, high)

    def widen(self, low: np.ndarray, high: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that share their first ``depth`` symbols with those given."""
        if depth not in self._edges:
            self._edges[depth] = np.flatnonzero(self.lcp < depth)
        edges = self._edges[depth]
        return edges[np.searchsorted(edges, low, side="right") - 1], edges[np.searchsorted(edges, high, side="left")]

    def matching_statistics(self, texts: np.ndarray, begins: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of texts[begins[i]:ends[i]]: the length, up to ``most``, of the longest
        match that starts there and lies in its text, and the match's rows.

        All texts are streamed side by side, each from its end. Symbols that the
        index lacks are 0 or beyond its largest.
        """
        length, low, high = (np.zeros(len(texts), np.int64) for _ in range(3))
        lo, hi, size = np.zeros(len(begins), np.int64), np.full(len(begins), self.size), np.zeros(len(begins), np.int64)
        live, place = np.arange(len(begins)), ends - 1
        while True:
            live = live[place[live] >= begins[live]]
            if not len(live):
                return length, low, high
            full = live[size[live] == most]
            if len(full):
                lo[full], hi[full] = self.widen(lo[full], hi[full], most - 1)
                size[full] = most - 1
            symbol = texts[place[live]]
            known = (symbol > 0) & (symbol < len(self.first))
            lost = live[~known]
            lo[lost], hi[lost], size[lost] = 0, self.size, 0
            todo = live[known]
            while len(todo):
                a, b = self.step(texts[place[todo]], lo[todo], hi[todo])
                met = a < b
                done = todo[met]
                lo[done], hi[done] = a[met], b[met]
                size[done] += 1
                todo = todo[~met]
                todo = todo[size[todo] > 0]
                shorter = np.maximum(self.lcp[lo[todo]], self.lcp[hi[todo]])  # the next longest match that ends alike
                shorter = np.minimum(shorter, size[todo] - 1)
                for depth in np.unique(shorter):
                    which = todo[shorter == depth]
                    lo[which], hi[which] = self.widen(lo[which], hi[which], int(depth)) if depth else (0, self.size)
                    size[which] = depth
            at = place[live]
            length[at], low[at], high[at] = size[live], lo[live], hi[live]
            place[live] -= 1
