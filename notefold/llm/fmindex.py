"""A compressed FM-index with truncated LCP values: matching statistics of streamed texts by vectorised backward search."""

from __future__ import annotations

import io

import numpy as np


class BitRank:
    """Bits in 64-bit words with a running count per word; ``ones(i)`` counts the ones before ``i``."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded.reshape(-1, 8), axis=1, bitorder="little").reshape(-1).view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, i: np.ndarray) -> np.ndarray:
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """``rank(c, i)``: how often each symbol ``c`` occurs before each ``i``."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        current = symbols.astype(np.int64)
        self.bits = max(1, int(sigma - 1).bit_length())
        for shift in range(self.bits - 1, -1, -1):
            bit = ((current >> shift) & 1).astype(np.uint8)
            self.levels.append(BitRank(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate((current[bit == 0], current[bit == 1]))
        self.starts = np.zeros(sigma, np.int64)
        self.starts = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, shift in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.levels[level].ones(i)
            i = np.where((c >> shift) & 1, self.zeros[level] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._walk(c, i) - self.starts[c]


def _dense(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)  # equal values get equal ranks, so their order is free
    v = values[order]
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.concatenate(([0], np.cumsum(v[1:] != v[:-1])))
    return ranks


class Ranges:
    """Least values of ranges of an array in constant time, by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            below, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(below[: len(below) - half], below[half:]))
        self.flat = np.concatenate(self.levels)
        self.offset = np.concatenate(([0], np.cumsum([len(x) for x in self.levels])))[:-1]

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value of each ``[low, high)``, none of which is empty."""
        level = np.frexp((high - low).astype(float))[1] - 1
        at = self.offset[level]
        return np.minimum(self.flat[at + low], self.flat[at + high - (np.int64(1) << level)])


class FMIndex:
    """Index of texts, each of which belongs to records numbered ``low`` to ``high`` (one, or the least and the greatest of several).

    ``build`` sorts the suffixes and keeps of them the transform in its wavelet matrix, the lengths that neighbours have in
    common (up to ``depth``) and each suffix's text; ``dump`` and ``load`` carry an index between tasks.
    """

    @staticmethod
    def build(texts: list[np.ndarray], low: np.ndarray, high: np.ndarray, depth: int) -> FMIndex:
        lengths = np.array([len(t) for t in texts], np.int64)
        joined = np.concatenate([np.append(t.astype(np.int64) + 1, 0) for t in texts])
        alphabet, s = np.unique(joined, return_inverse=True)
        # Ranks by the first 4, 8, 16, ... symbols (1, 2, 4, ... where four don't fit a number).
        n, sigma = len(s), len(alphabet) + 1
        width = 4 if sigma**4 < 2**62 else 1
        padded = np.concatenate((s.astype(np.int64) + 1, np.zeros(width, np.int64)))
        packed = padded[:n].copy()
        for k in range(1, width):
            packed = packed * sigma + padded[k : k + n]
        ranks = [(width, _dense(packed))]
        while ranks[-1][0] < depth:
            width, rank = ranks[-1]
            after = np.full(n, -1, np.int64)
            after[: max(0, n - width)] = rank[width:]
            ranks.append((width * 2, _dense(rank * (n + 1) + after + 1)))
        order = np.argsort(ranks[-1][1])
        # What neighbours have in common: at most once each width from the largest down, then single symbols.
        common, left, right = np.zeros(n, np.int64), order[:-1], order[1:]
        for width, rank in [*reversed(ranks), *[(1, s)] * (ranks[0][0] - 1)]:
            a, b = left + common[1:], right + common[1:]
            same = (a < n) & (b < n) & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            common[1:] += same * width
        people, both = np.unique(np.concatenate((low, high)), return_inverse=True)
        parts = {
            "alphabet": alphabet, "transform": s[order - 1].astype(np.int32), "common": np.minimum(common, depth).astype(np.int16 if depth < 2**15 else np.int32),
            "text_of": np.repeat(np.arange(len(texts)), lengths + 1)[order].astype(np.int32),
            "low": both[: len(low)].astype(np.int32), "high": both[len(low) :].astype(np.int32),
            "first": np.concatenate(([0], np.cumsum(np.bincount(s, minlength=len(alphabet)))))[:-1], "depth": np.array(depth),
        }
        return FMIndex(parts)

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts, self.depth = parts, int(parts["depth"])
        self.alphabet, self.first, self.text_of = parts["alphabet"], parts["first"], parts["text_of"]
        self.size = len(self.text_of)
        self.matrix = WaveletMatrix(parts["transform"], len(self.alphabet))
        self.common = Ranges(np.append(parts["common"], 0).astype(parts["common"].dtype))
        self.lowest, self.highest = Ranges(parts["low"][self.text_of]), Ranges(-parts["high"][self.text_of])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.parts)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> FMIndex:
        return FMIndex(dict(np.load(io.BytesIO(data))))

    def _widen(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of all suffixes that share ``length`` symbols with those of the given ones."""
        for k in range(len(self.common.levels) - 1, -1, -1):
            step, level, at = 1 << k, self.common.levels[k], self.common.offset[k]
            down, up = low - step + 1, high
            low = low - step * ((down >= 1) & (self.common.flat[at + np.maximum(down, 0)] >= length))
            inside = up + step <= self.size
            high = high + step * (inside & (self.common.flat[at + np.minimum(up, len(level) - 1)] >= length))
        return low, high

    def statistics(self, texts: list[np.ndarray], foreign: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(text, start, low, high)`` of each window of ``depth`` symbols that the index holds in another record.

        All texts step backwards together. A text's state is the interval of the longest stretch from its place on, up to
        ``depth`` symbols, that occurs in the index in two records (in one, if the texts are ``foreign`` to it): that is its
        matching statistic. A step that leaves no such occurrence shortens the stretch at its end, to the next longer
        interval around it, until the step succeeds or nothing is left.
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        width = int(lengths.max(initial=0))
        symbols = np.full((len(texts), width), -1, np.int64)
        for i, t in enumerate(texts):  # aligned at their ends
            at = np.searchsorted(self.alphabet, t.astype(np.int64) + 1)
            at = np.minimum(at, len(self.alphabet) - 1)
            symbols[i, width - len(t) :] = np.where(self.alphabet[at] == t.astype(np.int64) + 1, at, -1)
        low, high, length = np.zeros(len(texts), np.int64), np.full(len(texts), self.size, np.int64), np.zeros(len(texts), np.int64)
        out = []
        for step in range(1, width + 1):
            live = np.flatnonzero(lengths >= step)
            strange = live[symbols[live, width - step] < 0]
            low[strange], high[strange], length[strange] = 0, self.size, 0
            todo = live[symbols[live, width - step] >= 0]
            while len(todo):
                c = symbols[todo, width - step]
                both = self.matrix.rank(np.concatenate((c, c)), np.concatenate((low[todo], high[todo])))
                l2, h2 = self.first[c] + both[: len(todo)], self.first[c] + both[len(todo) :]
                some = h2 > l2
                shared = some & foreign
                if not foreign:
                    shared[some] = self.lowest.least(l2[some], h2[some]) < -self.highest.least(l2[some], h2[some])
                done = todo[shared]
                low[done], high[done] = l2[shared], h2[shared]
                length[done] += 1
                over = done[length[done] > self.depth]
                if len(over):
                    low[over], high[over] = self._widen(low[over], high[over], np.full(len(over), self.depth))
                    length[over] = self.depth
                todo = todo[~shared & (length[todo] > 0)]
                if len(todo):
                    rest = np.maximum(self.common.flat[low[todo]], self.common.flat[high[todo]]).astype(np.int64)
                    low[todo], high[todo] = self._widen(low[todo], high[todo], rest)
                    length[todo] = rest
            hit = live[length[live] >= self.depth]
            if len(hit):
                out.append((hit, lengths[hit] - step, low[hit], high[hit]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
