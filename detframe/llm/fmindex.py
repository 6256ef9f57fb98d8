"""A compressed FM-index over word sequences: a wavelet matrix of packed bits over the Burrows-Wheeler transform, and
backward search for many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words with one running count per word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]].astype(np.int32)

    def ones(self, ends: np.ndarray) -> np.ndarray:
        """Ones among the first ``ends`` bits."""
        word = ends >> 6
        inside = self.words[word] & ((np.uint64(1) << (ends & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels, self.zeros = [], []
        now = symbols
        for k in reversed(range(self.depth)):
            bit = (now >> k & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int((~bit).sum()))
            now = np.concatenate([now[~bit], now[bit]])
        every = np.arange(size)
        self.base = self._descend(every, np.zeros(size, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, zeros, k in zip(self.levels, self.zeros, reversed(range(self.depth))):
            ones = level.ones(at)
            at = np.where(symbols >> k & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        return self._descend(symbols, ends) - self.base[symbols]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling. Zeros part sequences and differ from one another, so that no comparison runs
    over the end of a sequence."""
    parts = text == 0
    rank = np.where(parts, np.cumsum(parts), text.astype(np.int64) + int(parts.sum()))
    step = 1
    while True:
        key = rank * (int(rank.max()) + 1)
        key[:-step] += rank[step:]
        order = np.argsort(key)
        ordered = key[order]
        number = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
        rank = np.empty_like(number)
        rank[order] = number
        if number[-1] == len(text) - 1:
            return order
        step *= 2


class FMIndex:
    """Index of several sequences of symbols from 1 on, each with an owner number; intervals know their least owner."""

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray, size: int):
        sizes = np.array([len(s) + 1 for s in sequences], np.int64)
        text = np.zeros(int(sizes.sum()), np.int64)
        ends = np.cumsum(sizes)
        for s, end in zip(sequences, ends):
            text[end - 1 - len(s):end - 1] = s
        order = suffix_array(text)
        self.length = len(text)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=size))[:-1]]
        self.wavelet = WaveletMatrix(text[order - 1], size)
        least = np.repeat(owners, sizes)[order].astype(np.int32)
        self.least, step = [least], 1
        while 2 * step <= self.length:
            least = np.minimum(least[:-step], least[step:])
            self.least.append(least)
            step *= 2

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        n = len(symbols)
        both = self.wavelet.rank(np.r_[symbols, symbols], np.r_[low, high])
        return self.before[symbols] + both[:n], self.before[symbols] + both[n:]

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least owner in each interval; intervals must not be empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int32)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            table = self.least[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(k))])
        return out


def earlier_windows(index: FMIndex, patterns: list[np.ndarray], owners: np.ndarray, window: int) -> list[np.ndarray]:
    """For each pattern (symbols; -1 is in no sequence), per window of ``window`` symbols: does it lie in a sequence whose
    owner is less than the pattern's?

    All patterns are searched in step, each from the right end of a stretch to the left. A stretch that is found whole
    settles all its windows, and the next one is twice as long; one that breaks off at a symbol rules out all windows
    that hold that symbol and the stretch's end.
    """
    sizes = np.array([len(p) for p in patterns], np.int64)
    base = np.cumsum(sizes) - sizes
    flat = np.concatenate(patterns) if patterns else np.zeros(0, np.int64)
    found = np.zeros(len(flat), bool)
    lane = np.flatnonzero(sizes >= window)
    start, gain = np.zeros(len(lane), np.int64), np.ones(len(lane), np.int64)
    end = np.full(len(lane), window, np.int64)
    at, low, high = end.copy(), np.zeros(len(lane), np.int64), np.full(len(lane), index.length, np.int64)
    while len(lane):
        symbol = flat[base[lane] + at - 1]
        known = symbol > 0
        new_low, new_high = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
        new_low[known], new_high[known] = index.extend(symbol[known], low[known], high[known])
        alive = np.flatnonzero(new_low < new_high)
        ok = np.zeros(len(lane), bool)
        ok[alive] = index.least_owner(new_low[alive], new_high[alive]) < owners[lane[alive]]
        low, high = np.where(ok, new_low, low), np.where(ok, new_high, high)
        at = at - ok
        whole = ok & (at == start)
        broken = ~ok
        for k in np.flatnonzero((whole | broken) & (end - at >= window)):
            found[base[lane[k]] + at[k]:base[lane[k]] + end[k] - window + 1] = True
        single = end - start == window
        start = np.where(whole, end - window + 1, np.where(broken & single, np.maximum(at, start + 1), start))
        gain = np.where(whole, 2 * gain, np.where(broken, 1, gain))
        turn = whole | broken
        if turn.any():
            limit = sizes[lane]
            end = np.where(turn, np.minimum(start + window - 1 + gain, limit), end)
            at = np.where(turn, end, at)
            low, high = np.where(turn, 0, low), np.where(turn, index.length, high)
            stay = ~turn | (start + window <= limit)
            lane, start, gain, end, at, low, high = (x[stay] for x in (lane, start, gain, end, at, low, high))
    return [found[b:b + max(0, n - window + 1)] for b, n in zip(base, sizes)]
