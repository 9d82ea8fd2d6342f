"""A compressed FM-index in numpy: BWT in a wavelet matrix of packed bits, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank in constant time: 64-bit words and a running count for each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[: len(self.words)].astype(np.int32)
        self.zeros = n - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many bits before each position are 1."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels = []
        for level in range(self.depth - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.levels.append(Bits(bit))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))
        every = np.arange(size)
        self.base = np.zeros(size, np.int64)
        self.base = self.walk(every, np.zeros(size, np.int64))

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            one = bits.ones(at)
            at = np.where(symbol >> level & 1, bits.zeros + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is found before each position."""
        return self.walk(symbol, at) - self.base[symbol]


class FMIndex:
    """An index of a text of small integers (0 parts passages), for patterns of up to `window` symbols.

    Suffixes are ordered by their first `window` symbols, which is all that such patterns ask for. `window` is from 33 to 64.
    """

    def __init__(self, text: np.ndarray, window: int):
        if not 33 <= window <= 64:
            raise ValueError("window is from 33 to 64")
        n = len(text)
        rank = text.astype(np.int64)
        step, ranks = 1, {1: text.astype(np.int32)}
        while step < 32:  # ranks of the first 1, 2, 4, ... 32 symbols
            after = np.concatenate((rank[step:], np.full(min(step, n), -1)))[:n] + 1
            rank = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)[1].astype(np.int64)
            step *= 2
            ranks[step] = rank.astype(np.int32)
        shift = window - 32
        whole = rank * (n + 1) + np.concatenate((rank[shift:], np.full(min(shift, n), -1)))[:n] + 1
        order = np.argsort(whole, kind="stable")
        self.window, self.order = window, order
        self.text = text
        self.size = int(text.max()) + 1
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.size))))
        self.bwt = WaveletMatrix(text[order - 1], self.size)
        same = whole[order[1:]] == whole[order[:-1]]
        self.starts = np.flatnonzero(np.concatenate(([True], ~same)))
        self.borders = self._borders(ranks, same)

    def _borders(self, ranks: dict[int, np.ndarray], same: np.ndarray) -> list[np.ndarray]:
        """Range minima of what neighbours in the order share: level k at i holds the least of 2^k borders from i on. Border i is before place i; 0 at both ends."""
        a, b = self.order[:-1], self.order[1:]
        n, shared = len(self.order), np.zeros(len(self.order) - 1, np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            inside = np.maximum(a, b) + shared < n
            at = np.minimum(a + shared, n - 1), np.minimum(b + shared, n - 1)
            shared += np.where(inside & (ranks[step][at[0]] == ranks[step][at[1]]), step, 0)
        level = np.concatenate(([0], np.where(same, self.window, np.minimum(shared, self.window)), [0])).astype(np.uint8)
        levels, step = [level], 1
        while 2 * step < len(levels[0]):
            level = np.minimum(level[:-step], level[step:])
            levels.append(level)
            step *= 2
        return levels

    def widen(self, low: np.ndarray, high: np.ndarray, length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """The range of all suffixes that share the first `length` symbols (1 or more) with those of a range."""
        for k in range(len(self.borders) - 1, -1, -1):
            level, step = self.borders[k], 1 << k
            at = low - step + 1
            low = np.where((at >= 0) & (level[np.clip(at, 0, len(level) - 1)] >= length), low - step, low)
            high = np.where((high < len(level)) & (level[np.minimum(high, len(level) - 1)] >= length), high + step, high)
        return low, high

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the range of symbol + pattern from the range of pattern."""
        return self.counts[symbol] + self.bwt.rank(symbol, low), self.counts[symbol] + self.bwt.rank(symbol, high)

    def matching_statistics(self, stream: np.ndarray, start: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stream passages stream[start : start + number + window - 1] through the index, all at once, each from its right end.

        Returns (length, low) for every place of the stream: for the places from window - 1 of a passage on, the length of the longest match
        that ends there, cut off at `window`, and for a match of full length the start of its range. (Other places: no meaning.) A symbol
        below 0 or beyond those of the index is in no passage of it. Each step of backward search takes one symbol to the left. A match
        that can't grow lets last symbols go until its range widens, so that the next symbol may fit: shorter cuts have the same range and
        fail alike. So steps are at most two for each symbol of a passage.
        """
        n = len(self.text)
        stream = np.where(stream < self.size, stream, -1)
        lengths, lows = np.full(len(stream), -1, np.int64), np.zeros(len(stream), np.int64)
        who, end = np.arange(len(start)), start + number + self.window - 2
        stop = start + self.window - 1
        length, low, high = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.full(len(start), n, np.int64)
        while len(who):
            symbol = stream[end - length]
            known = symbol >= 0
            l, h = self.extend(np.where(known, symbol, 0), low, high)
            on = known & (h > l)
            length, low, high = length + on, np.where(on, l, low), np.where(on, h, high)
            out = np.flatnonzero(~on | (length == self.window))
            if len(out):
                at, had, a, b = end[out], length[out], low[out], high[out]
                lengths[at], lows[at] = had, np.where(had == self.window, a, 0)
                left = np.where(on[out], self.window - 1, np.maximum(self.borders[0][a], self.borders[0][b]))  # a range of the whole order has borders 0
                a, b = self.widen(a, b, np.maximum(left, 1))
                empty = left == 0
                low[out], high[out], length[out] = np.where(empty, 0, a), np.where(empty, n, b), left
                end[out] = at - np.maximum(had - left, 1)
                more = end >= stop[who]
                who, end, length, low, high = who[more], end[more], length[more], low[more], high[more]
        told = np.where(lengths >= 0, np.arange(len(stream)), len(stream))  # between two places told lengths fall by one to the left
        after = np.minimum.accumulate(told[::-1])[::-1]
        inside = after < len(stream)
        at = after[inside]
        lengths[inside] = lengths[at] - (at - np.flatnonzero(inside))
        return lengths, lows

    def least(self, values: np.ndarray) -> np.ndarray:
        """For each place in the order the least of values (one per text position) over its group of equal windows."""
        size = np.diff(np.append(self.starts, len(values)))
        return np.repeat(np.minimum.reduceat(values[self.order], self.starts), size)
