"""A compressed full-text index over sequences of words, searched backwards for many patterns at once.

The Burrows-Wheeler transform of the sequences is held as a wavelet matrix of packed bits; its ranks
take one step of a backward search. Suffixes are sorted up to a given depth, which is as far as any
pattern reaches. Every sequence has an owner, a number; an interval of suffixes knows its smallest
owner, so a match can be asked for in sequences of smaller owners only.
"""

from __future__ import annotations

import numpy as np


class _Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.cumsum(np.append(0, np.bitwise_count(self.words)[:-1]), dtype=np.int64)

    def ones(self, place: np.ndarray) -> np.ndarray:
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class Wavelet:
    """Ranks in a sequence of small numbers: level by level, the numbers whose bit is 0 go first."""

    def __init__(self, values: np.ndarray, size: int):
        self.levels = []
        for shift in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bit = (values >> shift & 1).astype(bool)
            self.levels.append((shift, _Bits(bit), int((~bit).sum())))
            values = np.concatenate((values[~bit], values[bit]))
        # where the numbers of each kind start once all levels have sorted them
        self.first = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, value: np.ndarray, place: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(place)
            place = np.where(value >> shift & 1, zeros + ones, place - ones)
        return place

    def rank(self, value: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each value stands before each place."""
        return self._down(value, place) - self.first[value]


class _Smallest:
    """The smallest number in any range, from tables of powers of two."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.log2(np.maximum(high - low, 1)).astype(np.int64)
        out = np.empty(len(low), self.tables[0].dtype)
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            table = self.tables[k]
            out[own] = np.minimum(table[low[own]], table[high[own] - (1 << int(k))])
        return out


def _sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes, in order of their first ``depth`` numbers at least."""
    rank = text.astype(np.int64)
    reach, n = 1, len(text)
    order = np.argsort(rank)
    while reach < depth:
        after = np.zeros(n, np.int64)
        after[: n - reach] = rank[reach:] + 1
        key = rank * (int(after.max()) + 1) + after
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        reach *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


class Index:
    """The index of some sequences of word hashes, each with an owner."""

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray, depth: int):
        words, symbols = np.unique(np.concatenate(sequences), return_inverse=True)
        lengths = np.array([len(s) for s in sequences])
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(int(ends[-1]) + 1, np.int64)  # 0 ends a sequence
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = symbols + 1
        self.text, self.starts = text, ends - lengths
        self.lengths = lengths
        order = _sorted_suffixes(text, depth + 1)
        size = len(words) + 1
        self.wavelet = Wavelet(text[order - 1], size)
        self.smaller = np.append(0, np.cumsum(np.bincount(text, minlength=size)))[:-1]
        self.smallest = _Smallest(np.repeat(owners, lengths + 1)[order])

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Intervals of the patterns that have one more symbol in front."""
        base = self.smaller[symbol]
        both = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return base + both[: len(low)], base + both[len(low) :]

    def _reach(self, start: np.ndarray, end: np.ndarray, below: np.ndarray) -> np.ndarray:
        """For each range of the text, how far back from its end it occurs with an owner < below:
        the smallest place >= start from which on it does, or its end."""
        place = end.copy()
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.text))
        live = np.flatnonzero(place > start)
        while len(live):
            symbol = self.text[place[live] - 1]
            lo, hi = self.step(symbol, low[live], high[live])
            good = hi > lo
            good[good] = self.smallest(lo[good], hi[good]) < below[live[good]]
            low[live], high[live] = lo, hi
            place[live[good]] -= 1
            live = live[good]
            live = live[place[live] > start[live]]
        return place

    def repeated(self, window: int, owners: np.ndarray) -> np.ndarray:
        """For every place of the text: does a window that starts there, inside one sequence, occur
        in a sequence with a smaller owner? The matching statistics above the threshold.

        Each sequence is searched from its end first. What fails is then searched window by window
        from its start: a window that breaks off rules out all windows over the break, and one that
        matches is extended to the right as far as it goes, by bisection.
        """
        found = np.zeros(len(self.text), bool)
        first = self.starts.copy()  # windows before it are settled
        last = self.starts + self.lengths - window  # windows after it are settled
        place = self._reach(first, last + window, owners)
        self._mark(found, place, last)
        last = np.where(place <= last, np.minimum(place, last + 1) - 1, last)
        live = np.flatnonzero(first <= last)
        while len(live):
            at = first[live]
            place = self._reach(at, at + window, owners[live])
            hit = place == at
            first[live[~hit]] = place[~hit]  # the break is just before it
            good = live[hit]
            if len(good):
                low, high = first[good].copy(), last[good].copy()
                while (low < high).any():  # the last window start such that all up to it match at once
                    middle = (low + high + 1) // 2
                    whole = self._reach(first[good], middle + window, owners[good]) == first[good]
                    low, high = np.where(whole, middle, low), np.where(whole, high, middle - 1)
                self._mark(found, first[good], low)
                first[good] = low + 1
            live = live[first[live] <= last[live]]
        return found

    @staticmethod
    def _mark(found: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        change = np.zeros(len(found) + 1, np.int64)
        some = first <= last
        np.add.at(change, first[some], 1)
        np.add.at(change, last[some] + 1, -1)
        found |= np.cumsum(change[:-1]) > 0
