"""Words and runs of words as 64-bit numbers, for many texts at a time, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE_BYTES = 2 << 20  # of text that is hashed at a time; a longer single text is one piece

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _table(separators: bytes) -> np.ndarray:
    found = np.ones(256, bool)
    found[list(separators)] = False
    return found


SPACES = _table(b" \t\n\v\f\r")
#: For comparisons that disregard punctuation: everything in ASCII but letters, digits and _.
MARKS = _table(bytes(i for i in range(128) if not (chr(i).isalnum() or chr(i) == "_")))


def groups(texts, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``most`` characters."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts, inside: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and where each text's words start
    (one more entry than texts). None counts as an empty text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    word = inside[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    bounds = np.concatenate(([0], np.searchsorted(starts, ends))).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    letters = data[word]
    place = np.cumsum(word)[starts] - 1
    length = np.diff(np.append(place, len(letters)))
    offset = np.arange(len(letters)) - np.repeat(place, length)
    value = (letters.astype(np.uint64) + np.uint64(1)) * powers(_BASE, int(length.max()))[offset]
    return mixed(np.add.reduceat(value, place) + length.astype(np.uint64)), bounds


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` hashes; one for each place where a run fits."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * _BASE + hashes[k : k + n]
    return mixed(total)


class Ranges:
    """Hash of any range of a sequence of hashes, equal for equal ranges wherever they stand."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(_BASE, n), out=self.sums[1:], dtype=np.uint64)
        self.back = powers(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.back[start]
        return mixed(value + mixed((end - start).astype(np.uint64)))


def whole_runs(bounds: np.ndarray, size: int, n: int) -> np.ndarray:
    """For each place of ``runs`` over all texts: does the run lie within one text?"""
    good = np.ones(max(0, n - size + 1), bool)
    for k in range(1, size):
        cut = bounds[1:-1] - k
        good[cut[(cut >= 0) & (cut < len(good))]] = False
    return good


def shingles(texts, size: int, inside: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (owner, shingle, count), sorted by owner and shingle.

    A text of fewer than ``size`` words has one shingle, all its words; one without words has none.
    Shingles are 48-bit numbers; at most 65,535 texts at a time.
    """
    hashes, bounds = word_hashes(texts, inside)
    counts = np.diff(bounds)
    at = np.arange(len(hashes) - size + 1) if len(hashes) >= size else np.zeros(0, np.int64)
    good = whole_runs(bounds, size, len(hashes))
    owner = np.searchsorted(bounds, at[good], side="right") - 1
    value = runs(hashes, size)[good]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        few = Ranges(hashes)(bounds[short], bounds[short + 1])
        owner, value = np.concatenate((owner, short)), np.concatenate((value, few))
    keys = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (value >> np.uint64(16)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    places = np.flatnonzero(new)
    count = np.diff(np.append(places, len(keys)))
    keys = keys[places]
    return (keys >> np.uint64(48)).astype(np.int64), keys & np.uint64((1 << 48) - 1), count
