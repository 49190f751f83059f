"""Simple-8b: whole numbers packed into 64-bit words, many at a time, in numpy.

A word holds a 4-bit selector above 60 bits of payload. The selector says how many numbers of how
many bits the payload holds, first number lowest. Numbers that need more than 60 bits are escapes:
the word holds their place in the block's list of exceptions. A block may be decoded without the
ones before it.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: numbers in a word, by selector from 1 on.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
BLOCK = 4096  # numbers in a block; only the last of a sequence may hold fewer

_SELECTOR = np.zeros(61, np.uint64)
_SELECTOR[list(COUNTS)] = np.arange(1, len(COUNTS) + 1)


def _fitting(values: np.ndarray) -> np.ndarray:
    """How many numbers from each place on fit into one word; ``values`` is padded by 60 zeros."""
    n = len(values) - 60
    fits = np.ones(n, np.int64)
    places, most = None, values[:n]
    for before, count in zip(COUNTS[::-1], COUNTS[-2::-1]):
        # what fails for fewer, larger numbers fails for more, smaller ones as well
        for k in range(before, count):
            most = np.maximum(most, values[k : n + k] if places is None else values[places + k])
        good = most < np.uint64(1 << 60 // count)
        if good.all() and places is None:
            fits[:] = count
            continue
        places = np.flatnonzero(good) if places is None else places[good]
        most = most[good]
        if not len(places):
            break
        fits[places] = count
    return fits


def encode(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, exceptions) of each block of ``values``."""
    values = np.ascontiguousarray(values, np.uint64)
    blocks = -(-len(values) // BLOCK)
    if not blocks:
        return []
    large = np.flatnonzero(values >= np.uint64(1 << 60))
    exceptions = values[large]
    table = np.zeros((blocks, BLOCK + 60), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(values)] = values
    flat[large] = np.uint64((1 << 60) - 1)  # fits nowhere but alone
    table[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    fits = _fitting(np.append(table.ravel(), np.zeros(60, np.uint64))).reshape(table.shape)

    ends = np.full(blocks, BLOCK)
    ends[-1] = len(values) - (blocks - 1) * BLOCK
    row, at = np.arange(blocks), np.zeros(blocks, np.int64)
    starts = []
    while len(row):
        starts.append(row * table.shape[1] + at)
        at = at + fits[row, at]
        going = at < ends[row]
        row, at = row[going], at[going]
    start = np.sort(np.concatenate(starts))
    count = fits.ravel()[start]
    padded = np.append(table.ravel(), np.zeros(60, np.uint64))
    words = _SELECTOR[count] << np.uint64(60)
    for c in COUNTS:
        own = np.flatnonzero(count == c)
        if len(own):
            shift = np.arange(c, dtype=np.uint64) * np.uint64(60 // c)
            held = padded[start[own][:, None] + np.arange(c)] << shift
            words[own] |= np.bitwise_or.reduce(held, axis=1)
    block = start // table.shape[1]
    cuts = np.searchsorted(block, np.arange(blocks + 1))
    home = large // BLOCK
    extra = np.searchsorted(home, np.arange(blocks + 1))
    place = np.searchsorted(start, home * table.shape[1] + large % BLOCK)
    words[place] = np.uint64(ESCAPE << 60) | (np.arange(len(large)) - extra[home]).astype(np.uint64)
    return [
        (words[cuts[b] : cuts[b + 1]], exceptions[extra[b] : extra[b + 1]]) for b in range(blocks)
    ]


def decode(blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The numbers of consecutive blocks, each given as (numbers, words, exceptions)."""
    if not blocks:
        return np.zeros(0, np.uint64)
    words = np.concatenate([w for _, w, _ in blocks])
    selector = (words >> np.uint64(60)).astype(np.int64)
    sizes = np.array([0, *COUNTS, 1])[selector]
    ends = np.cumsum([len(w) for _, w, _ in blocks])
    # the last word of a block may hold more than the block's numbers
    total = np.concatenate(([0], np.cumsum(sizes)))
    spare = np.diff(total[np.concatenate(([0], ends))]) - [n for n, _, _ in blocks]
    place = total[:-1]
    out = np.zeros(int(total[-1]), np.uint64)
    for s, c in enumerate(COUNTS, 1):
        own = np.flatnonzero(selector == s)
        if len(own):
            bits = 60 // c
            shift = np.arange(c, dtype=np.uint64) * np.uint64(bits)
            mask = np.uint64((1 << bits) - 1)
            out[place[own][:, None] + np.arange(c)] = (words[own][:, None] >> shift) & mask
    own = np.flatnonzero(selector == ESCAPE)
    if len(own):
        first = np.cumsum([0] + [len(e) for _, _, e in blocks])
        block = np.searchsorted(ends, own, side="right")
        extra = np.concatenate([e for _, _, e in blocks])
        out[place[own]] = extra[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64) + first[block]]
    keep = np.ones(len(out), bool)
    for end, more in zip(total[ends], spare):
        if more:
            keep[end - more : end] = False
    return out[keep]
