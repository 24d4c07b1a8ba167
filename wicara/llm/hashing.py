"""Vectorised 64-bit hashing of words and word shingles straight from Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SHINGLE = 5
SLICE_BYTES = 1_000_000

_random = np.random.Generator(np.random.PCG64(20240901))
LETTERS = _random.integers(0, 1 << 64, 256, np.uint64)
LETTERS[65:91] = LETTERS[97:123]  # A-Z hash as a-z
PLACES = _random.integers(0, 1 << 64, SHINGLE, np.uint64) | np.uint64(1)
WORD = np.ones(256, bool)
WORD[[32, *range(9, 14)]] = False
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(max(size, SLICE_BYTES), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:size], _powers[1][:size]


def text_slices(column, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row bounds within them) of an Arrow string column, whole rows at a time."""
    _, offsets, data = column.buffers()
    wide = str(column.type).startswith("large")
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    bounds = bounds.astype(np.int64)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(bounds, bounds[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(column), first + 4096)
        part = bounds[first : last + 1]
        yield first, data[part[0] : part[-1]], part - part[0]
        first = last


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, row bounds in words); A-Z are lower-cased, words end at ASCII blanks."""
    size = len(data)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = WORD[data]
    before = np.empty(size, bool)
    before[0], before[1:] = False, inside[:-1]
    before[bounds[:-1][bounds[:-1] < size]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(size, bool)
    after[-1], after[:-1] = False, inside[1:]
    inner = bounds[1:-1]
    after[inner[(inner > 0)] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = powers(size)
    sums = np.empty(size + 1, np.uint64)
    sums[0] = 0
    np.cumsum(LETTERS[data] * up, out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, bounds)


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer words than a shingle count as one shingle."""
    words, rows = word_hashes(data, bounds)
    size = len(words)
    whole = np.zeros(max(size - SHINGLE + 1, 0), np.uint64)
    for j in range(SHINGLE if len(whole) else 0):
        whole += words[j : j + len(whole)] * PLACES[j]
    whole = mix(whole)
    out = []
    for s, e in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if e - s >= SHINGLE:
            out.append(np.unique(whole[s : e - SHINGLE + 1]))
        elif e > s:
            short = (words[s:e] * PLACES[: e - s]).sum(dtype=np.uint64) + np.uint64(e - s)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
