"""Five-word shingles of UTF-8 bytes as 64-bit hashes, by numpy over many texts at once."""

from __future__ import annotations

import numpy as np

WORDS = 5
STRIP = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.default_rng(20)
BYTES = _random.integers(0, 1 << 64, 256, np.uint64)
PLACES = _random.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STRIP + 4096)
        both = [np.ones(size, np.uint64), np.ones(size, np.uint64)]
        for out, base in zip(both, (BASE, _INVERSE), strict=True):
            out[1:] = base
            np.multiply.accumulate(out, out=out)
        _powers[:] = both
    return _powers[0], _powers[1]


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts raw[at[k]:at[k + 1]] in order, and how many each text has. A-Z count as a-z."""
    n = int(at[-1] - at[0])
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    own = LOWER[raw[at[0] : at[-1]]]
    inner = at[:-1][at[1:] > at[:-1]] - at[0]
    space = SPACE[own]
    edge = np.zeros(n + 1, bool)
    edge[inner] = edge[n] = True
    start = ~space
    start[1:] &= space[:-1] | edge[1:n]
    stop = ~space
    stop[:-1] &= space[1:] | edge[1:n]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop)
    up, down = _power(n)
    total = np.cumsum(BYTES[own] * up[:n])
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    length = (stops - starts + 1).astype(np.uint64)
    hashes = mix((total[stops] - before) * down[starts] + length * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.diff(np.searchsorted(starts, at - at[0]))


def _strips(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, for texts of any length: long ones go in strips that end at white space."""
    hashes, counts = [], np.zeros(len(at) - 1, np.int64)
    i = 0
    while i < len(counts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + STRIP, "right")) - 1)
        if at[j] - at[i] <= STRIP:
            h, c = word_hashes(raw, at[i : j + 1])
            hashes.append(h)
            counts[i:j] = c
        else:
            a = int(at[i])
            while a < at[j]:
                b = min(a + STRIP, int(at[j]))
                while b < at[j] and not SPACE[raw[b]]:
                    spaces = np.flatnonzero(SPACE[raw[b : b + STRIP]])
                    b = b + int(spaces[0]) if len(spaces) else min(b + STRIP, int(at[j]))
                h, c = word_hashes(raw, np.array([a, b]))
                hashes.append(h)
                counts[i] += c[0]
                a = b
        i = j
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def shingle_sets(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each text its distinct shingles, ascending: of five words, or of all words where there are fewer."""
    words, counts = _strips(raw, at)
    ends = np.cumsum(counts)
    n = len(words)
    runs = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        runs += words[k : k + len(runs)] * PLACES[k]
    runs = mix(runs)
    out = []
    for end, count in zip(ends, counts, strict=True):
        first = end - count
        if count >= WORDS:
            out.append(np.unique(runs[first : end - WORDS + 1]))
        elif count:
            held = np.uint64(count)
            one = words[first:end]
            with np.errstate(over="ignore"):
                for w in one:
                    held = mix(np.array([held * BASE + w]))[0]
            out.append(np.array([held]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
