"""Words of many texts at once, as 64-bit hashes, on bytes.

A word is a run of bytes other than space and \\t to \\r; A to Z count as
lower case. Words never span texts.
"""

import hashlib

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
LONG = 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(LONG, _STEP)]), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = h.astype(np.uint64, copy=True)
    for by in (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)):
        h ^= h >> np.uint64(31)
        h *= by
    h ^= h >> np.uint64(32)
    return h


def word_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of the first bytes of all words."""
    inside = IN_WORD[data]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    edge[first] = inside[first]
    return np.flatnonzero(edge)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and per text the offsets of its words."""
    inside = IN_WORD[data]
    starts = word_starts(data, at)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    kept = np.cumsum(inside)
    first = kept[starts] - 1
    length = np.diff(first, append=kept[-1])
    letters = LOWER[data[inside]].astype(np.uint64) + np.uint64(1)
    back = np.repeat(first + length - 1, length) - np.arange(len(letters))
    hashed = np.add.reduceat(letters * _POWERS[np.minimum(back, LONG)], first)
    hashed = mix(hashed + length.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    for k in np.flatnonzero(length > LONG):
        whole = LOWER[data[starts[k] : starts[k] + length[k]]].tobytes()
        hashed[k] = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little")
    return hashed, np.searchsorted(starts, at)


def shingles(hashed: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one text, and their offsets.

    A text with fewer words, but at least one, has its whole sequence as its one shingle.
    """
    count = np.diff(at)
    short = (count > 0) & (count < n)
    number = np.where(short, 1, np.maximum(count - n + 1, 0))
    ends = np.concatenate([[0], np.cumsum(number)])
    text = np.repeat(np.arange(len(count)), number)
    first = at[:-1][text] + np.arange(len(text)) - ends[:-1][text]
    out = np.zeros(len(text), np.uint64)
    for k in range(n):
        there = k < count[text]
        word = hashed[np.minimum(first + k, max(len(hashed) - 1, 0))] if len(hashed) else out
        out = np.where(there, mix(out * np.uint64(3) + word + np.uint64(k + 1)), out)
    return out, ends


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, ascending, and their offsets."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], np.searchsorted(text[new], np.arange(len(at)))
