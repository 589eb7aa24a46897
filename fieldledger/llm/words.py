"""Words and word shingles of whole texts as 64-bit hashes, computed on the bytes of a batch at once.

Separators and letters A-Z are ASCII, so work on UTF-8 bytes finds the same words as work on characters.
"""

from __future__ import annotations

from functools import cache

import numpy as np

_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Bytes of words between ASCII white space: ``[^\x20\x09-\x0D]+``.
SPACED = ~_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words of digits, small letters and anything beyond ASCII, after lower-casing.
LETTERS = ~_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of each 64-bit value (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@cache
def _powers(length: int, base: int) -> np.ndarray:
    out = np.empty(length, np.uint64)
    out[0] = 1
    done = 1
    while done < length:
        step = min(done, length - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def powers(length: int, base: int = _BASE) -> np.ndarray:
    return _powers(1 << max(20, (length - 1).bit_length()), base)[:length]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = base**i times the hash of data[i:j], modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), _BASE_INVERSE)[starts])


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = kind[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (first[:-1] | ~before))
    ends = np.flatnonzero(inside & (first[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the text number of each word of the lower-cased texts."""
    data = lower(data)
    starts, ends, owner = word_spans(data, offsets, kind)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), owner
    return span_hash(prefix_hash(data), starts, ends), owner


def hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.array([0, len(data)]), np.ones(256, bool))[0][0])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text its distinct shingles of ``width`` words, as sorted hashes.

    A text of fewer words has its whole sequence as one shingle, one without words none."""
    hashes, owner = word_hashes(data, offsets, SPACED)
    texts = len(offsets) - 1
    counts = np.bincount(owner, minlength=texts)
    firsts = np.concatenate(([0], np.cumsum(counts)))
    step = np.uint64(0xD6E8FEB86659FD93)
    if len(hashes) >= width:
        rolled = hashes[: len(hashes) - width + 1].copy()
        for i in range(1, width):
            rolled = rolled * step + hashes[i : len(hashes) - width + 1 + i]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    out = []
    for i in range(texts):
        n, first = int(counts[i]), int(firsts[i])
        if n >= width:
            out.append(np.unique(rolled[first : first + n - width + 1]))
        elif n:
            value = np.full(1, n, np.uint64)
            for h in hashes[first : first + n]:
                value = mix(value * step + h)
            out.append(value)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
