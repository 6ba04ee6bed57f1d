"""Vectorised word hashing over whole Arrow slices.

Words are maximal runs of characters other than ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.  A text's
shingles are its runs of five consecutive words; a text of one to four words has one shingle, made of
all of them, and a text without words has none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from undula.llm.common import text_bytes

WORDS = 5
U = np.uint64
_FACTOR, _CHAIN = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of more bytes than this are hashed one by one.
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: What of eight bytes, the first of them lowest, belongs to a run that has so many left.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return data + (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))


def blank(data: np.ndarray) -> np.ndarray:
    """True for ``[\\x20\\x09-\\x0D]``."""
    return (data == 32) | ((data - np.uint8(9)) < 5)


def runs(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross a text's end."""
    if len(keep) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(keep)
    before[0], before[1:] = False, keep[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(keep))]
    before[inner] = False
    after = np.empty_like(keep)
    after[-1], after[:-1] = False, keep[1:]
    after[inner - 1] = False
    return np.flatnonzero(keep & ~before), np.flatnonzero(keep & ~after) + 1


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run, made of eight of its bytes at a time."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))
    at, left = starts, ends - starts
    out = (left.astype(U) + _FACTOR) * _CHAIN
    for i in np.flatnonzero(left > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    live = np.flatnonzero(left <= _LONG)
    at, left = at[live], left[live]
    while len(live):
        part = eight[at] & _MASK[np.minimum(left, 8)]
        out[live] = mix(out[live] ^ part)
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and n+1 offsets of the texts into them."""
    data, offsets = text_bytes(texts)
    data = lower(data)
    starts, ends = runs(~blank(data), offsets)
    return hash_runs(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts in order, repeats included, and n+1 offsets of the texts."""
    h, at = words(texts)
    n = np.diff(at)
    count = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(n.dtype))
    ends = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(ends[-1], U)
    if len(h) >= WORDS:
        chain = h[: len(h) - WORDS + 1].copy()
        for k in range(1, WORDS):
            chain = chain * _CHAIN + h[k : len(h) - WORDS + 1 + k]
        inside = np.repeat(at[:-1] - ends[:-1], np.where(n >= WORDS, count, 0))
        full = np.repeat(n >= WORDS, count)
        out[full] = chain[np.flatnonzero(full) + inside]
    for i in np.flatnonzero((n > 0) & (n < WORDS)):
        one = _FACTOR * np.full(1, n[i], U)
        for k in range(at[i], at[i + 1]):
            one = one * _CHAIN + h[k : k + 1]
        out[ends[i]] = one[0]
    return mix(out), ends


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the distinct values in ascending order, their counts, and the n+1 new offsets."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(first)
    return v[at], np.diff(np.append(at, len(v))), np.searchsorted(o[at], np.arange(len(offsets)))
