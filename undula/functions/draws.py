"""Uniform numbers keyed by what they are for: the same on every run and every partitioning."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | str | int) -> Column:
    """A number in [0, 1) from the md5 of the key's parts joined by colons."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def geometric(u: Column, p: float) -> Column:
    """The geometric number of trials whose distribution function passes u; 0 for u = 0."""
    return F.ceil(F.ln(1 - u) / F.ln(F.lit(1 - p))).cast("int")


#: Bytes of a text whose digest is found among many, and such texts at once.
_LONGEST, _KEPT = 55, 1 << 15
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_PLACES = (lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16)
_SINES = [int(abs(math.sin(i + 1)) * 4294967296) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _heads(words: list[np.ndarray | None]) -> np.ndarray:
    """The first four bytes of the md5 of many texts of one block, from its 16 words; None for words of zeros."""
    shape = next(w for w in words if w is not None).shape
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        a += f
        a += np.uint32(_SINES[i])
        if (word := words[_PLACES[kind](i)]) is not None:
            a += word
        turn = _TURNS[kind][i % 4]
        np.left_shift(a, np.uint32(turn), out=g)
        a >>= np.uint32(32 - turn)
        a |= g
        a += b
        a, b, c, d = d, a, b, c
    return (a + np.uint32(_START[0])).byteswap()


def _endings(start: int, first: int, last: int, n: int) -> list[np.ndarray | None]:
    """Words of rep:k:which after `start` bytes of zeros, each (which, k, rep), with the block's end mark and length."""
    made = np.zeros((2, n, last - first, 64), np.uint8)
    for width in {len(str(r)) for r in range(first, last)}:
        reps = np.array([r for r in range(first, last) if len(str(r)) == width])
        for size in {len(str(n - 1)), *range(1, len(str(n - 1)))}:
            ks = np.arange(10 ** (size - 1) if size > 1 else 0, min(n, 10**size))
            part = np.zeros((2, len(ks), len(reps), 64), np.uint8)
            for i in range(width):
                part[..., start + i] = 48 + reps // 10 ** (width - 1 - i) % 10
            at = start + width
            for i in range(size):
                part[..., at + 1 + i] = (48 + ks // 10 ** (size - 1 - i) % 10)[:, None]
            part[..., at] = part[..., at + 1 + size] = 58
            part[..., at + size + 2] = np.array([49, 50])[:, None, None]
            part[..., at + size + 3] = 128
            part[..., 56], part[..., 57] = (at + size + 3) * 8 % 256, (at + size + 3) * 8 // 256
            made[:, ks[0] : ks[-1] + 1, reps[0] - first : reps[-1] - first + 1] = part
    words = made.view("<u4")
    return [np.ascontiguousarray(words[..., j]) if words[..., j].any() else None for j in range(16)]


_kept_endings = lru_cache(256)(_endings)


def many(names: Sequence[bytes], reps: range, n: int) -> np.ndarray:
    """`uniform` of name:rep:k:1 and name:rep:k:2, as (which, k, name, rep); names are of one length.

    Digests of texts that fit into one block are found together, word by word, as many as a cache holds.
    """
    if (some := max(1, _KEPT // (2 * max(n, 1) * len(reps)))) < len(names):
        return np.concatenate([many(names[i : i + some], reps, n) for i in range(0, len(names), some)], 2)
    shape, start = (2, n, len(names), len(reps)), len(names[0]) + 1
    if not n or start + len(str(reps[-1])) + len(str(n - 1)) + 3 > _LONGEST:
        texts = (b"%s:%d:%d:%d" % (name, rep, k, which) for which in (1, 2) for k in range(n) for name in names for rep in reps)
        return np.array([int(hashlib.md5(t).hexdigest()[:8], 16) for t in texts], float).reshape(shape) / 4294967296.0
    made = _kept_endings if 2 * n * len(reps) <= _KEPT else _endings
    begun = np.frombuffer(b"".join(name + b":" + bytes(64 - start) for name in names), "<u4").reshape(-1, 16)
    words: list[np.ndarray | None] = []
    for j, end in enumerate(made(start, reps[0], reps[-1] + 1, n)):
        head = begun[:, j][:, None] if 4 * j < start else None
        if head is None and end is None:
            words.append(None)
        else:
            full = np.zeros(shape, np.uint32) if end is None else np.broadcast_to(end[:, :, None, :], shape).copy()
            words.append(full if head is None else full | head)
    return _heads(words) / 4294967296.0
