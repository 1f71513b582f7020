"""MD5 of many short texts at once, in numpy."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _words(texts: list[bytes], at: int) -> list[np.ndarray]:
    """The 16 words of a block that holds equally long texts from byte ``at`` on, and zeros."""
    block = np.zeros((len(texts), 64), np.uint8)
    if texts and texts[0]:
        block[:, at : at + len(texts[0])] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1)
    return list(block.view("<u4").T)


def _one_block(starts: list[bytes], ends: list[bytes]) -> np.ndarray:
    """first_48_bits() of equally long starts and equally long ends that fit a block."""
    size = len(starts[0]) + len(ends[0])
    one, two, rest = _words(starts, 0), _words(ends, len(starts[0])), _words([b"\x80"], size)
    words = [x[:, None] | y[None, :] | z[0] for x, y, z in zip(one, two, rest, strict=True)]
    words[14] = words[14] | np.uint32(8 * size)
    # a word that all texts share stays a number, one that a side shares stays a row or a column
    words = [w[: 1 if (w[:1] == w).all() else None, : 1 if (w[:, :1] == w).all() else None] for w in words]
    a, b, c, d = (np.full((len(starts), len(ends)), x, np.uint32) for x in _START)
    f, turned = np.empty_like(a), np.empty_like(a)
    for k in range(64):
        part, step = divmod(k, 16)
        if part == 0:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            word = words[step]
        elif part == 1:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            word = words[(5 * step + 1) % 16]
        elif part == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            word = words[(3 * step + 5) % 16]
        else:  # c ^ (b | ~d)
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            word = words[7 * step % 16]
        np.add(f, a, out=f)
        np.add(f, word + np.uint32(_SINES[k]), out=f)
        turn = _TURNS[part][step % 4]
        np.left_shift(f, np.uint32(turn), out=turned)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        np.bitwise_or(f, turned, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    a, b = a + np.uint32(_START[0]), b + np.uint32(_START[1])
    return (a.byteswap().astype(np.uint64) << np.uint64(16)) | (b.byteswap() >> np.uint32(16))


def first_48_bits(starts: list[bytes], ends: list[bytes]) -> np.ndarray:
    """The first 12 hexadecimal digits of the MD5 of every start followed by every end, as numbers: a row a start."""
    out = np.empty((len(starts), len(ends)), np.uint64)
    for m in {len(s) for s in starts}:
        rows = [k for k, s in enumerate(starts) if len(s) == m]
        for n in {len(e) for e in ends}:
            columns = [k for k, e in enumerate(ends) if len(e) == n]
            some, others = [starts[k] for k in rows], [ends[k] for k in columns]
            if m + n <= 55:
                out[np.ix_(rows, columns)] = _one_block(some, others)
            else:
                out[np.ix_(rows, columns)] = [[int(hashlib.md5(s + e, usedforsecurity=False).hexdigest()[:12], 16) for e in others] for s in some]
    return out
