"""MD5 of many short texts at once, in numpy: for draws that are named by a hash, by the thousand million.

The digests are those of any md5; ``hash_unit`` in ``scalar`` is the same number as a Column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_K = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURN = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: The first word of the digest is what step 60 gives; the last three steps make the other words.
STEPS, BLOCK = 61, 1 << 15


def _first_word(fixed: list[int], varied: dict[int, np.ndarray]) -> np.ndarray:
    """The first 32 bits of the MD5 of one-block messages whose words are ``fixed``, plus ``varied`` where given."""
    shape = next(iter(varied.values())).shape
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(STEPS):
        if i < 16:  # d ^ (b & (c ^ d))
            word = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:  # c ^ (d & (b ^ c))
            word = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            word = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            word = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, np.uint32((_K[i] + fixed[word]) & 0xFFFFFFFF), out=f)
        if word in varied:
            np.add(f, varied[word], out=f)
        np.left_shift(f, np.uint32(_TURN[i]), out=g)
        np.right_shift(f, np.uint32(32 - _TURN[i]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_START[0])).byteswap()  # hexadecimal digits go from the first byte on


@lru_cache(maxsize=64)  # of some 400 KB each
def _digits(before: int, width: int, low: int, high: int) -> dict[int, np.ndarray]:
    """By message word, the decimal digits of the numbers from low on, as they stand after ``before`` bytes."""
    at, out = np.arange(low, high, dtype=np.uint64), {}
    for k in range(width):
        word, byte = divmod(before + width - 1 - k, 4)
        digit = (at % 10 + 48).astype(np.uint32) << np.uint32(8 * byte)
        out[word] = out[word] + digit if word in out else digit
        at = at // 10
    return out


def numbered(prefix: bytes, n: int) -> Iterator[np.ndarray]:
    """The first 32 bits, as a number, of the MD5 of ``prefix`` + str(i) for i from 0 to n - 1, in blocks; for prefixes of up to 36 bytes."""
    if len(prefix) > 36:
        raise ValueError("a longer prefix may not fit one block")
    low = 0
    while low < n:
        width = len(str(low))
        high = min(n, 10**width, low + BLOCK)
        size = len(prefix) + width
        plain = prefix + bytes(width) + b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little")
        yield _first_word([int.from_bytes(plain[4 * w : 4 * w + 4], "little") for w in range(16)], _digits(len(prefix), width, low, high))
        low = high
