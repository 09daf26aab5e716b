"""Resampling draws that any engine can repeat, made in blocks of numpy arrays."""

from __future__ import annotations

import math

import numpy as np

MESSAGES_PER_BLOCK = 8192  # a block's words and state stay in the cache of a core
# Fixed values of MD5: rotations, constants, initial state.
_ROTATIONS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(-1).tolist()
_CONSTANTS = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def picks(first: int, last: int, n: int) -> np.ndarray:
    """Row ``b - first``, column ``slot``: the first 32 bits of ``md5("b|slot")`` modulo ``n``, for first <= b < last, slot < n."""
    out = np.empty((last - first, n), np.uint32)
    for low, high, digits in _same_length(first, last):
        for left, right, width in _same_length(0, n):
            for start in range(left, right, MESSAGES_PER_BLOCK):
                slots = np.arange(start, min(start + MESSAGES_PER_BLOCK, right))
                step = max(1, MESSAGES_PER_BLOCK // len(slots))
                for begin in range(low, high, step):
                    rows = np.arange(begin, min(begin + step, high))
                    heads = _heads(rows, digits, slots, width)
                    if n < 2**32:
                        heads -= heads // np.uint32(n) * np.uint32(n)
                    out[begin - first : begin - first + len(rows), start : start + len(slots)] = heads.reshape(len(rows), -1)
    return out


def _same_length(first: int, last: int):
    """Cuts [first, last) into ranges of numbers with equally many digits."""
    while first < last:
        digits = len(str(first))
        end = min(last, 10**digits)
        yield first, end, digits
        first = end


def _heads(rows: np.ndarray, digits: int, slots: np.ndarray, width: int) -> np.ndarray:
    """First 32 bits of the digests of ``row|slot``, which are messages of one block and one length."""
    size = digits + 1 + width
    used = size // 4 + 1
    text = np.zeros((len(rows), len(slots), 4 * used), np.uint8)
    for i in range(digits):
        text[:, :, i] = (rows // 10 ** (digits - 1 - i) % 10 + 48)[:, None]
    text[:, :, digits] = ord("|")
    for i in range(width):
        text[:, :, digits + 1 + i] = slots // 10 ** (width - 1 - i) % 10 + 48
    text[:, :, size] = 0x80
    words = np.ascontiguousarray(text.view("<u4").reshape(-1, used).T)
    a, b, c, d = (np.full(words.shape[1], v, np.uint32) for v in _STATE)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(61):  # the last three steps leave the first word alone
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            k = 7 * i % 16
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, np.uint32((_CONSTANTS[i] + (8 * size if k == 14 else 0)) % 2**32), out=f)
        if k < used:
            np.add(f, words[k], out=f)
        np.left_shift(f, np.uint32(_ROTATIONS[i]), out=g)
        np.right_shift(f, np.uint32(32 - _ROTATIONS[i]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_STATE[0])).byteswap()
