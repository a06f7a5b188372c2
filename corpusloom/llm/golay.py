"""The perfect binary Golay code of length 23, built from its generator polynomial."""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, MESSAGE_BITS, RADIUS = 23, 12, 3
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a fixed value of the code
_CHECK_BITS = LENGTH - MESSAGE_BITS


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, _CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - _CHECK_BITS)
    return word


_OF_BIT = [_remainder(1 << i) for i in range(LENGTH)]


def _syndromes(bits: range) -> np.ndarray:
    out = np.zeros(1 << len(bits), np.int64)
    for k, bit in enumerate(bits):
        out[1 << k : 2 << k] = out[: 1 << k] ^ _OF_BIT[bit]
    return out


_LOW, _HIGH = _syndromes(range(0, 12)), _syndromes(range(12, LENGTH))
_ERROR = np.zeros(1 << _CHECK_BITS, np.int64)
for _weight in range(1, RADIUS + 1):
    for _bits in combinations(range(LENGTH), _weight):
        _s, _e = 0, 0
        for _b in _bits:
            _s, _e = _s ^ _OF_BIT[_b], _e | 1 << _b
        _ERROR[_s] = _e


def decode(words: np.ndarray) -> np.ndarray:
    """The index (12 message bits) of the one codeword within distance 3 of each 23-bit word."""
    words = words.astype(np.int64)
    return (words ^ _ERROR[_LOW[words & 0xFFF] ^ _HIGH[words >> 12]]) >> _CHECK_BITS


def neighbourhood(words: np.ndarray) -> np.ndarray:
    """Indices of the words one bit away and of each word itself, one row each, sorted; repeats become -1.

    A word within distance 2 of its codeword has one index, any other six.
    """
    words = words.astype(np.int64)
    near = np.sort(np.stack([decode(words), *(decode(words ^ (1 << b)) for b in range(LENGTH))], axis=1), axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    return near
