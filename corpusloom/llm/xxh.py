"""XXH64 of many byte ranges at once, in numpy, from the hash's published specification."""

from __future__ import annotations

import numpy as np
import xxhash

# Fixed values of the specification: its five primes.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Ranges beyond this many bytes are hashed one by one, so that a few long ones do not stretch the common loop.
LONG = 1024


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _lane(state: np.ndarray | np.uint64, word: np.ndarray) -> np.ndarray:
    return _turn(state + word * P2, 31) * P1


def _stripes(words: np.ndarray, at: np.ndarray, size: np.ndarray, seed: np.uint64) -> np.ndarray:
    """The state after all whole 32-byte stripes of ranges that have one at least."""
    with np.errstate(over="ignore"):
        begin = (seed + P1 + P2, seed + P2, seed, seed - P1)
    lanes = [np.full(len(at), b) for b in begin]
    row, left = np.arange(len(at)), size
    while len(row):
        for k, lane in enumerate(lanes):
            lane[row] = _lane(lane[row], words[at + 8 * k])
        more = np.flatnonzero(left >= 64)
        row, at, left = row[more], at[more] + 32, left[more] - 32
    out = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
    for lane in lanes:
        out = (out ^ _lane(np.uint64(0), lane)) * P1 + P4
    return out


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """The hash (uint64) of each ``data[start:end]``."""
    size, seed64 = end - start, np.uint64(seed)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    with np.errstate(over="ignore"):
        h = np.full(len(start), seed64 + P5)
    at = start.astype(np.int64)
    striped = np.flatnonzero((size >= 32) & (size <= LONG))
    if len(striped):
        h[striped] = _stripes(words, at[striped], size[striped], seed64)
        at[striped] += size[striped] // 32 * 32
    h += size.astype(np.uint64)
    long = size > LONG
    left = np.where(long, 0, end - at)
    while len(some := np.flatnonzero(left >= 8)):
        h[some] = _turn(h[some] ^ _lane(np.uint64(0), words[at[some]]), 27) * P1 + P4
        at[some] += 8
        left[some] -= 8
    some = np.flatnonzero(left >= 4)
    h[some] = _turn(h[some] ^ ((words[at[some]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at[some] += 4
    left[some] -= 4
    while len(some := np.flatnonzero(left > 0)):
        h[some] = _turn(h[some] ^ (padded[at[some]].astype(np.uint64) * P5), 11) * P1
        at[some] += 1
        left[some] -= 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(long):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return h
