"""Locally consistent parsing by recompression, over blocks of documents in numpy.

Each round replaces maximal runs of one symbol by a name of (symbol, length),
then every neighbouring pair (left-class symbol, right-class symbol) by a name of
the pair. Names and classes are 64-bit functions of the expansion alone, the
same on every executor, so the rounds need no dictionary and no exchange. A
symbol carries the span of words that fixed it: wherever those
words occur, the same symbol does, and that is what lets equal substrings of
different documents meet on one interior symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from corpusloom.llm._text import mix


def rounds_for(window: int) -> int:
    """Rounds after which symbols have outgrown what a window of so many words can fix: each round doubles them, and a symbol needs its neighbours in the window too."""
    return max(1, window.bit_length() - 2)


_RUN, _PAIR, _SIDE = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


@dataclass
class Level:
    """Symbols in order: name, first word, words, and the span [low, high) of words that fixed them."""

    name: np.ndarray
    start: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _neighbours(level: Level, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low of the symbol before, high of the one after, whether the one after is in the same document).

    Beyond its document's ends a symbol depends on a word that is not there.
    """
    same = np.zeros(len(doc), bool)
    same[:-1] = doc[1:] == doc[:-1]
    before = first[doc] - 1
    before[1:] = np.where(same[:-1], level.low[:-1], before[1:])
    after = first[doc + 1] + 1
    after[:-1] = np.where(same[:-1], level.high[1:], after[:-1])
    return before, after, same


def _round(level: Level, doc: np.ndarray, first: np.ndarray, number: int) -> tuple[Level, np.ndarray]:
    before, after, same = _neighbours(level, doc, first)
    equal = np.zeros(len(doc), bool)
    equal[1:] = (level.name[1:] == level.name[:-1]) & same[:-1]
    head = np.flatnonzero(~equal)
    tail = np.append(head[1:], len(doc)) - 1
    run = tail - head + 1
    name = level.name[head]
    long = run > 1
    name[long] = mix(name[long] * _RUN + run[long].astype(np.uint64))
    level = Level(name, level.start[head], level.start[tail] + level.size[tail] - level.start[head], before[head], after[tail])
    doc = doc[head]

    before, after, same = _neighbours(level, doc, first)
    right = (mix(level.name ^ np.uint64(int(_SIDE) * (2 * number + 1) % 2**64)) >> np.uint64(63)).astype(bool)
    opens = np.zeros(len(doc), bool)
    opens[:-1] = ~right[:-1] & right[1:] & same[:-1]
    closes = np.zeros(len(doc), bool)
    closes[1:] = opens[:-1]
    low = np.where(right & ~closes, before, level.low)
    high = np.where(~right & ~opens, after, level.high)
    at = np.flatnonzero(opens)
    name, size = level.name.copy(), level.size.copy()
    name[at] = mix(mix(level.name[at] + _PAIR) * _PAIR ^ level.name[at + 1])
    size[at] += level.size[at + 1]
    high[at] = level.high[at + 1]
    kept = ~closes
    return Level(name[kept], level.start[kept], size[kept], low[kept], high[kept]), doc[kept]


def parse(names: np.ndarray, first: np.ndarray, rounds: int = 4) -> list[Level]:
    """The levels of a block of documents, words first."""
    n = len(names)
    at = np.arange(n)
    levels = [Level(names, at, np.ones(n, np.int64), at, at + 1)]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for r in range(rounds if n else 0):
        level, doc = _round(levels[-1], doc, first, r)
        levels.append(level)
    return levels


def _least(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each range [lo, hi] the first place of the smallest key."""
    span = hi - lo + 1
    out = np.empty(len(lo), np.int64)
    table = np.arange(len(key))
    width = 1
    while True:
        here = np.flatnonzero((span >= width) & (span < 2 * width))
        if len(here):
            a, b = table[lo[here]], table[hi[here] - width + 1]
            out[here] = np.where(key[b] < key[a], b, a)
        if not (span >= 2 * width).any():
            return out
        a, b = table[:-width], table[width:]
        table = np.where(key[b] < key[a], b, a)
        width *= 2


def anchors(levels: list[Level], starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window [start, start+window): (level, symbol, symbol's name), chosen from the window's words alone.

    Of the symbols that the window's words fix, at the highest level that has any,
    the longest is taken and of equals the one with the smallest hash.
    """
    of_level, of_symbol = np.full(len(starts), -1), np.zeros(len(starts), np.int64)
    name = np.zeros(len(starts), np.uint64)
    todo = np.arange(len(starts))
    for number in range(len(levels) - 1, -1, -1):
        if not len(todo):
            break
        level = levels[number]
        lo = np.searchsorted(level.low, starts[todo], side="left")
        hi = np.searchsorted(level.high, starts[todo] + window, side="right") - 1
        some = hi >= lo
        if some.any():
            key = ((np.uint64(63) - np.minimum(level.size, 63).astype(np.uint64)) << np.uint64(58)) | (mix(level.name + _SIDE) >> np.uint64(6))
            found = _least(key, lo[some], hi[some])
            of_level[todo[some]], of_symbol[todo[some]], name[todo[some]] = number, found, level.name[found]
        todo = todo[~some]
    return of_level, of_symbol, name
