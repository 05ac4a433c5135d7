"""Recompression of word sequences: the parts that need no exchange.

Symbols have names: integers that Spark rounds assign (`substring`), equal for equal words
everywhere and different for different ones. Round 0 has a symbol for each maximal run of one
word. Each later round splits the names at hand into "left" and "right" ones by a hash bit of
name and round and makes one symbol of every adjacent (left, right) pair. Whether two
neighbours merge depends on their names alone: inside two equal substrings the parses are
equal, but for a margin at either end that follows from the substring itself. `certain` gives
the symbols of each round within a window's margins. Equal windows thus have equal ones.

A name of 0 is dead: its words stand in one document only, or their name was not asked for. It
never merges, and nothing that holds it is repeated in another document.
"""

from __future__ import annotations

import numpy as np

from quillon.llm.text import U64, mix

ROUNDS = 4  # of pairs


def rights(names: np.ndarray, level: int) -> np.ndarray:
    return (mix(names.astype(U64) + U64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))) >> U64(40)) & U64(1) == 1


def runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the maximal runs of one word, and len(words); none spans two texts."""
    head = np.ones(len(words), bool)
    head[1:] = words[1:] != words[:-1]
    head[first[first < len(words)]] = True
    return np.append(np.flatnonzero(head), len(words))


def pairs(names: np.ndarray, starts: np.ndarray, first: np.ndarray, level: int, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(symbols that stay or begin a pair, whether they begin one); pairs never span two texts. right: as `rights` gives it, if at hand."""
    right = rights(names, level) if right is None else right
    merge = np.zeros(len(names) + 1, bool)  # merge[k]: symbol k goes into symbol k-1
    begins = np.zeros(int(starts[-1]) + 1, bool)
    begins[first] = True
    merge[1:-1] = ~right[:-1] & right[1:] & (names[:-1] > 0) & (names[1:] > 0) & ~begins[starts[1:-1]]
    keep = np.flatnonzero(~merge[:-1])
    return keep, merge[keep + 1]


def certain(levels: list[tuple[np.ndarray, np.ndarray]], at: np.ndarray, width: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """([(first word, one past the last)] by round, whether all are named) of the certain symbols of each window of `width` words from `at`.

    Those are the symbols that any text would have there, whatever stands around the window.
    levels: (names, starts) by round, starts with a last entry, the number of words. Each window lies in one text."""
    ranges, good = [], np.ones(len(at), bool)
    if not len(at):
        return [(at, at)] * len(levels), good
    low = high = before = None
    for level, (names, starts) in enumerate(levels):
        low, high = _certain(level, starts, before, rights(levels[level - 1][0], level) if level else None, low, high, at, width)
        good &= _named(names == 0, low, high)
        ranges.append((starts[low], starts[high]))
        before = starts
    return ranges, good


def living(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]], at: np.ndarray, width: int) -> np.ndarray:
    """Those windows of at whose certain symbols all have names. levels: (starts, whether dead, whether right in the next round) by round."""
    low = high = before = right = None
    for level, (starts, dead, rights_next) in enumerate(levels):
        if not len(at):
            break
        low, high = _certain(level, starts, before, right, low, high, at, width)
        good = _named(dead, low, high)
        at, low, high = at[good], low[good], high[good]
        before, right = starts, rights_next
    return at


def _named(dead: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether no symbol from low to high is dead."""
    count = np.concatenate([[0], np.cumsum(dead)])
    return count[high] == count[low]


def _certain(level: int, starts: np.ndarray, before: np.ndarray | None, right: np.ndarray | None, low: np.ndarray | None, high: np.ndarray | None, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first certain symbol, one past the last) of each window, from those, the starts and the rights of the round before."""
    n = int(starts[-1])
    if level == 0:  # a run at an end of the window may go on outside it
        index = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        low, high = index[at] + 1, index[at + width - 1]
    else:
        m = len(before) - 1
        some = high > low
        low = low + (some & right[np.minimum(low, m - 1)])
        high = high - (some & (high > low) & ~right[np.maximum(high - 1, 0)])
        # the certain symbols begin and end at symbols of this round
        index = np.zeros(n + 1, np.int64)
        index[starts] = np.arange(len(starts))
        low, high = index[before[np.minimum(low, m)]], index[before[np.clip(high, 0, m)]]
    some = high > low if level == 0 else some & (high > low)
    return np.where(some, low, 0), np.where(some, high, 0)
