"""Suffix arrays over word numbers, and searches of many sequences in them at once."""

from __future__ import annotations

import numpy as np


def suffix_array(code: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``code`` (not negative) in the order of their suffixes; suffixes that agree in ``depth``
    codes at least may stand in any order, and a 0 may stand like the end of the sequence.  The first codes are packed into one number, then the sorted
    depth doubles, only among suffixes that still agree."""
    n = len(code)
    if not n:
        return np.zeros(0, dtype=np.int64)
    bits = max(int(code.max()).bit_length(), 1)
    have = max(min(63 // bits, depth, n), 1)
    key = code.astype(np.int64)
    for i in range(1, have):
        key <<= bits
        key[:n - i] |= code[i:]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while have < depth:
        last = np.append(new[1:], True)
        open_slots = np.flatnonzero(~(new & last))
        if not len(open_slots):
            break
        at = order[open_slots]
        then = at + have
        key = rank[at] * (n + 1) + np.where(then < n, rank[np.minimum(then, n - 1)] + 1, 0)
        sub = np.argsort(key)
        at, key = at[sub], key[sub]
        order[open_slots] = at
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        new[open_slots] = first
        rank[at] = np.maximum.accumulate(np.where(first, open_slots, 0))
        have *= 2
    return order


def narrowed(padded: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, symbol: np.ndarray):
    """Of the suffixes in the slots lo:hi, those whose code at ``depth`` is ``symbol``; all searches at
    once.  ``padded`` has at least ``depth`` codes after the last suffix."""

    def bound(right: bool):
        a, b = lo.copy(), hi.copy()
        todo = np.flatnonzero(a < b)
        while len(todo):
            mid = (a[todo] + b[todo]) >> 1
            seen = padded[order[mid] + depth]
            below = seen <= symbol[todo] if right else seen < symbol[todo]
            a[todo[below]] = mid[below] + 1
            b[todo[~below]] = mid[~below]
            todo = todo[a[todo] < b[todo]]
        return a

    return bound(False), bound(True)


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, value) of all values in the ranges lo:hi."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
