"""Token sequences: edit distance by bit vectors, and matching blocks from maximal diagonal runs."""

from __future__ import annotations

import numpy as np


def distance(a: list, b: list) -> int:
    """Levenshtein distance. A whole column of the table is one pair of bit vectors (as long as the shorter sequence), so a step is a few operations on integers."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    where: dict = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    every, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    up, down, score = every, 0, len(b)  # where a column rises and falls from one row to the next
    for x in a:
        same = where.get(x, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rises, falls = down | (every & ~(diagonal | up)), up & diagonal
        score += bool(rises & top) - bool(falls & top)
        rises, falls = (rises << 1 | 1) & every, (falls << 1) & every
        up, down = falls | (every & ~(diagonal | rises)), rises & diagonal
    return score


def matching_blocks(a: list, b: list) -> list[tuple[int, int, int]]:
    """(i, j, n) with a[i : i + n] == b[j : j + n], in order: the longest run that both share, then the same before and after it.

    Of equally long ones the first in a counts, then the first in b. Runs are found once, as maximal diagonals of equal pairs; a range's
    longest is the longest of them clipped to it, and the ranges before and after look at those that reach into them.
    """
    number: dict = {}
    x, y = (np.array([number.setdefault(t, len(number)) for t in s], np.int64) for s in (a, b))
    if not len(x) or not len(y):
        return []
    order = np.argsort(y, kind="stable")
    first, last = (np.searchsorted(y[order], x, side) for side in ("left", "right"))
    many = last - first
    i = np.repeat(np.arange(len(x)), many)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
    by = np.lexsort((i, j - i))
    i, d = i[by], (j - i)[by]
    begins = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)]) if len(i) else np.empty(0, np.int64)
    start, diagonal, end = i[begins], d[begins], i[begins] + np.diff(np.r_[begins, len(i)])
    out, todo = [], [(0, len(x), 0, len(y), start, end, diagonal)]
    while todo:
        low, high, left, right, s, e, g = todo.pop()
        s, e = np.maximum(np.maximum(s, low), left - g), np.minimum(np.minimum(e, high), right - g)
        real = e > s
        s, e, g = s[real], e[real], g[real]
        if not len(s):
            continue
        best = np.lexsort((s + g, s, s - e))[0]
        at, to, n = int(s[best]), int(s[best] + g[best]), int(e[best] - s[best])
        out.append((at, to, n))
        todo += [(low, at, left, to, s, e, g), (at + n, high, to + n, right, s, e, g)]
    return sorted(out)
