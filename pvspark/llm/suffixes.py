"""Suffix array of an integer string by linear grouping.

First phase: suffixes are grouped by their longest Lyndon prefix. Groups are
taken in descending order; each suffix of the current group points to the
nearest position before it whose group is smaller (found by a union-find over
the positions already done), and the positions pointed at move to a new group
right behind what is left of their own, more pointers further behind.

Second phase: from the smallest suffix on, each placed suffix places the one
before it and, along the pointers, those whose Lyndon prefix ends there, each
at the next free place of its group. No names are given and nothing recurs.
"""

import numpy as np


def _groups(text: np.ndarray):
    """Group start of each suffix and its pointer (1-based; 0 is none)."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    begin = np.repeat(first, np.diff(first, append=n))
    sa = (order + 1).tolist()
    place = np.zeros(n + 1, np.int64)
    place[order + 1] = np.arange(n)
    start = np.zeros(n + 1, np.int64)
    start[order + 1] = begin
    size_of = np.zeros(n + 1, np.int64)
    size_of[first] = np.diff(first, append=n)
    place, start, size = place.tolist(), start.tolist(), size_of.tolist()
    link = list(range(n + 1))
    point = [0] * (n + 1)
    end = n
    while end:
        low = start[sa[end - 1]]
        members = sa[low:end]
        end = low
        for s in members:
            link[s] = s - 1
        pointers: dict[int, int] = {}
        for s in members:
            x = link[s]
            while link[x] != x:
                link[x] = link[link[x]]
                x = link[x]
            link[s] = x
            point[s] = x
            if x:
                pointers[x] = pointers.get(x, 0) + 1
        if not pointers:
            continue
        levels = sorted(set(pointers.values()), reverse=True)
        for level in levels:
            by_group: dict[int, list[int]] = {}
            for x, k in pointers.items():
                if k == level:
                    by_group.setdefault(start[x], []).append(x)
            for g, moving in by_group.items():
                rest = size[g] - len(moving)
                if not rest:
                    continue
                last = g + size[g] - 1
                for x in moving:
                    i, other = place[x], sa[last]
                    sa[i], sa[last] = other, x
                    place[other], place[x] = i, last
                    last -= 1
                size[g] = rest
                size[g + rest] = len(moving)
                for x in moving:
                    start[x] = g + rest
    return start, point


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of ``text`` in order; a shorter prefix comes first."""
    if not len(text):
        return np.zeros(0, np.int64)
    whole = np.append(np.asarray(text, np.int64) - int(text.min()) + 1, 0)
    start, point = _groups(whole)
    n = len(whole)
    free = list(range(n + 1))
    out = [0] * n
    done = [False] * (n + 1)
    out[0] = n
    done[n] = True
    for i in range(n):
        s = out[i] - 1
        while s and not done[s]:
            g = start[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = True
            s = point[s]
    return np.array(out[1:], np.int64) - 1


def ranks(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equal-length byte rows and, between neighbours in it, the common prefix (first: 0)."""
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel()
    order = np.argsort(whole, kind="stable")
    ordered = rows[order]
    differ = ordered[1:] != ordered[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, np.concatenate([[0], common])
