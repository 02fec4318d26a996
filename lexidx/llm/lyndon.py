"""Suffix grouping by Lyndon prefixes, and the suffix order that follows from it.

``grouping`` is the first phase of the linear-time construction: suffixes start
in groups of equal first symbols; groups are taken in descending order, every
member looks for the nearest position before it whose suffix lies in a lower
group (its previous-smaller pointer), and the positions pointed at leave their
group for a new one just above it, the ones pointed at more often first. When a
group is taken, its members share their longest Lyndon prefix, so the phase
yields the Lyndon array and the previous-smaller pointers of the text.

``suffix_order`` is the second phase: suffixes of one group differ first in what
follows their common prefix, which starts at the next smaller suffix. Walking the
order upwards and, from every suffix, down the pointers of its left neighbours
appends each suffix to its group in the right order. Nothing is renamed and
nothing recurses.

Symbols are integers of any size; the end of the text is smaller than all of
them. An empty text gives empty results. Time and memory are linear in the text.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np


def grouping(symbols: np.ndarray) -> tuple[list[int], list[int], list[list[int]]]:
    """(length of the longest Lyndon prefix, previous-smaller pointer or -1) by position; groups in ascending order."""
    n = len(symbols)
    if not n:
        return [], [], []
    by_symbol = np.argsort(symbols, kind="stable")
    ordered = np.asarray(symbols)[by_symbol]
    cuts = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True)) + 1
    positions = by_symbol.tolist()
    members, at = [], 0
    of = np.empty(n, np.int64)
    of[by_symbol] = np.repeat(np.arange(len(cuts)), np.diff(cuts, prepend=0))
    of = of.tolist()                                   # position -> group
    for cut in cuts.tolist():                          # group -> positions, ascending; some may have left since
        members.append(positions[at:cut])
        at = cut
    above = [*range(1, len(members)), -1]              # group -> the next higher one
    length = [1] * len(members)                        # group -> length of the common prefix
    lyndon, pointer = [0] * n, [-1] * n
    taken = [False] * (n + 1)                          # the last entry stands for position -1: in no group
    group, below = len(members) - 1, [-1, *range(len(members) - 1)]
    final = []
    while group >= 0:
        here = [i for i in members[group] if of[i] == group]
        members[group] = here
        if here:
            size = length[group]
            pointed = []
            for i in here:
                p = i - 1
                while taken[p]:
                    p = pointer[p]
                pointer[i] = p
                taken[i] = True
                lyndon[i] = size
                if p >= 0:
                    pointed.append(p)
            final.append(here)
            if pointed:
                # equal pointers are neighbours, since pointers rise with the position
                if len(pointed) > 1 and len(set(pointed)) < len(pointed):
                    times = {}
                    for p, same in groupby(pointed):
                        times.setdefault(sum(1 for _ in same), []).append(p)
                    rounds = [(t, times[t]) for t in sorted(times, reverse=True)]
                else:
                    rounds = [(1, pointed)]
                for t, moved in rounds:
                    fresh = {}
                    for p in moved:
                        old = of[p]
                        new = fresh.get(old)
                        if new is None:
                            new = fresh[old] = len(members)
                            members.append([])
                            length.append(length[old] + t * size)
                            up = above[old]
                            above.append(up)
                            below.append(old)
                            above[old] = new
                            below[up] = new
                        members[new].append(p)
                        of[p] = new
        group = below[group]
    final.reverse()
    return lyndon, pointer, final


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in ascending order."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    lyndon, pointer, groups = grouping(symbols)
    place, starts = 0, []                              # group -> its next free place
    of = [0] * n
    for g, here in enumerate(groups):
        starts.append(place)
        place += len(here)
        for i in here:
            of[i] = g
    order = [0] * n
    p = n - 1                                          # what the empty suffix, the smallest of all, puts in place
    while p >= 0 and p + lyndon[p] == n:
        g = of[p]
        order[starts[g]] = p
        starts[g] += 1
        p = pointer[p]
    for at in range(n):
        s = order[at]
        p = s - 1
        while p >= 0 and p + lyndon[p] == s:
            g = of[p]
            order[starts[g]] = p
            starts[g] += 1
            p = pointer[p]
    return np.array(order, np.int64)
