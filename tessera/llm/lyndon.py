"""Suffix arrays of many texts at once by Lyndon groups: linear, without recursion, all texts advance in step.

Suffixes are grouped by their Lyndon prefixes. Phase 1 takes each text's groups in descending order: pointers to the
previous smaller suffix are found by jumping, and the suffixes pointed at are moved, by how often, to new groups just
above their own. Phase 2 runs through the order from below and puts the suffix before each place, and those along its
chain of pointers, first in what is left of their groups.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.common import ranges


def lyndon_groups(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix its group's number (where the group begins in the order) and its previous smaller suffix.

    Texts stand one after another from start[0] = 0, each closed by a 0 that occurs nowhere else in it. A previous
    smaller suffix before the text's start means none.
    """
    n = len(text)
    own = np.repeat(np.arange(len(start)), end - start)
    key = own * (int(text.max(initial=0)) + 1) + text
    order = np.argsort(key, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    size = np.diff(np.append(first, n))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(first, size)
    stop = np.zeros(n + 1, np.int64)
    stop[first] = first + size
    before = np.arange(-1, n - 1)
    target = np.zeros(n, bool)
    top, live = end.copy(), np.arange(len(start))
    while len(live):
        high = top[live]
        low = group[order[high - 1]]
        member = order[ranges(low, high - low)]
        mine = np.repeat(low, high - low)
        # the last suffix before each member that is in a lower group; pointers of one group may lean on each other
        open_ = np.arange(len(member))
        while len(open_):
            p = before[member[open_]]
            bad = p >= 0
            bad[bad] = group[p[bad]] >= mine[open_[bad]]
            open_ = open_[bad]
            before[member[open_]] = before[p[bad]]
        top[live] = low
        floor = np.repeat(start[live], high - low)
        p = before[member]
        p = np.sort(p[p >= floor])
        live = live[low > start[live]]
        if not len(p):
            continue
        head = np.flatnonzero(np.diff(p, prepend=-1))
        times, p = np.diff(np.append(head, len(p))), p[head]
        g = group[p]
        by = np.lexsort((times, g))
        p, g, times = p[by], g[by], times[by]
        # of each old group: its targets take the slots at its end, the others there go where targets were
        head = np.flatnonzero(np.diff(g, prepend=-1))
        many = np.diff(np.append(head, len(g)))
        last = stop[g[head]]
        slot = ranges(last - many, many)
        target[p] = True
        held = order[slot]
        away = held[~target[held]]
        gap = place[p]
        gap = gap[gap < np.repeat(last - many, many)]
        order[gap], place[away] = away, gap
        order[slot], place[p] = p, slot
        target[p] = False
        stop[g[head]] = last - many
        head = np.flatnonzero((np.diff(g, prepend=-1) != 0) | (np.diff(times, prepend=-1) != 0))
        many = np.diff(np.append(head, len(g)))
        group[p] = np.repeat(slot[head], many)
        stop[slot[head]] = slot[head] + many
    return group, before


def suffix_arrays(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The suffixes of each text in order, text by text."""
    n = len(text)
    group, before = lyndon_groups(text, start, end)
    out = np.full(n, -1, np.int64)
    free = np.arange(n)  # the next free place of the group that begins here
    placed = np.zeros(n, bool)
    out[start] = end - 1
    placed[end - 1] = True
    turn, live = 0, np.arange(len(start))
    while len(live):
        j = out[start[live] + turn] - 1
        floor = start[live]
        while len(j):
            ok = j >= floor
            ok[ok] = ~placed[j[ok]]
            j, floor = j[ok], floor[ok]
            if not len(j):
                break
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = before[j]
        turn += 1
        live = live[start[live] + turn < end[live]]
    return out
