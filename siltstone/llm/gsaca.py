"""Suffix arrays by linear grouping (no recursion, no renaming, no comparison sort).

First phase: suffixes are grouped by first symbol (counting sort) and the groups
processed from the highest down. For each suffix of a group, the previous suffix
of a lower group is found over the pointers of suffixes that are done (previous
smaller suffixes; pointers inside the group are shortened as they are passed).
Suffixes that are pointed to move up inside their group, further for each
further pointer. What remains are the groups of equal Lyndon prefixes, in order.
Second phase: from the smallest suffix on, each suffix puts those that end in
front of it (the pointer chain) at the next free place of their groups.
"""

from __future__ import annotations


def _by_symbol(text: list[int]) -> list[int]:
    """Positions by symbol; equal symbols stay in order."""
    places: list[list[int]] = [[] for _ in range(max(text, default=-1) + 1)]
    for i, symbol in enumerate(text):
        places[symbol].append(i)
    return [i for found in places for i in found]


def suffix_array(text: list[int]) -> list[int]:
    """Positions of all suffixes of ``text`` (small whole numbers) in order; a suffix that is a prefix of another comes first."""
    n = len(text)
    sa = _by_symbol(text)
    group, size, place = [0] * n, [0] * n, [0] * n  # group: start of the suffix's group in sa
    start = 0
    for i, s in enumerate(sa):
        if text[s] != text[sa[start]]:
            start = i
        group[s], place[s] = start, i
        size[start] += 1

    prev, hits = [-1] * n, [0] * n
    end = n
    while end > 0:
        start = group[sa[end - 1]]
        members = sa[start:end]
        for s in members:
            p = s - 1
            while p >= 0 and group[p] > start:
                p = prev[p]
            prev[s] = p
        pointed: list[int] = []
        for s in members:
            p = prev[s]
            if p >= 0 and group[p] == start:  # stopped inside the group: go on along its members
                path = [s]
                while p >= 0 and group[p] == start:
                    path.append(p)
                    p = prev[p]
                for q in path:
                    prev[q] = p
            if p >= 0:
                if not hits[p]:
                    pointed.append(p)
                hits[p] += 1
        levels: list[list[int]] = [[] for _ in range(max((hits[p] for p in pointed), default=0) + 1)]
        for p in pointed:
            levels[hits[p]].append(p)
            hits[p] = 0
        tops: dict[int, int] = {}
        for level in reversed(levels):
            lasts: dict[int, int] = {}
            for p in level:
                g = group[p]
                top = tops.get(g, g + size[g])
                lasts.setdefault(g, top)
                top -= 1
                other, at = sa[top], place[p]
                sa[at], sa[top] = other, p
                place[other], place[p] = at, top
                tops[g] = top
            for g, last in lasts.items():
                top = tops[g]
                for j in range(top, last):
                    group[sa[j]] = top
                if top > g:
                    size[top] = last - top
                else:  # the whole group has moved
                    tops[g], size[g] = g, last - g
        for g, top in tops.items():
            if top > g:
                size[g] = top - g
        end = start

    out, free = [0] * n, list(range(n))
    s = n - 1
    while s >= 0:  # those that end at the end of the text
        g = group[s]
        out[free[g]] = s
        free[g] += 1
        s = prev[s]
    for i in range(n):
        j = out[i]
        s, stop = j - 1, prev[j]
        while s != stop:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            s = prev[s]
    return out
