"""Suffix array by grouping: linear time, no recursion, no renaming.

First phase. Suffixes lie in groups, ordered, by a prefix they share: at first
their first symbol, in the end their longest Lyndon prefix. Groups are taken from
the highest down. For each member the previous smaller suffix is looked up, the
last one before it in a lower group; as all higher groups are done, that is the
nearest position to the left that isn't done, which a disjoint-set forest keeps.
Such a parent's prefix grows by the group's prefix, once for each of its members
there: parents go to new groups right above their old ones, those with more
members higher.

Second phase. Groups now have fixed places. Suffixes are read in order, from the
empty one: the position before it, then that one's previous smaller suffix and so
on, are exactly the suffixes whose next smaller suffix it is; each takes the next
place in its group, until one is met that has its place.
"""

from __future__ import annotations


def suffix_array(symbols) -> list[int]:
    """Starts of the suffixes of a sequence of whole numbers, in order."""
    n = len(symbols)
    first: dict[int, list[int]] = {}
    for i, c in enumerate(symbols):
        first.setdefault(c, []).append(i)
    members: list[list[int]] = []
    below: list[int] = []  # a linked list of groups, each with the next lower one and the next higher one
    above: list[int] = []
    group = [0] * n
    for g, c in enumerate(sorted(first)):
        members.append(first[c])
        below.append(g - 1)
        above.append(g + 1)
        for i in first[c]:
            group[i] = g
    if above:
        above[-1] = -1
    left = list(range(n + 1))  # left[i + 1]: i + 1 while position i isn't done, else a way to the nearest such to its left
    parent = [-1] * n
    size = [len(m) for m in members]

    g = len(members) - 1
    while g >= 0:
        if size[g] == 1:
            i = next(i for i in members[g] if group[i] == g)
            members[g] = [i]
            left[i + 1] = x = i
            while left[x] != x:
                left[x] = x = left[left[x]]
            if x:
                p = x - 1
                parent[i] = p
                old = group[p]
                if size[old] > 1:  # a group of its own it has already
                    group[p] = new = len(members)
                    members.append([p])
                    size.append(1)
                    size[old] -= 1
                    high = above[old]
                    below.append(old)
                    above.append(high)
                    above[old] = new
                    if high >= 0:
                        below[high] = new
            g = below[g]
            continue
        listed = members[g]
        if len(listed) != size[g]:
            members[g] = listed = [i for i in listed if group[i] == g]
        for i in listed:
            left[i + 1] = i
        parents: list[int] = []
        for i in listed:
            x = i
            while left[x] != x:
                left[x] = x = left[left[x]]
            if x:
                parent[i] = x - 1
                parents.append(x - 1)
        if not parents:
            g = below[g]
            continue
        once = set(parents)
        olds = {group[p] for p in once}
        if len(once) == len(parents) and len(olds) == 1:  # one new group at most: the usual case
            moved = [((1, olds.pop()), parents)]
        else:
            times: dict[int, int] = {}
            for p in parents:
                times[p] = times.get(p, 0) + 1
            dealt: dict[tuple[int, int], list[int]] = {}
            for p, k in times.items():
                dealt.setdefault((k, group[p]), []).append(p)
            moved = sorted(dealt.items(), reverse=True)
        for (_, old), those in moved:
            if len(those) == size[old]:  # all of it: it may stay as it is
                continue
            new = len(members)
            members.append(those)
            size.append(len(those))
            size[old] -= len(those)
            for p in those:
                group[p] = new
            high = above[old]
            below.append(old)
            above.append(high)
            above[old] = new
            if high >= 0:
                below[high] = new
        g = below[g]

    free = [0] * len(members)
    at, g = 0, 0 if n else -1
    while g >= 0:
        free[g] = at
        at += size[g]
        g = above[g]
    out = [-1] * n
    placed = bytearray(n)
    j = n - 1
    i = -1
    while True:
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = parent[j]
        i += 1
        if i >= n:
            return out
        j = out[i] - 1
