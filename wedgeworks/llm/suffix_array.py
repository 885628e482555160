"""A suffix array in linear steps, by grouping suffixes by their Lyndon prefixes."""

from __future__ import annotations

from collections import defaultdict


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in lexicographic order, a prefix before what extends it.

    Phase one keeps groups of suffixes in order, first by their first symbol, and takes them from the
    largest down. Of every member the nearest smaller-grouped position to the left is found (a
    previous-smaller pointer); positions so met extend their Lyndon prefix by the group's, and move into
    new groups right behind their old ones, apart by how many members point at them. In the end a group
    holds the suffixes of one Lyndon prefix. Phase two emits the order: taking suffixes from the
    smallest, what ends its Lyndon prefix at the suffix just taken comes next in its own group.
    """
    n = len(text)
    if not n:
        return []
    members: list[list[int]] = []
    group = [0] * n
    by_symbol = defaultdict(list)
    for i, c in enumerate(text):
        by_symbol[c].append(i)
    for g, c in enumerate(sorted(by_symbol)):
        members.append(by_symbol[c])
        for i in by_symbol[c]:
            group[i] = g
    follows = [*range(1, len(members)), -1]  # a linked list of groups in order
    precedes = [*range(-1, len(members) - 1)]
    pointer = [-1] * n
    left = [i - 1 for i in range(n)]  # leads over positions already taken
    taken = bytearray(n + 1)  # the last entry stands for position -1 and stays 0
    now = len(members) - 1
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        for i in own:
            taken[i] = 1
        met: dict[int, int] = {}
        for i in own:
            p = left[i]
            if taken[p]:
                path = [i]
                while taken[p]:
                    path.append(p)
                    p = left[p]
                for q in path:
                    left[q] = p
            pointer[i] = p
            if p >= 0:
                met[p] = met.get(p, 0) + 1
        members[now] = own
        if met:
            # Distinct counts are few: k of them need k * k / 2 members of the group.
            by_count = defaultdict(list)
            for p, times in met.items():
                by_count[times].append(p)
            for count in sorted(by_count, reverse=True):
                fresh: dict[int, int] = {}
                for p in by_count[count]:
                    old = group[p]
                    new = fresh.get(old)
                    if new is None:
                        new = fresh[old] = len(members)
                        members.append([])
                        after = follows[old]
                        follows.append(after)
                        precedes.append(old)
                        follows[old] = new
                        precedes[after] = new  # there is always one: the group just taken
                    members[new].append(p)
                    group[p] = new
        now = precedes[now]
    first = 0
    while precedes[first] >= 0:
        first = precedes[first]
    head, at = [0] * len(members), 0
    while first >= 0:
        head[first] = at
        at += len(members[first])
        first = follows[first]
    order = [-1] * n
    placed = bytearray(n + 1)
    placed[n] = 1  # position -1
    for k in range(-1, n):
        j = (order[k] if k >= 0 else n) - 1
        while not placed[j]:
            g = group[j]
            order[head[g]] = j
            head[g] += 1
            placed[j] = 1
            j = pointer[j]
    return order
