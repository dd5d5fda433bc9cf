"""Suffix arrays by linear grouping (no recursion, no renaming).

First suffixes are grouped by their Lyndon prefixes.  Groups are taken in descending order;
each suffix of the group points to the previous suffix of a smaller group.  A suffix so
pointed to k times continues with the group's prefix k times, so it is greater than the rest
of its own group and the more so the greater k: it moves into a group of its own behind it.
Then suffixes are read off in ascending order: each settles the next free place in the
groups of those that point past it.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of the suffixes of ``text`` in ascending order; a suffix is less than those it begins."""
    n = len(text)
    if n == 0:
        return []
    order = sorted(range(n), key=text.__getitem__)  # equal symbols stay in text order
    group = [0] * n  # by suffix: where its group begins
    place = [0] * n  # by suffix: where it is in ``order``
    size: dict[int, int] = {}
    start = 0
    for at, s in enumerate(order):
        if text[s] != text[order[start]]:
            start = at
        group[s], place[s] = start, at
        size[start] = at - start + 1
    previous = [-1] * n
    end = n
    while end > 0:  # the group that ends here
        start = group[order[end - 1]]
        members = sorted(order[start:end])
        times: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        by_times: dict[int, list[int]] = {}
        for p, k in times.items():
            by_times.setdefault(k, []).append(p)
        for k in sorted(by_times, reverse=True):
            shrunk: dict[int, int] = {}  # by group: how many move out
            for p in by_times[k]:
                own = group[p]
                to = own + size[own] - 1
                other = order[to]
                order[place[p]], place[other] = other, place[p]
                order[to], place[p] = p, to
                size[own] -= 1
                shrunk[own] = shrunk.get(own, 0) + 1
            for own, moved in shrunk.items():
                begin = own + size[own]
                size[begin] = moved
                for at in range(begin, begin + moved):
                    group[order[at]] = begin
        end = start
    sorted_starts = [-1] * n
    free = list(range(n))  # by group begin: its next free place
    settled = [False] * n

    def settle(s: int) -> None:
        while s >= 0 and not settled[s]:
            sorted_starts[free[group[s]]] = s
            free[group[s]] += 1
            settled[s] = True
            s = previous[s]

    settle(n - 1)
    for at in range(n):
        settle(sorted_starts[at] - 1)
    return sorted_starts


def common_prefixes(text: Sequence[int], order: list[int]) -> list[int]:
    """For each place but the first: how many symbols its suffix has in common with the one before."""
    n = len(order)
    rank = [0] * n
    for at, s in enumerate(order):
        rank[s] = at
    out, k = [0] * n, 0
    for s in range(n):
        if rank[s] == 0:
            k = 0
            continue
        other = order[rank[s] - 1]
        while s + k < n and other + k < n and text[s + k] == text[other + k]:
            k += 1
        out[rank[s]] = k
        k = max(0, k - 1)
    return out
