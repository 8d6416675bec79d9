"""Suffix array by linear grouping.

Phase 1 keeps suffixes in groups, at first by their first symbol, and takes the groups from the largest down. Each
suffix of a group finds the nearest suffix to its left in a smaller group (its pointer, followed over groups
already done). Those pointed to by the group grow by it: the ones pointed to most often form new groups last in
their old ones. When the smallest group is done, every group holds the suffixes of one longest Lyndon prefix.
Phase 2 goes through the array from the smallest suffix: each one emitted puts its left neighbour, and what that
points to, next in their groups. No step names or sorts the text anew.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Starts of the sorted suffixes of ``symbols``, integers over 0; a shorter suffix precedes its extensions."""
    n = len(symbols) + 1  # the end mark, smaller than all
    text = np.concatenate([np.asarray(symbols, np.int64), [0]])
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sa = order.tolist()
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    start_of = first[np.searchsorted(ranked[first], text)]
    at, group = at.tolist(), start_of.tolist()  # place in sa; first place of the suffix's group
    size = [0] * (n + 1)
    for s, e in zip(first.tolist(), [*first[1:].tolist(), n]):
        size[s] = e - s
    point = [-1] * n

    def grow(chosen: list[int]) -> None:
        """Move suffixes, each pointed to equally often, to the ends of their groups and make those groups of their own."""
        for p in chosen:
            g = group[p]
            size[g] -= 1
            to, frm = g + size[g], at[p]
            q = sa[to]
            sa[frm], sa[to] = q, p
            at[q], at[p] = frm, to
        fresh = [(p, group[p] + size[group[p]]) for p in chosen]
        for p, s in fresh:
            group[p] = s
            size[s] = 0
        for _, s in fresh:
            size[s] += 1

    end = n
    while end > 0:
        g = group[sa[end - 1]]
        if end - g == 1:
            i = sa[g]
            p = i - 1
            while p >= 0 and group[p] > g:
                p = point[p]
            point[i] = p
            if p >= 0:
                h = group[p]
                k = size[h] - 1
                if k:  # else the group of p is p alone and stays
                    size[h] = k
                    to, frm = h + k, at[p]
                    q = sa[to]
                    sa[frm], sa[to] = q, p
                    at[q], at[p] = frm, to
                    group[p] = to
                    size[to] = 1
        else:
            times: dict[int, int] = {}
            for i in sorted(sa[g:end]):
                p = i - 1
                while p >= 0 and group[p] >= g:
                    p = point[p]
                point[i] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            if times:
                most = max(times.values())
                if most == 1:
                    grow(list(times))
                else:
                    by: dict[int, list[int]] = {}
                    for p, k in times.items():
                        by.setdefault(k, []).append(p)
                    for k in sorted(by, reverse=True):
                        grow(by[k])
        end = g

    out = [0] * n
    out[0] = n - 1
    done = bytearray(n)
    done[n - 1] = 1
    free = group  # next place of the group that starts here, kept at its first place
    nxt = list(range(n + 1))
    for r in range(n):
        p = out[r] - 1
        while p >= 0 and not done[p]:
            g = free[p]
            out[nxt[g]] = p
            nxt[g] += 1
            done[p] = 1
            p = point[p]
    return out[1:]
