"""Linear suffix sorting by grouping Lyndon prefixes (Baier's scheme), for the texts of one task.

Phase 1 starts from groups of equal first symbols and takes the groups in descending order. With prev(s), the nearest
suffix before s in a lower group, every suffix p that is prev of k members moves up behind its group: its Lyndon prefix
grows by k copies of the group's. Phase 2 emits suffixes in order: suffix s fixes those whose Lyndon prefix ends at s,
which are s-1 and its prev pointers as long as they end there. No renaming and no recursion. First symbols and the members of a
group by k are put in order by Python's sort, so a bound of n log n holds where one group has many different k.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Order of all suffixes of `symbols`, whose last symbol must be smaller than all others."""
    n = len(symbols)
    starts: dict[int, int] = {}
    counts: dict[int, int] = {}
    for c in symbols:
        counts[c] = counts.get(c, 0) + 1
    at = 0
    size = [1] * n  # by group start: length of the Lyndon prefix
    end = [0] * n  # by group start
    for c in sorted(counts):
        starts[c] = at
        at += counts[c]
        end[starts[c]] = at
    group = [starts[c] for c in symbols]
    order, place = [0] * n, [0] * n
    free = dict(starts)
    for s, c in enumerate(symbols):
        order[free[c]] = s
        place[s] = free[c]
        free[c] += 1

    prev, length = [-1] * n, [1] * n
    e = n
    while e > 0:
        g = group[order[e - 1]]
        u = size[g]
        if e - g == 1:
            s = order[g]
            length[s] = u
            p = s - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[s] = p
            children = {p: 1} if p >= 0 else {}
        else:
            children = {}
            for s in sorted(order[g:e]):
                length[s] = u
                p = s - 1
                while p >= 0 and group[p] >= g:
                    p = prev[p]
                prev[s] = p
                if p >= 0:
                    children[p] = children.get(p, 0) + 1
        if len(children) == 1:
            rounds = [(k, [p]) for p, k in children.items()]
        else:
            by: dict[int, list[int]] = {}
            for p, k in children.items():
                by.setdefault(k, []).append(p)
            rounds = sorted(by.items(), reverse=True)
        for k, ps in rounds:
            old: dict[int, int] = {}
            for p in ps:
                h = group[p]
                if h not in old:
                    old[h] = end[h]
                b = end[h] - 1
                end[h] = b
                q, a = order[b], place[p]
                order[a], place[q] = q, a
                order[b], place[p] = p, b
            for h, was in old.items():
                new = end[h]
                end[new] = was
                size[new] = size[h] + k * u
                if new != h:
                    for i in range(new, was):
                        group[order[i]] = new
        e = g

    out, fill = [0] * n, list(range(n))
    out[0] = n - 1
    for i in range(n):
        s = out[i]
        j = s - 1
        while j >= 0 and j + length[j] == s:
            g = group[j]
            out[fill[g]] = j
            fill[g] += 1
            j = prev[j]
    return out
