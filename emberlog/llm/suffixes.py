"""Linear suffix sorting by grouping (after Baier, 2016)."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a list of integers from 0 on whose last one is smaller than all others.

    Groups of suffixes are visited in descending order. A visited group's suffixes find the last place before them that stands in a lower
    group, along pointers that were set before; the places found move behind the rest of their groups, those found most often first, so
    that in the end a group holds the suffixes with one Lyndon prefix. Then the places are given out in ascending order: a suffix brings
    the one before it, and that one's pointers, to the front of their groups.
    """
    n = len(text)
    if n < 2:
        return list(range(n))
    counts = [0] * (max(text) + 1)
    for c in text:
        counts[c] += 1
    total, first = 0, []
    for c in counts:
        first.append(total)
        total += c
    size = [0] * n  # by a group's first place
    order, place, group, fill = [0] * n, [0] * n, [0] * n, first[:]
    for i, c in enumerate(text):
        p = fill[c]
        fill[c] = p + 1
        order[p], place[i], group[i] = i, p, first[c]
        size[first[c]] += 1
    lower = [-1] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        members = order[start:end]
        if len(members) > 1:
            members.sort()
        found: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = lower[j]
            lower[i] = j
            if j >= 0:
                found[j] = found.get(j, 0) + 1
        if len(found) == len(members) or max(found.values(), default=1) == 1:
            batches = [list(found)] if found else []
        else:
            by_count: dict[int, list[int]] = {}
            for j, k in found.items():
                by_count.setdefault(k, []).append(j)
            batches = [by_count[k] for k in sorted(by_count, reverse=True)]
        for batch in batches:
            for j in batch:
                g = group[j]
                size[g] -= 1
                last, p = g + size[g], place[j]
                other = order[last]
                order[p], order[last] = other, j
                place[other], place[j] = p, last
            fresh = [(j, group[j] + size[group[j]]) for j in batch]
            for j, g in fresh:
                group[j] = g
                size[g] += 1
        end = start
    out, front, placed = [-1] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    front[group[n - 1]] += 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = 1
            j = lower[j]
    return out
