"""Suffix order of an integer sequence by grouping, linear in its length.

Suffixes are first put into groups by their first symbol.  From the largest group
down, every member i looks up the nearest suffix before it that lies in a smaller
group (following the pointers that larger members already have); those suffixes
get a longer Lyndon prefix and move, by how many members point at them, into a
new group right behind their old one.  In the end each group shares its longest Lyndon
prefix and groups are in order, so a second pass can emit the order inside each group: it walks
the order found so far, and from each suffix's predecessor along the pointers
puts the next suffix to the front of its group.  Nothing is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in ascending order; the last symbol must be the only smallest one."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    values, counts = np.unique(symbols, return_counts=True)
    starts = np.cumsum(counts) - counts
    first = starts[np.searchsorted(values, symbols)]
    slots_np = np.argsort(symbols, kind="stable")
    place_np = np.empty(n, np.int64)
    place_np[slots_np] = np.arange(n)
    slots, place, group = slots_np.tolist(), place_np.tolist(), first.tolist()  # who stands where, and the start of everyone's group
    size = [0] * (n + 1)
    for s, c in zip(starts.tolist(), counts.tolist()):
        size[s] = c
    before = [-1] * n

    def move(these: list[int], old: int) -> None:
        end = old + size[old]
        for j in these:
            end -= 1
            other, at = slots[end], place[j]
            slots[end], slots[at] = j, other
            place[j], place[other] = end, at
        size[old] -= len(these)
        size[end] = len(these)
        for j in these:
            group[j] = end

    high = n
    while high > 0:
        low = group[slots[high - 1]]
        if high - low == 1:
            i = slots[low]
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                old = group[j]
                end = old + size[old] - 1  # one suffix moves behind its group
                if end > old:
                    other, at = slots[end], place[j]
                    slots[end], slots[at] = j, other
                    place[j], place[other] = end, at
                    size[old] -= 1
                    size[end] = 1
                    group[j] = end
        else:
            pointed: dict[int, int] = {}
            for i in sorted(slots[low:high]):
                j = i - 1
                while j >= 0 and group[j] >= low:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            levels: dict[int, dict[int, list[int]]] = {}
            for j, times in pointed.items():
                levels.setdefault(times, {}).setdefault(group[j], []).append(j)
            for times in sorted(levels, reverse=True):
                for old, these in levels[times].items():
                    move(these, old)
        high = low

    order, front, done = [-1] * n, list(range(n)), bytearray(n)
    order[0] = n - 1
    done[n - 1] = 1
    for at in range(n):
        j = order[at] - 1
        while j >= 0 and not done[j]:
            s = group[j]
            order[front[s]] = j
            front[s] += 1
            done[j] = 1
            j = before[j]
    return np.array(order, np.int64)
