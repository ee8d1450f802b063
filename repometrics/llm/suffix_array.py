"""Linear suffix sorting by grouping.

A suffix belongs to the group of its Lyndon prefix: what lies before the next
smaller suffix.  Groups begin as first symbols.  They are taken in descending
order; each member points back to the nearest suffix of a lower group (its
previous smaller one), whose prefix then grows by the group's prefix, once
for each member that points there.  Suffixes that grew equally much leave
their group together and form one right above it.  When all groups are final, one
pass over the array in ascending order puts the suffixes in place: each
known suffix places the one before it and those its pointers lead to.
Ranks are never renamed and nothing is sorted recursively.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` (non-negative integers) in ascending order."""
    text = [*symbols, -1]
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, last = [0] * n, [0] * n, [0] * n
    first = 0
    for k, i in enumerate(order):
        if text[i] != text[order[first]]:
            first = k
        place[i], group[i], last[first] = k, first, k

    back = [-1] * n
    top = n - 1
    while top >= 0:
        own = group[order[top]]
        grown: dict[int, int] = {}
        for i in sorted(order[own : top + 1]):
            j = i - 1
            while j >= 0 and group[j] >= own:
                j = back[j]
            back[i] = j
            if j >= 0:
                grown[j] = grown.get(j, 0) + 1
        if len(grown) == 1:
            ranked = [(1, *grown)]
        else:
            ranked = sorted(((times, j) for j, times in grown.items()), reverse=True)
        # the most grown ones go to the upper end of their group
        opened: dict[tuple[int, int], int] = {}
        rooms: dict[int, int] = {}
        moved = []
        for times, j in ranked:
            old = group[j]
            room = rooms.get(old)
            if room is None:
                room = last[old]
            other, hole = order[room], place[j]
            order[hole], order[room] = other, j
            place[other], place[j] = hole, room
            opened[old, times] = room
            rooms[old] = room - 1
            moved.append((j, old, times))
        if moved:
            ends: dict[int, int] = {}
            for (old, _), low in sorted(opened.items(), key=lambda x: -x[1]):
                last[low] = ends.get(old, last[old])
                ends[old] = low - 1
            for old, end in ends.items():
                if end >= old:
                    last[old] = end
            for j, old, times in moved:
                group[j] = opened[old, times]
        top = own - 1

    free = list(range(n))
    placed = bytearray(n)
    order = [-1] * n
    order[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            own = group[j]
            order[free[own]] = j
            free[own] += 1
            placed[j] = 1
            j = back[j]
    return order[1:]
