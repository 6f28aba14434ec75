"""Suffix arrays by linear grouping, for many strings at a time.

Phase 1 sorts the suffixes of a string into groups by their Lyndon prefixes. Groups are processed in descending order.
For every suffix of the group the nearest earlier suffix of a lower group is found through previous-smaller pointers;
such a suffix's prefix grows by as many copies of the group's prefix as point at it, and it moves to a higher place in
its own group. Phase 2 emits the order: groups are ascending, and inside a group suffixes follow the order of the
suffixes right after their Lyndon prefixes, which are smaller and so are emitted before. Nothing is renamed and there
is no recursion.

Both phases take one step of every string at once with numpy, so the interpreter's share of the time falls with the
number of strings.
"""

from __future__ import annotations

import numpy as np


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + sizes[i] - 1, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def group_suffixes(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: the group of each suffix (the place of its first) and the length of its Lyndon prefix.

    String i is text[bounds[i] : bounds[i + 1]]; symbols are below 2 ** 16.
    """
    n = len(text)
    base, sizes = bounds[:-1], np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    code = (owner.astype(np.int64) << 16) | text.astype(np.int64)
    order = np.argsort(code, kind="stable").astype(np.int32)
    ranked = code[order]
    opens = np.ones(n, dtype=bool)
    opens[1:] = ranked[1:] != ranked[:-1]
    heads = np.nonzero(opens)[0]
    size_at = np.zeros(n, dtype=np.int32)
    size_at[heads] = np.diff(np.append(heads, n))
    group = np.empty(n, dtype=np.int32)
    group[order] = np.repeat(heads, size_at[heads])
    place = np.empty(n, dtype=np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    length = np.ones(n, dtype=np.int32)
    before = np.full(n, -1, dtype=np.int32)
    moved = np.zeros(n, dtype=bool)

    top, low = bounds[1:].astype(np.int64).copy(), base.astype(np.int64)
    live = np.nonzero(top > low)[0]
    while len(live):
        end = top[live]
        start = group[order[end - 1]].astype(np.int64)
        count = end - start
        members = order[ranges(start, count)]
        floor, head = np.repeat(low[live], count), np.repeat(start, count)
        copies_of = np.repeat(length[order[end - 1]], count)
        # Previous suffix in a lower group: skip what is higher, then what is in this group.
        at = members.astype(np.int64) - 1
        todo = np.nonzero((at >= floor) & (group[at] > head))[0]
        while len(todo):
            at[todo] = before[at[todo]]
            todo = todo[(at[todo] >= floor[todo]) & (group[at[todo]] > head[todo])]
        before[members] = at
        todo = np.nonzero((at >= floor) & (group[at] == head))[0]
        while len(todo):
            at[todo] = before[at[todo]]
            before[members[todo]] = at[todo]
            todo = todo[(at[todo] >= floor[todo]) & (group[at[todo]] >= head[todo])]
        top[live] = start
        live = live[start > low[live]]
        inside = at >= floor
        if not inside.any():
            continue
        # The suffixes pointed at, and by how many.
        ps = at[inside]
        by = np.argsort(ps, kind="stable")
        ps, grown = ps[by], copies_of[inside][by]
        first = np.nonzero(np.append(True, ps[1:] != ps[:-1]))[0]
        times = np.diff(np.append(first, len(ps)))
        ps = ps[first]
        length[ps] += times * grown[first]
        old = group[ps].astype(np.int64)
        by = np.lexsort((times, old))
        ps, times, old = ps[by], times[by], old[by]
        first = np.nonzero(np.append(True, old[1:] != old[:-1]))[0]
        each = np.diff(np.append(first, len(old)))
        heads = old[first]
        tails = heads + size_at[heads] - each
        slots = ranges(tails, each)
        # Elements that leave the tail take the places that open up before it.
        moved[ps] = True
        there = order[slots]
        leaving = there[~moved[there]]
        spots = place[ps]
        opened = spots[spots < np.repeat(tails, each)]
        order[opened], place[leaving] = leaving, opened
        order[slots], place[ps] = ps, slots
        moved[ps] = False
        fresh = np.nonzero(np.append(True, (old[1:] != old[:-1]) | (times[1:] != times[:-1])))[0]
        width = np.diff(np.append(fresh, len(old)))
        size_at[heads] -= each
        size_at[slots[fresh]] = width
        group[ps] = np.repeat(slots[fresh], width)
    return group, length


def suffix_arrays(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix arrays of all strings, one after another, as positions in ``text``."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int32)
    group, length = group_suffixes(text, bounds)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    follows = np.arange(n) + length
    ends = follows == bounds[1:][owner]
    # Who stands right before a suffix: those whose Lyndon prefix ends there.
    key = np.where(ends, n + owner, follows)
    by = np.argsort(key, kind="stable").astype(np.int32)
    counts = np.bincount(key, minlength=n + len(bounds) - 1)
    opens = np.append(0, np.cumsum(counts))
    out = np.full(n, -1, dtype=np.int32)
    free = np.arange(n, dtype=np.int32)

    def emit(keys: np.ndarray) -> None:
        js = by[ranges(opens[keys], counts[keys])]
        if len(js):
            g = group[js]
            slots = free[g]
            out[slots] = js
            free[g] = slots + 1

    strings = np.nonzero(np.diff(bounds) > 0)[0]
    emit(n + strings)
    at, last = bounds[:-1][strings].astype(np.int64), bounds[1:][strings]
    while len(at):
        emit(out[at])
        at = at + 1
        on = at < last
        if not on.all():
            at, last = at[on], last[on]
    return out
