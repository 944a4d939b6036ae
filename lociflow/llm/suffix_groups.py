"""Linear suffix sorting by grouping: Lyndon-prefix groups in descending order, then each group's order from the front.

Phase 1 starts with a group for each byte and takes groups from the greatest down. The previous-smaller pointer of a
suffix is the nearest one to its left that is in a smaller group; suffixes that are pointed at by more members of the
current group move further up, just above what stays of their own group. In the end a group holds the suffixes with
one longest Lyndon prefix. Phase 2 reads the order from the front: a suffix settles, in front of their groups, the ones
to its left whose next smaller suffix it is. Nothing is renamed and no recursion is needed.
"""

from __future__ import annotations

import numpy as np

__all__ = ["suffix_array", "suffix_arrays"]


def suffix_array(text: bytes) -> list[int]:
    """The suffix array of one text, in time linear in its length but for the first sort by byte."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, tail = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for k, i in enumerate(order):
        if k and text[i] != text[order[k - 1]]:
            tail[start] = k
            start = k
        place[i], group[i] = k, start
    tail[start] = n
    before = [-1] * n
    end = n
    while end:
        start = group[order[end - 1]]
        counts: dict[int, int] = {}
        for i in sorted(order[start:end]):
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        levels: dict[int, list[int]] = {}
        for p, k in counts.items():
            levels.setdefault(k, []).append(p)
        for k in sorted(levels, reverse=True):
            ends: dict[int, int] = {}
            for p in levels[k]:
                g = group[p]
                ends.setdefault(g, tail[g])
                tail[g] = t = tail[g] - 1
                at, other = place[p], order[t]
                order[at], order[t], place[other], place[p] = other, p, at, t
            for p in levels[k]:
                group[p] = tail[group[p]]
            for g, e in ends.items():
                new = tail[g]
                if new != g:
                    tail[new] = e
                else:
                    tail[g] = e
        end = start
    # Phase 2. The empty suffix is the least and comes first.
    out, front = [-1] * n, group[:]
    settled = [False] * n
    slots = list(range(n + 1))

    def settle(s: int) -> None:
        p = s - 1
        while p >= 0 and not settled[p]:
            settled[p] = True
            g = group[p]
            out[slots[g]] = p
            slots[g] += 1
            p = before[p]

    settle(n)
    del front
    for k in range(n):
        settle(out[k])
    return out


def suffix_arrays(texts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Suffix arrays of many short texts at once, each step of the algorithm taken for all of them together.

    ``texts`` holds the texts one after another, ``lengths`` their lengths. The result has each text's suffix array in
    the text's own place, as positions in ``texts``.
    """
    n = len(texts)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    first = starts[owner]
    # A group's number is its first slot, so numbers of groups of one text stand in their order.
    order = np.lexsort((texts, owner))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    sorted_texts = texts[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_texts[1:] != sorted_texts[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    group = np.empty(n, np.int64)
    group[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    tail = np.zeros(n, np.int64)  # by group: the slot after its last
    tail[heads] = np.append(heads[1:], n)
    before = np.arange(n) - 1
    live = np.flatnonzero(lengths > 0)
    end = starts[live] + lengths[live]
    while len(live):
        start = group[order[end - 1]]
        sizes = end - start
        total = int(sizes.sum())
        slots = np.arange(total) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)
        members = order[slots]
        level, low = np.repeat(start, sizes), first[members]
        # Previous-smaller pointers: done groups give theirs, members of the current one the way they have come.
        todo = np.arange(total)
        at = before[members]
        while True:
            going = (at[todo] >= low[todo]) & (group[np.maximum(at[todo], 0)] >= level[todo])
            todo = todo[going]
            if not len(todo):
                break
            at[todo] = before[at[todo]]
            before[members[todo]] = at[todo]
        at = np.where(at >= low, at, -1)
        before[members] = np.where(at >= 0, at, low - 1)
        targets, counts = np.unique(at[at >= 0], return_counts=True)
        if len(targets):
            old = group[targets]
            rank = np.lexsort((-counts, old))
            targets, counts, old = targets[rank], counts[rank], old[rank]
            edge = np.ones(len(old), bool)
            edge[1:] = old[1:] != old[:-1]
            runs = np.flatnonzero(edge)
            sizes = np.diff(np.append(runs, len(old)))
            within = np.arange(len(old)) - np.repeat(runs, sizes)
            ends = tail[old]
            # Slots from the end of the group: most pointed at, last slot.
            goal = ends - 1 - within
            # What stands in the way goes to the slots that movers leave.
            mover = place[targets]
            bottom = np.repeat(ends[runs] - sizes, sizes)
            leaving = np.sort(mover[mover < bottom])
            inside = np.zeros(0, np.int64)
            if len(leaving):
                staying = np.sort(goal)
                inside = order[staying[~np.isin(staying, mover, assume_unique=True)]]
            order[goal], place[targets] = targets, goal
            if len(leaving):
                order[leaving], place[inside] = inside, leaving
            # New group numbers: the lowest slot of each run of equal counts.
            last = np.ones(len(old), bool)
            last[:-1] = edge[1:] | (counts[1:] != counts[:-1])
            marks = np.flatnonzero(last)
            spans = np.diff(np.append(-1, marks))
            number = goal[marks]
            group[targets] = np.repeat(number, spans)
            tail[old[runs]] = ends[runs] - sizes
            tail[number] = goal[marks] + spans
        end = start
        more = end > starts[live]
        live, end = live[more], end[more]
    # Phase 2, all texts slot by slot.
    out, settled, slots = np.full(n, -1, np.int64), np.zeros(n, bool), np.arange(n)

    def settle(s: np.ndarray, low: np.ndarray) -> None:
        p = s - 1
        while len(p):
            ok = p >= low
            p, low = p[ok], low[ok]
            ok = ~settled[p]
            p, low = p[ok], low[ok]
            settled[p] = True
            g = group[p]
            out[slots[g]] = p
            slots[g] += 1
            p = before[p]

    live = np.flatnonzero(lengths > 0)
    settle((starts + lengths)[live], starts[live])
    for k in range(int(lengths.max(initial=0))):
        live = live[lengths[live] > k]
        settle(out[starts[live] + k], starts[live])
    return out
