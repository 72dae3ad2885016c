"""Suffix arrays of many texts at once by linear grouping.

The suffixes of a text are first put into groups of one Lyndon prefix (the longest
Lyndon word that a suffix begins with), groups in order, then every group is put in
order.  Nothing is renamed and nothing recurses:

1. Groups start as the suffixes of one first symbol and are taken from the highest down.
   Each suffix of the group in hand gets its pointer: the nearest suffix before it in a
   lower group.  A suffix that several pointers of the group name carries the group's
   prefix so many times behind its own; it moves, with those of its group that do so as
   often, into a new group just above its old one.
2. From the least suffix up, the suffix one place before each, and those its pointers
   lead to, are put at the front of what is left of their groups, until one is in place.

Both take steps in proportion to the length of a text.  A step is made for all texts
together, as array operations over those that are not done, so that thousands of short
texts cost little more than one.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class _Groups:
    """Suffixes in their groups: a group is named by the first of its slots."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray):
        n = len(symbols)
        self.n, self.low, self.end = n, bounds[:-1], bounds[1:]
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        ranked = owner * (int(symbols.max()) + 1) + symbols
        self.suffix = np.argsort(ranked, kind="stable").astype(np.int32)
        ranked = ranked[self.suffix]
        heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        sizes = np.diff(np.append(heads, n))
        # one place more than there are suffixes: below all, and before the first of a text
        self.size = np.zeros(n + 1, np.int32)
        self.size[heads] = sizes
        self.group = np.full(n + 1, -1, np.int32)
        self.group[self.suffix] = np.repeat(heads, sizes)
        self.slot = np.empty(n, np.int32)
        self.slot[self.suffix] = np.arange(n, dtype=np.int32)
        self.pointer = np.full(n + 1, n, np.int32)
        self.before = np.arange(-1, n, dtype=np.int32)
        self.before[self.low] = n
        self.named = np.zeros(n + 1, bool)

    def point(self, members: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Pointers of the members of groups: own is the group of each."""
        at = self.before[members]
        todo = np.flatnonzero(self.group[at] > own)
        while len(todo):  # through groups that are done
            at[todo] = self.pointer[at[todo]]
            todo = todo[self.group[at[todo]] > own[todo]]
        self.pointer[members] = at
        todo = np.flatnonzero(self.group[at] == own)
        while len(todo):  # through the group itself, twice as far each time
            at[todo] = self.pointer[at[todo]]
            self.pointer[members[todo]] = at[todo]
            todo = todo[self.group[at[todo]] == own[todo]]
        return at

    def raise_(self, pointed: np.ndarray) -> None:
        """Move suffixes that pointers name to new groups, by how many name them."""
        at, times = np.unique(pointed, return_counts=True)
        old = self.group[at]
        order = np.lexsort((times, old))
        at, times, old = at[order], times[order], old[order]
        fresh = np.concatenate([[True], old[1:] != old[:-1]])
        heads = np.flatnonzero(fresh)
        moved = np.diff(np.append(heads, len(at)))
        groups = old[heads]
        floor = groups + self.size[groups] - moved  # the slots of the moved ones of each group end where it ends
        slots = _ranges(floor, moved)
        self.named[at] = True
        there = self.suffix[slots]
        there = there[~self.named[there]]
        left = self.slot[at]
        left = left[left < np.repeat(floor, moved)]
        self.suffix[left], self.slot[there] = there, left
        self.suffix[slots], self.slot[at] = at, slots
        self.named[at] = False
        self.size[groups] -= moved.astype(np.int32)
        fresh[1:] |= times[1:] != times[:-1]
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, len(at)))
        self.group[at] = np.repeat(slots[heads], sizes)
        self.size[slots[heads]] = sizes

    def run(self) -> None:
        top, active = self.end.copy(), np.flatnonzero(self.end - self.low > 1)
        while len(active):
            own = self.group[self.suffix[top[active] - 1]].astype(np.int64)
            sizes = top[active] - own
            at = self.point(self.suffix[_ranges(own, sizes)], np.repeat(own, sizes))
            at = at[at < self.n]
            if len(at):
                self.raise_(at)
            top[active] = own
            active = active[own > self.low[active] + 1]

    def ordered(self) -> np.ndarray:
        out = np.empty(self.n, np.int32)
        front = np.arange(self.n + 1, dtype=np.int32)
        done = np.zeros(self.n + 1, bool)
        last = self.end - 1  # the least suffix of each text is its last symbol
        out[self.low], done[last], done[self.n] = last, True, True
        place, now = self.low.copy(), self.before[last].astype(np.int64)
        active = np.arange(len(place))
        while len(active):
            at = now[active]
            free = ~done[at]
            put = at[free]
            if len(put):
                groups = self.group[put]
                out[front[groups]] = put
                front[groups] += 1
                done[put] = True
                now[active[free]] = self.pointer[put]
            if len(put) < len(active):
                on = active[~free]
                place[on] += 1
                on = on[place[on] < self.end[on]]
                now[on] = self.before[out[place[on]]]
                active = np.concatenate([active[free], on]) if len(put) else on
        return out


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffixes of every text in order, one text after the other.

    symbols: whole numbers from 0; text i is symbols[bounds[i]:bounds[i + 1]] and must
    end with its only 0.  Suffixes are named by their place in ``symbols``.
    """
    if not len(symbols):
        return np.zeros(0, np.int32)
    groups = _Groups(symbols.astype(np.int64), np.asarray(bounds, np.int64))
    groups.run()
    return groups.ordered()
