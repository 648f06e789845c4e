"""Hash-compared suffix sort of anchored texts (used by operator 2).

``Block`` holds many short byte strings, each with an anchor: up to ``REACH``
bytes to its left and up to ``LENGTH`` bytes from it on.  Within each group the
suffixes that begin at the anchors are sorted by a bottom-up merge sort.  Two
suffixes are compared in logarithmic time: a binary search over their prefix
polynomial hashes finds the common extension, and the next byte decides.  All
merges of a level run side by side on numpy arrays.  Neighbours are then compared
byte by byte over their common extension, so a hash collision cannot pass.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Base and byte values of the polynomial hashes (drawn once; any odd base does).
BASE = U(0x9E3779B97F4A7C15)
LETTERS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def powers(n: int, base=BASE) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64))), dtype=np.uint64)[:n]


class Block:
    def __init__(self, group: np.ndarray, left: np.ndarray, right: np.ndarray, left_size: np.ndarray,
                 right_size: np.ndarray):
        """``group``: ascending group numbers; ``left`` (n, REACH), its last column beside the anchor; ``right``: (n, LENGTH)."""
        self.group, self.left, self.right = group, left, right
        self.left_size, self.right_size = left_size, right_size
        p = powers(right.shape[1])
        self.hashes = np.zeros((len(group), right.shape[1] + 1), np.uint64)
        np.cumsum(LETTERS[right] * p, axis=1, out=self.hashes[:, 1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, by binary search over prefix hashes."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.right_size[a], self.right_size[b])
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.hashes[a, mid] == self.hashes[b, mid]
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def below(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before suffix b."""
        size = self.common(a, b)
        ends = (size >= self.right_size[a]) | (size >= self.right_size[b])
        at = np.minimum(size, self.right.shape[1] - 1)
        return np.where(ends, self.right_size[a] < self.right_size[b], self.right[a, at] < self.right[b, at])

    def order(self) -> np.ndarray:
        """Indices of the suffixes, group by group in sorted order (stable merge sort)."""
        n = len(self.group)
        order = np.arange(n)
        starts = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]]) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, n])
        first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        width = 1
        while n and width < sizes.max():
            at = np.flatnonzero(size > width)             # places in groups that are not yet one run
            local = at - first[at]
            block = local // (2 * width) * (2 * width)
            middle, end = block + width, np.minimum(block + 2 * width, size[at])
            is_left = local < middle
            low = np.where(is_left, np.minimum(middle, end), block)
            high = np.where(is_left, end, np.minimum(middle, end))
            base = low.copy()
            me = order[at]
            todo = np.flatnonzero(low < high)
            while len(todo):
                mid = (low[todo] + high[todo]) >> 1
                other = order[first[at[todo]] + mid]
                mine = me[todo]
                left = is_left[todo]
                # a left element passes what is below it, a right element what is not above it
                less = self.below(np.where(left, other, mine), np.where(left, mine, other))
                ahead = np.where(left, less, ~less)
                low[todo] = np.where(ahead, mid + 1, low[todo])
                high[todo] = np.where(ahead, high[todo], mid)
                todo = todo[low[todo] < high[todo]]
            own = local - np.where(is_left, block, middle)
            place = first[at] + block + own + (low - base)
            order[place] = me
            width *= 2
        return order

    def shared(self, order: np.ndarray) -> np.ndarray:
        """Verified common extension of each suffix with its predecessor in ``order`` (-1 at a group's start)."""
        out = np.full(len(order), -1, np.int64)
        at = np.flatnonzero(np.r_[False, self.group[order][1:] == self.group[order][:-1]]) if len(order) else order
        if len(at):
            a, b = order[at - 1], order[at]
            out[at] = self.common(a, b)
            inside = np.arange(self.right.shape[1]) < out[at][:, None]
            if ((self.right[a] != self.right[b]) & inside).any():
                raise ArithmeticError("hash collision")
        return out

    def repeats(self, low: np.ndarray, high: np.ndarray, age: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest offset at which each element repeats an older one (or 1 and 0).

        At offset o an element stands for the string of the o bytes before the anchor and the
        ``LENGTH - o`` bytes from it on; it has offsets ``low`` to ``high``; ``age`` orders the elements.
        """
        length, reach = self.right.shape[1], self.left.shape[1]
        order = self.order()
        shared = self.shared(order)
        least, most = np.ones(len(order), np.int64), np.zeros(len(order), np.int64)
        lefts = np.zeros(len(order), np.uint64)
        for o in range(0, int(high.max(initial=-1)) + 1):
            if o:
                lefts = lefts * BASE + LETTERS[self.left[:, reach - o]]
            run = np.cumsum(shared < length - o)              # equal right parts are side by side
            own = np.flatnonzero(((low <= o) & (o <= high))[order])
            if len(own) < 2:
                continue
            item, run = order[own], run[own]
            by = np.lexsort((age[item], lefts[item], run))
            item, run = item[by], run[by]
            head = np.r_[True, (run[1:] != run[:-1]) | (lefts[item[1:]] != lefts[item[:-1]])]
            eldest = item[np.maximum.accumulate(np.where(head, np.arange(len(item)), 0))]
            again, eldest = item[~head], eldest[~head]
            if o and len(again) and (self.left[again, reach - o:] != self.left[eldest, reach - o:]).any():
                raise ArithmeticError("hash collision")
            again = again[age[again] > age[eldest]]
            fresh = most[again] < least[again]
            least[again[fresh]] = o
            most[again] = o
        return least, most
