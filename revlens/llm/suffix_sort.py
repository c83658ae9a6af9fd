"""Deep-shallow sorting of equally long strings given by their places in a buffer.

The shallow phase is a multikey quicksort: groups of strings equal so far are split by
their next eight bytes, up to a small depth. What is still tied shares a long prefix and
goes to the deep phase, a blind trie per group: every string is compared with the
group's first one, only the place where they part is kept, and strings that part at the
same place with the same bytes form a subtree. Subtrees go on in the same way, so no
byte that the trie has passed is looked at again. All groups move in step, as arrays.
"""

from __future__ import annotations

import numpy as np

STEP = 8
SHALLOW = 32  # bytes sorted by multikey quicksort
SLICE = 1 << 16  # strings whose bytes are held side by side


def _runs(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before it."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _words(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one big-endian number; ``buffer`` ends in eight spare bytes."""
    out = np.zeros(len(buffer) - STEP, np.uint64)
    for i in range(STEP):
        out = (out << np.uint64(8)) | buffer[i:i + len(out)].astype(np.uint64)
    return out


def deep_shallow(buffer: np.ndarray, places: np.ndarray, bucket: np.ndarray, length: int,
                 shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): places sorted by bucket and string, and whether a string equals its predecessor's.

    ``length`` is a multiple of eight; every string ends within the buffer.
    """
    padded = np.concatenate([buffer, np.zeros(STEP, np.uint8)])
    word = _words(padded)
    order = np.argsort(bucket, kind="stable")
    new = _runs(bucket[order])
    depth = 0

    def tied() -> tuple[np.ndarray, np.ndarray]:
        """Slots of groups with two strings or more, and the group of each."""
        group = np.cumsum(new)
        sizes = np.bincount(group)
        slots = np.flatnonzero(sizes[group] > 1)
        return slots, group[slots]

    slots, group = tied()
    while depth < min(shallow, length) and len(slots):
        key = word[places[order[slots]] + depth]
        rank = np.lexsort((key, group))
        order[slots] = order[slots][rank]
        new[slots] = _runs(group[rank], key[rank])
        depth += STEP
        slots, group = tied()

    steps = (length - depth) // STEP
    done = np.zeros(len(order), bool)  # equal to its predecessor, to the end
    passed = np.zeros(len(order), np.int64)  # words of the deep part known to be equal within the group
    while len(slots) and steps:
        first = slots[_runs(group)]
        pivot = np.repeat(first, np.diff(np.append(np.flatnonzero(_runs(group)), len(slots))))
        parts, value, below = (np.full(len(slots), steps), np.zeros(len(slots), np.uint64), np.zeros(len(slots), bool))
        for a in range(0, len(slots), SLICE):
            s, p = places[order[slots[a:a + SLICE]]] + depth, places[order[pivot[a:a + SLICE]]] + depth
            todo, column = np.arange(len(s)), passed[slots[a:a + SLICE]].copy()
            while len(todo):
                todo = todo[column[todo] < steps]
                x, y = word[s[todo] + STEP * column[todo]], word[p[todo] + STEP * column[todo]]
                apart = x != y
                at = todo[apart]
                parts[a + at], value[a + at], below[a + at] = column[at], x[apart], x[apart] < y[apart]
                todo = todo[~apart]
                column[todo] += 1
        equal = parts == steps
        side = np.where(equal, 1, np.where(below, 0, 2))
        # Below the first string those that part early come first, above it those that part late.
        rank = np.lexsort((value, np.where(side == 2, -parts, parts), side, group))
        order[slots] = order[slots][rank]
        group, side, parts, value, equal = group[rank], side[rank], parts[rank], value[rank], equal[rank]
        fresh = _runs(group, side, parts, value)
        new[slots] = fresh
        done[slots] |= equal & ~fresh
        passed[slots] = np.where(equal, steps, parts + 1)
        size = np.bincount(np.cumsum(fresh))
        again = ~equal & (size[np.cumsum(fresh)] > 1)
        slots, group = slots[again], np.cumsum(fresh)[again]
    if not steps:
        done = ~new
    return order, done


def repeated(buffer: np.ndarray, places: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Whether another place of the same bucket starts an equal string."""
    out = np.zeros(len(places), bool)
    if len(places):
        order, same = deep_shallow(buffer, places, bucket, length)
        out[order] = same
        out[order[:-1]] |= same[1:]
    return out
