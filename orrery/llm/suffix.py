"""Suffix arrays by prefix doubling over unsorted groups, and common prefixes in text order, in numpy."""

from __future__ import annotations

import numpy as np

#: Positions of one array: three such numbers fit in 64 bits, so that a sort needs no index array beside it.
MOST_POSITIONS = 1 << 21
_BITS = np.uint64(21)
_LOW = np.uint64(MOST_POSITIONS - 1)


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes of strings laid end to end; ``ends`` has for every position the end of its string.

    Larsson-Sadakane refinement: after suffixes are grouped by their first h bytes, the members of each group that is
    still unsorted are ordered by the group of the suffix h bytes later; groups of one drop out, and h doubles. The
    end of a string sorts before every byte; equal rests of strings keep the order of the strings.
    """
    n = len(data)
    assert n <= MOST_POSITIONS
    at = np.arange(n, dtype=np.uint64)
    left = ends - np.arange(n)
    padded = np.zeros(n + 4, np.uint64)
    padded[:n] = data.astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for k in range(4):
        key = key * np.uint64(257) + np.where(left > k, padded[k : n + k], np.uint64(0))
    packed = np.sort((key << _BITS) | at)
    order = (packed & _LOW).astype(np.int64)
    key = packed >> _BITS
    longest = int(left.max()) if n else 0
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = group + 1
    slots = np.flatnonzero(_unsorted(fresh))
    h = 4
    while len(slots) and h < longest:
        members = order[slots]
        later = rank[np.where(left[members] > h, members + h, n)]
        head = group[slots]
        packed = (head.astype(np.uint64) << (_BITS + _BITS)) | (later.astype(np.uint64) << _BITS) | np.arange(len(slots), dtype=np.uint64)
        packed.sort()
        members = members[(packed & _LOW).astype(np.int64)]
        order[slots] = members
        key = packed >> _BITS
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        group[slots] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        rank[members] = group[slots] + 1
        slots = slots[_unsorted(fresh)]
        h *= 2
    return order


def _unsorted(fresh: np.ndarray) -> np.ndarray:
    """Members of groups of more than one, given where groups begin."""
    last = np.append(fresh[1:], True)
    return ~(fresh & last)


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to ``most`` bytes, of each suffix with the one before it in the order, by text position.

    Kasai's bound, that one position later at most one byte less is shared, lets positions at ever finer strides
    start from what the position before them has; all positions of a stride are compared together, 8 bytes a step.
    """
    n = len(data)
    before = np.empty(n, np.int64)
    before[order[:1]] = -1
    before[order[1:]] = order[:-1]
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    words = np.ndarray((n + 1,), "<u8", padded.data, strides=(1,))
    limit = np.minimum(np.minimum(ends - np.arange(n), ends[before] - before), most)
    limit[before < 0] = 0
    shared = np.zeros(n, np.int64)
    stride = 256
    at = np.arange(0, n, stride)
    while True:
        now = at
        while len(now):
            i = now + shared[now]
            j = before[now] + shared[now]
            room = limit[now] - shared[now]
            now, i, j, room = (x[room > 0] for x in (now, i, j, room))
            differ = words[i] ^ words[j]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
            shared[now] += np.minimum(same, room)
            now = now[(same == 8) & (room > 8)]
        if stride == 1:
            return shared
        half = stride // 2
        at = np.arange(half, n, stride)
        shared[at] = np.clip(shared[at - half] - half, 0, limit[at])
        stride = half


def repeat_classes(shared_in_order: np.ndarray, least: int) -> np.ndarray:
    """Class of each place in a suffix order: neighbours that share ``least`` bytes or more are in one."""
    return np.cumsum(shared_in_order < least)
