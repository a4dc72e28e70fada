"""Suffix arrays in numpy: Larsson-Sadakane refinement to a depth, Kasai common prefixes, groups of equal windows."""

from __future__ import annotations

import numpy as np

#: Slots and places that are worked on at a time: what a step needs besides the arrays it keeps stays small.
BLOCK = 1 << 17


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number; zeros follow the end."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        k = len(range(o, n, 8))
        out[o::8] = padded[o : o + 8 * k].view(">u8")
    return out


def places_of(n: int):
    """The narrowest kind of number for places below n."""
    return np.int32 if n <= np.iinfo(np.int32).max else np.int64


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes, sorted by their first `depth` bytes at least.

    Larsson and Sadakane: a rank is the first slot of a group of suffixes that are not told apart yet; each round doubles
    the prefix that is sorted and touches only groups of several suffixes, a block of slots after the other. Where a key and
    a place fit into 64 bits they are sorted as one number, which takes a fraction of the time of sorting places by key.
    """
    n = len(data)
    key, bits, kind = words(data), n.bit_length(), places_of(n + 2 * depth + 16)
    h = min(8, (64 - bits) // 8)
    if h >= 4:
        low = np.uint64(64 - 8 * h)
        key >>= low
        key <<= low
        for a in range(0, n, BLOCK):
            key[a : a + BLOCK] |= np.arange(a, min(a + BLOCK, n), dtype=np.uint64)
        key.sort()
        order = np.empty(n, kind)
        for a in range(0, n, BLOCK):
            order[a : a + BLOCK] = key[a : a + BLOCK] & np.uint64((1 << bits) - 1)
        key >>= low
    else:
        h, order = 8, np.argsort(key, kind="stable").astype(kind)
        key = key[order]
    same = np.zeros(n, bool)
    same[1:] = key[1:] == key[:-1]
    del key
    slot = np.arange(n, dtype=kind)
    slot[same] = 0
    rank = np.full(n + 2 * depth + 16, -1, kind)
    rank[order] = np.maximum.accumulate(slot) if n else slot
    del slot
    more = True
    while h < depth + 8 and more:  # a short last suffix ties with zeros only in its last word
        more, a = False, 0
        while a < n:
            z = min(a + BLOCK, n)
            if z < n and same[z]:  # a group stays in one block
                k = int(np.argmin(same[z:]))
                z = n if same[z + k] else z + k
            more |= refine(order, rank, same, a, z, h, bits)
            a = z
        h *= 2
    return order


def refine(order: np.ndarray, rank: np.ndarray, same: np.ndarray, a: int, z: int, h: int, bits: int) -> bool:
    """Sort the groups of several suffixes in slots a to z by the ranks h places on. False where there are none."""
    several = same[a:z].copy()
    several[:-1] |= same[a + 1 : z]
    at = a + np.flatnonzero(several)
    if not len(at):
        return False
    p = order[at]
    group = np.cumsum(~same[at])
    index = len(at).bit_length()
    if 2 * index + bits + 1 <= 64:
        key = (group.astype(np.uint64) << np.uint64(bits + 1)) | (rank[p + h] + 1).astype(np.uint64)
        key <<= np.uint64(index)
        key |= np.arange(len(at), dtype=np.uint64)
        key.sort()
        p = p[(key & np.uint64((1 << index) - 1)).astype(np.int64)]
        key >>= np.uint64(index)
    else:
        key = group * (len(order) + 1) + rank[p + h] + 1
        o = np.argsort(key, kind="stable")
        p, key = p[o], key[o]
    order[at] = p
    eq = np.zeros(len(at), bool)
    eq[1:] = key[1:] == key[:-1]
    same[at] = eq
    rank[p] = at[np.maximum.accumulate(np.where(eq, 0, np.arange(len(at))))]
    return True


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in `order`, by place in the text.

    Kasai: where the predecessor of place i is the place after the predecessor of i - 1, the prefix is one shorter than
    there, if there is one there. Only the other places compare bytes, eight at a time, all of them at once.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    chained = np.zeros(n, bool)
    chained[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (data[before[:-1]] == data[:-1])
    w = np.concatenate((words(data), np.zeros(8, np.uint64)))
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(~chained & (before >= 0))
    a, b = live.copy(), before[live]
    while len(live):
        x = w[a] ^ w[b]
        step = np.where(x == 0, 8, 0)
        odd = np.flatnonzero(x)
        if len(odd):
            lead = x[odd]
            k = np.zeros(len(odd), np.int64)
            for s in range(7, 0, -1):
                k += (lead >> np.uint64(8 * (8 - s))) == 0
            step[odd] = k
        out[live] += step
        on = (x == 0) & (a + 8 < n) & (b + 8 < n)
        live, a, b = live[on], a[on] + 8, b[on] + 8
    out = np.minimum(out, n - np.maximum(np.arange(n), before))
    lead = np.maximum.accumulate(np.where(chained, 0, np.arange(n)))
    return np.maximum(out[lead] - (np.arange(n) - lead), 0)


def equal_windows(data: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """A number from 0 for each valid place (in order of place): equal where the `width` bytes (8 at least) from there are equal.

    Neighbours in the order of suffixes are compared eight bytes at a time, as long as they agree and no further than `width`.
    """
    order = suffix_order(data, width)
    order = order[valid[order]]
    w = words(np.concatenate((data, np.zeros(width, np.uint8))))
    new = np.zeros(len(order), bool)
    for a in range(0, len(order), BLOCK):
        own = order[max(a - 1, 0) : a + BLOCK]
        live = np.arange(1, len(own))
        for o in [*range(0, width - 8, 8), width - 8]:
            differ = w[own[live] + o] != w[own[live - 1] + o]
            new[max(a - 1, 0) + live[differ]] = True
            live = live[~differ]
    del w
    group = np.empty(len(data), places_of(len(data)))
    group[order] = np.cumsum(new, dtype=group.dtype)
    return group[valid]
