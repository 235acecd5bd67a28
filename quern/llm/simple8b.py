"""Word-aligned coding of integers: a 64-bit word has a 4-bit selector and as many equal-width values as fit."""

from __future__ import annotations

import numpy as np

# Values per word and bits per value, by selector. Selector 0 is an escape: one value, an index into the block's list of values of 60 bits or more.
COUNT = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

_LEVEL16 = (15 - np.searchsorted(BITS[1:], np.frexp(np.arange(1 << 16, dtype=np.float64))[1])).astype(np.int8)

#: Values that start on a word of their own, so that they can be found and decoded alone.
GROUP = 1024


def _widest(values: np.ndarray) -> np.ndarray:
    """For each value 16 less the first selector, by width, that holds it: 15 for a zero, 1 for 31 to 60 bits."""
    if not values.max(initial=0) >> np.uint64(16):
        return _LEVEL16[values.astype(np.int64)]
    bits = np.minimum(np.frexp(values.astype(np.float64))[1], 60)
    return (15 - np.searchsorted(BITS[1:], bits)).astype(np.int8)


def encode(values: np.ndarray) -> bytes:
    """A block: counts of values, words and escaped values; word offset of each group; escaped values; words."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    groups = -(-n // GROUP)
    wide = np.flatnonzero(values >> np.uint64(60))
    escaped, small = values[wide], values.copy()
    small[wide] = np.arange(len(wide), dtype=np.uint64)
    level = np.full((groups, GROUP + int(COUNT.max())), 15, dtype=np.int8)  # past the end everything fits
    inside = np.full(groups * GROUP, 15, dtype=np.int8)
    inside[:n] = _widest(small)
    inside[wide] = 0
    level[:, :GROUP] = inside.reshape(groups, GROUP)
    best = level[:, :GROUP].copy()
    best[best > 0] = 15
    least, run = level, 1  # over runs of 1, 2, 4, ... values
    for s in range(14, 0, -1):  # ever more values in a word
        count = int(COUNT[s])
        while 2 * run <= count:
            least, run = np.minimum(least[:, :-run], least[:, run:]), 2 * run
        lo = least[:, :GROUP] if run == count else np.minimum(least[:, :GROUP], least[:, count - run : count - run + GROUP])
        fits = lo >= 16 - s
        if not fits.any():
            break
        best[fits] = s
    begins = np.zeros((groups, GROUP), dtype=bool)
    size = np.full(groups, GROUP)
    if groups:
        size[-1] = n - (groups - 1) * GROUP
    at, live = np.zeros(groups, dtype=np.int64), np.arange(groups)
    while len(live):  # all groups take one word in each turn
        p = at[live]
        begins[live, p] = True
        at[live] = p = p + COUNT[best[live, p]]
        live = live[p < size[live]]
    place = np.flatnonzero(begins)
    row, chosen = place // GROUP, best.flat[place]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.zeros(groups * GROUP + int(COUNT.max()), dtype=np.uint64)
    padded[:n] = small
    ends = np.append(np.arange(1, groups) * GROUP, n)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        if s == 0:
            words[mine] |= padded[place[mine]]
            continue
        if not BITS[s]:
            continue
        last = ends[row[mine]]
        for j in range(COUNT[s]):
            slot = place[mine] + j
            v = padded[slot] << np.uint64(BITS[s] * j)
            words[mine] |= v if (slot < last).all() else np.where(slot < last, v, np.uint64(0))
    starts = np.searchsorted(row, np.arange(groups + 1))
    head = np.array([n, len(words), len(escaped)], dtype="<u8")
    return b"".join((head.tobytes(), starts.astype("<u8").tobytes(), escaped.astype("<u8").tobytes(), words.astype("<u8").tobytes()))


def decode(block: bytes) -> np.ndarray:
    """The values of a block, all words with the same selector at once."""
    n, n_words, n_escaped = (int(x) for x in np.frombuffer(block, "<u8", 3))
    groups = -(-n // GROUP)
    starts = np.frombuffer(block, "<u8", groups + 1, 24).astype(np.int64)
    escaped = np.frombuffer(block, "<u8", n_escaped, 24 + 8 * (groups + 1))
    words = np.frombuffer(block, "<u8", n_words, 24 + 8 * (groups + 1 + n_escaped))
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNT[selector]
    group = np.repeat(np.arange(groups), np.diff(starts))
    total = np.cumsum(count) - count
    at = total - total[starts[:-1]][group] + group * GROUP if n_words else total
    limit = np.minimum((group + 1) * GROUP, n)
    out = np.zeros(n, dtype=np.uint64)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        slots = at[mine, None] + np.arange(COUNT[s])
        if s == 0:
            out[slots[:, 0]] = escaped[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        if BITS[s] == 0:
            continue
        got = (words[mine, None] >> (np.arange(COUNT[s], dtype=np.uint64) * np.uint64(BITS[s]))) & np.uint64((1 << int(BITS[s])) - 1)
        inside = slots < limit[mine, None]
        if inside.all():
            out[slots] = got
        else:
            out[slots[inside]] = got[inside]
    return out


def decode_groups(block: bytes, first: int, last: int) -> np.ndarray:
    """Values of groups first to last - 1 alone, found by the block's offsets."""
    n, n_words, n_escaped = (int(x) for x in np.frombuffer(block, "<u8", 3))
    groups = -(-n // GROUP)
    starts = np.frombuffer(block, "<u8", groups + 1, 24).astype(np.int64)
    a, b = starts[first], starts[last]
    m = min(last * GROUP, n) - first * GROUP
    base = 24 + 8 * (groups + 1)
    part = b"".join((np.array([m, b - a, n_escaped], dtype="<u8").tobytes(), (starts[first : last + 1] - a).astype("<u8").tobytes(), block[base : base + 8 * n_escaped], block[base + 8 * (n_escaped + a) : base + 8 * (n_escaped + b)]))
    return decode(part)
