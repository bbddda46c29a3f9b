"""Suffix arrays of bounded shards in numpy: Larsson-Sadakane refinement, Kasai
common prefixes, and lookups between shards by binary search.

A shard is a byte array of texts, each followed by END (a byte that UTF-8 never
has), of less than LIMIT bytes. A group of suffixes, its rank by a further h
bytes and a suffix fit one 64-bit word, so a refinement round is one sort of
plain words.
"""

from __future__ import annotations

import numpy as np

BITS = 21
LIMIT = (1 << BITS) - 2          # bytes of a shard at most
END, PAD = 0xFF, 0xFE
LANES = 8192

_MASK = np.uint64((1 << BITS) - 1)
_B = np.uint64(BITS)
BASE = 0x9E3779B97F4A7C15
_INV = pow(BASE, -1, 1 << 64)


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sa, least, below): suffixes in order, refined until ``depth`` bytes at
    least have been compared, and the bounds that this leaves of the bytes a
    suffix shares with the one before it: ``least`` of them, fewer than
    ``below`` (2^31 where both are equal over all bytes compared; the order
    among such ones is by position)."""
    n = len(data)
    least, below = np.zeros(n, np.int32), np.full(n, np.iinfo(np.int32).max, np.int32)
    if not n:
        return np.zeros(0, np.int64), least, below
    if n > LIMIT:
        raise ValueError("a shard must be cut")
    used = np.bincount(data, minlength=256) > 0
    code = np.cumsum(used).astype(np.uint64)
    width = int(code[-1]).bit_length()
    h = 2 * BITS // width
    char = np.zeros(n + h, np.uint64)
    char[:n] = code[data]
    word = np.zeros(n, np.uint64)
    for k in range(h):
        word = (word << np.uint64(width)) | char[k:n + k]
    word = (word << _B) | np.arange(n, dtype=np.uint64)
    word.sort()
    sa = (word & _MASK).astype(np.int64)
    first = np.ones(n + 1, bool)
    first[1:n] = (word[1:] >> _B) != (word[:-1] >> _B)
    below[first[:n]] = h
    rank = np.zeros(n, np.uint64)               # first place of the suffix's group
    rank[sa] = np.maximum.accumulate(np.where(first[:n], np.arange(n), 0)).astype(np.uint64)
    at = np.flatnonzero(~(first[:n] & first[1:]))
    while h < depth and len(at):
        m = sa[at]
        ahead = np.zeros(len(m), np.uint64)
        inside = m + h < n
        ahead[inside] = rank[m[inside] + h] + np.uint64(1)
        word = (rank[m] << np.uint64(2 * BITS)) | (ahead << _B) | m.astype(np.uint64)
        word.sort()
        m = (word & _MASK).astype(np.int64)
        sa[at] = m
        first = np.ones(len(at) + 1, bool)
        first[1:-1] = (word[1:] >> _B) != (word[:-1] >> _B)
        apart = at[first[:-1] & (below[at] > h)]
        least[apart], below[apart] = h, 2 * h
        rank[m] = at[np.maximum.accumulate(np.where(first[:-1], np.arange(len(at)), 0))].astype(np.uint64)
        at = at[~(first[:-1] & first[1:])]
        h *= 2
    least[below > h] = h
    return sa, least, below


def windows8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one word, least significant first."""
    padded = np.full(len(data) + 8, PAD, np.uint8)
    padded[:len(data)] = data
    return np.ascontiguousarray(np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,)))


def common_prefixes(data: np.ndarray, sa: np.ndarray, least: np.ndarray, below: np.ndarray, length: int) -> np.ndarray:
    """Kasai: bytes that each suffix of ``sa`` shares with the one before it,
    exact where the bounds leave open whether it is ``length`` (``least``
    elsewhere). What place i shares, less one, place i + 1 shares at least.
    Stretches of the text go side by side, a step of each at a time."""
    n = len(sa)
    lcp = least.astype(np.int64)
    order = np.empty(n, np.int64)
    order[sa] = np.arange(n)
    open_ = (least < length) & (below > length)
    open_[:1] = False                            # nothing stands before the first
    todo = np.sort(sa[open_])                    # in text order
    if not len(todo):
        return lcp
    follows = np.r_[False, todo[1:] == todo[:-1] + 1]
    word = windows8(data)
    lanes = min(LANES, len(todo))
    p = np.arange(lanes) * len(todo) // lanes
    stop = np.r_[p[1:], len(todo)]
    i = todo[p]
    j = sa[order[i] - 1]
    h = lcp[order[i]]
    while len(p):
        diff = word[np.minimum(i + h, n)] ^ word[np.minimum(j + h, n)]
        go = diff == 0
        h[go] += 8
        done = np.flatnonzero(~go)
        d = diff[done]
        low = (d & (~d + np.uint64(1))).astype(np.float64)
        h[done] += (np.frexp(low)[1] - 1) >> 3
        lcp[order[i[done]]] = h[done]
        p[done] += 1
        more = p < stop
        if not more.all():
            p, stop, i, j, h = p[more], stop[more], i[more], j[more], h[more]
            done = np.flatnonzero(~go[more])
        at = p[done]
        i[done] = todo[at]
        place = order[todo[at]]
        j[done] = sa[place - 1]
        h[done] = np.maximum(np.where(follows[at], h[done] - 1, 0), least[place])
    return lcp


def repeated(data: np.ndarray, length: int) -> np.ndarray:
    """For each place, whether its ``length`` bytes start elsewhere in the shard too."""
    sa, least, below = suffix_array(data, length)
    lcp = common_prefixes(data, sa, least, below, length)
    long = lcp >= length
    out = np.zeros(len(data), bool)
    out[sa] = long | np.r_[long[1:], False]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Polynomial hashes of any stretch of a shard; the powers are kept."""

    def __init__(self, size: int = LIMIT + 2):
        self.up, self.down = (np.full(size, x & ((1 << 64) - 1), np.uint64) for x in (BASE, _INV))
        for x in (self.up, self.down):
            x[0] = 1
            np.multiply.accumulate(x, out=x)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:len(data)], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, length: int) -> np.ndarray:
        n = max(len(prefix) - length, 0)
        return mix((prefix[length:] - prefix[:n]) * self.down[:n])

    def stretches(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((prefix[stop] - prefix[start]) * self.down[start] + (stop - start).astype(np.uint64) * np.uint64(BASE))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones."""
    n = len(values)
    if n < width:
        return values[:0]
    x = np.full((-(-n // width), width), np.iinfo(np.uint64).max, np.uint64)
    x.ravel()[:n] = values
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def look_up(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted ones by binary search, -1 if it is not there."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)
