"""Vectorised word shingles and SuperMinHash signatures over Arrow text columns.

Everything works on the UTF-8 buffer of a column, a bounded block of whole
documents at a time. The word separators (space, \\t..\\r) and A-Z are single
bytes, so byte positions are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20          # text bytes handled at once (one longer text is a block of its own)
SLOTS, BANDS = 128, 32         # signature slots, bands of SLOTS // BANDS slots
SHINGLE = 5

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240607)
_COEF = _rng.integers(1, 1 << 63, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += np.uint64(32)
_LOW += np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base & ((1 << 64) - 1), np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets (null = empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges (i, j) of at most ``limit`` bytes, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, 64-bit hash of its lower-cased bytes)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = ~_SEP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    prev, nxt = np.empty_like(word), np.empty_like(word)
    prev[0], prev[1:] = False, word[:-1]
    nxt[-1], nxt[:-1] = False, word[1:]
    start = np.flatnonzero(word & (~prev | edge[:-1]))
    end = np.flatnonzero(word & (~nxt | edge[1:])) + 1
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOW[data] * _powers(_BASE, len(data)), out=prefix[1:])
    h = (prefix[end] - prefix[start]) * _powers(_INV, len(data))[start]
    return np.searchsorted(off, start, "right") - 1, mix(h + (end - start).astype(np.uint64))


def shingle_sets(column: pa.Array):
    """Per block: (first row, rows, row of each distinct shingle, its hash),
    ordered by row and hash. Fewer than five words are one shingle."""
    data, off = flat(column)
    for i, j in blocks(off):
        row, h = word_hashes(data[off[i]:off[j]], off[i:j + 1] - off[i])
        n = j - i
        count = np.bincount(row, minlength=n)
        long_row, long_h = row, None
        if len(row) >= SHINGLE:
            ok = row[:-SHINGLE + 1] == row[SHINGLE - 1:]
            acc = h[:len(row) - SHINGLE + 1] * _COEF[0]
            for k in range(1, SHINGLE):
                acc += h[k:len(row) - SHINGLE + 1 + k] * _COEF[k]
            long_row, long_h = row[:-SHINGLE + 1][ok], mix(acc[ok])
        else:
            long_row, long_h = row[:0], h[:0]
        few = (count > 0) & (count < SHINGLE)
        if few.any():
            sel = few[row]
            first = np.cumsum(count) - count
            place = np.arange(len(row)) - first[row]
            part = h[sel] * _COEF[place[sel]]
            rows = row[sel]
            at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            short_h = mix(np.add.reduceat(part, at) + count[rows[at]].astype(np.uint64) * _COEF[8])
            long_row, long_h = np.r_[long_row, rows[at]], np.r_[long_h, short_h]
        order = np.lexsort((long_h, long_row))
        row, h = long_row[order], long_h[order]
        if len(h):
            keep = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]
            row, h = row[keep], h[keep]
        yield i, n, row, h


def super_minhash(n: int, row: np.ndarray, h: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures (n x slots) of the sets given as (row, element).

    Every element draws one random permutation of the slots (a Fisher-Yates
    shuffle run step by step) and offers rank j plus a fraction to the slot
    at place j; a slot keeps the least offer. Step j runs for all elements
    together; a row stops as soon as no slot is above rank j, since later
    offers are at least j + 1. An offer is rank << 32 | fraction.
    """
    sig = np.full(n * slots, np.iinfo(np.uint64).max, np.uint64)
    todo = np.flatnonzero(np.bincount(row, minlength=n))
    perm = None
    for j in range(slots):
        draw = mix(h + np.uint64((j * _BASE) & 0xFFFFFFFFFFFFFFFF))
        place = (j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32))).astype(np.int64)
        offer = (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32))
        if perm is None:
            target = place
        else:
            at = np.arange(len(h))
            target = perm[at, place].astype(np.int64)
            perm[at, place] = perm[:, j]
            perm[:, j] = target
        np.minimum.at(sig, row * slots + target, offer)
        high = sig.reshape(n, slots)[todo].max(axis=1)
        open_rows = np.zeros(n, bool)
        todo = todo[high >= np.uint64((j + 1) << 32)]
        if not len(todo) or j == slots - 1:
            break
        open_rows[todo] = True
        keep = open_rows[row]
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (int(keep.sum()), 1))
            at = np.arange(len(perm))
            perm[at, place[keep]] = 0
            perm[:, 0] = place[keep]
        else:
            perm = perm[keep]
        row, h = row[keep], h[keep]
    return sig.reshape(n, slots)


def set_ids(n: int, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set sizes, 16-byte ids): equal sets get equal ids, whatever the order."""
    size = np.bincount(row, minlength=n)
    out = np.zeros((n, 2), np.uint64)
    np.add.at(out[:, 0], row, mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    np.add.at(out[:, 1], row, mix(h * _COEF[9] + _COEF[10]))
    out[:, 0] += mix(size.astype(np.uint64) * _COEF[11])
    return size, out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per row and band."""
    n, slots = sig.shape
    r = slots // bands
    part = sig.reshape(n, bands, r)
    acc = np.zeros((n, bands), np.uint64)
    for k in range(r):
        acc = mix(acc + part[:, :, k] * _COEF[k])
    return mix(acc + np.arange(bands, dtype=np.uint64) * _COEF[12])

