"""Simple-8b word-aligned integer coding (Anh and Moffat 2010), vectorised with numpy.

Ids are cut into sub-blocks of ``SUB`` values.  Each sub-block starts on a new 64-bit word and its
first word is listed in ``offsets``, so any sub-block can be decoded alone and all of them at once.
A word holds a 4-bit selector in its top bits and ``count`` values of ``bits`` bits below, the first
value in the lowest bits.  Selector 0 is the escape for values of more than 60 bits: its payload is
an index into a list of raw 64-bit values.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the coding: (values per word, bits per value) of selectors 1 to 14.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12),
             (4, 15), (3, 20), (2, 30), (1, 60)]
MAGIC = b"S8B1"
SUB = 1024
HEAD = struct.Struct("<4sQQQQ")
COUNTS = np.array([1] + [c for c, _ in SELECTORS], np.int64)
MASK60 = np.uint64((1 << 60) - 1)
FOUR = np.uint64(60)


PAD = SELECTORS[0][0]   # room after a sub-block for the unused values of its last word
LIMITS = np.array([1 << b for _, b in SELECTORS], np.uint64)
SMALL = np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def _classes(ids: np.ndarray) -> np.ndarray:
    """Per id the first selector index (0-based) wide enough for it, 14 for an escape."""
    if len(ids) and ids.max() < len(SMALL):
        return SMALL[ids.astype(np.uint16)]
    return np.searchsorted(LIMITS, ids, side="right").astype(np.uint8)


def encode(ids: np.ndarray) -> bytes:
    """Bytes of one block of unsigned integers of at most 64 bits; an empty block is a bare header."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    subs = -(-n // SUB)
    grid = np.zeros((subs, SUB + PAD), np.uint64)
    rows, rest = n // SUB, n % SUB
    grid[:rows, :SUB] = ids[:rows * SUB].reshape(rows, SUB)
    if rest:
        grid[rows, :rest] = ids[rows * SUB:]
    flat = grid.ravel()
    cls = _classes(flat)
    # widest[i]: the widest class among the ``done`` values from i, grown step by step
    pick = np.zeros(flat.shape, np.uint8)
    take = np.ones(flat.shape, np.uint8)
    widest = cls.copy()
    done = 1
    for j in range(len(SELECTORS) - 1, -1, -1):
        count = SELECTORS[j][0]
        while done < count:
            np.maximum(widest[:len(cls) - done], cls[done:], out=widest[:len(cls) - done])
            done += 1
        fits = widest <= j
        if not fits.any():
            break   # nor do more, narrower values fit anywhere
        np.copyto(pick, j + 1, where=fits)
        np.copyto(take, count, where=fits)
    # one step a word, in all sub-blocks at once; one that is through stays at its end
    first = np.arange(subs) * (SUB + PAD)
    ends = first + np.minimum(SUB, n - np.arange(subs) * SUB)
    at, now = [], first
    while (now < ends).any():
        at.append(now)
        now = np.minimum(now + take[now], ends)
    places = np.array(at, np.int64).reshape(len(at), subs).T
    open_ = places < ends[:, None]
    offsets = np.concatenate(([0], np.cumsum(open_.sum(axis=1)))).astype(np.uint64)
    starts = places[open_]
    sel = pick[starts] if len(starts) else np.zeros(0, np.uint8)
    words = np.zeros(len(starts), np.uint64)
    for j, (count, bits) in enumerate(SELECTORS, 1):
        where = np.flatnonzero(sel == j)
        if len(where):
            at_first = starts[where]
            got = flat[at_first]
            for k in range(1, count):
                got |= flat[at_first + k] << np.uint64(k * bits)
            words[where] = got
    escaped = np.flatnonzero(sel == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    words |= sel.astype(np.uint64) << FOUR
    return b"".join((HEAD.pack(MAGIC, n, len(words), len(escaped), subs), offsets.tobytes(), words.tobytes(),
                     flat[starts[escaped]].tobytes()))


def _parts(block: bytes):
    magic, n, n_words, n_raw, subs = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of packed ids")
    at = HEAD.size
    offsets = np.frombuffer(block, np.uint64, subs + 1, at).astype(np.int64)
    words = np.frombuffer(block, np.uint64, n_words, at + 8 * (subs + 1))
    raw = np.frombuffer(block, np.uint64, n_raw, at + 8 * (subs + 1 + n_words))
    return n, offsets, words, raw


def _unpack(words: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Values of the sub-blocks whose words start at ``offsets``, one row of SUB + PAD each: what a
    row's last word holds beyond its sub-block falls into the padding."""
    sel = (words >> FOUR).astype(np.uint8)
    run = np.concatenate(([0], np.cumsum(COUNTS[sel])))
    base = np.arange(len(offsets) - 1) * (SUB + PAD) - run[offsets[:-1]]
    first = run[:-1] + np.repeat(base, np.diff(offsets))
    body = words & MASK60
    out = np.zeros((len(offsets) - 1) * (SUB + PAD), np.uint64)
    for j, (count, bits) in enumerate(SELECTORS, 1):
        where = np.flatnonzero(sel == j)
        if len(where):
            got, to, keep = body[where], first[where], np.uint64((1 << bits) - 1)
            for k in range(count):
                out[to + k] = (got >> np.uint64(k * bits)) & keep
    escaped = np.flatnonzero(sel == 0)
    out[first[escaped]] = raw[body[escaped].astype(np.int64)]
    return out.reshape(-1, SUB + PAD)


def decode(block: bytes) -> np.ndarray:
    """All ids of a block, decoded at once."""
    n, offsets, words, raw = _parts(block)
    return _unpack(words, raw, offsets)[:, :SUB].ravel()[:n]


def decode_sub(block: bytes, s: int) -> np.ndarray:
    """The ids of one sub-block, without reading the words of the others."""
    n, offsets, words, raw = _parts(block)
    part = words[offsets[s]:offsets[s + 1]]
    return _unpack(part, raw, np.array([0, len(part)]))[0, :min(SUB, n - s * SUB)]
