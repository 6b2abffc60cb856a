"""Simple-8b word-aligned coding of ids, over whole arrays at a time.

A word has 64 bits: a 4-bit selector says how many values of how many bits the other 60 hold.
Ids are coded in blocks of `BLOCK`; each block starts a new word, and the word each starts at is
stored, so that all blocks are coded and decoded side by side. A value beyond 60 bits is an escape:
its slot holds zero, and its place and value stand in a list of their own.
"""

from __future__ import annotations

import numpy as np

#: Values in a word by selector, fewest first; each value has 60 // count bits. The first two
#: selectors are runs of zeros and store no bits.
RUNS = np.array([240, 120], dtype=np.int64)
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
HELD = np.concatenate([RUNS, COUNTS])
BITS = np.concatenate([[0, 0], 60 // COUNTS])
BLOCK = 1024


def _choose(table: np.ndarray) -> np.ndarray:
    """For each place of each block the selector that holds most values from there on."""
    rows, width = table.shape
    best = np.full((rows, width), 2, dtype=np.int8)
    order = [*range(3, len(HELD)), 1, 0]  # by count: the last that fits wins
    for s in order:
        if BITS[s] and not (small := table < (np.uint64(1) << np.uint64(BITS[s]))).any():
            break
        if not BITS[s]:
            small = table == 0
        misses = np.zeros((rows, width + 1), dtype=np.int32)
        np.cumsum(~small, axis=1, out=misses[:, 1:])
        ends = np.minimum(np.arange(width) + HELD[s], width)
        best[misses[:, ends] == misses[:, :-1]] = s
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escape places, escape values) of unsigned ids."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    places = np.flatnonzero(ids >> np.uint64(60))
    values = ids[places]
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.empty(0, np.uint64), np.empty(0, np.uint32), places, values
    flat = np.zeros(blocks * BLOCK + int(HELD.max()), dtype=np.uint64)
    flat[:len(ids)] = ids
    flat[places] = 0
    table = flat[:blocks * BLOCK].reshape(blocks, BLOCK)
    best = _choose(table)
    at, open_ = np.zeros(blocks, dtype=np.int64), np.arange(blocks)
    who, where, which = [], [], []
    while len(open_):
        chosen = best[open_, at[open_]].astype(np.int64)
        who.append(open_)
        where.append(at[open_])
        which.append(chosen)
        at[open_] += HELD[chosen]
        open_ = open_[at[open_] < BLOCK]
    order = np.argsort(np.concatenate(who), kind="stable")
    block, start, chosen = (np.concatenate(x)[order] for x in (who, where, which))
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(2, len(HELD)):
        own = np.flatnonzero(chosen == s)
        if len(own):
            inside = start[own, None] + np.arange(HELD[s])
            held = np.where(inside < BLOCK, flat[block[own, None] * BLOCK + inside], np.uint64(0))
            shifts = (np.arange(HELD[s]) * BITS[s]).astype(np.uint64)
            words[own] |= np.bitwise_or.reduce(held << shifts, axis=1)
    firsts = np.searchsorted(block, np.arange(blocks)).astype(np.uint32)
    return words, firsts, places, values


def decode(words: np.ndarray, firsts: np.ndarray, places: np.ndarray, values: np.ndarray,
           length: int) -> np.ndarray:
    """The ids again, all blocks at once."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    block = np.zeros(len(words), dtype=np.int64)
    block[firsts[1:]] = 1
    block = np.cumsum(block)
    ends = np.cumsum(HELD[chosen])
    start = ends - HELD[chosen]
    if len(words):
        start = start - start[firsts][block] + block * BLOCK
    out = np.zeros(length, dtype=np.uint64)
    for s in range(2, len(HELD)):
        own = np.flatnonzero(chosen == s)
        if len(own):
            shifts = (np.arange(HELD[s]) * BITS[s]).astype(np.uint64)
            mask = (np.uint64(1) << np.uint64(BITS[s])) - np.uint64(1)
            held = (words[own, None] >> shifts) & mask
            inside = start[own, None] + np.arange(HELD[s])
            real = inside < np.minimum((block[own, None] + 1) * BLOCK, length)
            out[inside[real]] = held[real]
    out[places] = values
    return out
