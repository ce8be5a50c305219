"""Words of a batch of texts as hash arrays, for the operators that count or compare words.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased; in UTF-8
no byte of another character is among these, so bytes and code points agree. Hashes are
64 bits, from a polynomial over random byte values, mixed; texts are taken in pieces of
about PIECE bytes cut at white space, so a long text needs no more memory than its words.
Hashes are mixed STEP at a time: a task holds its arrays, not several copies of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
#: hashes mixed at a time, so that what is made on the way stays small
STEP = 1 << 16
SEED = 20_240_229

_random = np.random.default_rng(SEED)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, PIECE + 1), _powers(_INVERSE, PIECE + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x; one to one."""
    if x.ndim == 1 and len(x) > STEP:
        out = np.empty_like(x)
        for at in range(0, len(x), STEP):
            out[at : at + STEP] = mixed(x[at : at + STEP])
        return out
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece(data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of one piece; `starts_at` are places where a new text begins."""
    part = ~_SPACE[data]
    new = np.zeros(len(data) + 1, bool)
    new[starts_at] = True
    before = np.concatenate(([False], part[:-1]))
    first = np.flatnonzero(part & (~before | new[:-1]))
    after = np.concatenate((part[1:], [False]))
    last = np.flatnonzero(part & (~after | new[1:])) + 1
    up, down = (_UP, _DOWN) if len(data) <= PIECE else (_powers(_BASE, len(data)), _powers(_INVERSE, len(data)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    return first, mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the word hashes of all texts in order, and where each text's end.

    Text i has the words hashes[ends[i-1]:ends[i]]; null is an empty text.
    """
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    count = len(texts)
    if not count:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + count + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    low, high = int(offsets[0]), int(offsets[-1])
    hashes, places = [], []
    at = low
    while at < high:
        to = min(at + PIECE, high)
        if to < high:
            # cut where a text begins or after white space; a longer word grows the piece
            begins = offsets[np.searchsorted(offsets, to, "right") - 1]
            if begins > at:
                to = int(begins)
            else:
                while True:
                    blank = np.flatnonzero(_SPACE[data[at:to]])
                    stop = int(offsets[np.searchsorted(offsets, at, "right")])
                    if len(blank):
                        to = at + int(blank[-1]) + 1
                        break
                    if to >= stop:
                        to = stop
                        break
                    to = min(to + PIECE, stop)
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
        first, own = _piece(data[at:to], inside)
        hashes.append(own)
        places.append(first + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(count, np.int64)
    all_hashes, all_places = np.concatenate(hashes), np.concatenate(places)
    return all_hashes, np.searchsorted(all_places, offsets[1:], "left")


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every `n` neighbours; fewer words than n give none."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(count, np.uint64)
    for at in range(0, count, STEP):
        to = min(at + STEP, count)
        part = np.zeros(to - at, np.uint64)
        for k in range(n):
            part = mixed(part * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k : to + k])
        out[at:to] = part
    return out
