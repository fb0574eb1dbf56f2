"""Simple-8b: 64-bit words whose selector says how many ids of how many bits they hold.

Ids are coded in blocks of a fixed number, each block on its own, with the number of the first word of every block, so
blocks decode in any order and many at once. An id of more than 60 bits is an escape: its word holds the place of the
id in a list of exceptions. Both directions work on all blocks at the same time with array operations.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BLOCK = 1024
#: Fixed values of the format: selector -> (ids in a word, bits of each). Selector 0 is the escape.
SELECTORS = {
    1: (128, 0), 2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8),
    10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60),
}
ESCAPE = 0
_BITS = np.array([b for _, b in SELECTORS.values()], dtype=np.int64)
_LIMITS = np.array([(1 << int(b)) - 1 for b in _BITS], dtype=np.uint64)
_COUNT = np.array([1, *(n for n, _ in SELECTORS.values())], dtype=np.int64)
_PAD = int(_COUNT.max())
#: For small ids, the least selector index whose bits hold them, by table.
_LEVEL16 = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64)).astype(np.uint8)


class Coded(NamedTuple):
    n: int
    words: np.ndarray
    #: The number of the first word of each block, and of the end.
    offsets: np.ndarray
    exceptions: np.ndarray


def _levels(ids: np.ndarray) -> np.ndarray:
    if ids.size == 0 or int(ids.max()) < 1 << 16:
        return _LEVEL16[ids.astype(np.int64)]
    return np.searchsorted(_LIMITS, ids.astype(np.uint64)).astype(np.uint8)


def encode(ids: np.ndarray) -> Coded:
    """Code unsigned ids of up to 64 bits."""
    n = len(ids)
    if not n:
        return Coded(0, np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64))
    blocks = -(-n // BLOCK)
    wide = np.zeros((blocks, BLOCK + _PAD), dtype=np.uint64)
    full = n // BLOCK
    flat = ids.astype(np.uint64)
    wide[:full, :BLOCK] = flat[: full * BLOCK].reshape(full, BLOCK)
    wide[full:, : n - full * BLOCK] = flat[full * BLOCK :]
    level = np.zeros(wide.shape, dtype=np.uint8)
    level[:, :BLOCK] = _levels(wide[:, :BLOCK])
    # choice: for each position, the selector of most ids that all fit; more ids never fit where fewer don't.
    choice = np.where(level <= 14, np.uint8(15), np.uint8(ESCAPE))
    most, width = level, 1
    for s in range(14, 0, -1):
        count = SELECTORS[s][0]
        while width < count:
            step = min(width, count - width)
            shifted = np.zeros_like(most)
            shifted[:, :-step] = most[:, step:]
            most = np.maximum(most, shifted)
            width += step
        fits = most <= s - 1
        if not fits[:, :BLOCK].any():
            break
        choice[fits] = s
    lengths = np.full(blocks, BLOCK)
    if n % BLOCK:
        lengths[-1] = n % BLOCK
    rows, at = np.arange(blocks), np.zeros(blocks, dtype=np.int64)
    starts, chosen, of = [], [], []
    while rows.size:
        s = choice[rows, at]
        starts.append(rows * (BLOCK + _PAD) + at)
        chosen.append(s)
        of.append(rows)
        at = at + _COUNT[s]
        on = at < lengths[rows]
        rows, at = rows[on], at[on]
    # The k-th step of a block is its k-th word.
    block = np.concatenate(of)
    offsets = np.zeros(blocks + 1, dtype=np.int64)
    np.cumsum(np.bincount(block, minlength=blocks), out=offsets[1:])
    place = offsets[block] + np.repeat(np.arange(len(of)), [len(r) for r in of])
    start, s = np.empty(len(place), dtype=np.int64), np.empty(len(place), dtype=np.uint8)
    start[place], s[place] = np.concatenate(starts), np.concatenate(chosen)
    words = s.astype(np.uint64) << np.uint64(60)
    values = wide.reshape(-1)
    for k, (count, bits) in SELECTORS.items():
        here = np.flatnonzero(s == k)
        if bits and here.size:
            for j in range(count):
                words[here] |= values[start[here] + j] << np.uint64(j * bits)
    odd = np.flatnonzero(s == ESCAPE)
    words[odd] = np.arange(odd.size, dtype=np.uint64)
    return Coded(n, words, offsets, values[start[odd]])


def decode(c: Coded, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` up to ``last`` (all of them by default), as unsigned 64-bit integers."""
    blocks = len(c.offsets) - 1
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.zeros(0, np.uint64)
    words = c.words[c.offsets[first] : c.offsets[last]]
    per = np.diff(c.offsets[first : last + 1])
    s = (words >> np.uint64(60)).astype(np.int64)
    ahead = np.cumsum(_COUNT[s]) - _COUNT[s]  # ids before a word, padding included
    base = np.repeat(ahead[np.cumsum(per) - per], per)
    to = np.repeat(np.arange(last - first), per) * (BLOCK + _PAD) + ahead - base
    out = np.zeros((last - first) * (BLOCK + _PAD), dtype=np.uint64)
    for k, (count, bits) in SELECTORS.items():
        here = np.flatnonzero(s == k)
        if bits and here.size:
            mask = np.uint64((1 << bits) - 1)
            for j in range(count):
                out[to[here] + j] = words[here] >> np.uint64(j * bits) & mask
    odd = np.flatnonzero(s == ESCAPE)
    if odd.size:
        out[to[odd]] = c.exceptions[words[odd].astype(np.int64)]
    out = out.reshape(last - first, BLOCK + _PAD)[:, :BLOCK].reshape(-1)
    return out[: min(last * BLOCK, c.n) - first * BLOCK]


_MAGIC = b"CS8B0001"


def to_bytes(c: Coded) -> bytes:
    head = np.array([c.n, len(c.words), len(c.offsets), len(c.exceptions)], dtype="<u8").tobytes()
    return b"".join([_MAGIC, head, c.offsets.astype("<u4").tobytes(), c.words.astype("<u8").tobytes(), c.exceptions.astype("<u8").tobytes()])


def from_bytes(data: bytes) -> Coded:
    if data[:8] != _MAGIC:
        raise ValueError("not a Simple-8b segment")
    n, words, offsets, odd = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
    at = 40
    o = np.frombuffer(data, "<u4", offsets, at).astype(np.int64)
    at += 4 * offsets
    w = np.frombuffer(data, "<u8", words, at)
    return Coded(n, w, o, np.frombuffer(data, "<u8", odd, at + 8 * words))
