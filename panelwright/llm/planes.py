"""Fingerprints as 64 vertical bit planes, compared 64 pairs at a time.

The distances of all rows to the rows d places on are counted by carry-save adders over
the planes, and a word of 64 pairs is given up once all its counts exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def majority(h: np.ndarray, many: np.ndarray) -> np.ndarray:
    """uint64 fingerprints of texts of ``many`` hashes each: a bit is set if it is in over half of them; 0 without hashes."""
    out = np.zeros(len(many), np.uint64)
    have = np.flatnonzero(many)
    if not len(have):
        return out
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    n = np.add.reduceat(bits, (np.cumsum(many) - many)[have], axis=0, dtype=np.int32)
    out[have] = np.packbits(2 * n > many[have][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _pack(bits: np.ndarray) -> np.ndarray:
    """(..., rows) of booleans to (..., words) of 64 rows, least bit first, one empty word at the end."""
    pad = -bits.shape[-1] % 64 + 64
    bits = np.concatenate([bits, np.zeros((*bits.shape[:-1], pad), bits.dtype)], -1)
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def close_at(fp: np.ndarray, run: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, i, i + d) for each distance d: rows of one run (sorted run numbers) whose fingerprints differ in at most ``radius`` bits."""
    n = len(fp)
    shifts = np.arange(64, dtype=np.uint64)
    planes = _pack(((fp[None, :] >> shifts[:, None]) & np.uint64(1)).astype(np.uint8))
    words = planes.shape[1] - 1
    longest = int(np.bincount(run - run[0]).max()) if n else 0
    counters = max(radius.bit_length(), 1)
    for d in range(1, longest):
        mask = _pack((run[d:] == run[:-d]).astype(np.uint8))
        at = np.flatnonzero(mask[:words])
        if not len(at):
            break
        q, r = divmod(d, 64)
        live = mask[at]
        count = [np.zeros(len(at), np.uint64) for _ in range(counters)]
        over = np.zeros(len(at), np.uint64)
        for p in range(0, 64, 4):
            own = planes[p: p + 4, at]
            low = planes[p: p + 4][:, np.minimum(at + q, words)]
            if r:
                low = (low >> np.uint64(r)) | (planes[p: p + 4][:, np.minimum(at + q + 1, words)] << np.uint64(64 - r))
            x = own ^ low
            pair, carry = x[0] ^ x[1], x[0] & x[1]
            one, carry2 = pair ^ x[2], pair & x[2]
            for weight, bit in ((0, one), (0, x[3]), (1, carry), (1, carry2)):
                for k in range(weight, counters):
                    count[k], bit = count[k] ^ bit, count[k] & bit
                over |= bit
            if p % 8:
                keep = live & ~(over | _exceeds(count, radius))
                some = keep != 0
                if not some.all():
                    at, live, over, count = at[some], live[some], over[some], [c[some] for c in count]
                    if not len(at):
                        break
        if len(at):
            keep = live & ~(over | _exceeds(count, radius))
            bits = np.unpackbits(keep.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, b = np.nonzero(bits)
            i = at[w] * 64 + b
            yield d, i, i + d


def close_pairs(fp: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one run (sorted run numbers) whose fingerprints differ in at most ``radius`` bits."""
    none = np.empty(0, np.int64)
    found = [(none, none), *[(i, j) for _, i, j in close_at(fp, run, radius)]]
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _exceeds(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits whose counter is above ``radius``: compared from the highest counter bit down."""
    more, same = np.zeros_like(count[0]), np.full_like(count[0], ALL)
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same = same & count[k]
        else:
            more |= same & count[k]
            same = same & ~count[k]
    return more
