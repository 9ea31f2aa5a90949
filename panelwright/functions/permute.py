"""Keyed permutations of 0 .. n - 1 that are computed, never stored: a Feistel network with cycle walking.

A number is cut in two halves of bits; in turn each is changed by a keyed function of the
other.  That permutes 0 .. 2^bits - 1; numbers that leave 0 .. n - 1 are permuted again until they are back.
The same integers come from NumPy, from Columns and from the SQL text, none of them beyond 63 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# A prime modulus and multipliers of the round function.
PRIME, OF_VALUE, OF_KEY, OF_ROUND, OF_SEED, LAST = 2_147_483_647, 48_271, 69_621, 1_299_709, 15_485_863, 40_692
ROUNDS, WALKS = 6, 64


def halves(n: int) -> tuple[int, int]:
    """Bits of the high and the low half."""
    bits = max(2, (max(n, 1) - 1).bit_length())
    return bits - bits // 2, bits // 2


def _mix(v, r, key, seed):
    t = (v * OF_VALUE + key * OF_KEY + r * OF_ROUND + seed * OF_SEED) % PRIME
    return ((t * t) % PRIME * LAST + r) % PRIME // 8


def permuted(pos: np.ndarray, key: int, n: int, seed: int = 0) -> np.ndarray:
    """Images of ``pos`` under the permutation number ``key``."""
    hi, lo = halves(n)

    def once(x):
        for r in range(ROUNDS):
            if r % 2 == 0:
                x = x ^ ((_mix(x & ((1 << lo) - 1), r, key, seed) & ((1 << hi) - 1)) << lo)
            else:
                x = x ^ (_mix(x >> lo, r, key, seed) & ((1 << lo) - 1))
        return x
    out = once(np.asarray(pos, np.int64))
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = once(out[far])
    return out


def permuted_column(pos: Column, key: Column, n: int, seed: int = 0) -> Column:
    """The same as a Column; a number that has not come back after WALKS steps (chance under 2^-64) is null."""
    hi, lo = halves(n)
    key = key.cast("bigint")

    def mix(v, r):
        t = (v * OF_VALUE + key * OF_KEY + r * OF_ROUND + seed * OF_SEED) % PRIME
        return F.floor(((t * t) % PRIME * LAST + r) % PRIME / 8)

    def rounds(x):
        """One pass over the rounds, as a fold, so that the expression stays small."""
        def step(x, r):
            low = x.bitwiseAND(F.lit((1 << lo) - 1))
            v = F.when(r % 2 == 0, low).otherwise(F.shiftright(x, lo))
            m = mix(v, r)
            return x.bitwiseXOR(F.when(r % 2 == 0, F.shiftleft(m.bitwiseAND(F.lit((1 << hi) - 1)), lo)).otherwise(m.bitwiseAND(F.lit((1 << lo) - 1))))
        return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.lit(ROUNDS - 1).cast("bigint")), x, step)
    start = rounds(pos.cast("bigint"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, lambda x, _: F.when(x >= n, rounds(x)).otherwise(x))
    return F.when(end < n, end)


def permuted_sql(pos: str, key: str, seed: int = 0) -> str:
    """One pass as SQL text for an engine with list lambdas; ``hi`` and ``lo`` are columns, and so is what is walked again."""
    t = f"((CASE WHEN r % 2 = 0 THEN x & ((1::BIGINT << lo) - 1) ELSE x >> lo END) * {OF_VALUE} + {key} * {OF_KEY} + r * {OF_ROUND} + {seed * OF_SEED}) % {PRIME}"
    mix = f"((({t}) * ({t})) % {PRIME} * {LAST} + r) % {PRIME} // 8"
    return f"""list_reduce(list_concat([({pos})::BIGINT], range({ROUNDS})), lambda x, r: xor(x,
      CASE WHEN r % 2 = 0 THEN (({mix}) & ((1::BIGINT << hi) - 1)) << lo ELSE ({mix}) & ((1::BIGINT << lo) - 1) END))"""
