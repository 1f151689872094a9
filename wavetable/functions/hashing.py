"""Deterministic order and uniform numbers from md5: the same on every partitioning and in every SQL engine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rounds of swap_or_not, and the multiplier and prime modulus from which their constants are drawn.
ROUNDS, MULTIPLIER, PRIME = 64, 48271, 2**31 - 1
#: Rows that stay in a processor's cache through all rounds, and rows of equal terms from which these go by themselves.
BLOCK, RUN = 4096, 256


def order_key(seed: int | str, *keys: Column) -> Column:
    """Hexadecimal md5 of seed:key:key…, to sort by."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def uniform(seed: int | str, *keys: Column) -> Column:
    """Double in [0, 1) from the first 32 bits of the md5."""
    return F.conv(F.substring(order_key(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _fold(v: np.ndarray, spare: np.ndarray) -> None:
    """v modulo PRIME, in place, without a division, as PRIME is a power of two less one: below PRIME + 8, as PRIME + i may stand for i."""
    for _ in range(2):
        np.right_shift(v, 31, out=spare)
        v &= PRIME
        v += spare


def _swapped(x: np.ndarray, n: np.ndarray | np.uint64, terms: list[tuple]) -> np.ndarray:
    """Rounds of swap_or_not with terms (k, a, c), of unsigned x."""
    x, wide = x.copy(), np.max(n, initial=0) > PRIME
    other, t, h, spare = (np.empty_like(x) for _ in range(4))
    for k, a, c in terms:
        np.subtract(k, x, out=other)  # below zero it is very large, and with n added small
        np.add(other, n, out=spare)
        np.minimum(other, spare, out=other)
        np.maximum(x, other, out=t)
        if wide:
            t %= PRIME
        t += c
        np.multiply(t, t, out=h)  # below 2**64
        _fold(h, spare)
        h *= t
        h += a
        _fold(h, spare)
        np.add(h, 1, out=spare)
        spare >>= 31
        h += spare
        h &= 1  # odd: change places
        other -= x
        other *= h
        x += other
    return x


def swap_or_not(x: np.ndarray, n: np.ndarray, s: np.ndarray, rounds: int = ROUNDS, back: bool = False) -> np.ndarray:
    """A bijection of 0 to n - 1 for each s, place by place: in each round x and k - x (mod n) change places or not, as a hash of the larger says.

    k and the hash's terms come from a sequence that begins at s (1 to PRIME - 1). Any n up to 2**62 goes, without walking cycles.
    back: its inverse, the same rounds from the last to the first. Terms are made once for each run of equal (n, s).
    """
    if not len(x):
        return x
    first = np.flatnonzero(np.append(True, (n[1:] != n[:-1]) | (s[1:] != s[:-1])))
    ends, size, s, terms = np.append(first[1:], len(x)), n[first], s[first], []
    for _ in range(rounds):
        a = s * MULTIPLIER % PRIME
        b = a * MULTIPLIER % PRIME
        s = b * MULTIPLIER % PRIME
        terms.append(tuple(v.astype(np.uint64) for v in ((a * 2**31 + b) % size, a, s)))
    terms = terms[::-1] if back else terms
    x, size = x.astype(np.uint64), size.astype(np.uint64)
    if len(x) < RUN * len(first):  # short runs go together
        lengths = ends - first
        return _swapped(x, np.repeat(size, lengths), [tuple(np.repeat(v, lengths) for v in own) for own in terms]).astype(np.int64)
    out = [_swapped(x[a:b], size[i], [(k[i], f[i], c[i]) for k, f, c in terms]) for i, (begin, end) in enumerate(zip(first, ends)) for a, b in ((a, min(a + BLOCK, end)) for a in range(begin, end, BLOCK))]
    return np.concatenate(out).astype(np.int64)


@F.pandas_udf(T.LongType())
def dealt_place(place: pd.Series, n: pd.Series, start: pd.Series) -> pd.Series:
    """The place that swap_or_not takes to each one of a column."""
    return pd.Series(swap_or_not(place.to_numpy(np.int64), n.to_numpy(np.int64), start.to_numpy(np.int64), back=True))


def shuffle_start(seed: int | str, *keys: Column) -> Column:
    """Where the sequence of a shuffle begins: 1 to 2**28, from the md5."""
    return F.conv(F.substring(order_key(seed, *keys), 1, 7), 16, 10).cast("long") + 1
