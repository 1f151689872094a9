"""Characteristic polynomials of symmetric integer matrices, their real roots and null spaces, all exact or to any precision.

The polynomial is taken modulo primes, each by reduction to Hessenberg form, and put together by Chinese remainders; the
bound on its coefficients comes from the trace, as the matrix has no negative eigenvalues. All roots being real, the number
of roots above a point is the number of changes of sign of the polynomial moved there (Budan and Fourier), so that roots
are isolated in integer arithmetic, also repeated ones.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from math import comb, isqrt

import numpy as np

#: Primes lie below this, so that a product of two residues fits 64 bits.
BELOW = 2**31
#: Binary digits of a root, counted from its first one.
DIGITS = 110


def primes_for(bound: int) -> list[int]:
    """Primes down from BELOW whose product is more than twice the bound."""
    small = [p for p in range(2, isqrt(BELOW) + 1) if all(p % q for q in range(2, isqrt(p) + 1))]
    divisors = np.array(small)
    found, product, p = [], 1, BELOW - 1
    while product <= 2 * bound:
        if (p % divisors).all():
            found.append(p)
            product *= p
        p -= 2
    return found


def coefficient_bound(trace: int, d: int) -> int:
    """No coefficient is larger: the k-th is the sum of the products of k eigenvalues, most where all are equal."""
    return max(-(-comb(d, k) * trace**k // d**k) for k in range(d + 1))


def residues(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients, lowest first, of det(x I - matrix) modulo p. matrix: int64 residues, changed in place."""
    h, d = matrix, len(matrix)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        i = k + 1 + int(below[0])
        if i != k + 1:
            h[[k + 1, i]] = h[[i, k + 1]]
            h[:, [k + 1, i]] = h[:, [i, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + _product(h[:, k + 2 :], u, p)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)  # of the leading blocks
    polys[0, 0] = 1
    for k in range(d):
        polys[k + 1, 1:] = polys[k, :-1]
        polys[k + 1] = (polys[k + 1] - polys[k] * h[k, k] % p) % p
        beta = 1
        factors = np.zeros(k, np.int64)
        for i in range(k - 1, -1, -1):
            beta = beta * int(h[i + 1, i]) % p
            factors[i] = beta * int(h[i, k]) % p
        if k:
            polys[k + 1] = (polys[k + 1] - _product(polys[:k].T, factors, p)) % p
    return polys[d].tolist()


def _product(a: np.ndarray, u: np.ndarray, p: int) -> np.ndarray:
    """a @ u modulo p; the products are reduced before they are added."""
    return (a * u % p).sum(axis=1) % p


def from_residues(found: dict[int, list[int]]) -> list[int]:
    """The integer coefficients by Chinese remainders, of either sign."""
    product = reduce(lambda a, b: a * b, found)
    lifts = {p: product // p * pow(product // p, -1, p) for p in found}
    out = []
    for i in range(len(next(iter(found.values())))):
        c = sum(r[i] * lifts[p] for p, r in found.items()) % product
        out.append(c - product if 2 * c > product else c)
    return out


def _above(coefficients: list[int], num: int, bits: int) -> int:
    """Roots above num / 2**bits: changes of sign after moving the polynomial there."""
    d = len(coefficients) - 1
    c = [x << bits * (d - i) for i, x in enumerate(coefficients)]  # times 2**(bits d), in y = 2**bits x
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += num * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(coefficients: list[int], num: int, bits: int) -> int:
    value, power = 0, 0
    for c in reversed(coefficients):
        value = value * num + (c << power)
        power += bits
    return (value > 0) - (value < 0)


def largest_roots(coefficients: list[int], most: int, digits: int = DIGITS) -> list[Fraction]:
    """The largest roots, falling, repeated ones as often as they are; none that is zero. All roots are real and not negative.

    Each is the middle of an interval of 2**-digits of itself, at most.
    """
    d = len(coefficients) - 1
    zeros = next(i for i, c in enumerate(coefficients) if c)
    c = coefficients[zeros:]
    top = 1 << (abs(coefficients[d - 1]).bit_length())  # above the sum of the roots
    out = []
    for k in range(1, min(most, d - zeros) + 1):
        low, high, bits = 0, top, 0  # of low < root <= high, in units of 2**-bits
        alone = None
        while not low or (high - low) << digits > low:
            low, high, bits = low << 1, high << 1, bits + 1
            middle = (low + high) >> 1
            if alone is None:
                n = _above(c, middle, bits)
                low, high = (middle, high) if n >= k else (low, middle)
                if low and _above(c, low, bits) == k and _above(c, high, bits) == k - 1 and _sign(c, high, bits):
                    alone = _sign(c, high, bits)
            else:
                s = _sign(c, middle, bits)
                if not s:
                    low = high = middle
                    break
                low, high = (low, middle) if s == alone else (middle, high)
        out.append(Fraction(low + high, 1 << bits + 1))
    return out


def null_vector(matrix: list[list[int]], root: Fraction, found: list[np.ndarray], steps: int = 4) -> np.ndarray:
    """The unit vector that the matrix maps to root times itself, to double precision, its largest entry positive.

    Inverse iteration in doubles at the root, then corrections by the same solver from residuals in integer arithmetic.
    found: vectors that it has to be at right angles to, for repeated roots.
    """
    d = len(matrix)
    exact = np.array(matrix, dtype=object)
    scale = max(1, max(abs(int(x)) for x in exact.ravel()))
    shift = float(root / scale)
    a = np.array([[float(Fraction(int(x), scale)) for x in row] for row in matrix])
    away = 4 * np.finfo(float).eps * max(abs(a).sum(axis=1).max(), 1e-300)
    solver = np.linalg.inv(a - (shift + away) * np.eye(d))

    def straight(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for other in found:
                v = v - (other @ v) * other
        return v / np.linalg.norm(v)

    v = straight(1 + np.cos((len(found) + 1) * np.arange(1, d + 1)))  # another start for each of a repeated root
    for _ in range(steps):
        v = straight(solver @ v)
    one, over = 1 << 80, root.limit_denominator(1 << 200)
    lam = int(over * one)  # the root times 2**80
    for _ in range(steps):
        whole = np.array([int(Fraction(x) * one) for x in v.tolist()], dtype=object)
        left = exact @ whole * one - whole * lam
        r = np.array([float(Fraction(int(x), scale * one * one)) for x in left])
        change = solver @ r
        v = straight(v - (change - (v @ change) * v))
    return v * np.sign(v[np.abs(v).argmax()])
