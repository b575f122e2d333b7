"""Exact eigenvalues and eigenvectors of symmetric integer matrices by their characteristic polynomial.

The polynomial is found modulo many primes under 2^31 (reduction to Hessenberg form, then the recurrence over its
leading minors) and put together by Chinese remaindering; a bound on its coefficients says how many primes are needed.
All roots of a symmetric matrix are real, so the sign changes of the polynomial shifted by a count the roots above a
exactly (Budan-Fourier): bisection with that count isolates the largest roots, whatever their multiplicity, and a simple
root is then narrowed by signs alone. A root's components are the null space of matrix minus root, by inverse iteration
on an LU decomposition. All numbers are Python integers, with a binary point where fractions are needed.

Defined results: only roots above 0 are returned; roots nearer to each other than ``PRECISION`` bits count as one of
that multiplicity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np

# Bits to which a root is known, relative to itself.
PRECISION = 160
# Further bits of the fixed-point numbers of the inverse iteration.
GUARD = 256
TOP_PRIME_BITS = 31


def _is_prime(n: int) -> bool:
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):  # enough below 3,215,031,751
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes() -> Iterator[int]:
    """Primes under 2^31, falling."""
    return (n for n in range(2**TOP_PRIME_BITS - 1, 2 ** (TOP_PRIME_BITS - 1), -2) if _is_prime(n))


def needed_primes(matrix: Sequence[Sequence[int]]) -> list[int]:
    """As many primes as the coefficients need: with roots of 0 or more the k-th is at most C(d, k) (trace / d)^k."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = max(math.comb(d, k) * (trace**k // d**k + 1) for k in range(d + 1))
    chosen, product = [], 1
    for p in primes():
        if product > 2 * bound + 1:
            return chosen
        chosen.append(p)
        product *= p
    raise ValueError("the matrix is too large for primes under 2^31")


def polynomial_mod(matrix: Sequence[Sequence[int]], p: int) -> list[int]:
    """Coefficients modulo p of det(x - matrix), from the constant one up."""
    h = np.array([[int(c) % p for c in row] for row in matrix], dtype=np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        at = m + int(below[0])
        if at != m:
            h[[m, at]] = h[[at, m]]
            h[:, [m, at]] = h[:, [at, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m][None, :] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u[None, :] % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), dtype=np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        factors, below = [int(h[k - 1, k - 1])], 1
        for i in range(1, k):
            below = below * int(h[k - i, k - i - 1]) % p
            factors.append(below * int(h[k - 1 - i, k - 1]) % p)
        minors[k, 1 : k + 1] = minors[k - 1, :k]
        taken = np.array(factors[::-1], dtype=np.int64)[:, None] * minors[:k] % p
        minors[k] = (minors[k] - taken.sum(axis=0)) % p
    return [int(c) for c in minors[d]]


def remaindered(residues: Sequence[tuple[int, Sequence[int]]]) -> list[int]:
    """The coefficients of smallest size that have the given residues (prime, coefficients)."""
    product, found = 1, [0] * len(residues[0][1])
    for p, coefficients in residues:
        inverse = pow(product, -1, p)
        found = [c + product * ((r - c) * inverse % p) for c, r in zip(found, coefficients)]
        product *= p
    return [c - product if 2 * c > product else c for c in found]


def roots_above(coefficients: Sequence[int], at: int, shift: int) -> int:
    """How many roots, with multiplicity, are above at / 2^shift; all must be real."""
    d = len(coefficients) - 1
    c = [x << (shift * (d - k)) for k, x in enumerate(coefficients)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _positive_at(coefficients: Sequence[int], at: int, shift: int) -> int:
    """Sign of the polynomial at at / 2^shift."""
    value, d = 0, len(coefficients) - 1
    for k in range(d, -1, -1):
        value = value * at + (coefficients[k] << (shift * (d - k)))
    return (value > 0) - (value < 0)


def largest_roots(coefficients: Sequence[int], k: int, bound: int) -> list[tuple[int, int, int]]:
    """The largest roots above 0, falling, as (numerator, shift, multiplicity) until ``k`` are counted.

    ``bound`` is no less than any root.
    """
    rank = roots_above(coefficients, 0, 0)
    found: list[tuple[int, int, int]] = []
    open_ = [(0, bound, 0, rank, 0)] if rank else []  # low, high, shift, roots above low, roots above high
    while open_:
        low, high, shift, above_low, above_high = open_.pop()
        if above_high >= k:
            continue
        while above_low - above_high > 1 and (high - low) << PRECISION > low:
            if high - low == 1:
                low, high, shift = 2 * low, 2 * high, shift + 1
            middle = (low + high) // 2
            above = roots_above(coefficients, middle, shift)
            if above_high < above < above_low:
                open_.append((low, middle, shift, above_low, above))
                low, above_low = middle, above
            elif above == above_low:
                low = middle
            else:
                high = middle
        if above_low - above_high == 1:
            above_sign = -1 if above_low % 2 else 1  # the sign between the root and the next one below
            while (high - low) << PRECISION > low:
                if high - low == 1:
                    low, high, shift = 2 * low, 2 * high, shift + 1
                middle = (low + high) // 2
                sign = _positive_at(coefficients, middle, shift)
                if sign == 0:
                    low = high = middle
                elif sign == above_sign:
                    low = middle
                else:
                    high = middle
        found.append((low + high, shift + 1, above_low - above_high))
    return found


def _decomposed(matrix: Sequence[Sequence[int]], root: int, shift: int, bits: int) -> tuple[np.ndarray, list[int]]:
    """LU of matrix - root / 2^shift with row exchanges, numbers with ``bits`` binary places."""
    d = len(matrix)
    a = np.array([[int(c) << bits for c in row] for row in matrix], dtype=object)
    for i in range(d):
        a[i, i] -= root << (bits - shift)
    rows = list(range(d))
    for k in range(d):
        at = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if at != k:
            a[[k, at]] = a[[at, k]]
            rows[k], rows[at] = rows[at], rows[k]
        if a[k, k] == 0:
            a[k, k] = 1
        if k + 1 < d:
            factors = (a[k + 1 :, k] << bits) // a[k, k]
            a[k + 1 :, k + 1 :] -= (factors[:, None] * a[k, k + 1 :][None, :]) >> bits
            a[k + 1 :, k] = factors
    return a, rows


def _solved(lu: np.ndarray, rows: list[int], b: list[int], bits: int) -> list[int]:
    d = len(b)
    x = np.array([b[i] for i in rows], dtype=object)
    for k in range(1, d):
        x[k] -= sum(lu[k, :k] * x[:k]) >> bits
    for k in range(d - 1, -1, -1):
        x[k] = ((x[k] - (sum(lu[k, k + 1 :] * x[k + 1 :]) >> bits)) << bits) // lu[k, k]
    return list(x)


def _unit(x: list[int], bits: int) -> list[int]:
    size = math.isqrt(sum(c * c for c in x))
    return [(c << bits) // size for c in x]


def null_vectors(matrix: Sequence[Sequence[int]], root: int, shift: int, multiplicity: int) -> list[list[float]]:
    """Orthonormal vectors, as many as ``multiplicity``, that matrix - root / 2^shift sends to (nearly) zero.

    The sign is such that the largest entry is positive.
    """
    d, bits = len(matrix), shift + PRECISION + GUARD
    lu, rows = _decomposed(matrix, root, shift, bits)
    found: list[list[int]] = []
    state = 1
    for _ in range(multiplicity):
        x = []
        for _ in range(d):  # any start that is not orthogonal to the null space
            state = state * 6364136223846793005 % 2**64 + 1442695040888963407
            x.append((state >> 33) + 1)
        for _ in range(3):
            x = _solved(lu, rows, x, bits)
            for v in found:
                along = sum(a * b for a, b in zip(x, v)) >> bits
                x = [a - ((along * b) >> bits) for a, b in zip(x, v)]
            x = _unit(x, bits)
        found.append(x)
    signed = [v if max(v, key=abs) > 0 else [-c for c in v] for v in found]
    return [[c / (1 << bits) for c in v] for v in signed]
