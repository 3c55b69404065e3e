"""Eigenvalues and eigenvectors of an integer symmetric matrix through its exact characteristic polynomial."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Sequence
from fractions import Fraction

import numpy as np

RELATIVE_BITS = 128  # of a root
GUARD_BITS = 320  # fraction bits of the fixed-point solver


def primes_below(top: int) -> Iterable[int]:
    """Primes in falling order; the bases decide every number below 2**32."""
    for n in range(top - 1, 2, -1):
        if n % 2 == 0 or any(n % q == 0 and n != q for q in (3, 5, 7, 11, 13)):
            continue
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 7, 61):
            x = pow(base, odd, n)
            if base % n and x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
                break
        else:
            yield n


def primes_for(dims: int, trace: int) -> list[int]:
    """Primes whose product exceeds twice every coefficient of a positive semidefinite matrix's polynomial.

    The k-th coefficient is at most C(dims, k) (trace / dims)**k, by Maclaurin's inequality.
    """
    most = max(math.comb(dims, k) * trace**k // dims**k for k in range(dims + 1)) + 1
    found, product = [], 1
    for p in primes_below(1 << 31):
        if product > 2 * most + 1:
            break
        found.append(p)
        product *= p
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(xI - matrix) modulo a prime below 2**31, constant first, by Hessenberg reduction."""
    h, n = matrix.astype(np.int64) % p, len(matrix)
    for k in range(n - 2):
        pivots = np.flatnonzero(h[k + 1 :, k])
        if not len(pivots):
            continue
        r = k + 1 + int(pivots[0])
        if r != k + 1:  # a similarity: rows and columns
            h[[k + 1, r]] = h[[r, k + 1]]
            h[:, [k + 1, r]] = h[:, [r, k + 1]]
        f = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - f[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * f % p).sum(axis=1)) % p
    found = np.zeros((n + 1, n + 1), dtype=np.int64)  # found[k]: of the leading k x k block
    found[0, 0] = 1
    for k in range(1, n + 1):
        weights, product = np.zeros(k, dtype=np.int64), 1
        for i in range(k - 1, -1, -1):  # h[i, k-1] times the subdiagonal below it
            weights[i] = int(h[i, k - 1]) * product % p
            if i:
                product = product * int(h[i, i - 1]) % p
        found[k, 1:] = found[k - 1, :-1]
        found[k] = (found[k] - (weights[:, None] * found[:k] % p).sum(axis=0)) % p
    return found[n].tolist()


def combine(residues: dict[int, Sequence[int]]) -> list[int]:
    """Signed integers from their residues modulo primes (Chinese remaindering)."""
    values, product = None, 1
    for p, found in sorted(residues.items()):
        if values is None:
            values = list(found)
        else:
            inverse = pow(product, -1, p)
            values = [v + product * ((r - v) * inverse % p) for v, r in zip(values, found)]
        product *= p
    return [v - product if 2 * v > product else v for v in values or [1]]


class RealRoots:
    """Roots of a polynomial whose roots are all real and not negative, counted and isolated exactly."""

    def __init__(self, coefficients: Sequence[int]):
        self.zeros = next(i for i, c in enumerate(coefficients) if c)
        self.c = list(coefficients[self.zeros :])

    def _scaled(self, bits: int) -> list[int]:
        """The polynomial in y = 2**bits x, times a power of two."""
        n = len(self.c) - 1
        return [c << bits * (n - i) for i, c in enumerate(self.c)]

    def above(self, place: int, bits: int) -> int:
        """Roots greater than place / 2**bits, with multiplicity: where all roots are real, Descartes' rule is exact."""
        c = self._scaled(bits)
        n = len(c)
        for i in range(n - 1):  # shift the variable by place
            for j in range(n - 2, i - 1, -1):
                c[j] += place * c[j + 1]
        signs = [x > 0 for x in c if x]
        return sum(a != b for a, b in zip(signs, signs[1:]))

    def _sign(self, place: int, bits: int) -> int:
        value, n = 0, len(self.c) - 1
        for i in range(n, -1, -1):
            value = value * place + (self.c[i] << bits * (n - i))
        return (value > 0) - (value < 0)

    def largest(self, count: int) -> list[tuple[Fraction, int]]:
        """The largest positive roots with multiplicities, falling, at least ``count`` in all where there are as many.

        Intervals of width 2**-bits are halved until each holds one root, then by the polynomial's sign; roots that
        stay together to RELATIVE_BITS bits are one multiple root.
        """
        positive = len(self.c) - 1
        if not positive:
            return []
        top = 1 << (-self.c[-2] // self.c[-1]).bit_length()  # above the sum of the roots
        while top > 1 and not self.above(top // 2, 0):
            top //= 2
        found: list[tuple[Fraction, int]] = []
        parts = [(0, top, 0, positive, 0)]  # low, high, bits, roots above low, roots above high
        while parts and sum(m for _, m in found) < count:
            low, high, bits, n_low, n_high = parts.pop()
            inside = n_low - n_high
            if not inside:
                continue
            if inside == 1:
                found.append((self._refined(low, high, bits), 1))
                continue
            if low and (high - low) << RELATIVE_BITS <= low:
                found.append((Fraction(low + high, 2 << bits), inside))
                continue
            if high - low == 1:
                low, high, bits = 2 * low, 2 * high, bits + 1
            middle = (low + high) // 2
            n = self.above(middle, bits)
            parts += [(low, middle, bits, n_low, n), (middle, high, bits, n, n_high)]
        return found

    def _refined(self, low: int, high: int, bits: int) -> Fraction:
        """The one root in (low, high], to RELATIVE_BITS bits."""
        right = self._sign(high, bits)
        if right == 0:
            return Fraction(high, 1 << bits)
        while not low or (high - low) << RELATIVE_BITS > low:
            if high - low == 1:
                low, high, bits = 2 * low, 2 * high, bits + 1
            middle = (low + high) // 2
            sign = self._sign(middle, bits)
            if sign == 0:
                return Fraction(middle, 1 << bits)
            if sign == right:
                high = middle
            else:
                low = middle
        return Fraction(low + high, 2 << bits)


def null_vectors(matrix: Sequence[Sequence[int]], root: Fraction, count: int) -> list[list[float]]:
    """``count`` orthonormal vectors that matrix - root I (nearly) annuls, by inverse iteration in fixed point."""
    n, one = len(matrix), 1 << GUARD_BITS
    shift = root.numerator * one // root.denominator
    a = [[x << GUARD_BITS for x in row] for row in matrix]
    for i in range(n):
        a[i][i] -= shift
    order = list(range(n))
    for k in range(n):
        r = max(range(k, n), key=lambda i: abs(a[i][k]))
        a[k], a[r], order[k], order[r] = a[r], a[k], order[r], order[k]
        top = a[k]
        if not top[k]:
            top[k] = 1  # as small as numbers get
        for i in range(k + 1, n):
            row = a[i]
            if row[k]:
                f = row[k] = (row[k] << GUARD_BITS) // top[k]
                for j in range(k + 1, n):
                    row[j] -= f * top[j] >> GUARD_BITS
    rng, found = random.Random(n), []
    for _ in range(count):
        v = [rng.randrange(-one, one) for _ in range(n)]
        for _ in range(3):
            v = [v[i] for i in order]
            for i in range(n):
                v[i] -= sum(f * x for f, x in zip(a[i][:i], v)) >> GUARD_BITS
            for i in range(n - 1, -1, -1):
                rest = (v[i] << GUARD_BITS) - sum(f * x for f, x in zip(a[i][i + 1 :], v[i + 1 :]))
                v[i] = rest // a[i][i]
            v = _unit(v)
            for u in found * 2:
                along = sum(x * y for x, y in zip(u, v)) >> GUARD_BITS
                v = [y - (along * x >> GUARD_BITS) for x, y in zip(u, v)]
            v = _unit(v)
        found.append(v)
    return [[x / one for x in _upright(v)] for v in found]


def _unit(v: list[int]) -> list[int]:
    size = max(abs(x) for x in v).bit_length()
    v = [x << GUARD_BITS - size if size <= GUARD_BITS else x >> size - GUARD_BITS for x in v]
    length = math.isqrt(sum(x * x for x in v))
    return [(x << GUARD_BITS) // length for x in v]


def _upright(v: list[int]) -> list[int]:
    """The sign with which the largest entry (the first of equals) is positive."""
    return v if max(v, key=abs) >= 0 else [-x for x in v]
