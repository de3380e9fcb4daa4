"""Exact characteristic polynomial, real roots and components of an integer positive semidefinite matrix.

Matrices are numpy arrays of Python integers, polynomials lists of integers from the highest power down. The parts that grow with
the dimension (one residue polynomial for each prime, one component for each root) are separate functions, so that Spark can deal them out.
"""

from __future__ import annotations

import math

import numpy as np

#: Bits to which a root is isolated, relative to itself, and bits behind the point in the inverse iteration.
ROOT_BITS, FIXED_BITS = 200, 288


def is_prime(n: int) -> bool:
    """Miller-Rabin with the bases that decide every n below 2^32."""
    if n < 2 or n % 2 == 0:
        return n == 2
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 7, 61):
        if n == a:
            return True
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(matrix: np.ndarray) -> list[int]:
    """Primes under 2^31 whose product exceeds twice every coefficient.

    The coefficients of a positive semidefinite matrix add up to det(I + M), at most (1 + trace / d)^d.
    """
    d = len(matrix)
    bound = 2 * (1 + sum(int(matrix[i, i]) for i in range(d)) // d + 1) ** d
    found, product, p = [], 1, 2**31 - 1
    while product <= bound:
        if is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def residue_polynomial(matrix: np.ndarray, p: int) -> list[int]:
    """Characteristic polynomial modulo p: similarity to Hessenberg form, then the recurrence of its leading minors."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for k in range(d - 2):
        rows = np.nonzero(h[k + 1:, k])[0]
        if not len(rows):
            continue
        i = k + 1 + int(rows[0])
        if i != k + 1:
            h[[i, k + 1]] = h[[k + 1, i]]
            h[:, [i, k + 1]] = h[:, [k + 1, i]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(axis=1)) % p
    minors = [np.zeros(d + 1, np.int64)]  # of the leading blocks, from the constant up
    minors[0][0] = 1
    for m in range(d):
        own = np.roll(minors[m], 1)
        own = (own - int(h[m, m]) * minors[m]) % p
        chain = 1
        for i in range(1, m + 1):
            chain = chain * int(h[m - i + 1, m - i]) % p
            if not chain:
                break
            own = (own - chain * int(h[m - i, m]) % p * minors[m - i]) % p
        minors.append(own)
    return minors[d][::-1].tolist()


def from_residues(primes: list[int], polynomials: list[list[int]]) -> list[int]:
    """The integer polynomial with these residues and coefficients of least size (Chinese remainders)."""
    product = math.prod(primes)
    parts = [(product // p) * pow(product // p % p, -1, p) for p in primes]
    out = []
    for residues in zip(*polynomials):
        x = sum(r * w for r, w in zip(residues, parts)) % product
        out.append(x - product if 2 * x > product else x)
    return out


def derivative(f: list[int]) -> list[int]:
    k = len(f) - 1
    return [c * (k - i) for i, c in enumerate(f[:-1])]


def primitive(f: list[int]) -> list[int]:
    at = next((i for i, c in enumerate(f) if c), len(f))
    f = f[at:]
    g = math.gcd(*f) if f else 1
    return [c // g for c in f] if not f or f[0] > 0 else [-c // g for c in f]


def remainder(a: list[int], b: list[int]) -> list[int]:
    """Pseudo-remainder of a by b, primitive."""
    a = list(a)
    while len(a) >= len(b):
        lead = a[0]
        a = [x * b[0] - lead * (b[i] if i < len(b) else 0) for i, x in enumerate(a)][1:]
        a = primitive(a) if a and not a[0] else a
        if a and len(a) >= len(b):
            a = primitive(a)
        if not a:
            break
    return primitive(a)


def common(a: list[int], b: list[int]) -> list[int]:
    """Greatest common divisor of two integer polynomials, primitive."""
    a, b = primitive(a), primitive(b)
    while b:
        a, b = b, remainder(a, b)
    return a


def quotient(a: list[int], b: list[int]) -> list[int]:
    """a / b, primitive, where b divides a over the rationals."""
    scale = b[0] ** (len(a) - len(b) + 1)
    a, out = [c * scale for c in a], []
    while len(a) >= len(b):
        q = a[0] // b[0]
        out.append(q)
        a = [x - q * (b[i] if i < len(b) else 0) for i, x in enumerate(a)][1:]
    return primitive(out)


def square_free(f: list[int]) -> list[tuple[list[int], int]]:
    """Factors with simple roots and the multiplicity each stands for (Yun)."""
    f, out, m = primitive(f), [], 1
    g = common(f, derivative(f))
    w = quotient(f, g)
    while len(w) > 1:
        y = common(w, g)
        part = quotient(w, y)
        if len(part) > 1:
            out.append((part, m))
        w, g, m = y, quotient(g, y), m + 1
    return out


def simple_modulo(f: list[int], p: int) -> bool:
    """Whether f has no repeated factor modulo p, which proves that it has none at all."""
    a, b = [c % p for c in f], [c % p for c in derivative(f)]
    if not a[0]:
        return False
    while True:
        while b and not b[0]:
            b = b[1:]
        if not b:
            return len(a) == 1
        inverse = pow(b[0], -1, p)
        while len(a) >= len(b):
            q = a[0] * inverse % p
            a = [(x - q * (b[i] if i < len(b) else 0)) % p for i, x in enumerate(a)][1:]
        a, b = b, a


def roots_above(f: list[int], at: int, shift: int) -> int:
    """Roots of f above at / 2^shift: sign changes after moving the point to zero, exact where all roots are real (Descartes)."""
    a = [c << (shift * i) for i, c in enumerate(f)]
    for end in range(len(a), 1, -1):
        for j in range(1, end):
            a[j] += a[j - 1] * at
    signs = [c > 0 for c in a if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def sign_at(f: list[int], at: int, shift: int) -> int:
    value = 0
    for i, c in enumerate(f):
        value = value * at + (c << (shift * i))
    return (value > 0) - (value < 0)


def isolate(f: list[int], most: int, bits: int = ROOT_BITS) -> list[tuple[int, int]]:
    """The largest `most` roots of f (simple, real, positive) from above, each as (n, shift) for n / 2^shift."""
    bound = 1 << max(1, max(-(-(abs(c).bit_length() - abs(f[0]).bit_length() + 1) // i) for i, c in enumerate(f) if i and c) + 1)
    stack, found = [(0, bound, 0, roots_above(f, 0, 0), 0)], []
    while stack and len(found) < most:
        lo, hi, shift, above_lo, above_hi = stack.pop()  # the part that lies highest comes off first
        inside = above_lo - above_hi
        if not inside:
            continue
        if inside == 1:
            found.append(refine(f, lo, hi, shift, bits))
            continue
        if hi - lo == 1:
            lo, hi, shift = 2 * lo, 2 * hi, shift + 1
        mid = (lo + hi) // 2
        above = roots_above(f, mid, shift)
        stack += [(lo, mid, shift, above_lo, above), (mid, hi, shift, above, above_hi)]
    return found


def refine(f: list[int], lo: int, hi: int, shift: int, bits: int) -> tuple[int, int]:
    """The one root in (lo, hi] / 2^shift to `bits` bits of its own size, by the sign of f."""
    top = sign_at(f, hi, shift)
    if not top:
        return hi, shift
    while hi.bit_length() - (hi - lo).bit_length() < bits:
        if hi - lo < 4:
            lo, hi, shift = lo << 32, hi << 32, shift + 32
        mid = (lo + hi) // 2
        s = sign_at(f, mid, shift)
        if not s:
            return mid, shift
        lo, hi = (lo, mid) if s == top else (mid, hi)
    return lo + hi, shift + 1


def largest_roots(f: list[int], most: int) -> list[tuple[int, int, int]]:
    """(n, shift, multiplicity) of the largest positive roots of a polynomial with real roots, from above, `most` of them by multiplicity."""
    f = primitive(f)
    while f and not f[-1]:
        f = f[:-1]  # roots that are exactly zero
    if len(f) < 2:
        return []
    simple = any(simple_modulo(f, p) for p in (2**31 - 1, 2147483629, 2147483587))
    factors = [(f, 1)] if simple else square_free(f)
    found = [(n, shift, m) for part, m in factors for n, shift in isolate(part, most)]
    deepest = max(shift for _, shift, _ in found)
    found.sort(key=lambda r: -(r[0] << (deepest - r[1])))
    out, count = [], 0
    for r in found:
        if count >= most:
            break
        out.append(r)
        count += r[2]
    return out


def eigenvectors(matrix: np.ndarray, n: int, shift: int, many: int, bits: int = FIXED_BITS) -> np.ndarray:
    """Orthonormal basis (columns) of the null space of M - n / 2^shift, of dimension `many`: inverse iteration in fixed point.

    Elimination with row pivots in integers with `bits` bits behind the point; the solved block is scaled and solved again, then rounded to doubles.
    """
    d = len(matrix)
    a = np.array([[int(x) << bits for x in row] for row in matrix], dtype=object)
    root = (n << bits) >> shift
    for i in range(d):
        a[i, i] -= root
    seed, x = 12345, np.empty((d, many), dtype=object)
    for i in range(d):
        for j in range(many):
            seed = (seed * 6364136223846793005 + 1442695040888963407) % 2**64
            x[i, j] = ((seed >> 32) - 2**31) << (bits - 32)
    steps = []
    for k in range(d):
        best = k + int(np.argmax([abs(v) for v in a[k:, k]]))
        if best != k:
            a[[k, best]] = a[[best, k]]
        pivot = a[k, k] if a[k, k] else 1
        a[k, k] = pivot
        u = (a[k + 1:, k] << bits) // pivot
        a[k + 1:, k + 1:] -= (u[:, None] * a[k, k + 1:][None, :]) >> bits
        steps.append((best, u))
    for _ in range(2):
        for k, (best, u) in enumerate(steps):
            if best != k:
                x[[k, best]] = x[[best, k]]
            x[k + 1:] -= (u[:, None] * x[k][None, :]) >> bits
        for k in range(d - 1, -1, -1):
            rest = x[k] << bits
            for j in range(many):
                rest[j] -= int(np.dot(a[k, k + 1:], x[k + 1:, j])) if k + 1 < d else 0
            x[k] = rest // a[k, k]
        for j in range(many):
            size = max(abs(v) for v in x[:, j]).bit_length()
            x[:, j] = [v >> (size - bits) if size > bits else v << (bits - size) for v in x[:, j]]
    out = np.empty((d, many))
    for j in range(many):
        for other in range(j):  # exact enough before rounding: whole numbers of `bits` bits
            dot, own = int(np.dot(x[:, j], x[:, other])), int(np.dot(x[:, other], x[:, other]))
            x[:, j] -= (x[:, other] * dot) // own
        norm = math.isqrt(int(np.dot(x[:, j], x[:, j])))
        out[:, j] = [v / norm for v in x[:, j]]
        out[:, j] *= 1.0 if out[np.argmax(abs(out[:, j])), j] > 0 else -1.0
    return out
