"""Exact numbers: checked rationals, trigonometry in turns, the counter-based generator.

Scalars are ``fractions.Fraction`` whose parts must fit signed 64 bits; anything else is Overflow,
never a rounded value.  Vector forms work on NumPy arrays, with Python integers where 64 bits could
overflow on the way.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

LOW, HIGH = -(2**63), 2**63 - 1


class Overflow(ArithmeticError):
    """A reduced result has a part outside signed 64 bits, or a division by zero."""


def fit(x: Fraction) -> Fraction:
    if not (LOW <= x.numerator <= HIGH and x.denominator <= HIGH):
        raise Overflow(f"{x.numerator}/{x.denominator}")
    return x


def ratio(num: int, den: int = 1) -> Fraction:
    if den == 0:
        raise Overflow("zero denominator")
    return fit(Fraction(num, den))


def add(a: Fraction, b: Fraction) -> Fraction:
    return fit(a + b)


def sub(a: Fraction, b: Fraction) -> Fraction:
    return fit(a - b)


def mul(a: Fraction, b: Fraction) -> Fraction:
    return fit(a * b)


def div(a: Fraction, b: Fraction) -> Fraction:
    if b == 0:
        raise Overflow("division by zero")
    return fit(a / b)


def neg(a: Fraction) -> Fraction:
    return fit(-a)


def floor(a: Fraction) -> Fraction:
    return fit(Fraction(math.floor(a)))


def ceil(a: Fraction) -> Fraction:
    return fit(Fraction(math.ceil(a)))


HALF, QUARTER = Fraction(1, 2), Fraction(1, 4)


def pixel_centre(i: int) -> Fraction:
    return Fraction(2 * i + 1, 2)


#: Scale of the sine, and its odd polynomial over a quarter turn in ten-thousandths.
SINE_SCALE = 32768
SINE_TERMS = (15708, -6459, 794, -43)
SINE_UNIT = 10000


def quarter_sine(num: int, den: int) -> int:
    """Scaled sine at ``num / den`` quarter turns in [0, 1]; all divisions are of non-negative numbers."""
    if num <= 0:
        return 0
    if num >= den:
        return SINE_SCALE
    u = min(SINE_SCALE, (num * SINE_SCALE + den // 2) // den)
    square = u * u // SINE_SCALE
    cube = square * u // SINE_SCALE
    powers = (u, cube, square * square // SINE_SCALE * u // SINE_SCALE, cube * cube // SINE_SCALE * u // SINE_SCALE)
    total = sum(c * p for c, p in zip(SINE_TERMS, powers, strict=True)) + SINE_UNIT // 2
    return max(0, min(SINE_SCALE, total // SINE_UNIT if total >= 0 else -(-total // SINE_UNIT)))


def sin_turns(angle: Fraction) -> Fraction:
    """The sine of an angle in turns, folded to its quadrant."""
    den = angle.denominator
    four = angle.numerator % den * 4
    quadrant, rest = divmod(four, den)
    value = quarter_sine(rest if quadrant % 2 == 0 else den - rest, den)
    return Fraction(value if quadrant < 2 else -value, SINE_SCALE)


def cos_turns(angle: Fraction) -> Fraction:
    return sin_turns(angle + QUARTER)


#: Fixed values of the SplitMix64 generator, and the stride of a walk's seeds.
GAMMA = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
WALK_STRIDE = 0xBF58476D1CE4E5B9
WALK_GRID = 1024
MASK = 2**64 - 1


def mix64(state: np.ndarray) -> np.ndarray:
    """Words of generator states, as uint64 arrays that wrap."""
    z = np.asarray(state, np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
    return z ^ (z >> np.uint64(31))


def words(seed: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """The ``draw``-th word (from 1) of each seed, without the words before it."""
    with np.errstate(over="ignore"):
        return mix64(np.asarray(seed, np.uint64) + np.asarray(draw, np.uint64) * np.uint64(GAMMA))


class Generator:
    """One stream, drawn from in order."""

    def __init__(self, seed: int) -> None:
        self.state = seed & MASK

    def word(self) -> int:
        self.state = (self.state + GAMMA) & MASK
        z = self.state
        z = (z ^ (z >> 30)) * MIX_1 & MASK
        z = (z ^ (z >> 27)) * MIX_2 & MASK
        return z ^ (z >> 31)

    def below(self, bound: int) -> int:
        """Uniform in [0, bound) by masking and rejecting; a bound of one draws nothing."""
        if bound <= 1:
            return 0
        mask = (1 << (bound - 1).bit_length()) - 1
        while (x := self.word() & mask) >= bound:
            pass
        return x

    def unit(self) -> Fraction:
        return Fraction(self.word() >> 2, 1 << 62)


def walk_seed(base: int, step: int) -> int:
    return (base + step * WALK_STRIDE) & MASK


def walk_steps(seed: int, steps: int) -> np.ndarray:
    """(steps, 2) grid displacements of a walk's steps 1..steps, each in [-WALK_GRID, WALK_GRID].

    Every step has a stream of its own, so all are drawn at once; rejected draws are redrawn.
    """
    k = np.arange(1, steps + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        seeds = np.uint64(seed) + k * np.uint64(WALK_STRIDE)
    out = np.zeros((steps, 2), np.int64)
    have = np.zeros(steps, np.int64)
    bound, mask = 2 * WALK_GRID + 1, (1 << (2 * WALK_GRID).bit_length()) - 1
    draw = 1
    while (todo := np.flatnonzero(have < 2)).size:
        x = (words(seeds[todo], np.uint64(draw)) & np.uint64(mask)).astype(np.int64)
        good = x < bound
        rows = todo[good]
        out[rows, have[rows]] = x[good] - WALK_GRID
        have[rows] += 1
        draw += 1
    return out


def blend(src: int, alpha: int, dst: int) -> int:
    return (src * alpha + dst * (255 - alpha) + 127) // 255


def binary32(num: int, den: int) -> int:
    """Bits of the single-precision float nearest to ``num / den`` (both below 2**32), ties to even."""
    if num == 0:
        return 0
    e = num.bit_length() - den.bit_length()
    if num * (1 << max(0, -e)) < den * (1 << max(0, e)):
        e -= 1
    shift = 23 - e
    a, b = (num << shift, den) if shift >= 0 else (num, den << -shift)
    q, r = divmod(a, b)
    if 2 * r > b or 2 * r == b and q & 1:
        q += 1
    if q == 1 << 24:
        q, e = q >> 1, e + 1
    return (e + 127) << 23 | q & 0x7FFFFF


def vector_binary32(num, den) -> np.ndarray:
    """binary32 of arrays: both parts are shifted to 32 bits, one long division leaves 31 or 32 bits of quotient."""
    num, den = (np.asarray(x, np.int64) for x in (num, den))
    if ((num < 0) | (num >= 2**32) | (den < 1) | (den >= 2**32)).any():
        raise Overflow("parts of 32 bits")
    up_n, up_d = (32 - np.frexp(x.astype(np.float64))[1].astype(np.int64) for x in (num, den))
    n, d = (num << up_n).astype(np.uint64), (den << up_d).astype(np.uint64)
    q, r = np.divmod(n << np.uint64(31), d)
    whole = n >= d
    drop = np.where(whole, 8, 7).astype(np.uint64)
    half = np.uint64(1) << (drop - np.uint64(1))
    low, mantissa = q & ((np.uint64(1) << drop) - np.uint64(1)), q >> drop
    mantissa += (low > half) | (low == half) & ((r > 0) | (mantissa & np.uint64(1) == 1))
    e = up_d - up_n - ~whole + 127
    carry = mantissa == 1 << 24
    e, mantissa = e + carry, np.where(carry, mantissa >> np.uint64(1), mantissa).astype(np.int64)
    return np.where(num == 0, 0, e << 23 | mantissa & 0x7FFFFF)


def vector_ratio(op: str, an, ad, bn, bd) -> tuple[np.ndarray, np.ndarray]:
    """(num, den) int64 arrays of a op b for rational arrays; Overflow if any reduced part does not fit.

    Rows whose parts are below 2**31 are done in 64 bits, the others on Python integers.
    """
    an, ad, bn, bd = (np.asarray(x, np.int64) for x in (an, ad, bn, bd))
    if op == "sub":
        an, ad, bn, bd = an, ad, -bn if (bn != LOW).all() else bn.astype(object) * -1, bd
    small = np.ones(len(an), bool)
    for x in (an, ad, bn, bd):
        small &= (x > -(2**31)) & (x < 2**31)

    def raw(an, ad, bn, bd):
        if op in ("add", "sub"):
            return an * bd + bn * ad, ad * bd
        return (an * bn, ad * bd) if op == "mul" else (an * bd, ad * bn)

    num, den = np.zeros(len(an), np.int64), np.ones(len(an), np.int64)
    if small.any():
        n, d = raw(*(x[small].astype(np.int64) for x in (an, ad, bn, bd)))
        if (d == 0).any():
            raise Overflow("division by zero")
        sign = np.sign(d)
        n, d = n * sign, d * sign
        g = np.gcd(n, d)
        num[small], den[small] = n // g, d // g
    for i in np.flatnonzero(~small):
        n, d = raw(int(an[i]), int(ad[i]), int(bn[i]), int(bd[i]))
        r = ratio(n, d)
        num[i], den[i] = r.numerator, r.denominator
    return num, den
