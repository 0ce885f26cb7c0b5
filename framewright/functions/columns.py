"""Column expressions for exact integers and rationals; all stay in the JVM.

A rational column is STRUCT<den, num> with den > 0, reduced.  Parts are BIGINT and ANSI arithmetic
raises on overflow; ``functions.arrow`` has the form that is exact up to 64-bit results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.exact import SINE_SCALE, SINE_TERMS, SINE_UNIT

#: Euclid's algorithm on 32-bit numbers takes at most this many steps.
EUCLID_STEPS = 46


def lit(n: int) -> Column:
    return F.lit(n).cast("long")


def div(a: Column, b: Column | int) -> Column:
    """Integer quotient, truncated toward zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else lit(b))


def floordiv(a: Column, b: Column) -> Column:
    return div(a - F.pmod(a, b), b)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of magnitudes below 2**31 (for larger ones use the Arrow form)."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, lit(1)).otherwise(s["b"])).alias("b")))
    start = F.struct(F.greatest(F.abs(a), F.abs(b)).alias("a"), F.least(F.abs(a), F.abs(b)).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(EUCLID_STEPS)), start, step)["a"]


def ratio(num: Column, den: Column) -> Column:
    """num / den reduced; a zero denominator raises."""
    den = F.when(den == 0, F.raise_error(F.lit("zero denominator")).cast("long")).otherwise(den)
    g = gcd(num, den) * F.signum(den).cast("long")
    return F.struct(div(den, g).alias("den"), div(num, g).alias("num"))


def integer(num: Column) -> Column:
    return F.struct(lit(1).alias("den"), num.cast("long").alias("num"))


def r_neg(a: Column) -> Column:
    return F.struct(a["den"].alias("den"), (-a["num"]).alias("num"))


def r_cmp(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by cross products; structs themselves do not order by value."""
    x = a["num"] * b["den"] - b["num"] * a["den"]
    return F.signum(x).cast("int")


def r_floor(a: Column) -> Column:
    return floordiv(a["num"], a["den"])


def r_ceil(a: Column) -> Column:
    return -floordiv(-a["num"], a["den"])


def r_text(a: Column) -> Column:
    return F.concat_ws("/", a["num"], a["den"])


def pixel_centre(i: Column) -> Column:
    return F.struct(lit(2).alias("den"), (2 * i + 1).cast("long").alias("num"))


def sine(num: Column, den: Column, cosine: bool = False) -> Column:
    """Scaled sine (or cosine) of num/den turns: a BIGINT in units of 1/32768."""
    four = F.pmod(num * 4 + (den if cosine else lit(0)), den * 4)
    quadrant, rest = div(four, den), four % den
    up = F.when(quadrant % 2 == 0, rest).otherwise(den - rest)
    # the ends of a quarter give 0 and 1 by the polynomial as well; nothing below stands under a condition, so that
    # generated code works each power out once, not once for each mention
    u = F.when(up <= 0, lit(0)).when(up >= den, lit(SINE_SCALE)).otherwise(F.least(lit(SINE_SCALE), div(up * SINE_SCALE + div(den, 2), den)))
    two = div(u * u, SINE_SCALE)
    three = div(two * u, SINE_SCALE)
    five = div(div(two * two, SINE_SCALE) * u, SINE_SCALE)
    seven = div(div(three * three, SINE_SCALE) * u, SINE_SCALE)
    total = sum((c * p for c, p in zip(SINE_TERMS, (u, three, five, seven), strict=True)), lit(SINE_UNIT // 2))
    return F.greatest(lit(0), F.least(lit(SINE_SCALE), div(total, SINE_UNIT))) * F.when(quadrant < 2, lit(1)).otherwise(lit(-1))


def blend(src: Column, alpha: Column, dst: Column) -> Column:
    return div(src * alpha + dst * (255 - alpha) + 127, 255)


def clamp8(x: Column) -> Column:
    return F.greatest(lit(0), F.least(lit(255), x))


def ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    shift = lambda x: F.shiftright(x.cast("long"), 8)
    return clamp8(shift(77 * r + 150 * g + 29 * b + 128)), clamp8(shift(-43 * r - 85 * g + 128 * b + 128) + 128), clamp8(shift(128 * r - 107 * g - 21 * b + 128) + 128)


def hex_u32(x: Column, little: bool = False) -> Column:
    """Eight hex digits of a 32-bit field."""
    h = F.lower(F.lpad(F.hex(x.cast("long")), 8, "0"))
    return F.regexp_replace(h, "^(..)(..)(..)(..)$", "$4$3$2$1") if little else h
