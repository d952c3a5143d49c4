"""Whole numbers of any size as columns: canonical decimal text, worked on in limbs of nine digits.

A value is its shortest text: no plus sign, no leading zeros, no minus before zero. Comparisons look at sign, length and
digits; remainders fold over limbs; texts with the prefixes 0x, 0o and 0b are brought to decimal by folding over their
digits with an array of limbs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import _DIGITS, bound, trimmed

LIMB = 9
_BASE = 10**LIMB


def limbs(digits: Column) -> Column:
    """Limbs of decimal digits, the lowest first."""
    n = F.ceil(F.length(digits) / LIMB).cast("int")
    part = lambda i: F.substring(digits, F.greatest(F.length(digits) - (i + 1) * LIMB + 1, F.lit(1)), F.least(F.length(digits) - i * LIMB, F.lit(LIMB)))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: part(i).cast("long"))


def text_of(limbs: Column) -> Column:
    """Digits of limbs, the lowest first."""
    padded = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), LIMB, F.lit("0"))), "")
    return F.regexp_replace(padded, "^0+(?=.)", "")


def _times_plus(a: Column, times: int, plus: Column) -> Column:
    """limbs * times + plus, with carries."""
    def add(s: Column, x: Column) -> Column:
        whole = x * times + s["carry"]
        return F.struct(F.concat(s["out"], F.array(whole % _BASE)).alias("out"), F.floor(whole / _BASE).cast("long").alias("carry"))

    start = F.struct(F.array().cast("array<bigint>").alias("out"), plus.cast("long").alias("carry"))
    return F.aggregate(a, start, add, lambda s: F.when(s["carry"] > 0, F.concat(s["out"], F.array(s["carry"]))).otherwise(s["out"]))


def canonical(s: Column) -> Column:
    """Text to a whole number's canonical text: empty is 0, no fractions; null if it is none."""
    t = trimmed(s)

    def plain(t: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(t, "^[+-]", ""), "^0+(?=.)", "")
        out = F.when(t == "", F.lit("0")).when(t.rlike(r"^[+-]?\d+\z"), F.concat(F.when(t.startswith("-") & (digits != "0"), F.lit("-")).otherwise(F.lit("")), digits))
        for base, (letters, kinds) in _DIGITS.items():
            each = F.filter(F.split(F.substring(t, 3, 2147483647), ""), lambda c: c != "")
            zero = F.array(F.lit(0).cast("long"))
            made = F.aggregate(each, zero, lambda a, c: _times_plus(a, base, F.conv(c, 16, 10).cast("long")))  # noqa: B023
            out = out.when(t.rlike(rf"^0[{letters}][{kinds}]+\z"), text_of(made))
        return out

    return bound(t, plain)


def compared(x: Column, to: int) -> Column:
    """-1, 0 or 1: a canonical text against a number."""
    digits, n = F.regexp_replace(x, "^-", ""), str(abs(to))
    size = F.when(F.length(digits) != len(n), F.when(F.length(digits) > len(n), 1).otherwise(-1)).when(digits == n, 0).when(digits > n, 1).otherwise(-1)
    if to < 0:
        return F.when(~x.startswith("-"), 1).otherwise(-size)
    return F.when(x.startswith("-"), -1).otherwise(size)


def is_multiple(x: Column, of: int) -> Column:
    if of >= 10**18:
        raise ValueError("remainders are of numbers under 10 ** 18")
    big = "decimal(38,0)"
    rest = F.aggregate(F.reverse(limbs(F.regexp_replace(x, "^-", ""))), F.lit(0).cast(big), lambda a, l: ((a * F.lit(_BASE).cast("decimal(10,0)") + l) % F.lit(of).cast("decimal(18,0)")).cast(big))
    return rest == 0
