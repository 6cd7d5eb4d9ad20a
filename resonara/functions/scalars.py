"""Column functions without a counterpart among Spark's built-ins."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded, and never minus zero: for results that are compared."""
    return F.round(x, digits) + F.lit(0.0)


def hann(k: Column, n: int) -> Column:
    """Periodic Hann window of n points at k."""
    return F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(TAU) * k / F.lit(float(n)))


def semitone_distance(from_tonic: Column, to_tonic: Column) -> Column:
    """Shortest way from one pitch class to another in semitones, -6 to 5."""
    return F.pmod(to_tonic - from_tonic + 18, F.lit(12)) - 6


def pcm16(x: Column) -> Column:
    """A sample in 16 bits: clamped to [-1, 1], scaled by 32768 below and 32767 above zero, cut towards zero."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return F.when(c < 0, c * 32768).otherwise(c * 32767).cast("int")


def format_time(sec: Column) -> Column:
    """m:ss; 0:00 where there is no finite number."""
    fine = sec.isNotNull() & ~F.isnan(sec) & (F.abs(sec) < F.lit(1e15))
    whole = F.floor(F.when(fine, sec).otherwise(0.0))
    return F.concat(F.floor(whole / 60).cast("bigint").cast("string"), F.lit(":"), F.lpad(F.pmod(whole, F.lit(60)).cast("bigint").cast("string"), 2, "0"))


def kebab(label: Column) -> Column:
    return F.lower(F.regexp_replace(label, r"\s+", "-"))


def percent(share: Column) -> Column:
    return F.concat(half_up(share * 100).cast("bigint").cast("string"), F.lit("%"))


def _imul(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, which 64 signed bits can't hold whole."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    high = (F.shiftright(a, 16) * b).bitwiseAND(F.lit(0xFFFF))
    return (low.bitwiseAND(F.lit(0xFFFFFFFF)) + F.shiftleft(high, 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def seeded_uniform(seed: int, draw: Column) -> Column:
    """Draw number 0, 1, ... of the counter-based 32-bit generator: each is a function of seed and number alone."""
    mask = F.lit(0xFFFFFFFF)
    step = F.lit(0x6D2B79F5)
    n = draw.cast("bigint") + 1
    a = (F.lit(seed) + (n.bitwiseAND(F.lit(0xFFFF)) * step + F.shiftleft((F.shiftright(n, 16) * step).bitwiseAND(F.lit(0xFFFF)), 16))).bitwiseAND(mask)
    t = _imul(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + _imul(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(mask))
    return t.bitwiseXOR(F.shiftright(t, 14)).cast("double") / F.lit(2.0**32)
