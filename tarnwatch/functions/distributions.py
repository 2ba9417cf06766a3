"""Tails of distributions and deviates from hashes, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def erfc(x: Column, terms: int = 80) -> Column:
    """The complementary error function of x >= 0: a series below 2, a continued fraction above."""
    zero = F.struct((x * 1.0).alias("t"), (x * 1.0).alias("s"))

    def step(a: Column, k: Column) -> Column:
        t = a["t"] * (2 * x * x) / (2 * k + 1)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * F.aggregate(F.sequence(F.lit(1), F.lit(terms)), zero, step)["s"]
    fraction = F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), F.lit(0.0), lambda a, k: k * F.lit(0.5) / (x + a))
    far = F.exp(-x * x) / (math.sqrt(math.pi) * (x + fraction))
    return F.when(x < 2, near).otherwise(far)


def chi2_tail(x: Column, degrees: Column) -> Column:
    """The chance that chi squared of whole degrees of freedom passes x >= 0: the regularised upper
    incomplete gamma function at degrees / 2, which for whole and half numbers is a finite sum. The
    sum's terms are kept as logarithms, so that none is lost to a small leading one."""
    h = x / 2
    whole = degrees % 2 == 0
    # Even: exp(-h) h^j / j! for j from 0 on. Odd: erfc(sqrt(h)) and exp(-h) h^(j - 1/2) / Gamma(j + 1/2) from 1 on.
    first = F.when(whole, -h).otherwise(0.5 * F.ln(h) - h - math.log(math.sqrt(math.pi) / 2))
    n = F.when(whole, degrees / 2).otherwise((degrees - 1) / 2).cast("int")
    zero = F.struct(first.alias("t"), F.when(n > 0, F.exp(first)).otherwise(0.0).alias("s"))

    def step(a: Column, j: Column) -> Column:
        t = a["t"] + F.ln(h) - F.ln(j + F.when(whole, 0.0).otherwise(0.5))
        return F.struct(t.alias("t"), F.when(j < n, a["s"] + F.exp(t)).otherwise(a["s"]).alias("s"))

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), zero, step)["s"]
    p = total + F.when(whole, 0.0).otherwise(erfc(F.sqrt(h)))
    return F.when(x <= 0, 1.0).otherwise(F.least(p, F.lit(1.0)))


def kolmogorov_tail(distance: Column, n1: Column, n2: Column, terms: int = 40) -> Column:
    """The two-sided p of the largest distance of two empirical distribution functions by
    Kolmogorov's series, with the effective number of rows and Stephens' correction for few."""
    n = F.sqrt(F.try_divide(n1.cast("double") * n2, n1.cast("double") + n2))
    x = (n + 0.12 + 0.11 / n) * distance
    over = F.sequence(F.lit(1), F.lit(terms))
    # Both series hold for every x; each is short on its side.
    far = 2 * F.aggregate(over, F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x))
    near = 1 - math.sqrt(2 * math.pi) / x * F.aggregate(over, F.lit(0.0), lambda a, k: a + F.exp(-((2 * k - 1) * (2 * k - 1)) * F.lit(math.pi**2 / 8) / (x * x)))
    return F.when(x < 1e-3, 1.0).when(x < 1.18, near).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), far)))


def uniform(*key: Column | str) -> Column:
    """In (0, 1), by hash of a key: a repeated task draws the same."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 40)) + 0.5) / (1 << 40)


def normal_deviate(u: Column, v: Column) -> Column:
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def student_deviate(u: Column, v: Column, degrees: float) -> Column:
    """Student's t from two uniform numbers, by Bailey's polar form."""
    return F.sqrt(degrees * (F.pow(u, F.lit(-2.0 / degrees)) - 1)) * F.cos(2 * math.pi * v)


def cauchy_deviate(u: Column) -> Column:
    return F.tan(math.pi * (u - 0.5))
