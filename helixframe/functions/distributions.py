"""Distributions and small numerics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def log_factorial(n: Column) -> Column:
    """Natural logarithm of n!."""
    return _sum(F.transform(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), lambda i: F.log(i.cast("double"))))


def poisson(k: Column, mean: Column) -> Column:
    return F.exp(k * F.log(mean) - mean - log_factorial(k))


def poisson_cdf(k: Column, mean: Column) -> Column:
    """Sum of the first k + 1 terms, each from the one before."""
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("total"))
    steps = F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1)))
    run = F.aggregate(steps, start, lambda acc, i: F.struct((acc["term"] * mean / i).alias("term"), (acc["total"] + acc["term"] * mean / i).alias("total")))
    return F.when(k < 0, 0.0).when(k < 1, F.exp(-mean)).otherwise(run["total"])


def choose(n: Column, k: Column) -> Column:
    return F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k))


def binomial(k: Column, n: Column, p: Column) -> Column:
    return choose(n, k) * F.pow(p, k) * F.pow(1 - p, n - k)


def normal_density(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))


def normal_cdf(z: Column) -> Column:
    """Zelen-Severo approximation, absolute error below 1e-7."""
    # The coefficients of the approximation.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(b):
        poly = (poly + c) * t
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def wilson_interval(passes: Column, trials: Column, z: float = 1.96) -> Column:
    """Struct (low, high): the score interval of a proportion."""
    n = trials.cast("double")
    p = passes / n
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    scale = 1 + z * z / n
    return F.struct(((p + z * z / (2 * n) - spread) / scale).alias("low"), ((p + z * z / (2 * n) + spread) / scale).alias("high"))


def normal_boundary(m1: Column, s1: Column, m2: Column, s2: Column, prior: float = 1.0) -> Column:
    """Where two weighted normal densities are equal, between their means; null if nowhere."""
    a = 1 / (s1 * s1) - 1 / (s2 * s2)
    b = 2 * (m2 / (s2 * s2) - m1 / (s1 * s1))
    c = m1 * m1 / (s1 * s1) - m2 * m2 / (s2 * s2) - 2 * F.log(prior * s2 / s1)
    root = F.sqrt(b * b - 4 * a * c)
    within = lambda x: F.when((x >= F.least(m1, m2)) & (x <= F.greatest(m1, m2)), x)
    return F.when(F.abs(a) < 1e-15, within(-c / b)).otherwise(F.coalesce(within((-b + root) / (2 * a)), within((-b - root) / (2 * a))))


def quadratic_roots(a: Column, b: Column, c: Column) -> Column:
    """Array of the two real roots in order, empty if there is none."""
    d = b * b - 4 * a * c
    root = F.sqrt(d)
    return F.when(d >= 0, F.array_sort(F.array((-b - root) / (2 * a), (-b + root) / (2 * a)))).otherwise(F.array().cast("array<double>"))


def gcd(a: Column, b: Column, steps: int = 48) -> Column:
    """Greatest common divisor by Euclid's steps, as many as 64-bit numbers can need in practice."""
    run = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y")), lambda acc, _: F.struct(F.when(acc["y"] == 0, acc["x"]).otherwise(acc["y"]).alias("x"), F.when(acc["y"] == 0, 0).otherwise(acc["x"] % acc["y"]).cast("long").alias("y")))
    return run["x"]
