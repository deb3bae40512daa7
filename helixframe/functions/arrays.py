"""Column expressions over arrays: containment, order, co-sorting, overlaps, subsets, combinations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def meets(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def position(a: Column, value: Column) -> Column:
    """First place from 0, -1 if there is none."""
    return F.array_position(a, value) - 1


def is_ordered(a: Column, strictly: bool = False) -> Column:
    """Whether no entry is below (or, strictly, at) the one before."""
    pairs = F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x < y if strictly else x <= y)
    return F.forall(pairs, lambda x: x)


def sorted_together(key: Column, *others: Column, descending: bool = False, unique: bool = False) -> list[Column]:
    """The arrays in the order of the first one, ties in the order of the others; with ``unique`` the first entry of each key."""
    zipped = F.arrays_zip(key.alias("k"), *(o.alias(f"o{i}") for i, o in enumerate(others)))
    rows = F.sort_array(zipped, asc=not descending)
    if unique:
        rows = F.filter(rows, lambda x, i: (i == 0) | (x.getField("k") != F.get(rows, i - 1).getField("k")))
    return [rows.getField(n) for n in ["k", *(f"o{i}" for i in range(len(others)))]]


def overlap_size(a: Column, b: Column) -> Column:
    """The largest n for which the last n entries of ``a`` are the first n of ``b``."""
    most = F.least(F.size(a), F.size(b))
    return F.array_max(F.filter(F.sequence(F.lit(0), most), lambda n: (n == 0) | (F.slice(a, F.size(a) - n + 1, n) == F.slice(b, 1, n))))


def overlap_append(a: Column, b: Column) -> Column:
    """``a`` and what ``b`` adds behind their overlap."""
    n = overlap_size(a, b)
    return F.concat(a, F.slice(b, n + 1, F.size(b) - n))


def combinations(n: int, k: int) -> Column:
    """All sets of k of n things (n at most 20) as bit masks."""
    if not 0 <= k <= n <= 20:
        raise ValueError("0 <= k <= n <= 20")
    return F.filter(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda m: F.bit_count(m) == k)


def power_of_two_at_least(n: Column) -> Column:
    """The least power of two that is no less than n >= 1."""
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long") - 1))))


def polynomial(x: Column, *coefficients: float) -> Column:
    """a0 + a1 x + a2 x^2 ..., by Horner's rule."""
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + F.lit(float(c))
    return out


def quadratic_roots(a: float, b: float, c: float) -> list[float]:
    """The real roots in order."""
    if a == 0:
        return [] if b == 0 else [-c / b]
    d = b * b - 4 * a * c
    return [] if d < 0 else sorted({(-b - d**0.5) / (2 * a), (-b + d**0.5) / (2 * a)})
