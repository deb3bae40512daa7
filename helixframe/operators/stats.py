"""Weighted quantiles, histograms and estimates over positive integer columns.

Order statistics run over the table of distinct values and their counts, which a
combinable aggregate makes first, so the one-partition window sees one row per
distinct value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _steps(df: DataFrame, value: str, descending: bool = False) -> DataFrame:
    """value, n, mass (running sum of value * n including this value), total."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    order = F.col("value").desc() if descending else F.col("value").asc()
    w = Window.orderBy(order)
    mass = F.col("value") * F.col("n")
    return counts.select("value", "n", F.sum(mass).over(w).alias("mass"), F.sum(mass).over(Window.partitionBy()).alias("total"), F.lead("value").over(w).alias("next"))


def n50(df: DataFrame, value: str) -> DataFrame:
    """The value at which the running sum (ascending) reaches half; at exactly half the mean with the next, rounded down.

    The running sum passes exact half inside a block of equal values too; then the next value is the same one."""
    rows = _steps(df, value)
    before = F.col("mass") - F.col("value") * F.col("n")
    hit = rows.where((2 * F.col("mass") >= F.col("total")) & (2 * before < F.col("total")))
    both = F.floor((F.col("value") + F.coalesce("next", "value")) / 2)
    return hit.select(F.when(2 * F.col("mass") == F.col("total"), both).otherwise(F.col("value")).cast("long").alias("n50"))


def n_statistics(df: DataFrame, value: str) -> DataFrame:
    """stat (10..90), value: the largest values whose sum reaches that share of the total (integer arithmetic)."""
    rows = _steps(df, value, descending=True)
    targets = rows.select("value", "mass", "total", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("i"))
    target = F.floor(F.col("total") * F.col("i") * 10 / 100).cast("long")
    hit = targets.where(F.col("mass") >= target)
    return hit.groupBy((F.col("i") * 10).cast("long").alias("stat")).agg(F.max("value").alias("value"))


def basic_nstats(df: DataFrame, value: str, percents: tuple[int, ...]) -> DataFrame:
    """stat (percent), value: the largest value such that it and all larger ones make up that share of the total."""
    rows = _steps(df, value, descending=True).select("value", "mass", "total", F.explode(F.array(*(F.lit(p).cast("long") for p in percents))).alias("stat"))
    return rows.where(100 * F.col("mass") >= F.col("total") * F.col("stat")).groupBy("stat").agg(F.max("value").alias("value"))


def median_upper(df: DataFrame, value: str) -> DataFrame:
    """The element n div 2 (from 0) of the sorted values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select("value", F.sum("n").over(Window.orderBy("value")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return rows.where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("value").alias("median"))


def histogram(df: DataFrame, value: str, start: float, width: float, bins: int) -> DataFrame:
    """bin, n: bin 0 below ``start``, then ``bins`` bins of ``width``, the last one open."""
    bin_ = F.when(F.col(value) < start, 0).otherwise(F.least(F.lit(bins), F.floor((F.col(value) - start) / width) + 1))
    return df.where(F.col(value).isNotNull()).groupBy(bin_.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def log_histogram(df: DataFrame, value: str, base: float = 10.0) -> DataFrame:
    """magnitude, n of positive values."""
    return df.where(F.col(value) > 0).groupBy(F.floor(F.log(base, F.col(value)) + 1e-12).cast("long").alias("magnitude")).agg(F.count(F.lit(1)).alias("n"))


def quality_score(correct: Column, wrong: Column) -> Column:
    """-10 log10 of (1 + wrong) / (1 + wrong + correct)."""
    return -10 * F.log10((1.0 + wrong) / (1.0 + wrong + correct))


def weighted_mean(df: DataFrame, value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def combined_normal(mean: str, sd: str) -> tuple[Column, Column]:
    """Inverse-variance weighted mean and its deviation."""
    w = 1 / (F.col(sd) * F.col(sd))
    return F.sum(F.col(mean) * w) / F.sum(w), F.sqrt(1 / F.sum(w))


def library_size(n: float, distinct: float, steps: int = 60) -> float:
    """x with distinct / x - 1 + exp(-n / x) = 0: molecules in a library of which ``n`` draws gave ``distinct`` ones."""
    import math

    if distinct >= n or distinct <= 0:
        return float("nan")
    gap = lambda x: distinct / x - 1 + math.exp(-n / x)
    low, high = distinct, distinct * 10
    while gap(high) >= 0 and high < 1e18:
        high *= 10
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if gap(mid) > 0 else (low, mid)
    return (low + high) / 2


def library_size_column(n: Column, distinct: Column, steps: int = 100) -> Column:
    """``library_size`` as a column: bisection of the logarithm between ``distinct`` and a million times that."""
    start = F.struct(distinct.cast("double").alias("low"), (distinct * 1e6).alias("high"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.sqrt(acc["low"] * acc["high"])
        above = distinct / mid - 1 + F.exp(-n / mid) > 0
        return F.struct(F.when(above, mid).otherwise(acc["low"]).alias("low"), F.when(above, acc["high"]).otherwise(mid).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return F.when((distinct > 0) & (distinct < n), F.sqrt(found["low"] * found["high"]))


def complexity_curve(x: Column, n: Column, distinct: Column, folds: int = 10) -> Column:
    """Array of (fold, yield): distinct molecules expected at z times the draws, relative to now."""
    return F.transform(F.sequence(F.lit(1), F.lit(folds)), lambda z: F.struct(z.alias("fold"), (x * (1 - F.exp(-z * n / x)) / distinct).alias("yield")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter of two arrays."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))
    return dot / F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x)) * total(F.transform(b, lambda y: y.cast("double") * y)))
