"""Centred windows, runs and peaks over ordered columns.  Each works per partition key, which bounds a sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def centred(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, radius: int) -> DataFrame:
    """Adds win_min, win_max, win_sum, win_mean over ``radius`` rows on either side, fewer at the ends."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-radius, radius)
    return df.withColumns({f"win_{k}": f(value).over(w) for k, f in (("min", F.min), ("max", F.max), ("sum", F.sum), ("mean", F.avg))})


def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """by..., run, value, n, first, last: maximal runs of equal values (nulls are equal)."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    marked = df.withColumn("run", F.sum(change.cast("long")).over(w))
    return marked.groupBy(*by, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def peaks(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, shoulder: int) -> DataFrame:
    """Rows that are the strict maximum of what lies within ``shoulder`` rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    left = F.max(value).over(w.rowsBetween(-shoulder, -1))
    right = F.max(value).over(w.rowsBetween(1, shoulder))
    marked = df.withColumns({"__l": left, "__r": right})
    return marked.where((F.col("__l").isNull() | (F.col(value) > F.col("__l"))) & (F.col("__r").isNull() | (F.col(value) > F.col("__r")))).drop("__l", "__r")


def best_against_second(df: DataFrame, by: Sequence[str], errors: str, ties: Sequence[str], most: int, margin: int) -> DataFrame:
    """The best row per key if it has at most ``most`` errors and the second is more than ``margin`` worse."""
    w = Window.partitionBy(*by).orderBy(errors, *ties)
    ranked = df.withColumns({"__rank": F.row_number().over(w), "second": F.lead(errors).over(w)})
    return ranked.where((F.col("__rank") == 1) & (F.col(errors) <= most) & (F.col("second").isNull() | (F.col("second") - F.col(errors) > margin))).drop("__rank")
