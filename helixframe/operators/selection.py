"""Row selection, renumbering, sampling and line tools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.graph import cut


def by_ids(df: DataFrame, ids: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Rows whose key is (or is not) in a one-column table of ids."""
    return df.join(ids.distinct(), key, "left_semi" if keep else "left_anti")


def by_header(df: DataFrame, column: str, text: str, complement: bool = False) -> DataFrame:
    found = F.col(column).contains(text)
    return df.where(~found if complement else found)


def sparse(df: DataFrame, keep: Column, value: str) -> DataFrame:
    """All rows, with ``value`` emptied where ``keep`` does not hold."""
    return df.withColumn(value, F.when(keep, F.col(value)).otherwise(""))


def portable_hash(key: Column, seed: int = 0) -> Column:
    """A hash of an integer that other engines can also compute: two linear steps modulo a prime."""
    prime = 2_147_483_647
    once = F.pmod(F.pmod(key, F.lit(prime)) * 48_271 + (seed + 11), F.lit(prime))
    return F.pmod(once * 69_621 + 7, F.lit(prime))


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by hash order: the same rows on every run and cluster (a top-n, not a sort of everything)."""
    return df.orderBy(portable_hash(F.col(key), seed), key).limit(n)


def sample_up_to(df: DataFrame, key: str, weight: str, target: int, seed: int = 0, bins: int = 4096) -> DataFrame:
    """Rows in hash order until their weights reach ``target``.

    Hash bins are summed first; only the bin in which the target falls is sorted."""
    h = portable_hash(F.col(key), seed)
    width = 2_147_483_647 // bins + 1
    rows = df.withColumn("__h", h).withColumn("__bin", F.floor(F.col("__h") / width))
    sums = rows.groupBy("__bin").agg(F.sum(weight).alias("w"))
    upto = sums.select("__bin", (F.sum("w").over(Window.orderBy("__bin")) - F.col("w")).alias("__before"))
    rows = rows.join(upto.where(F.col("__before") < target), "__bin")
    within = Window.partitionBy("__bin").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.coalesce(F.sum(weight).over(within), F.lit(0)) + F.col("__before"))
    return rows.where(F.col("__before") < target).drop("__h", "__bin", "__before")


def _ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in range partitions with ``__p``, the partition.  Kept, because both the sizes and the rows are read from
    it and another run may draw other bounds."""
    return cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))


def divided(df: DataFrame, order: Sequence[str], parts: int) -> DataFrame:
    """Adds ``part`` (from 1): equal shares of the rows in order, by range partitions counted first.

    The place of a row is the size of the ranges before its own plus its place there."""
    ranged = _ranged(df, order)
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"), F.sum("n").over(Window.partitionBy()).alias("__n"))
    placed = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1).join(starts, "__p")
    place, n = F.col("__i") + F.col("__s"), F.col("__n")
    small, big = F.floor(n / parts), F.pmod(n, F.lit(parts))
    edge = big * (small + 1)
    part = F.when(place < edge, F.floor(place / (small + 1))).otherwise(big + F.floor((place - edge) / F.greatest(small, F.lit(1)))) + 1
    return placed.withColumn("part", part.cast("long")).drop("__p", "__i", "__s", "__n")


def chunks(df: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """key, chunk (from 0), piece: fixed-size pieces of a string."""
    n = F.greatest(F.ceil(F.length(value) / size).cast("int"), F.lit(1))
    rows = df.select(key, F.col(value).cast("binary").alias("b"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return rows.select(key, F.col("chunk").cast("long").alias("chunk"), F.substr(F.col("b"), F.col("chunk") * size + 1, F.lit(size)).cast("string").alias("piece"))


def broken_at(df: DataFrame, key: str, value: str, letter: str, least: int) -> DataFrame:
    """key, piece_no, piece: the string split at runs of at least ``least`` equal letters."""
    return df.select(key, F.posexplode(F.split(value, f"{letter}{{{least},}}")).alias("piece_no", "piece")).where("piece <> ''")


def numbered(df: DataFrame, order: Sequence[str], name: str = "new_id") -> DataFrame:
    """A gapless number from 0 in order, by range partitions as in ``divided``."""
    ranged = _ranged(df, order)
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    placed = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1).join(starts, "__p")
    return placed.withColumn(name, (F.col("__i") + F.col("__s")).cast("long")).drop("__p", "__i", "__s")


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 0), line"""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def until(lines_: DataFrame, key: str, mark: str) -> DataFrame:
    """Lines up to and including the first that holds ``mark``."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(F.col("line").contains(mark).cast("int")).over(w)
    return lines_.withColumn("__seen", F.coalesce(seen, F.lit(0))).where("__seen = 0").drop("__seen")


def between_marks(lines_: DataFrame, key: str, start: str, stop: str) -> DataFrame:
    """Lines from each one that holds ``start`` to the next that holds ``stop``, both included."""
    w = Window.partitionBy(key).orderBy("line_no")
    last_start = F.max(F.when(F.col("line").contains(start), F.col("line_no"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last_stop = F.max(F.when(F.col("line").contains(stop), F.col("line_no"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = lines_.withColumns({"__a": last_start, "__b": last_stop})
    return marked.where(F.col("__a").isNotNull() & (F.col("__b").isNull() | (F.col("__b") < F.col("__a")))).drop("__a", "__b")


def multiset_difference(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """columns, n: how many more times a row occurs in a than in b (positive ones only), without exploding copies."""
    rows = a.select(*columns, F.lit(1).alias("d")).unionByName(b.select(*columns, F.lit(-1).alias("d")))
    return rows.groupBy(*columns).agg(F.sum("d").alias("n")).where("n > 0")


def symmetric_difference(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """columns, side: rows that only one of two sets has."""
    rows = a.select(*columns, F.lit(1).alias("s")).unionByName(b.select(*columns, F.lit(2).alias("s")))
    sides = rows.groupBy(*columns).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return sides.where("lo = hi").select(*columns, F.when(F.col("lo") == 1, "left").otherwise("right").alias("side"))
