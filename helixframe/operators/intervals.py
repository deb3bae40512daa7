"""Half-open integer intervals (contig, start, stop) as rows.

Coverage is a sweep over +1/-1 events, pre-aggregated by place, with one running
sum per contig.  Overlap joins put each interval into fixed-width bins and join
on (contig, bin), so no interval meets one far away; each pair is kept only in
the first bin that both share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Length of the overlap of [a, b) and [c, d)."""
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))


def distance(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Gap between [a, b) and [c, d), 0 if they meet."""
    return F.greatest(F.lit(0), F.greatest(a, c) - F.least(b, d))


def condensed(iv: DataFrame) -> DataFrame:
    """contig, start, stop, coverage: disjoint pieces between the least start and the greatest stop of each contig."""
    iv = iv.where("start < stop")
    events = iv.select("contig", F.col("start").alias("p"), F.lit(1).alias("d")).unionAll(iv.select("contig", F.col("stop").alias("p"), F.lit(-1).alias("d")))
    events = events.groupBy("contig", "p").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("contig").orderBy("p")
    swept = events.select("contig", F.col("p").alias("start"), F.lead("p").over(w).alias("stop"), F.sum("d").over(w).alias("coverage"))
    return swept.where("stop IS NOT NULL")


def with_coverage(iv: DataFrame, least: int) -> DataFrame:
    """contig, start, stop: maximal stretches of coverage at least ``least``."""
    return _glued(condensed(iv).where(F.col("coverage") >= least))


def _glued(pieces: DataFrame) -> DataFrame:
    """Neighbouring disjoint pieces put together."""
    w = Window.partitionBy("contig").orderBy("start")
    fresh = (~F.col("start").eqNullSafe(F.lag("stop").over(w))).cast("long")
    marked = pieces.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    return marked.groupBy("contig", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def merged(iv: DataFrame) -> DataFrame:
    """Union of the intervals of each contig (touching ones are joined)."""
    return with_coverage(iv, 1)


def uncovered(iv: DataFrame) -> DataFrame:
    """Holes between the first start and the last stop of each contig."""
    return _glued(condensed(iv).where("coverage = 0"))


def total_covered(iv: DataFrame) -> DataFrame:
    """contig, covered: length of the union."""
    return condensed(iv).where("coverage > 0").groupBy("contig").agg(F.sum(F.col("stop") - F.col("start")).alias("covered"))


def coverage_histogram(iv: DataFrame) -> DataFrame:
    """coverage, bases"""
    return condensed(iv).groupBy("coverage").agg(F.sum(F.col("stop") - F.col("start")).alias("bases"))


def two_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    """contig, start, stop, in_a, in_b: disjoint pieces and whether each mask covers them; one sweep over both."""
    ends = lambda iv, x, y: iv.where("start < stop").select("contig", F.explode(F.array(F.struct(F.col("start").alias("p"), F.lit(x).alias("a"), F.lit(y).alias("b")), F.struct(F.col("stop").alias("p"), F.lit(-x).alias("a"), F.lit(-y).alias("b")))).alias("e")).select("contig", "e.*")
    events = ends(a, 1, 0).unionAll(ends(b, 0, 1)).groupBy("contig", "p").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy("contig").orderBy("p")
    swept = events.select("contig", F.col("p").alias("start"), F.lead("p").over(w).alias("stop"), (F.sum("a").over(w) > 0).alias("in_a"), (F.sum("b").over(w) > 0).alias("in_b"))
    return swept.where("stop IS NOT NULL")


def _binned(iv: DataFrame, width: int, side: str) -> DataFrame:
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))
    cols = [F.col(c).alias(f"{side}_{c}") for c in iv.columns if c != "contig"]
    return iv.where("start < stop").select("contig", *cols, F.explode(bins).alias("bin"))


def overlap_join(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """contig, l_*, r_*: all pairs that overlap.  ``width`` is best near the usual interval length."""
    pairs = _binned(left, width, "l").join(_binned(right, width, "r"), ["contig", "bin"])
    meets = (F.col("l_start") < F.col("r_stop")) & (F.col("r_start") < F.col("l_stop"))
    first = F.floor(F.greatest("l_start", "r_start") / width) == F.col("bin")
    return pairs.where(meets & first).drop("bin")


def points_in(points: DataFrame, iv: DataFrame, width: int) -> DataFrame:
    """contig, p_* of points (contig, at, ...) with r_* of the intervals that hold them."""
    cols = [F.col(c).alias(f"p_{c}") for c in points.columns if c != "contig"]
    left = points.select("contig", *cols, F.floor(F.col("at") / width).alias("bin"))
    return left.join(_binned(iv, width, "r"), ["contig", "bin"]).where("r_start <= p_at AND p_at < r_stop").drop("bin")


def near_duplicates(iv: DataFrame, d: int) -> DataFrame:
    """Pairs a < b of intervals on one contig whose starts and stops differ by at most ``d``."""
    width = d + 1
    left = iv.select("contig", F.col("iv").alias("a"), F.col("start").alias("s1"), F.col("stop").alias("e1"), F.explode(F.sequence(F.floor(F.col("start") / width) - 1, F.floor(F.col("start") / width) + 1)).alias("bin"))
    right = iv.select("contig", F.col("iv").alias("b"), F.col("start").alias("s2"), F.col("stop").alias("e2"), F.floor(F.col("start") / width).alias("bin"))
    both = left.join(right, ["contig", "bin"])
    return both.where((F.col("a") < F.col("b")) & (F.abs(F.col("s1") - F.col("s2")) <= d) & (F.abs(F.col("e1") - F.col("e2")) <= d)).select("contig", "a", "b")


def as_of(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """left (contig, at, key) with the last ``value`` of right (contig, at, value) at or before it: one window, no join."""
    rows = left.select("contig", "at", "key", F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("side")).unionByName(
        right.select("contig", "at", F.lit(None).cast(left.schema["key"].dataType).alias("key"), value, F.lit(0).alias("side"))
    )
    w = Window.partitionBy("contig").orderBy("at", "side", value).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("found", F.last(value, ignorenulls=True).over(w)).where("side = 1").select("contig", "at", "key", F.col("found").alias(value))
