"""Bias and coverage: starts, halves, content windows, percentiles, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import gc_count


def start_counts(placed: DataFrame, by: list[str]) -> DataFrame:
    """by, pos, n: how many placements start at each place."""
    return placed.groupBy(*by, "pos").agg(F.count(F.lit(1)).alias("n"))


def start_bias(starts: DataFrame, by: list[str], places: Column) -> DataFrame:
    """by, mean, ratio: variance of the starts per place over their mean, 1 for uniform starts; places without a start count as 0.

    ``places`` is the number of places in which a placement can start, an aggregate."""
    sums = starts.groupBy(*by).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), places.alias("places"))
    mean = F.col("s") / F.col("places")
    return sums.select(*by, mean.alias("mean"), ((F.col("q") / F.col("places") - mean * mean) / mean).alias("ratio"))


def halves(rows: DataFrame, by: list[str], half: Column) -> DataFrame:
    """by, n_first, n_second, difference: the counts of two halves and how many standard deviations they are apart."""
    counts = rows.groupBy(*by).agg(F.count_if(half).alias("n_first"), F.count_if(~half).alias("n_second"))
    return counts.withColumn("difference", (F.col("n_first") - F.col("n_second")) / F.sqrt(F.col("n_first") + F.col("n_second")))


def content_windows(seqs: DataFrame, key: str, size: int, step: int) -> DataFrame:
    """key, start, gc of whole windows of ``size`` bases every ``step``."""
    last = F.length("seq") - size
    starts = F.explode(F.sequence(F.lit(0), last, F.lit(step)))
    rows = seqs.where(last >= 0).select(key, F.col("seq").cast("binary").alias("b"), starts.alias("start"))
    part = F.substr("b", F.col("start") + 1, F.lit(size)).cast("string")
    return rows.select(key, "start", gc_count(part).alias("gc"))


def by_dinucleotide(seqs: DataFrame) -> DataFrame:
    """pair, n: overlapping pairs of bases."""
    pairs = F.explode(F.zip_with(F.split("seq", ""), F.slice(F.split("seq", ""), 2, F.greatest(F.length("seq") - 1, F.lit(0))), lambda x, y: F.concat(x, y)))
    return seqs.where(F.length("seq") >= 2).select(pairs.alias("pair")).where("pair IS NOT NULL").groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def percentiles(histogram: DataFrame, value: str, n: str, by: list[str]) -> DataFrame:
    """by, value, n, share: the share of the counts at or below each value; one row per value, so the window holds few rows."""
    own = Window.partitionBy(*by)
    return histogram.select(*by, value, n, (F.sum(n).over(own.orderBy(value)) / F.sum(n).over(own)).alias("share"))


def correlation(first: DataFrame, second: DataFrame, on: list[str], value: str) -> DataFrame:
    """r, n_both: Pearson's r of the values that both tables have for a key, one row."""
    both = first.select(*on, F.col(value).cast("double").alias("x")).join(second.select(*on, F.col(value).cast("double").alias("y")), on)
    return both.agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n_both"))


def sites(seqs: DataFrame, key: str, motif: str) -> DataFrame:
    """key, pos (from 1): every place of a motif, overlapping ones too."""
    parts = F.split("seq", f"(?={motif})")
    before = F.transform(parts, lambda p, i: F.when((i > 0) | F.col("seq").startswith(motif), F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda s, x: s + F.length(x)) + 1))
    return seqs.where(F.col("seq").contains(motif)).select(key, F.explode(F.filter(before, lambda p: p.isNotNull())).alias("pos"))


def prefixes(seqs: DataFrame, size: int) -> DataFrame:
    """prefix, n of sequences that are long enough."""
    return seqs.where(F.length("seq") >= size).groupBy(F.left("seq", F.lit(size)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def shared_prefixes(first: DataFrame, second: DataFrame, size: int) -> DataFrame:
    """prefix, n_first, n_second of prefixes that both have."""
    return prefixes(first, size).withColumnRenamed("n", "n_first").join(prefixes(second, size).withColumnRenamed("n", "n_second"), "prefix")
