"""Pairs of reads, libraries, link bundles between contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def library_stats(pairs: DataFrame) -> DataFrame:
    """lib, n_pairs, mean_sep, sd_sep, least_sep, most_sep"""
    return pairs.groupBy("lib").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("sep"), 6).alias("mean_sep"), F.round(F.stddev_pop("sep"), 6).alias("sd_sep"), F.min("sep").alias("least_sep"), F.max("sep").alias("most_sep")
    )


def separation_histogram(pairs: DataFrame, width: int) -> DataFrame:
    return pairs.groupBy("lib", (F.floor(F.col("sep") / width) * width).alias("from_sep")).agg(F.count(F.lit(1)).alias("n"))


def valid(pairs: DataFrame, k: float) -> DataFrame:
    """Pairs whose separation lies within ``k`` deviations of their library's mean (libraries are a small table)."""
    libs = pairs.groupBy("lib").agg(F.avg("sep").alias("mean"), F.stddev_pop("sep").alias("sd"))
    return pairs.join(libs, "lib").where(F.abs(F.col("sep") - F.col("mean")) <= k * F.col("sd")).select(*pairs.columns)


def link_bundles(pairs: DataFrame, least: int) -> DataFrame:
    """a, b, links, sep, dev: unordered contig pairs joined by at least ``least`` pairs."""
    rows = pairs.where("id1 <> id2").select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), "sep")
    bundles = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("links"), F.round(F.avg("sep"), 6).alias("sep"), F.round(F.stddev_pop("sep"), 6).alias("dev"))
    return bundles.where(F.col("links") >= least)


def scaffold_edges(bundles: DataFrame, ratio: float) -> DataFrame:
    """Bundles that are the best of both their contigs and outweigh the second best by ``ratio``."""
    both = bundles.select(F.col("a").alias("c"), "a", "b", "links").unionByName(bundles.select(F.col("b").alias("c"), "a", "b", "links"))
    w = Window.partitionBy("c").orderBy(F.desc("links"), "a", "b")
    ranked = both.withColumns({"r": F.row_number().over(w), "second": F.lead("links").over(w)})
    good = ranked.where((F.col("r") == 1) & (F.col("second").isNull() | (F.col("links") >= ratio * F.col("second"))))
    return good.groupBy("a", "b").agg(F.count(F.lit(1)).alias("sides"), F.max("links").alias("links")).where("sides = 2").select("a", "b", "links")


def duplicates(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows after the first of their key."""
    first = df.groupBy(*key).agg(F.min(order).alias("__first"))
    return df.join(first, key).where(F.col(order) > F.col("__first")).drop("__first")


def removed(pairs: DataFrame, bad: DataFrame) -> DataFrame:
    """Pairs neither of whose ends is in a one-column table ``id``."""
    out = pairs.join(bad.select(F.col("id").alias("id1")).distinct(), "id1", "left_anti")
    return out.join(bad.select(F.col("id").alias("id2")).distinct(), "id2", "left_anti")


def physical_span(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """contig, start, stop: what a pair spans when both ends are placed on one contig (id, contig, pos)."""
    one = placed.select(F.col("id").alias("id1"), F.col("contig"), F.col("pos").alias("p1"))
    two = placed.select(F.col("id").alias("id2"), F.col("contig"), F.col("pos").alias("p2"))
    both = pairs.join(one, "id1").join(two, ["id2", "contig"])
    return both.select("pair_id", "contig", F.least("p1", "p2").alias("start"), F.greatest("p1", "p2").alias("stop"))
