"""Pileups, genotype and somatic likelihoods, base statistics; stack-based correction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pileup(bases: DataFrame) -> DataFrame:
    """contig, pos, A, C, G, T, depth from rows (contig, pos, base): conditional sums, combined before the shuffle."""
    return bases.groupBy("contig", "pos").agg(*(F.count_if(F.col("base") == b).alias(b) for b in "ACGT"), F.count(F.lit(1)).alias("depth"))


def consensus(piles: DataFrame) -> DataFrame:
    """Adds the most frequent base (first of A, C, G, T at a tie) and its count."""
    best = F.greatest(*(F.struct(F.col(b).alias("n"), F.lit(-i).alias("r"), F.lit(b).alias("base")) for i, b in enumerate("ACGT")))
    return piles.withColumns({"base": best["base"], "support": best["n"]})


def _log_likelihood(q: Column, matches: Column) -> Column:
    error = F.pow(F.lit(10.0), -q / 10)
    return F.log10(F.when(matches, 1 - error).otherwise(error / 3))


def genotype_scores(bases: DataFrame) -> DataFrame:
    """contig, pos, ref_ll, het_ll, hom_ll of the main other base, from rows (contig, pos, ref, base, q)."""
    other = F.col("base") != F.col("ref")
    q = F.greatest("q", F.lit(2))
    is_ref, not_ref = _log_likelihood(q, ~other), _log_likelihood(q, other)
    half = F.log10((F.pow(F.lit(10.0), is_ref) + F.pow(F.lit(10.0), not_ref)) / 2)
    return bases.groupBy("contig", "pos").agg(
        F.count(F.lit(1)).alias("depth"), F.count_if(other).alias("n_other"), F.sum(is_ref).alias("ref_ll"), F.sum(half).alias("het_ll"), F.sum(not_ref).alias("hom_ll")
    )


def somatic(tumour: DataFrame, normal: DataFrame, lod_tumour: float = 6.3, lod_normal: float = 2.3) -> DataFrame:
    """Places where the tumour prefers a mutant model and the normal the reference, by log-odds (base 10)."""
    t = tumour.select("contig", "pos", (F.greatest("het_ll", "hom_ll") - F.col("ref_ll")).alias("lod_t"))
    n = normal.select("contig", "pos", (F.col("ref_ll") - F.col("het_ll")).alias("lod_n"))
    return t.join(n, ["contig", "pos"]).where((F.col("lod_t") >= lod_tumour) & (F.col("lod_n") >= lod_normal))


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(F.least(ref, alt), F.greatest(ref, alt)).isin("AG", "CT")


def strand_bias(fwd_ref: Column, fwd_alt: Column, rev_ref: Column, rev_alt: Column) -> Column:
    """Log2 ratio of the share of the other base on both strands, with one pseudo-count each."""
    return F.log2(((fwd_alt + 1.0) / (fwd_ref + fwd_alt + 2.0)) / ((rev_alt + 1.0) / (rev_ref + rev_alt + 2.0)))


def stacks(seqs: DataFrame, flank: int, key: str) -> DataFrame:
    """left, right, base, key, pos, q: the base between two flanks of ``flank`` letters at every place of a read."""
    n = F.length("seq") - 2 * flank
    rows = seqs.where(n > 0).select(key, F.col("seq").cast("binary").alias("b"), F.explode(F.sequence(F.lit(1), n)).alias("at"))
    piece = lambda i, k: F.substr(F.col("b"), i, F.lit(k)).cast("string")
    rows = rows.select(key, (F.col("at") + flank).alias("pos"), piece(F.col("at"), flank).alias("left"), piece(F.col("at") + flank, 1).alias("base"), piece(F.col("at") + flank + 1, flank).alias("right"))
    return rows.withColumn("q", (F.ascii("base") * 7 + F.col("pos") * 13) % 41)


def stack_columns(rows: DataFrame) -> DataFrame:
    """left, right, A, C, G, T (quality sums), depth"""
    return rows.groupBy("left", "right").agg(*(F.sum(F.when(F.col("base") == b, F.col("q")).otherwise(0)).alias(b) for b in "ACGT"), F.count(F.lit(1)).alias("depth"))


def fishy(columns: DataFrame, least_depth: int, ratio: float) -> DataFrame:
    """Columns in which a minority base has some support, but at most 1 / ``ratio`` of the best one's."""
    best = F.greatest("A", "C", "G", "T")
    rest = F.col("A") + F.col("C") + F.col("G") + F.col("T") - best
    return columns.where((F.col("depth") >= least_depth) & (rest > 0) & (best >= ratio * rest)).select("left", "right", "depth", best.alias("best"), rest.alias("rest"))


def recommended(rows: DataFrame, columns: DataFrame, least_best: int, ratio: float) -> DataFrame:
    """Reads' bases that the column's winner should replace: winner strong, own base weak."""
    best = F.greatest(*(F.struct(F.col(b).alias("n"), F.lit(-i).alias("r"), F.lit(b).alias("base")) for i, b in enumerate("ACGT")))
    own = F.when(F.col("base") == "A", F.col("A")).when(F.col("base") == "C", F.col("C")).when(F.col("base") == "G", F.col("G")).otherwise(F.col("T"))
    judged = rows.join(columns, ["left", "right"]).withColumns({"winner": best["base"], "best": best["n"], "own": own})
    return judged.where((F.col("winner") != F.col("base")) & (F.col("best") >= least_best) & (F.col("best") >= ratio * F.col("own")))


def expected_coverage_start(n: int, length: int) -> float:
    """Expected share of places without a start among ``n`` uniform starts."""
    return math.exp(-n / length) if length else 1.0
