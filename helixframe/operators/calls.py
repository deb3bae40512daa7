"""Variant calls: filters, merging of regions, likelihoods, family tests, editing of a reference.

Calls have contig, pos (from 1), ref, alt, qual and, where asked for, filter, region or genotypes as numbers of
alternative alleles (0, 1, 2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import is_homopolymer
from helixframe.operators.correct import edited


def passing(calls: DataFrame, least: float, states: tuple[str, ...] = ("PASS", ".")) -> DataFrame:
    return calls.where((F.col("qual") >= least) & F.col("filter").isin(*states))


def marked_by_probability(calls: DataFrame, names: tuple[str, ...], least: float, mark: str) -> DataFrame:
    """``filter`` gets ``mark`` where a probability lies between 0 and ``least``, both exclusive; null ones don't count."""
    low = F.lit(False)
    for name in names:
        low = low | F.coalesce((F.col(name) > 0) & (F.col(name) < least), F.lit(False))
    kept = F.when(F.col("filter").isin("PASS", "."), F.lit(mark)).otherwise(F.concat_ws(";", "filter", F.lit(mark)))
    return calls.withColumn("filter", F.when(low, kept).otherwise(F.col("filter")))


def merged_regions(calls: DataFrame) -> DataFrame:
    """One call for each contig, pos, ref and alt of overlapping regions: the best quality, then the least region."""
    best = F.max_by(F.struct("region", "qual"), F.struct("qual", (-F.col("region")).alias("least")))
    return calls.groupBy("contig", "pos", "ref", "alt").agg(best.alias("b"), F.count(F.lit(1)).alias("n_regions")).select("contig", "pos", "ref", "alt", "b.region", "b.qual", "n_regions")


def kind(ref: Column, alt: Column) -> Column:
    n, m = F.length(ref), F.length(alt)
    return F.when((n == 1) & (m == 1), "snp").when(n == m, "mnp").when(n > m, "deletion").otherwise("insertion")


def in_homopolymer(before: Column, after: Column) -> Column:
    """Whether the bases around a place are one run."""
    return is_homopolymer(F.concat(before, after)) & (F.length(before) > 0)


def het_rate(calls: DataFrame, by: list[str]) -> DataFrame:
    return calls.groupBy(*by).agg(F.count_if(F.col("gt") == 1).alias("n_het"), F.count_if(F.col("gt") > 0).alias("n"), (F.count_if(F.col("gt") == 1) / F.count_if(F.col("gt") > 0)).alias("rate"))


def not_mendelian(child: Column, mother: Column, father: Column) -> Column:
    """Whether no allele of each parent makes up the child's genotype (numbers of alternative alleles)."""
    gives = lambda parent: (F.when(parent < 2, 0).otherwise(1), F.when(parent > 0, 1).otherwise(0))
    (m0, m1), (f0, f1) = gives(mother), gives(father)
    return (child < m0 + f0) | (child > m1 + f1)


def genotype_likelihoods(n_ref: Column, n_alt: Column, error: float) -> list[Column]:
    """Log10 likelihood of 0, 1 and 2 alternative alleles for reads that err with one rate."""
    log = lambda p: F.log10(F.lit(p))
    return [n_ref * log(1 - error) + n_alt * log(error), (n_ref + n_alt) * log(0.5), n_ref * log(error) + n_alt * log(1 - error)]


def genotype_posteriors(n_ref: Column, n_alt: Column, error: float, priors: tuple[float, float, float]) -> list[Column]:
    """Probabilities of 0, 1 and 2 alternative alleles under priors, scaled by the best one to keep small numbers."""
    joint = [lik + F.log10(F.lit(p)) for lik, p in zip(genotype_likelihoods(n_ref, n_alt, error), priors, strict=True)]
    best = F.greatest(*joint)
    powers = [F.pow(F.lit(10.0), j - best) for j in joint]
    return [p / (powers[0] + powers[1] + powers[2]) for p in powers]


def support_phred(log_odds: Column, most: float = 100.0) -> Column:
    """Phred-scaled probability of a wrong call from the sum of the reads' log10 odds, an aggregate."""
    return F.least(F.lit(most), F.greatest(F.lit(0.0), 10 * F.sum(log_odds)))


def edited_reference(seqs: DataFrame, calls: DataFrame, key: str) -> DataFrame:
    """The sequences with all homozygous calls made; of overlapping calls the first stays."""
    own = Window.partitionBy("contig").orderBy("pos", "ref", "alt")
    made = calls.where("gt = 2").select("contig", "pos", "ref", "alt", (F.col("pos") - 1 + F.length("ref")).alias("stop"))
    # A call is left out where it begins before the end of one that stays: decided along each contig.
    made = made.withColumn("reach", F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))).where("reach IS NULL OR pos > reach")
    edits = made.select(F.col("contig").alias(key), (F.col("pos") - 1).cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), F.col("alt").alias("text"))
    return edited(seqs, edits, key)
