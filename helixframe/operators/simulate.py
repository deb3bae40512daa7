"""Seeded simulation by hashes of row numbers: the same rows on every run and any number of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.selection import portable_hash


def random_bases(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """id, base"""
    at = F.pmod(portable_hash(F.col("id"), seed), F.lit(4)).cast("int") + 1
    return spark.range(n).select("id", F.substr(F.lit("ACGT"), at, F.lit(1)).alias("base"))


def mutated(bases: DataFrame, rate: float, seed: int = 1) -> DataFrame:
    """Adds ``mutant``: the base, or with probability ``rate`` one of the other three."""
    h = portable_hash(F.col("id"), seed)
    step = F.pmod(portable_hash(F.col("id"), seed + 1), F.lit(3)).cast("int") + 1
    other = F.substr(F.lit("ACGTACGT"), F.instr(F.lit("ACGT"), F.col("base")) + step, F.lit(1))
    return bases.withColumn("mutant", F.when(h < int(rate * 2_147_483_647), other).otherwise(F.col("base")))


def read_starts(spark: SparkSession, n_reads: int, genome: int, length: int, seed: int = 2) -> DataFrame:
    """read_id, start, stop of reads placed uniformly on a genome."""
    start = F.pmod(portable_hash(F.col("id"), seed), F.lit(max(1, genome - length + 1)))
    return spark.range(n_reads).select(F.col("id").alias("read_id"), start.alias("start"), (start + length).alias("stop"))


def simulated_reads(spark: SparkSession, genome: DataFrame, n_reads: int, length: int, rate: float, seed: int = 2) -> DataFrame:
    """read_id, seq: reads of ``genome`` (id, base) with substitutions; one join on places, no collected genome."""
    size = genome.count()
    places = read_starts(spark, n_reads, size, length, seed).select("read_id", "start", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("id"))
    rows = places.join(genome, "id").withColumn("at", F.col("id") - F.col("start"))
    noisy = mutated(rows.withColumn("id", F.col("read_id") * 1_000_003 + F.col("at")), rate, seed + 7)
    return noisy.groupBy("read_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("at", "mutant"))), lambda x: x["mutant"])).alias("seq"))
