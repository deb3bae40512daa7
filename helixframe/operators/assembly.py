"""Clean-up of assembly graphs, copy numbers, scaffolds.  Edges have eid, src, dst, seq and a weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.graph import components, cut, degrees


def without_hangs(edges: DataFrame, most_length: int, ratio: float, max_rounds: int = 5) -> DataFrame:
    """Dead-end edges shorter than ``most_length`` go if an edge beside them weighs ``ratio`` times as much; repeated."""
    edges = cut(edges)
    for _ in range(max_rounds):
        deg = degrees(edges)
        dead = deg.where("n_out = 0 AND n_in = 1").select(F.col("node").alias("dst"))
        best = edges.groupBy("src").agg(F.max("weight").alias("best"))
        short = edges.where(F.length("seq") < most_length).join(dead, "dst", "left_semi").join(best, "src")
        gone = cut(short.where(F.col("best") >= ratio * F.col("weight")).select("eid"))
        if gone.isEmpty():
            break
        edges = cut(edges.join(gone, "eid", "left_anti"))
    return edges


def popped_bubbles(edges: DataFrame, most_difference: float) -> DataFrame:
    """Of parallel edges that differ little from the heaviest one, only that one stays; it takes their weight."""
    w = Window.partitionBy("src", "dst").orderBy(F.desc("weight"), "eid")
    best = edges.groupBy("src", "dst").agg(F.max_by(F.struct("eid", "seq"), F.struct("weight", -F.col("eid"))).alias("b"), F.count(F.lit(1)).alias("n"))
    rows = edges.join(best, ["src", "dst"])
    far = F.levenshtein("seq", F.col("b.seq")) > most_difference * F.greatest(F.length("seq"), F.length("b.seq"))
    rows = rows.withColumn("stays", (F.col("eid") == F.col("b.eid")) | far).withColumn("lead", F.row_number().over(w))
    extra = rows.where("NOT stays").groupBy(F.col("b.eid").alias("eid")).agg(F.sum("weight").alias("extra"))
    kept = rows.where("stays").select("eid", "src", "dst", "seq", "weight").join(extra, "eid", "left")
    return kept.select("eid", "src", "dst", "seq", (F.col("weight") + F.coalesce("extra", F.lit(0))).alias("weight"))


def bubble_kinds(edges: DataFrame) -> DataFrame:
    """src, dst, kind: pairs of parallel edges as substitution (equal lengths, one difference), several, or indel."""
    two = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("eid", "seq")).alias("a"), F.max(F.struct("eid", "seq")).alias("b")).where("n = 2")
    same = F.length("a.seq") == F.length("b.seq")
    kind = F.when(same & (F.levenshtein("a.seq", "b.seq") == 1), "substitution").when(same, "several").otherwise("indel")
    return two.select("src", "dst", kind.alias("kind"))


def copy_numbers(coverage: DataFrame, single: float) -> DataFrame:
    """Adds cn, the copy number whose Poisson mean ``cn * single`` fits the coverage best (rounded ratio, at least 1)."""
    return coverage.withColumn("cn", F.greatest(F.lit(1), F.round(F.col("coverage") / single)).cast("long"))


def scaffolds(joins: DataFrame) -> DataFrame:
    """contig, scaffold of mutual joins (a, b): the least contig names a scaffold."""
    return components(joins.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("component", "scaffold").withColumnRenamed("node", "contig")


def scaffold_layout(placed: DataFrame) -> DataFrame:
    """Adds start and stop on the scaffold from contig lengths and gaps (scaffold, place, contig, len, gap)."""
    w = Window.partitionBy("scaffold").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("len") + F.coalesce("gap", F.lit(0))).over(w), F.lit(0))
    return placed.withColumn("start", start).withColumn("stop", start + F.col("len"))


def scaffold_lengths(placed: DataFrame) -> DataFrame:
    """scaffold, true_length (with gaps), reduced_length (without)."""
    last = F.max_by("gap", "place")
    return placed.groupBy("scaffold").agg((F.sum(F.col("len") + F.coalesce("gap", F.lit(0))) - F.coalesce(last, F.lit(0))).alias("true_length"), F.sum("len").alias("reduced_length"))
