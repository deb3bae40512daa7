"""Read preparation: trimming, quality lengths, removal of dodgy and noisy reads with their partners, joins by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import count_of, reverse_complement


def trimmed(rows: DataFrame, start: int, stop: int | None = None, reverse: bool = False) -> DataFrame:
    """Bases ``start`` (from 0) to ``stop`` (exclusive; negative: from the end; none: all), then the other strand with ``reverse``."""
    n = F.length("seq")
    end = n if stop is None else F.least(n, F.lit(stop)) if stop >= 0 else F.greatest(n + stop, F.lit(0))
    cut = F.substr("seq", F.lit(start + 1), F.greatest(end - start, F.lit(0)))
    return rows.withColumn("seq", reverse_complement(cut) if reverse else cut)


def synced_quals(rows: DataFrame, fill: int = 0) -> DataFrame:
    """``quals`` cut or filled to the length of ``seq``."""
    missing = F.greatest(F.length("seq") - F.size("quals"), F.lit(0))
    return rows.withColumn("quals", F.concat(F.slice("quals", 1, F.length("seq")), F.array_repeat(F.lit(fill), missing)))


def dodgy(rows: DataFrame, key: str = "read_id", most_a: float = 0.9) -> DataFrame:
    """key, reason: reads with more than ``most_a`` of A, and all but the least id among equal reads."""
    poly = rows.where(count_of(F.col("seq"), "A") > most_a * F.length("seq")).select(key, F.lit("poly_a").alias("reason"))
    # Equal reads meet by their 128-bit digests; the least id comes from a combinable aggregate.
    named = rows.select(key, F.md5(F.col("seq").cast("binary")).alias("digest"))
    least = named.groupBy("digest").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = named.join(least, "digest").where(F.col(key) != F.col("first")).select(key, F.lit("duplicate").alias("reason"))
    return poly.union(again)


def noisy(rows: DataFrame, base: str, most: float, key: str = "read_id") -> DataFrame:
    """key: reads in which more than the share ``most`` is ``base``."""
    return rows.where(count_of(F.col("seq"), base) > most * F.length("seq")).select(key)


def with_partners(marked: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """pair_id: pairs of which a read is marked; ``pairs`` has pair_id, id1, id2."""
    ends = pairs.select("pair_id", F.explode(F.array("id1", "id2")).alias(key))
    return ends.join(marked.select(key).distinct(), key, "left_semi").select("pair_id").distinct()


def partners(pairs: DataFrame) -> DataFrame:
    """id, pair_id, partner: one row for each end of a pair."""
    ends = F.explode(F.array(F.struct(F.col("id1").alias("id"), F.col("id2").alias("partner")), F.struct(F.col("id2").alias("id"), F.col("id1").alias("partner"))))
    return pairs.select("pair_id", ends.alias("e")).select("e.id", "pair_id", "e.partner")


def by_place(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of sibling tables side by side; a row without a sibling stays, as in files of unequal length."""
    return left.join(right, key, "full_outer")


def appended(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both tables, the ids of the second moved behind the largest of the first (one scalar)."""
    behind = first.agg((F.coalesce(F.max(key), F.lit(-1)) + 1).alias("behind"))
    moved = second.join(F.broadcast(behind)).withColumn(key, F.col(key) + F.col("behind")).drop("behind")
    return first.unionByName(moved)


def composed(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(q, t, start, stop, rc) of placements q on m (``inner``) carried through placements of m on t (``outer``).

    Both have from, to, start, stop, rc: where ``from`` lies on ``to``.  On the reverse strand places count from the end.
    """
    a = inner.select(F.col("from").alias("q"), F.col("to").alias("m"), F.col("start").alias("a0"), F.col("stop").alias("a1"), F.col("rc").alias("ar"))
    b = outer.select(F.col("from").alias("m"), F.col("to").alias("t"), F.col("start").alias("b0"), F.col("stop").alias("b1"), F.col("rc").alias("br"))
    both = a.join(b, "m")
    return both.select(
        "q", "m", "t",
        F.when(F.col("br"), F.col("b1") - F.col("a1")).otherwise(F.col("b0") + F.col("a0")).alias("start"),
        F.when(F.col("br"), F.col("b1") - F.col("a0")).otherwise(F.col("b0") + F.col("a1")).alias("stop"),
        (F.col("ar") != F.col("br")).alias("rc"),
    )


def qual_counts(rows: DataFrame, quality) -> DataFrame:
    """cycle, qual, n over all bases; ``quality`` gives the column of a base's quality from its place and letter."""
    bases = rows.select(F.posexplode(F.split("seq", "")).alias("cycle", "base")).where("base <> ''")
    return bases.groupBy((F.col("cycle") + 1).alias("cycle"), quality(F.col("cycle") + 1, F.col("base")).alias("qual")).agg(F.count(F.lit(1)).alias("n"))


def unique_best(aligned: DataFrame) -> DataFrame:
    """Alignments (q, t, pos, errors) that are the only best one of their query."""
    own = Window.partitionBy("q")
    best = aligned.withColumn("least", F.min("errors").over(own)).where("errors = least")
    return best.withColumn("n", F.count(F.lit(1)).over(own)).where("n = 1").drop("least", "n")


def pair_consistent(aligned: DataFrame, pairs: DataFrame, least: int, most: int) -> DataFrame:
    """pair_id, t, sep of pairs whose ends both have one best place, on the same target and apart as wanted."""
    best = unique_best(aligned)
    one, two = (best.select(F.col("q").alias(f"id{i}"), F.col("t").alias(f"t{i}"), F.col("pos").alias(f"p{i}")) for i in (1, 2))
    both = pairs.select("pair_id", "id1", "id2").join(one, "id1").join(two, "id2").where("t1 = t2")
    return both.select("pair_id", F.col("t1").alias("t"), (F.col("p2") - F.col("p1")).alias("sep")).where(F.col("sep").between(least, most))
