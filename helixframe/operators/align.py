"""Alignment: seeds by k-mer joins, gapless extension by column expressions, affine gaps by a vectorised UDF."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequence import mismatches, reverse_complement
from helixframe.operators.kmers import kmerized
from helixframe.operators.windows import best_against_second


def seed_hits(queries: DataFrame, targets: DataFrame, k: int, q_key: str, t_key: str, most: int | None = None) -> DataFrame:
    """q, q_pos, t, t_pos, offset (t_pos - q_pos) of equal forward words; words more frequent than ``most`` in the
    targets are no seeds (a parameter of seeded lookups)."""
    q = kmerized(queries, k, q_key).select(F.col(q_key).alias("q"), F.col("pos").alias("q_pos"), "fwd")
    t = kmerized(targets, k, t_key).select(F.col(t_key).alias("t"), F.col("pos").alias("t_pos"), "fwd")
    if most is not None:
        t = t.join(t.groupBy("fwd").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select("fwd"), "fwd", "left_semi")
    return q.join(t, "fwd").select("q", "q_pos", "t", "t_pos", (F.col("t_pos") - F.col("q_pos")).alias("offset"))


def diagonals(hits: DataFrame) -> DataFrame:
    """q, t, offset, n_seeds, q_from, q_to"""
    return hits.groupBy("q", "t", "offset").agg(F.count(F.lit(1)).alias("n_seeds"), F.min("q_pos").alias("q_from"), F.max("q_pos").alias("q_to"))


def gapless(hits: DataFrame, queries: DataFrame, targets: DataFrame, q_key: str, t_key: str) -> DataFrame:
    """q, t, offset, errors of placements in which the whole query lies on the target."""
    places = hits.select("q", "t", "offset").distinct()
    q = queries.select(F.col(q_key).alias("q"), F.col("seq").alias("q_seq"))
    t = targets.select(F.col(t_key).alias("t"), F.col("seq").alias("t_seq"))
    both = places.join(q, "q").join(t, "t").where((F.col("offset") >= 0) & (F.col("offset") + F.length("q_seq") <= F.length("t_seq")))
    return both.select("q", "t", "offset", mismatches(F.col("q_seq"), F.substr("t_seq", F.col("offset") + 1, F.length("q_seq"))).alias("errors"))


def unique_best(placed: DataFrame, most: int = 4, margin: int = 2) -> DataFrame:
    return best_against_second(placed, ["q"], "errors", ["t", "offset"], most, margin)


def search_both_strands(queries: DataFrame, targets: DataFrame, q_key: str, t_key: str, k: int) -> DataFrame:
    """q, t, pos, rc: every exact end-to-end place of a query or its reverse complement (queries of k letters or more)."""
    strands = queries.where(F.length("seq") >= k)
    strands = strands.select(F.col(q_key).alias("q"), "seq", F.lit(False).alias("rc")).unionAll(strands.select(F.col(q_key).alias("q"), reverse_complement(F.col("seq")), F.lit(True)))
    first = strands.withColumn("fwd", F.left("seq", F.lit(k)))
    t = kmerized(targets, k, t_key).select(F.col(t_key).alias("t"), "pos", "fwd")
    whole = targets.select(F.col(t_key).alias("t"), F.col("seq").cast("binary").alias("t_seq"))
    found = first.join(t, "fwd").join(whole, "t")
    return found.where(F.substr("t_seq", F.col("pos"), F.length("seq")).cast("string") == F.col("seq")).select("q", "t", "pos", "rc")


def affine_score(a: str, b: str, match: int = 1, mismatch: int = -2, gap_open: int = -3, gap_extend: int = -1) -> int:
    """Best local alignment score with affine gaps, one vector step per row of the table."""
    if not a or not b:
        return 0
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    n = len(y)
    steps = gap_extend * np.arange(n + 1)
    h, f, best = np.zeros(n + 1), np.full(n + 1, -np.inf), 0.0
    for c in x:
        f = np.maximum(f + gap_extend, h + gap_open)
        diagonal = h[:-1] + np.where(y == c, match, mismatch)
        row = np.maximum(np.concatenate([[0.0], diagonal]), np.maximum(f, 0.0))
        row[0] = 0.0
        # Gaps along the row: the best earlier start minus its distance is a running maximum.
        reach = np.maximum.accumulate(row - steps) + steps
        e = np.concatenate([[-np.inf], reach[:-1] + gap_open])
        h = np.maximum(row, e)
        best = max(best, float(h.max()))
    return int(best)


def smith_waterman(pairs: DataFrame, a: str, b: str, **scores: int) -> DataFrame:
    """Adds ``score`` of the best local alignment of two string columns."""

    @F.pandas_udf("long")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([affine_score(p or "", q or "", **scores) for p, q in zip(x, y, strict=True)], dtype="int64")

    return pairs.withColumn("score", score(a, b))
