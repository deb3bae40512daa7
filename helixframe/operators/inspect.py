"""Questions to graphs, paths, words and reads: differences, summaries, inverse indexes, neighbours, picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import reverse_complement
from helixframe.operators.graph import degrees
from helixframe.operators.kmers import kmerized


def edge_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """src, dst, side ("first" or "second") of edges that only one graph has; both are combined before the shuffle."""
    rows = first.select("src", "dst", F.lit(1).alias("side")).unionAll(second.select("src", "dst", F.lit(2)))
    found = rows.groupBy("src", "dst").agg(F.min("side").alias("low"), F.max("side").alias("high")).where("low = high")
    return found.select("src", "dst", F.when(F.col("low") == 1, "first").otherwise("second").alias("side"))


def summary(edges: DataFrame) -> DataFrame:
    """One row: n_edges, n_loops, n_nodes, n_sources, n_sinks, most_out, most_in."""
    of_edges = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("src") == F.col("dst")).alias("n_loops"))
    of_nodes = degrees(edges).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("n_in") == 0).alias("n_sources"), F.count_if(F.col("n_out") == 0).alias("n_sinks"), F.max("n_out").alias("most_out"), F.max("n_in").alias("most_in")
    )
    return of_edges.join(F.broadcast(of_nodes))  # one row each


def path_index(steps: DataFrame) -> DataFrame:
    """edge, path, first, n: which paths pass an edge, from (path, place, edge)."""
    return steps.groupBy("edge", "path").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))


def path_breaks(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """path, n_steps, n_unknown (edges that the graph lacks), first_break (place after which the next edge does not follow on)."""
    rows = steps.join(edges.select(F.col("eid").alias("edge"), "src", "dst"), "edge", "left")
    rows = rows.withColumn("next", F.lead("src").over(Window.partitionBy("path").orderBy("place")))
    broken = F.when(F.col("next") != F.col("dst"), F.col("place"))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n_steps"), F.count_if(F.col("src").isNull()).alias("n_unknown"), F.min(broken).alias("first_break"))


def peak_behind_valley(counts: DataFrame) -> DataFrame:
    """value, n: the most frequent value at or behind the first one that is not more frequent than the next (ties: the least).

    ``counts`` has a row per value, so the window without partition sees a histogram."""
    nxt = counts.withColumn("next", F.lead("n").over(Window.orderBy("value")))
    valley = nxt.where("n <= next").agg(F.min("value").alias("valley"))
    behind = counts.join(F.broadcast(valley)).where("value >= valley")  # one row
    return behind.agg(F.max_by(F.struct("value", "n"), F.struct(F.col("n"), -F.col("value"))).alias("x")).where("x IS NOT NULL").select("x.*")


def one_letter_off(word: Column, k: int) -> Column:
    """Array of the 3k words that differ from a word of k letters in one."""
    at = lambda i: F.transform(
        F.filter(F.array(*map(F.lit, "ACGT")), lambda b: b != F.substr(word, i, F.lit(1))), lambda b: F.concat(F.substr(word, F.lit(1), i - 1), b, F.substr(word, i + 1, F.lit(k)))
    )
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(k)), at))


def neighbours(words: DataFrame, k: int) -> DataFrame:
    """word, n: how many words of the set (column word, distinct) differ from it in one letter; words without any are left out."""
    near = words.select("word", F.explode(one_letter_off(F.col("word"), k)).alias("near"))
    return near.join(words.select(F.col("word").alias("near")), "near").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def words_in_reads(words: DataFrame, seqs: DataFrame, k: int, key: str) -> DataFrame:
    """word, rc, n, n_reads: places of each word (k letters) and of its reverse complement in all sequences.

    The list must fit a broadcast, so that only words on it are rows of a shuffle; those are
    counted by read first."""
    both = words.select("word", F.col("word").alias("fwd"), F.lit(False).alias("rc")).unionAll(words.select("word", reverse_complement(F.col("word")), F.lit(True)))
    found = kmerized(seqs, k, key).join(F.broadcast(both.select("fwd").distinct()), "fwd", "left_semi")
    per_read = found.groupBy("fwd", key).agg(F.count(F.lit(1)).alias("n"))
    return per_read.groupBy("fwd").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_reads")).join(both, "fwd").select("word", "rc", "n", "n_reads")


def barcodes_found(barcodes: DataFrame, seqs: DataFrame, k: int, key: str) -> DataFrame:
    """barcode, errors (0 or 1), key, pos of every place of a barcode (k letters) with at most one letter changed."""
    forms = barcodes.select("barcode", F.lit(0).alias("errors"), F.col("barcode").alias("fwd")).unionAll(barcodes.select("barcode", F.lit(1), F.explode(one_letter_off(F.col("barcode"), k))))
    return kmerized(seqs, k, key).join(forms, "fwd").select("barcode", "errors", key, "pos")


def picked_bases(seqs: DataFrame, picks: DataFrame, key: str) -> DataFrame:
    """key, start, seq of ranges (key, start, stop: from 0, half-open, cut at the end; rc: turned round)."""
    part = F.expr("substring(seq, int(start) + 1, int(greatest(stop - start, 0)))")
    return picks.join(seqs.select(key, "seq"), key).select(key, "start", F.when(F.col("rc"), reverse_complement(part)).otherwise(part).alias("seq"))


def subproject(ids: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Pairs (id1, id2) of which both reads are in ``ids`` (column ``key``)."""
    known = ids.select(key).distinct()
    return pairs.join(known.withColumnRenamed(key, "id1"), "id1", "left_semi").join(known.withColumnRenamed(key, "id2"), "id2", "left_semi")
