"""Finishing of assemblies: lines, repeats pulled apart, circles, breaks, cut regions, merged pairs, haplotype calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import reverse_complement
from helixframe.operators.graph import chains, components, cut


def lines(edges: DataFrame) -> DataFrame:
    """line (first cell: s, e), pos (from 0), src, dst, n_edges.

    A cell is all edges from one node to the same other one (an edge or a bubble).  Cells follow each other in a line where
    they meet in a node with one cell in and one out; a circle of cells begins at its least one.
    """
    cells = cut(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_edges")))
    into = cells.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"), F.min("src").alias("before")).where("i = 1")
    out = cells.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"), F.min("dst").alias("after")).where("o = 1")
    cell = lambda s, e: F.struct(F.col(s).alias("s"), F.col(e).alias("e"))
    links = cut(into.join(out, "node").where("before <> node").select(cell("before", "node").alias("src"), cell("node", "after").alias("dst")))
    member = components(links)
    headed = member.join(links.select(F.col("dst").alias("node")), "node", "left_anti").select("component")
    circles = member.join(headed, "component", "left_anti").where("node = component").select(F.col("node").alias("dst"))
    nodes = cells.select(cell("src", "dst").alias("node"), "n_edges")
    placed = chains(nodes.select("node"), links.join(circles, "dst", "left_anti"))
    return placed.join(nodes, "node").select(F.col("head").alias("line"), F.col("d").cast("long").alias("pos"), F.col("node.s").alias("src"), F.col("node.e").alias("dst"), "n_edges")


def islands(rows: DataFrame, by: list[str], order: str, ends: Column) -> DataFrame:
    """Adds part (from 0): a new one begins after each row at which ``ends`` holds."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("part", F.coalesce(F.sum(ends.cast("long")).over(before), F.lit(0)))


def broken(layout: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    """scaffold, place, part: scaffolds are cut between two places that fewer than ``least`` spans
    (scaffold, first, last: places of both ends) reach across.  Spans are counted by end before they meet a scaffold."""
    ends = spans.select("scaffold", F.col("first").alias("place"), F.lit(1).alias("n")).unionAll(spans.select("scaffold", "last", F.lit(-1)))
    ends = ends.groupBy("scaffold", "place").agg(F.sum("n").alias("change"))
    upto = Window.partitionBy("scaffold").orderBy("place")
    rows = layout.select("scaffold", "place").join(ends, ["scaffold", "place"], "left").withColumn("across", F.sum(F.coalesce("change", F.lit(0))).over(upto))
    return islands(rows, ["scaffold"], "place", F.col("across") < least).select("scaffold", "place", "part")


def circular(layout: DataFrame, links: DataFrame, least: int) -> DataFrame:
    """scaffold, gap, n_links: scaffolds whose last contig is linked with their first one by ``least`` links or more.

    ``layout`` has scaffold, place, contig; ``links`` has a (its end), b (its start), sep.  A link counts where it is in the table;
    links are counted by (a, b) first."""
    ends = layout.groupBy("scaffold").agg(F.max_by("contig", "place").alias("a"), F.min_by("contig", "place").alias("b"))
    bundles = links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_links"), F.floor(F.avg("sep")).alias("gap")).where(F.col("n_links") >= least)
    return ends.join(bundles, ["a", "b"]).select("scaffold", "gap", "n_links")


def without_regions(seqs: DataFrame, regions: DataFrame, key: str, least: int) -> DataFrame:
    """key, start (from 0), seq: what is left of each sequence outside its regions (key, start, stop: half-open, in any order,
    overlapping or beyond the end), in pieces of ``least`` letters or more."""
    size = seqs.select(key, F.length("seq").cast("long").alias("start"), F.length("seq").cast("long").alias("stop"))
    marks = regions.where("start < stop").select(key, F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).unionAll(size)
    before = Window.partitionBy(key).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    gaps = marks.withColumn("begin", F.greatest(F.coalesce(F.max("stop").over(before), F.lit(0)), F.lit(0))).where(F.col("start") - F.col("begin") >= least)
    found = gaps.join(seqs.select(key, "seq"), key).withColumn("piece", F.expr("substring(seq, int(begin) + 1, int(start - begin))"))
    return found.where(F.length("piece") >= least).select(key, F.col("begin").alias("start"), F.col("piece").alias("seq"))


def pulled_apart(edges: DataFrame, triples: DataFrame, least: int = 5, ratio: float = 5.0) -> DataFrame:
    """eid, src, dst after repeats are split in two where reads say how they are passed.

    A repeat is an edge r whose source has two edges in and one out and whose target has one in and two out.  Of the two ways
    to pair its edges in with those out one is taken if each of its pairs has ``least`` reads or more and the
    weaker one ``ratio`` times as many as the stronger pair of the other way.  ``triples`` has a, r, c, n (path counts, a row per
    triple).  The pair with the greater edge in moves to new nodes -(2r + 1) and -(2r + 2) and the new edge -(r + 1).
    Ids are 0 or more.
    """
    edges = edges.select("eid", "src", "dst")
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("eid").alias("low"), F.max("eid").alias("high"), F.min("src").alias("s1"), F.max("src").alias("s2"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("eid").alias("low"), F.max("eid").alias("high"))
    left = into.where("n = 2").join(out.where("n = 1").select("node"), "node").select(F.col("node").alias("src"), F.col("low").alias("a1"), F.col("high").alias("a2"), "s1", "s2")
    right = out.where("n = 2").join(into.where("n = 1").select("node"), "node").select(F.col("node").alias("dst"), F.col("low").alias("c1"), F.col("high").alias("c2"))
    repeats = edges.join(left, "src").join(right, "dst").where("s1 <> dst AND s2 <> dst").select(F.col("eid").alias("r"), "a1", "a2", "c1", "c2")
    reads = lambda a, c: F.coalesce(F.sum(F.when((F.col("a") == F.col(a)) & (F.col("c") == F.col(c)), F.col("n"))), F.lit(0))
    votes = triples.join(repeats, "r").groupBy("r", "a1", "a2", "c1", "c2").agg(reads("a1", "c1").alias("x"), reads("a2", "c2").alias("y"), reads("a1", "c2").alias("u"), reads("a2", "c1").alias("v"))
    clear = lambda p, q, s, t: (F.least(p, q) >= least) & (F.least(p, q) >= ratio * F.greatest(s, t))
    straight, crossed = clear("x", "y", "u", "v"), clear("u", "v", "x", "y")
    # The edges of the pair that moves: its edge in is the greater one.
    moved = cut(votes.where(straight | crossed).select("r", F.col("a2").alias("a"), F.when(straight, F.col("c2")).otherwise(F.col("c1")).alias("c")))
    new_dst = moved.select(F.col("a").alias("eid"), (-(2 * F.col("r") + 1)).alias("new_dst"))
    new_src = moved.select(F.col("c").alias("eid"), (-(2 * F.col("r") + 2)).alias("new_src"))
    kept = edges.join(new_dst, "eid", "left").join(new_src, "eid", "left").select("eid", F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"))
    return kept.unionAll(moved.select(-(F.col("r") + 1), -(2 * F.col("r") + 1), -(2 * F.col("r") + 2)))


def stretches(hits: DataFrame, k: int) -> DataFrame:
    """q, t, offset, q_from, length of every maximal exact match of ``k`` letters or more, from the seed hits of all words."""
    w = Window.partitionBy("q", "t", "offset").orderBy("q_pos")
    rows = hits.withColumn("island", F.col("q_pos") - F.row_number().over(w))
    return rows.groupBy("q", "t", "offset", "island").agg(F.min("q_pos").alias("q_from"), (F.count(F.lit(1)) + (k - 1)).alias("length")).drop("island")


def joined(first: bytes, second: bytes, least: int) -> bytes | None:
    """``first`` and ``second`` over their longest overlap (an end of one, a beginning of the other) of ``least`` letters or more."""
    if least < 1 or len(second) < least:
        return None
    start, seed = max(0, len(first) - len(second)), second[:least]
    while (start := first.find(seed, start)) >= 0:
        if second.startswith(first[start:]):
            return first[:start] + second
        start += 1
    return None


def filled_pairs(pairs: DataFrame, first: str, second: str, least: int) -> DataFrame:
    """Adds seq: both reads of a pair in one, the second one turned round; null where they do not overlap or one is null."""

    def run(a: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in a:
            both = ((joined(p.encode(), q.encode(), least) if p is not None and q is not None else None) for p, q in zip(x, y, strict=True))
            yield pd.Series([s.decode() if s is not None else None for s in both], dtype=object)

    udf = F.pandas_udf(run, "string")
    return pairs.withColumn("seq", udf(F.col(first), reverse_complement(F.col(second))))


def haplotypes(piles: DataFrame, least: int, share: float, above: float, balance: float) -> DataFrame:
    """Adds haplotypes: 1, 2 or 0 (not to be trusted) for each pile (A, C, G, T).

    One: the first base has ``least`` reads, ``share`` of all and ``above`` times the second.  Two: so have the first two together,
    the second ``above`` times the third and ``balance`` of the first."""
    n = F.sort_array(F.array(*(F.col(b) for b in "ACGT")), asc=False)
    n0, n1, n2 = n[0], n[1], n[2]
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    one = (n0 >= least) & (n0 >= share * total) & (n0 >= above * n1)
    two = (n0 + n1 >= least) & (n0 + n1 >= share * total) & (n1 >= above * n2) & (n1 >= balance * n0)
    return piles.withColumn("haplotypes", F.when(one & (total > 0), 1).when(two & (total > 0), 2).otherwise(0))
