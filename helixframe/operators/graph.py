"""Graphs as edge tables: unitigs, components, paths, clean-up.

Iterations are joins over shrinking or pointer-doubled tables.  After each round
the state is cut from its lineage with ``checkpoint()`` into the folder that
spark.checkpoint.dir names, which all executors share.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import reverse_complement


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept where every executor can read them."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="helixframe-"))
    return df.checkpoint()


def oriented_kmers(kmers: DataFrame) -> DataFrame:
    """node: distinct words of both strands."""
    both = kmers.select(F.col("fwd").alias("node")).unionAll(kmers.select(reverse_complement(F.col("fwd")).alias("node")))
    return both.distinct()


def adjacency(nodes: DataFrame) -> DataFrame:
    """src, dst: the last k - 1 letters of src begin dst."""
    left = nodes.select(F.col("node").alias("src"), F.expr("substring(node, 2)").alias("mid"))
    right = nodes.select(F.col("node").alias("dst"), F.expr("left(node, length(node) - 1)").alias("mid"))
    return left.join(right, "mid").select("src", "dst")


def unbranched(edges: DataFrame) -> DataFrame:
    """Edges whose source has one way out and whose target has one way in (no loops)."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("o"), F.min("dst").alias("dst")).where("o = 1").select("src", "dst")
    into = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("i")).where("i = 1").select("dst")
    return out.join(into, "dst").where("src <> dst").select("src", "dst")


def unitigs(nodes: DataFrame, max_rounds: int = 40) -> DataFrame:
    """head, n, seq: maximal unbranched paths, from their first word; circles begin at their least word.

    Pointer doubling: every node knows an ancestor and its distance; each round
    doubles the distance, so a path of n words takes log2(n) rounds.
    """
    links = cut(unbranched(adjacency(nodes)))
    # Nodes on circles never meet a first word; break each circle before its least node.
    back = nodes.join(links.select(F.col("dst").alias("node"), F.col("src").alias("up")), "node", "left")
    state = cut(back.select("node", F.coalesce("up", "node").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("d"), F.col("up").isNull().alias("done"), F.least("node", F.coalesce("up", "node")).alias("low")))
    for _ in range(max_rounds):
        above = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"), F.col("done").alias("done2"), F.col("low").alias("low2"))
        state = cut(
            state.join(above, "up").select(
                "node",
                F.when(F.col("done"), F.col("up")).otherwise(F.col("up2")).alias("up"),
                F.when(F.col("done"), F.col("d")).otherwise(F.col("d") + F.col("d2")).alias("d"),
                (F.col("done") | F.col("done2")).alias("done"),
                F.least("low", "low2").alias("low"),
            )
        )
        open_ = state.where(~F.col("done")).agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).first()
        if not open_["n"] or open_["d"] > 2 * open_["n"]:
            break
    else:
        raise RuntimeError(f"unitigs are not settled after {max_rounds} rounds")
    circles = state.where(~F.col("done")).select("node", "low")
    if not circles.isEmpty():
        broken = links.join(circles.where("node = low").select(F.col("node").alias("dst")), "dst", "left_anti")
        kept = nodes.join(circles.select("node"), "node", "left_semi")
        extra = chains(kept, broken.join(kept.select(F.col("node").alias("dst")), "dst", "left_semi"), max_rounds)
        placed = state.where("done").select("node", F.col("up").alias("head"), "d").unionByName(extra)
    else:
        placed = state.select("node", F.col("up").alias("head"), "d")
    return _spelled(placed)


def chains(nodes: DataFrame, links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node, head, d: the first node of its chain and the steps from there; links (src, dst) form no circle."""
    back = nodes.join(links.select(F.col("dst").alias("node"), F.col("src").alias("up")), "node", "left")
    state = cut(back.select("node", F.coalesce("up", "node").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("d")))
    for _ in range(max_rounds):
        above = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        state = cut(state.join(above, "up").select("node", F.col("up2").alias("up"), (F.col("d") + F.col("d2")).alias("d"), (F.col("d2") > 0).alias("moved")))
        if state.where("moved").isEmpty():
            return state.select("node", F.col("up").alias("head"), "d")
        state = state.drop("moved")
    raise RuntimeError(f"chains are not settled after {max_rounds} rounds")


def _spelled(chains: DataFrame) -> DataFrame:
    """The first word, then the last letter of each further one; one row per unitig."""
    rows = chains.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("d", F.right("node", F.lit(1)).alias("c")))).alias("path"))
    tail = F.concat_ws("", F.transform(F.expr("slice(path, 2, size(path))"), lambda x: x["c"]))
    return rows.select("head", "n", F.concat("head", tail).alias("seq"))


def involution(seqs: DataFrame, key: str) -> DataFrame:
    """key, inv: each sequence and the one that is its reverse complement."""
    other = seqs.select(F.col(key).alias("inv"), reverse_complement(F.col("seq")).alias("seq"))
    return seqs.join(other, "seq").select(key, "inv")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component: the least node that can be reached, edges taken both ways."""
    both = cut(edges.select("src", "dst").unionAll(edges.select("dst", "src")).distinct())
    state = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    for _ in range(max_rounds):
        heard = both.join(state.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("heard"))
        near = state.join(heard, "node").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("component"))
        jump = state.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = cut(near.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        moved = not step.where("component <> old").isEmpty()
        state = step.select("node", "component")
        if not moved:
            return state
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")


def distances(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """node, steps: least number of edges from any source (column node), up to ``depth``."""
    found = cut(sources.select("node").distinct().withColumn("steps", F.lit(0)))
    frontier = found
    for k in range(1, depth + 1):
        nxt = frontier.join(edges.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node")).distinct()
        frontier = cut(nxt.join(found, "node", "left_anti").withColumn("steps", F.lit(k)))
        if frontier.isEmpty():
            break
        found = cut(found.unionByName(frontier))
    return found


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_out, n_in"""
    rows = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    return rows.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def tips(edges: DataFrame) -> DataFrame:
    """Edges that end in a dead end while their source has another way on."""
    deg = degrees(edges)
    dead = deg.where("n_out = 0 AND n_in = 1").select(F.col("node").alias("dst"))
    fork = deg.where("n_out > 1").select(F.col("node").alias("src"))
    return edges.join(dead, "dst", "left_semi").join(fork, "src", "left_semi")


def bubbles(edges: DataFrame, columns: list[str]) -> DataFrame:
    """src, dst, n, members: places where several edges lead from one node to the same other."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(*columns))).alias("members")).where("n > 1")


def without_parallel(edges: DataFrame, order: list[str]) -> DataFrame:
    """The first edge between each two nodes."""
    w = Window.partitionBy("src", "dst").orderBy(*order)
    return edges.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def spanning_forest(edges: DataFrame, max_rounds: int = 30) -> DataFrame:
    """src, dst, w of a least spanning forest (Boruvka): every component takes its least edge, then components merge."""
    edges = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").groupBy("src", "dst").agg(F.min("w").alias("w")))
    nodes = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct()
    state, chosen = cut(nodes.withColumn("component", F.col("node"))), None
    for _ in range(max_rounds):
        a, b = state.select(F.col("node").alias("src"), F.col("component").alias("ca")), state.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
        outer = cut(edges.join(a, "src").join(b, "dst").where("ca <> cb"))
        if outer.isEmpty():
            return chosen.select("src", "dst", "w") if chosen is not None else edges.limit(0)
        both = outer.select(F.col("ca").alias("c"), "src", "dst", "w").unionAll(outer.select(F.col("cb").alias("c"), "src", "dst", "w"))
        picked = both.groupBy("c").agg(F.min(F.struct("w", "src", "dst")).alias("e")).select("e.*").distinct()
        chosen = cut(picked if chosen is None else chosen.unionByName(picked))
        state = components(chosen.select("src", "dst"))
        state = cut(nodes.join(state, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    raise RuntimeError(f"the forest is not settled after {max_rounds} rounds")


def shortest_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node, distance of every node that can be reached from a start over edges (src, dst, weight >= 0).

    Each round relaxes the edges of nodes whose distance fell in the last one, until none falls."""
    reached = cut(starts.select("node", F.lit(0.0).alias("distance")).distinct())
    frontier = reached
    while True:
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"))
        step = step.groupBy("node").agg(F.min("distance").alias("nearer"))
        frontier = cut(step.join(reached, "node", "left").where("distance IS NULL OR nearer < distance").select("node", F.col("nearer").alias("distance")))
        if frontier.isEmpty():
            return reached
        reached = cut(reached.union(frontier).groupBy("node").agg(F.min("distance").alias("distance")))


def paths_between(edges: DataFrame, starts: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    """path (array of nodes) of every simple path of at most ``most`` edges from a start to an end."""
    back = cut(ends.select("node").distinct())
    # Only nodes from which an end can be reached in the steps left are followed.
    near = [back]
    for _ in range(most):
        near.append(cut(near[-1].union(edges.join(near[-1], F.col("dst") == F.col("node")).select(F.col("src").alias("node"))).distinct()))
    walks = starts.select("node").distinct().join(near[most], "node", "left_semi").select("node", F.array("node").alias("path"))
    found = walks.join(back, "node", "left_semi").select("path")
    for left in range(most - 1, -1, -1):
        step = walks.join(edges.select("src", "dst").distinct(), F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        walks = cut(step.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")).join(near[left], "node", "left_semi"))
        found = found.union(walks.join(back, "node", "left_semi").select("path"))
    return found


def odd_components(edges: DataFrame) -> DataFrame:
    """component: the components (least node) that hold an odd cycle, of edges (src, dst) without direction.

    Every node becomes two, one for each parity; an odd cycle joins both."""
    side = lambda c, p: F.concat(F.lpad(F.col(c).cast("string"), 20, "0"), F.lit(f":{p}"))
    doubled = edges.select(side("src", 0).alias("src"), side("dst", 1).alias("dst")).union(edges.select(side("src", 1).alias("src"), side("dst", 0).alias("dst")))
    by_node = components(doubled).groupBy(F.substring_index("node", ":", 1).alias("name")).agg(F.min("component").alias("c"), F.count_distinct("component").alias("n"))
    return by_node.where("n = 1").select(F.substring_index("c", ":", 1).cast("long").alias("component")).distinct()


def disjoint_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Edges (src, dst) of both, the second's nodes moved behind the first's (one scalar)."""
    behind = first.agg((F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)) + 1).alias("behind"))
    moved = second.join(F.broadcast(behind)).select((F.col("src") + F.col("behind")).alias("src"), (F.col("dst") + F.col("behind")).alias("dst"))
    return first.select("src", "dst").union(moved)
