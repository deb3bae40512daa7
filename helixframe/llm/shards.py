"""Sharding by a hierarchical weighted hash tree (native DataFrame code only).

A tree has three levels: region, rack, shard.  A row descends it with one
weighted hash draw per level: every child ``c`` of weight ``w`` draws
``-ln(u(key, c)) / w`` from a hash of the key and the child's name, and the
smallest draw wins.  A child's draw depends on nothing but its own name and
weight, so a changed weight moves rows only between the changed subtree and its
siblings; all other subtrees keep their rows.  ``grow`` hangs a new shard into a
region of its own: at every level the old draws stay as they were, hence rows
can only move into the new shard.

Defined results: a null key is a key like any other; a null text has no bytes
(size 1, crc32 of nothing); rows with equal keys share a shard and get
different slots; an empty table gives an empty table; columns of the input
other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one slot bucket holds on average.
BUCKET_ROWS = 100_000
#: A shard has at least so many slot buckets, which spreads small tables too.
MIN_BUCKETS = 256


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def balanced_tree(shards: int = 8, per_rack: int = 2, per_region: int = 4) -> list[Leaf]:
    return [Leaf(f"region{i // per_region}", f"rack{i // per_rack}", i) for i in range(shards)]


def grow(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, which is the only one that gains rows."""
    n = 1 + max(leaf.shard for leaf in tree)
    return [*tree, Leaf(f"region+{n}", f"rack+{n}", n, weight)]


def _draw(key: Column, name: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(2**53))) / F.lit(float(weight))


def _pick(draws: list[tuple[Column, Column]]) -> Column:
    """The value that goes with the smallest draw; the first one at a tie."""
    if len(draws) == 1:
        return draws[0][1]
    rows = [F.struct(d.alias("d"), F.lit(i).alias("i"), v.alias("v")) for i, (d, v) in enumerate(draws)]
    return F.least(*rows)["v"]


def place(df: DataFrame, tree: Sequence[Leaf], key: str, out: str) -> DataFrame:
    """Add column ``out``: the shard of each row."""
    if not tree or any(leaf.weight <= 0 for leaf in tree) or len({leaf.shard for leaf in tree}) < len(tree):
        raise ValueError("a tree needs shards of positive weight and distinct numbers")
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in tree:
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    k = F.col(key)
    total = lambda leaves: sum(x.weight for x in leaves)
    region, rack = f"__{out}_region", f"__{out}_rack"

    draws = [(_draw(k, f"region/{r}", sum(map(total, racks.values()))), F.lit(r)) for r, racks in regions.items()]
    df = df.withColumn(region, _pick(draws))
    picks = [
        (F.col(region) == r, _pick([(_draw(k, f"rack/{r}/{q}", total(leaves)), F.lit(q)) for q, leaves in racks.items()]))
        for r, racks in regions.items()
    ]
    df = df.withColumn(rack, reduce(lambda c, x: c.when(*x), picks[1:], F.when(*picks[0])))
    picks = [
        (
            (F.col(region) == r) & (F.col(rack) == q),
            _pick([(_draw(k, f"shard/{r}/{q}/{x.shard}", x.weight), F.lit(x.shard)) for x in leaves]),
        )
        for r, racks in regions.items()
        for q, leaves in racks.items()
    ]
    df = df.withColumn(out, reduce(lambda c, x: c.when(*x), picks[1:], F.when(*picks[0])).cast("int"))
    return df.drop(region, rack)


def slotted(df: DataFrame, shard: str, order: Sequence[str], rows: int) -> DataFrame:
    """Add ``slot``: a gapless number from 0 within each shard.

    Rows of a shard are numbered bucket by bucket.  A bucket is a hash class of
    the ordering columns, so that no task ever sorts a whole shard, and the
    first number of each bucket comes from a sum over bucket counts only.
    """
    from pyspark.sql import Window

    buckets = max(MIN_BUCKETS, -(-rows // BUCKET_ROWS))
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    # The bucket number lies in [0, buckets): one small row per shard and bucket.
    within = Window.partitionBy(shard, "__bucket").orderBy(*order)
    ranked = df.withColumn("__rank", F.row_number().over(within) - 1)
    joined = ranked.join(starts, [shard, "__bucket"])
    return joined.withColumn("slot", (F.col("__start") + F.col("__rank")).cast("long")).drop("__bucket", "__rank", "__start")


def shard_documents(docs: DataFrame, tree: Sequence[Leaf] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    tree = list(tree or balanced_tree())
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = place(rows, tree, "doc_id", "shard")
    rows = place(rows, grow(tree), "doc_id", "grown_shard")
    rows = slotted(rows, "shard", ["doc_id", "text_crc32", "size"], docs.count())
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
