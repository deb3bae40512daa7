import heapq
import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import arrays, strings
from helixframe.operators import bias, calls, graph, reads


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize("text, want", [("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("2 ^ 3 ^ 2", 512), ("7 / 2 - 1", 2), ("-x + 10", 5), ("10 - 2 - 3", 5), ("x * x / 4", 6)])
def test_calculator(spark, text, want):
    assert one(spark, strings.calculated(text, x=F.col("x")), x=5) == want


def test_calculator_refuses_other_signs():
    with pytest.raises(ValueError):
        strings.calculated("1 % 2")


def test_string_places(spark):
    s = F.col("s")
    assert one(spark, strings.position_last(s, "ab"), s="abcab") == 4 and one(spark, strings.position_last(s, "x"), s="abcab") == 0
    assert one(spark, strings.with_extension(s, ".b"), s="d.e/f") == "d.e/f.b" and one(spark, strings.with_extension(s, ".b"), s="d/f.txt") == "d/f.b"
    assert one(spark, strings.parsed_int(s), s="1.5") is None and one(spark, strings.parsed_float(s), s="-1.5e2") == -150


def test_arrays(spark):
    a = F.array(*map(F.lit, [3, 1, 3, 2]))
    b = F.array(*map(F.lit, [1, 2, 3, 4]))
    keys, other = arrays.sorted_together(a, b, unique=True)
    assert one(spark, keys) == [1, 2, 3] and one(spark, other) == [2, 4, 1]
    assert one(spark, arrays.overlap_append(F.array(*map(F.lit, [1, 2, 3])), F.array(*map(F.lit, [2, 3, 4])))) == [1, 2, 3, 4]
    assert not one(spark, arrays.is_ordered(a)) and one(spark, arrays.is_ordered(b, strictly=True))
    assert len(one(spark, arrays.combinations(6, 3))) == 20
    assert [one(spark, arrays.power_of_two_at_least(F.lit(n))) for n in (1, 2, 3, 64, 65)] == [1, 2, 4, 64, 128]
    assert arrays.quadratic_roots(1, -3, 2) == [1, 2] and arrays.quadratic_roots(1, 0, 1) == []


def test_placements_follow_the_bases(spark):
    """A piece cut from a middle sequence and that from a target must spell the same on the composed place."""
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rng = random.Random(1)
    target = "".join(rng.choice("ACGT") for _ in range(300))
    for br in (False, True):
        middle = rc(target[100:200]) if br else target[100:200]
        for ar in (False, True):
            read = rc(middle[20:50]) if ar else middle[20:50]
            schema = "`from` long, `to` long, start long, stop long, rc boolean"
            r = reads.composed(spark.createDataFrame([(1, 2, 20, 50, ar)], schema), spark.createDataFrame([(2, 3, 100, 200, br)], schema)).first()
            found = target[r["start"] : r["stop"]]
            assert (rc(found) if r["rc"] else found) == read


def test_dodgy_reads_and_their_pairs(spark):
    rows = spark.createDataFrame([(1, "AAAA"), (2, "ACGT"), (3, "ACGT"), (4, ""), (5, None), (6, "")], "read_id long, seq string")
    got = {(r["read_id"], r["reason"]) for r in reads.dodgy(rows).collect()}
    assert got == {(1, "poly_a"), (3, "duplicate"), (6, "duplicate")}
    pairs = spark.createDataFrame([(10, 1, 2), (11, 2, 5), (12, 3, 3)], "pair_id long, id1 long, id2 long")
    assert {r[0] for r in reads.with_partners(reads.dodgy(rows), pairs, "read_id").collect()} == {10, 12}


def test_edited_reference_leaves_out_overlapping_calls(spark):
    seqs = spark.createDataFrame([(1, "ACGTACGT"), (2, "AAAA")], "contig_id long, seq string")
    rows = [(1, 2, "CGT", "C", 2), (1, 3, "G", "T", 2), (1, 5, "A", "AGG", 2), (1, 6, "C", "T", 1)]
    made = spark.createDataFrame(rows, "contig long, pos long, ref string, alt string, gt int")
    assert {r["contig_id"]: r["seq"] for r in calls.edited_reference(seqs, made, "contig_id").collect()} == {1: "ACAGGCGT", 2: "AAAA"}


def test_sites_overlap(spark):
    rows = spark.createDataFrame([(1, "AAAATAA"), (2, "CC"), (3, "AA")], "read_id long, seq string")
    assert {(r["read_id"], r["pos"]) for r in bias.sites(rows, "read_id", "AA").collect()} == {(1, 1), (1, 2), (1, 3), (1, 6), (3, 1)}


def test_shortest_paths_match_dijkstra(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(12), rng.randrange(12), float(rng.randrange(10))) for _ in range(40)]
    best, heap = {}, [(0.0, 0)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in best:
            best[n] = d
            for a, b, w in edges:
                if a == n:
                    heapq.heappush(heap, (d + w, b))
    got = graph.shortest_paths(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame([(0,)], "node long"))
    assert {r["node"]: r["distance"] for r in got.collect()} == best


def test_odd_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 11), (11, 12), (12, 13), (13, 10), (20, 21)]
    assert {r[0] for r in graph.odd_components(spark.createDataFrame(edges, "src long, dst long")).collect()} == {1}


def test_mendelian_rule(spark):
    rows = spark.createDataFrame([(c, m, f) for c in range(3) for m in range(3) for f in range(3)], "c int, m int, f int")
    alleles = {0: (0,), 1: (0, 1), 2: (1,)}
    for r in rows.withColumn("odd", calls.not_mendelian(F.col("c"), F.col("m"), F.col("f"))).collect():
        assert r["odd"] == (r["c"] not in {x + y for x in alleles[r["m"]] for y in alleles[r["f"]]})
