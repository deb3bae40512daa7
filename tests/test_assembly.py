import math
import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import distributions as d
from helixframe.operators import assembly, correct


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_single_errors_are_mended(spark):
    rng = random.Random(4)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    good = [genome[i : i + 60] for i in range(0, 240, 10)]
    bad = list(genome[95:155])
    at = 30
    bad[at] = "ACGT"[("ACGT".index(bad[at]) + 1) % 4]
    rows = spark.createDataFrame([*enumerate(good), (99, "".join(bad))], "read_id long, seq string")
    fixes = correct.single_fixes(rows, 15, 2)
    assert [(r["read_id"], r["pos"], r["base"]) for r in fixes.collect()] == [(99, at + 1, genome[95 + at])]
    mended = {r["read_id"]: r["seq"] for r in correct.applied(rows, fixes).collect()}
    assert mended[99] == genome[95:155] and mended[0] == good[0]


def test_hangs_and_bubbles(spark):
    edges = [(1, 0, 1, "A" * 50, 9.0), (2, 1, 2, "C" * 50, 9.0), (3, 1, 3, "G" * 5, 1.0), (4, 2, 4, "ACGTACGTAC", 8.0), (5, 2, 4, "ACGTACGAAC", 2.0)]
    df = spark.createDataFrame(edges, "eid long, src long, dst long, seq string, weight double")
    assert {r["eid"] for r in assembly.without_hangs(df, 10, 5.0).collect()} == {1, 2, 4, 5}
    assert {(r["eid"], r["weight"]) for r in assembly.popped_bubbles(df, 0.2).collect()} == {(1, 9.0), (2, 9.0), (3, 1.0), (4, 10.0)}
    assert [tuple(r) for r in assembly.bubble_kinds(df).collect()] == [(2, 4, "substitution")]


def test_edits_apply_from_the_right(spark):
    seqs = spark.createDataFrame([(1, "ABCDEFGH"), (2, "XY")], "k long, seq string")
    edits = spark.createDataFrame([(1, 1, 3, "zzz"), (1, 5, 5, "+"), (1, 7, 8, "")], "k long, start int, stop int, text string")
    assert {r["k"]: r["seq"] for r in correct.edited(seqs, edits, "k").collect()} == {1: "AzzzDE+FG", 2: "XY"}


def test_scaffolds(spark):
    placed = spark.createDataFrame([(1, 1, 10, 5), (1, 2, 20, 7), (2, 1, 3, None)], "scaffold long, place int, len long, gap long")
    assert {r["scaffold"]: (r["true_length"], r["reduced_length"]) for r in assembly.scaffold_lengths(placed).collect()} == {1: (35, 30), 2: (3, 3)}
    joins = spark.createDataFrame([(1, 2), (2, 5)], "a long, b long")
    assert {r["contig"]: r["scaffold"] for r in assembly.scaffolds(joins).collect()} == {1: 1, 2: 1, 5: 1}


def test_distributions(spark):
    assert value(spark, d.poisson(F.lit(3), F.lit(2.5))) == pytest.approx(math.exp(-2.5) * 2.5**3 / 6)
    assert value(spark, d.poisson_cdf(F.lit(3), F.lit(2.5))) == pytest.approx(sum(math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(4)))
    assert value(spark, d.binomial(F.lit(2), F.lit(5), F.lit(0.3))) == pytest.approx(10 * 0.09 * 0.343)
    for z in (-2.0, 0.0, 1.5):
        assert value(spark, d.normal_cdf(F.lit(z))) == pytest.approx((1 + math.erf(z / math.sqrt(2))) / 2, abs=1e-6)
    assert value(spark, d.normal_boundary(F.lit(0.0), F.lit(1.0), F.lit(4.0), F.lit(1.0))) == pytest.approx(2.0)
    roots = [value(spark, d.quadratic_roots(F.lit(a), F.lit(b), F.lit(c))) for a, b, c in ((1.0, -2.0, 1.0), (1.0, 0.0, 1.0), (2.0, 0.0, -2.0))]
    assert roots == [[1.0, 1.0], [], [-1.0, 1.0]]
    assert value(spark, d.gcd(F.lit(84), F.lit(-36))) == 12
