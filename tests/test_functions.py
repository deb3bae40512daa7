import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as s
from helixframe.functions import strings as t
from helixframe.operators import stats


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_reverse_complement_is_its_own_inverse(spark):
    for a, b in (("TTGGAACC", "GGTTCCAA"), ("GGTTCAA", "TTGAACC")):
        assert one(spark, s.reverse_complement(F.col("q")), q=a) == b
        assert one(spark, s.reverse_complement(s.reverse_complement(F.col("q"))), q=a) == a


def test_both_canonical_rules_pick_one_of_each_strand(spark):
    for word in ("ACGTACGTACG", "AAAAATAAAAA", "GGGGGCGGGGG"):
        for rule in (s.canonical, lambda c: s.canonical_by_middle(c, 11)):
            both = {one(spark, rule(F.col("q")), q=word), one(spark, rule(s.reverse_complement(F.col("q"))), q=word)}
            assert len(both) == 1


def test_runs_and_dominant_base(spark):
    assert one(spark, s.longest_run(F.col("q")), q="AAAGGGGGAAAAA") == 5
    assert one(spark, s.capped_runs(F.col("q"), 2), q="AAAGGGGGACC") == "AAGGACC"
    best = one(spark, s.dominant_base(F.col("q")), q="AAAAAAAAAAGGGTTTCCCC")
    assert (best["percent"], best["base"]) == (50.0, "A")
    assert one(spark, s.is_homopolymer(F.col("q")), q="AAAA") and not one(spark, s.is_homopolymer(F.col("q")), q="AGTC")


def test_translation_and_frames(spark):
    assert one(spark, s.translated(F.col("q")), q="ATGGCCTAAG") == "MA*"
    assert one(spark, s.open_frames(F.col("q")), q="CCATGAAATAGATGTGA") == ["ATGAAATAG", "ATGTGA"]


def test_overlap_digest_and_codes(spark):
    assert one(spark, s.suffix_prefix_overlap(F.col("a"), F.col("b")), a="ACGTTT", b="TTTACG") == 3
    assert one(spark, s.digest(F.col("q"), "GATC", 0), q="AAGATCTTGATCC") == ["AA", "GATCTT", "GATCC"]
    assert one(spark, s.kmer_code(F.col("q")), q="CA") == 4
    assert one(spark, s.mismatches(F.col("a"), F.col("b")), a="ACGT", b="AGGA") == 2


def test_cosine_truncates_the_longer(spark):
    rows = spark.createDataFrame([([1.0, 1.0], [2.0, 2.0, 44.0], 1.0), ([1.0, 1.0], [-1.0, 1.0], 0.0), ([1.0, 1.0], [32000.0, 0.0], 0.5**0.5)], "a array<double>, b array<double>, want double")
    for got, want in rows.select(stats.cosine(F.col("a"), F.col("b")), "want").collect():
        assert got == pytest.approx(want)


def test_n_statistics_of_the_worked_example(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v long")
    assert [r["value"] for r in stats.n_statistics(rows, "v").orderBy("stat").collect()] == [4, 4, 4, 4, 3, 3, 3, 2, 2]
    assert stats.n50(rows, "v").first()["n50"] == 3


@pytest.mark.parametrize("values,want", [([2, 2, 4], 3), ([1, 1, 2], 1), ([5], 5), ([3, 3], 3)])
def test_n50_at_exactly_half(spark, values, want):
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    half, total = 0, sum(values)
    for i, v in enumerate(sorted(values)):
        half += v
        if 2 * half == total and i < len(values) - 1:
            brute = (v + sorted(values)[i + 1]) // 2
            break
        if 2 * half >= total:
            brute = v
            break
    assert stats.n50(rows, "v").first()["n50"] == brute == want


def test_strings(spark):
    assert one(spark, t.before_last(F.col("q"), "/"), q="a/b/c") == "a/b"
    assert one(spark, t.between(F.col("q"), "(", ")"), q="x(y)z") == "y"
    assert one(spark, t.overlapping_count(F.col("q"), "aa"), q="aaaa") == 3
    assert one(spark, t.natural_key(F.col("a")) < t.natural_key(F.col("b")), a="x9", b="x10")
    assert t.parsed_int_set("3|{5,7}|[10,12)") == [(3, 3), (5, 5), (7, 7), (10, 11)]
    assert t.expanded_ranges("chr[#1-3]") == "chr(?:1|2|3)"


def test_library_size_solves_its_equation(spark):
    import math

    assert one(spark, stats.library_size_column(F.col("n"), F.col("d")), n=1000, d=800) == pytest.approx(stats.library_size(1000, 800), rel=1e-9)

    x = stats.library_size(1000, 800)
    assert 800 / x - 1 + math.exp(-1000 / x) == pytest.approx(0, abs=1e-9)
