import random

import pytest
from pyspark.sql import functions as F

from helixframe import plans
from helixframe.operators import correct, inspect, kmers, packed, variants

rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(autouse=True)
def small_buffers(monkeypatch):
    monkeypatch.setattr(packed, "LETTERS", 300)
    monkeypatch.setattr(packed, "BUFFER", 500)


def made(spark, seed=1):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    items = [None, "", "ACG", "A" * 700, genome, rc(genome)]
    for _ in range(40):
        at, n = rng.randrange(380), rng.randrange(5, 200)
        read = list(genome[at : at + n])
        for _ in range(rng.randrange(3)):
            read[rng.randrange(len(read))] = rng.choice("ACGT")
        items.append("".join(read) if rng.random() < 0.5 else rc("".join(read)))
    return spark.createDataFrame(list(enumerate(items)), "read_id long, seq string").repartition(3)


def same(found, wanted):
    rows = lambda df: sorted(tuple(r) for r in df.select(*wanted.columns).collect())
    assert rows(found) == rows(wanted) and wanted.count() > 0


@pytest.mark.parametrize("k", [1, 3, 7, 11])
def test_counts_and_places_are_those_of_the_joins(spark, k):
    rows = made(spark)
    words = kmers.kmerized(rows, k)
    same(packed.per_read(rows, k), kmers.per_read(words))
    same(packed.located(rows, k), kmers.with_counts(words, "kmer", "read_id").select("kmer", F.col("n").alias("kf"), "read_id", F.col("pos").cast("long").alias("pos")))


@pytest.mark.parametrize("k, least", [(3, 2), (11, 2), (15, 2), (15, 3)])
def test_weak_words_and_fixes_are_those_of_the_joins(spark, k, least):
    rows = made(spark, 2)
    words = kmers.kmerized(rows, k)
    weak = correct.weak_places(words, correct.trusted(words, least), "read_id").groupBy("read_id")
    wanted = weak.agg(F.count(F.lit(1)).alias("n"), F.min("pos").cast("long").alias("s"), F.max("pos").cast("long").alias("e"))
    if k > 3:
        same(packed.weak_runs(rows, k, least), wanted)
        same(packed.single_fixes(rows, k, least), correct.single_fixes(rows, k, least))
    else:
        assert packed.weak_runs(rows, k, least).collect() == wanted.collect()


@pytest.mark.parametrize("flank", [1, 4, 6])
def test_recommended_bases_are_those_of_the_join(spark, flank):
    rows = made(spark, 3)
    stacks = variants.stacks(rows, flank, "read_id")
    wanted = variants.recommended(stacks, variants.stack_columns(stacks), 20, 2)
    same(packed.recommended(rows, flank, 20, 2), wanted.select("read_id", F.col("pos").cast("long").alias("pos"), "base", "winner"))


def test_large_sums_and_gaps_survive_the_encoding(spark):
    import numpy as np

    numbers, sums = np.array([0, 254, 509, 765, 4_000_000]), np.array([1, 254, 255, 256, 10**12])
    back = packed._decoded(packed._encoded(numbers, sums))
    assert (back[0] == numbers).all() and (back[1] == sums).all()
    rows = spark.range(700).select(F.col("id").alias("read_id"), F.lit("A" * 20).alias("seq"))
    assert {tuple(r)[1:] for r in packed.per_read(rows, 11).collect()} == {(10, 7000, 7000, 70000)}


def test_what_has_no_number_is_refused_or_empty(spark):
    rows = made(spark)
    assert packed.per_read(rows.limit(0), 11).count() == packed.weak_runs(rows.limit(0), 15, 2).count() == packed.recommended(rows.limit(0), 6, 20, 2).count() == 0
    for wrong in (lambda: packed.per_read(rows, 13), lambda: packed.weak_runs(rows, 14, 2), lambda: packed.recommended(rows, 7, 20, 2)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(Exception, match="other letters"):
        packed.per_read(rows.withColumn("seq", F.concat("seq", F.lit("N"))), 3)


def moved(df):
    """Whether rows of single words reach a shuffle."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Generate explode" in plan


@pytest.mark.parametrize("name", ["stack_recommend", "kmer_read_min_freq", "kmer_read_frequencies", "trusted_kmer_fix", "weak_stretches", "kmer_with_locations"])
def test_no_word_is_a_row_of_a_shuffle(spark, name):
    assert not moved(plans.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_words_meet_the_list_before_the_shuffle(spark):
    found = plans.QUERIES["count_in_reads"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = {name: next(i for i, line in enumerate(plan) if name in line) for name in ("Join LeftSemi", "Generate explode")}
    assert depth["Join LeftSemi"] < depth["Generate explode"] and "strategy=broadcast" in plan[depth["Join LeftSemi"]]
    words = spark.createDataFrame([("ACGT",), ("AAAC",), ("CCCC",)], "word string")
    rows = spark.createDataFrame([(1, "ACGTACGT"), (2, "GTTT"), (3, None)], "read_id long, seq string")
    assert {tuple(r) for r in inspect.words_in_reads(words, rows, 4, "read_id").collect()} == {("ACGT", False, 2, 1), ("ACGT", True, 2, 1), ("AAAC", True, 1, 1)}


@pytest.mark.parametrize("k", [1, 8, 15])
def test_numbered_words_are_the_words(spark, k):
    rows = made(spark, 4)
    code = lambda c: F.conv(F.translate(c, "ACGT", "0123"), 4, 10).cast("int")
    for both, column in ((False, "fwd"), (True, "kmer")):
        same(packed.numbered_words(rows, k, both=both), kmers.kmerized(rows, k).select(code(column).alias("word"), "read_id", "pos"))


@pytest.mark.parametrize("name", ["friends", "kmer_self_similarity"])
def test_linked_words_are_numbers(spark, name):
    found = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow numbers" in plan and "AS fwd" not in plan and found.count() > 0
