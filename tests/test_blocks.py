"""Pairs of reads that share words are whole, and are found block against block."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe import plans
from helixframe.operators import blocks, correct, kmers

WORD = "ACGTTGCA"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_frequent_word_links_all_its_reads(spark):
    # The word is in seven different reads; the old star had the six pairs of the least one only.
    rows = spark.createDataFrame([(i, "C" * i + WORD) for i in range(7)], "read_id long, seq string")
    words = kmers.kmerized(rows, 8)
    own = {r.read_id: set() for r in words.collect()}
    for r in words.collect():
        own[r.read_id].add(r.kmer)
    whole = sorted((a, b, len(own[a] & own[b])) for a in own for b in own if a < b and own[a] & own[b])
    assert len(whole) == 21
    for most in (2, 3, 100):
        assert rows_of(kmers.shared_pairs(words, most)) == whole
    assert not rows_of(kmers.shared_pairs(words.limit(0), 2))


@pytest.fixture
def many_blocks(spark, monkeypatch):
    """A block for every three reads."""
    monkeypatch.setattr(blocks, "CHUNK", 1)
    monkeypatch.setattr(blocks, "BLOCK", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def made(spark):
    """Different reads in no order of their keys, with few words to choose from, one of them in most reads."""
    draw = random.Random(5)
    seqs = {(i, "".join(draw.choices("ACGT", k=draw.randint(0, 90))) + draw.choice(["", WORD])) for i in range(0, 80, 2)}
    seqs |= {(7, WORD * 6), (9, "ACGT"), (10, None), (11, ""), (13, "A" * 70)} | {(14, "".join(draw.choices("ACGT", k=40))) for _ in range(4)}
    seqs = sorted(seqs, key=lambda x: draw.random())
    return spark.createDataFrame(seqs, "read_id long, seq string").repartition(3)


@pytest.mark.parametrize("k", [4, 7])
def test_common_words_of_blocks(spark, many_blocks, k):
    rows = made(spark)
    whole = rows_of(kmers.shared_pairs(kmers.kmerized(rows, k), 1000))
    assert rows_of(blocks.common_words(rows, k)) == whole and len(whole) > 100
    texts = rows.withColumn("read_id", F.format_string("%03d", "read_id"))
    assert rows_of(blocks.common_words(texts, k)) == [(f"{a:03}", f"{b:03}", n) for a, b, n in whole]
    assert not rows_of(blocks.common_words(rows.limit(0), k))


def test_a_key_is_in_one_block():
    sizes = [(1, 3, 0, 5), (3, 3, 1, 5), (3, 4, 2, 5), (5, 9, 3, 5), (10, 12, 4, 2)]
    assert blocks._dealt(sizes, 7) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)]


def test_a_step_may_end_within_a_row(spark):
    reads = [(i, "".join(random.Random(i % 3).choices("ACGT", k=400))) for i in range(1200)]
    rows = spark.createDataFrame(reads, "read_id long, seq string")
    own = {i: {min(s[p : p + 12], s[p : p + 12][::-1].translate(str.maketrans("ACGT", "TGCA"))) for p in range(389)} for i, s in reads[:3]}
    found = blocks.common_words(rows, 12)
    assert 389 * 400 > blocks.LINKS  # links of one read
    whole = Counter(len(own[a % 3] & own[b % 3]) for a in range(1200) for b in range(a))
    del whole[0]
    assert dict(found.groupBy("n").count().collect()) == whole


@pytest.mark.parametrize(("k", "most"), [(4, 3), (4, 30), (7, 2), (7, 50)])
def test_diagonals_of_blocks(spark, many_blocks, k, most):
    rows = made(spark)
    links = kmers.word_links(kmers.kmerized(rows, k).select("read_id", "pos", "fwd"), "fwd", most, "read_id")
    whole = rows_of(correct.on_diagonals(links, 1))
    assert rows_of(blocks.on_diagonals(rows, k, most)) == whole and len(whole) > 100
    assert not rows_of(blocks.on_diagonals(rows.limit(0), k, most))


@pytest.mark.parametrize("name", ["friends", "kmer_self_similarity"])
def test_no_link_is_a_row_of_a_shuffle(spark, name):
    found = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() > 0
