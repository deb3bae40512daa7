import random

from pyspark.sql import functions as F

from helixframe.functions.sequence import reverse_complement
from helixframe.operators import finishing


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_lines_bubbles_circles_and_loops(spark):
    edges = frame(spark, [(1, 2), (2, 3), (2, 3), (3, 4), (4, 5), (4, 6), (10, 11), (11, 12), (12, 10), (20, 20), (30, 31), (31, 30)], "src long, dst long")
    got = {}
    for r in finishing.lines(edges).collect():
        got.setdefault(tuple(r["line"]), []).append((r["pos"], r["src"], r["dst"], r["n_edges"]))
    assert {k: sorted(v) for k, v in got.items()} == {
        (1, 2): [(0, 1, 2, 1), (1, 2, 3, 2), (2, 3, 4, 1)],
        (4, 5): [(0, 4, 5, 1)],
        (4, 6): [(0, 4, 6, 1)],
        (10, 11): [(0, 10, 11, 1), (1, 11, 12, 1), (2, 12, 10, 1)],
        (20, 20): [(0, 20, 20, 1)],
        (30, 31): [(0, 30, 31, 1), (1, 31, 30, 1)],
    }
    assert finishing.lines(edges.limit(0)).count() == 0


def test_pulled_apart(spark):
    edges = frame(spark, [(0, 0, 2), (1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 3, 5)], "eid long, src long, dst long")
    triples = lambda *n: frame(spark, [(a, 2, c, k) for (a, c), k in zip([(0, 3), (1, 4), (0, 4), (1, 3)], n, strict=True)], "a long, r long, c long, n long")
    rows = lambda t: sorted(tuple(r) for r in finishing.pulled_apart(edges, t).collect())
    plain = [(0, 0, 2), (1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 3, 5)]
    assert rows(triples(5, 6, 1, 0)) == sorted([(0, 0, 2), (1, 1, -5), (2, 2, 3), (3, 3, 4), (4, -6, 5), (-3, -5, -6)])
    assert rows(triples(0, 1, 9, 5)) == sorted([(0, 0, 2), (1, 1, -5), (2, 2, 3), (3, -6, 4), (4, 3, 5), (-3, -5, -6)])
    assert rows(triples(4, 6, 0, 0)) == plain and rows(triples(9, 9, 2, 0)) == plain
    # A way back from the target into the source is no plain repeat.
    back = edges.where("eid <> 0").unionAll(frame(spark, [(0, 3, 2)], "eid long, src long, dst long"))
    assert finishing.pulled_apart(back, triples(9, 9, 0, 0)).count() == 5


def test_without_regions_against_brute_force(spark):
    rng = random.Random(4)
    seqs = [(i, "".join(rng.choices("ACGT", k=rng.randrange(0, 60)))) for i in range(30)]
    regions = [(rng.randrange(30), s := rng.randrange(-5, 60), s + rng.randrange(0, 25)) for _ in range(60)]
    want = set()
    for key, seq in seqs:
        free = [not any(k == key and a <= p < b for k, a, b in regions) for p in range(len(seq))]
        p = 0
        while p < len(seq):
            q = p
            while q < len(seq) and free[q]:
                q += 1
            if q - p >= 4:
                want.add((key, p, seq[p:q]))
            p = max(q, p + 1)
    got = finishing.without_regions(frame(spark, seqs, "id long, seq string"), frame(spark, regions, "id long, start long, stop long"), "id", 4)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_broken_against_brute_force(spark):
    rng = random.Random(5)
    layout = [(s, p) for s in range(6) for p in range(1, 8)]
    spans = [(rng.randrange(6), a := rng.randrange(1, 8), min(7, a + rng.randrange(4))) for _ in range(40)]
    want = {(s, p): sum(sum(1 for t, a, b in spans if t == s and a <= j < b) < 2 for j in range(1, p)) for s, p in layout}
    got = finishing.broken(frame(spark, layout, "scaffold long, place long"), frame(spark, spans, "scaffold long, first long, last long"), 2)
    assert {(r["scaffold"], r["place"]): r["part"] for r in got.collect()} == want


def test_circular(spark):
    layout = frame(spark, [(1, 0, 7), (1, 1, 8), (2, 0, 5), (2, 1, 6)], "scaffold long, place long, contig long")
    links = frame(spark, [(8, 7, 10), (8, 7, 13), (6, 5, 1), (5, 6, 1)], "a long, b long, sep long")
    assert [tuple(r) for r in finishing.circular(layout, links, 2).collect()] == [(1, 11, 2)]


def test_joined_takes_the_longest_overlap():
    rng = random.Random(6)
    for _ in range(500):
        a, b = ("".join(rng.choices("AC", k=rng.randrange(0, 12))).encode() for _ in range(2))
        sizes = [n for n in range(3, min(len(a), len(b)) + 1) if a[-n:] == b[:n]]
        assert finishing.joined(a, b, 3) == (a + b[max(sizes) :] if sizes else None)
    assert finishing.joined(b"ACGT", b"ACGT", 0) is None


def test_filled_pairs(spark):
    rows = frame(spark, [(1, "AACCGG", "TTAACCGG"), (2, "AAAA", "AAAA"), (3, None, "ACGT"), (4, "", "")], "id long, a string, b string")
    got = {r["id"]: r["seq"] for r in finishing.filled_pairs(rows, "a", "b", 4).collect()}
    assert got == {1: "AACCGGTTAA", 2: None, 3: None, 4: None}
    turned = rows.where("id = 1").select(reverse_complement(F.col("b")).alias("x")).first()["x"]
    assert turned == "CCGGTTAA"


def test_haplotypes(spark):
    piles = [(9, 0, 0, 0), (5, 4, 0, 0), (3, 0, 0, 0), (4, 4, 4, 4), (0, 0, 0, 0), (8, 1, 1, 1)]
    got = finishing.haplotypes(frame(spark, [(i, *p) for i, p in enumerate(piles)], "i long, A long, C long, G long, T long"), 4, 0.7, 2.0, 0.5)
    assert [r["haplotypes"] for r in got.orderBy("i").collect()] == [1, 2, 0, 0, 0, 1]


def test_stretches(spark):
    a, b = "ACGTACGGTCA", "TTACGTACGCTCAA"
    hits = [(1, i, 2, j, j - i) for i in range(1, len(a) - 1) for j in range(1, len(b) - 1) if a[i - 1 : i + 2] == b[j - 1 : j + 2]]
    want = set()
    for off in range(-len(a), len(b)):
        i = 0
        while i < len(a):
            k = 0
            while i + k < len(a) and 0 <= i + k + off < len(b) and a[i + k] == b[i + k + off]:
                k += 1
            if k >= 3:
                want.add((1, 2, off, i + 1, k))
            i += max(k, 1)
    got = finishing.stretches(frame(spark, hits, "q long, q_pos long, t long, t_pos long, offset long"), 3)
    assert {tuple(r[c] for c in ("q", "t", "offset", "q_from", "length")) for r in got.collect()} == want
