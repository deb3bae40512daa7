import random

from helixframe.operators import inspect


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


EDGES = "src long, dst long"


def test_edge_difference(spark):
    a, b = frame(spark, [(1, 2), (1, 2), (2, 3), (4, 4)], EDGES), frame(spark, [(2, 3), (3, 2)], EDGES)
    assert rows(inspect.edge_difference(a, b)) == [(1, 2, "first"), (3, 2, "second"), (4, 4, "first")]
    assert rows(inspect.edge_difference(a, a)) == []


def test_summary(spark):
    assert rows(inspect.summary(frame(spark, [(1, 2), (1, 3), (2, 3), (3, 3)], EDGES))) == [(4, 1, 3, 1, 0, 2, 3)]
    assert rows(inspect.summary(frame(spark, [], EDGES))) == [(0, 0, 0, 0, 0, None, None)]


def test_paths(spark):
    steps = frame(spark, [(1, 0, 10), (1, 1, 11), (1, 2, 10), (2, 0, 11), (2, 1, 99), (3, 5, 11), (3, 6, 11)], "path long, place long, edge long")
    edges = frame(spark, [(10, 1, 2), (11, 2, 1)], "eid long, src long, dst long")
    assert rows(inspect.path_breaks(steps, edges)) == [(1, 3, 0, None), (2, 2, 1, None), (3, 2, 0, 5)]
    assert rows(inspect.path_index(steps)) == [(10, 1, 0, 2), (11, 1, 1, 1), (11, 2, 0, 1), (11, 3, 5, 2), (99, 2, 1, 1)]


def test_peak(spark):
    counts = lambda *n: frame(spark, list(enumerate(n, 1)), "value long, n long")
    assert rows(inspect.peak_behind_valley(counts(90, 20, 5, 8, 30, 12, 30, 2))) == [(5, 30)]
    assert rows(inspect.peak_behind_valley(counts(5, 4, 3))) == []


def test_neighbours_and_barcodes_against_brute_force(spark):
    rng = random.Random(7)
    words = sorted({"".join(rng.choices("ACGT", k=3)) for _ in range(30)})
    far = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    want = [(w, n) for w in words if (n := sum(far(w, v) == 1 for v in words))]
    assert rows(inspect.neighbours(frame(spark, [(w,) for w in words], "word string"), 3)) == want
    seqs = [(i, "".join(rng.choices("ACGT", k=rng.randrange(0, 30)))) for i in range(20)]
    codes = ["ACGT", "TTAC"]
    found = [(c, far(c, s[p : p + 4]), i, p + 1) for c in codes for i, s in seqs for p in range(len(s) - 3) if far(c, s[p : p + 4]) <= 1]
    table = frame(spark, seqs, "id long, seq string")
    assert rows(inspect.barcodes_found(frame(spark, [(c,) for c in codes], "barcode string"), table, 4, "id")) == sorted(found)
    turned = {"ACG": "CGT", "TTA": "TAA"}
    hits = lambda w: [sum(s[p : p + 3] == w for p in range(len(s))) for _, s in seqs]
    counted = [(w, rc, sum(hits(x)), sum(n > 0 for n in hits(x))) for w, t in turned.items() for rc, x in ((False, w), (True, t)) if sum(hits(x))]
    assert rows(inspect.words_in_reads(frame(spark, [(w,) for w in turned], "word string"), table, 3, "id")) == sorted(counted)


def test_picks_and_subproject(spark):
    seqs = frame(spark, [(1, "AACGT"), (2, "")], "id long, seq string")
    picks = frame(spark, [(1, 1, 4, False), (1, 1, 4, True), (1, 4, 9, False), (1, 3, 2, False), (2, 0, 5, True), (3, 0, 1, False)], "id long, start long, stop long, rc boolean")
    assert rows(inspect.picked_bases(seqs, picks, "id")) == [(1, 1, "ACG"), (1, 1, "CGT"), (1, 3, ""), (1, 4, "T"), (2, 0, "")]
    pairs = frame(spark, [(1, 2), (1, 3), (2, 1), (None, 1)], "id1 long, id2 long")
    assert rows(inspect.subproject(seqs, pairs, "id")) == [(1, 2), (2, 1)]
