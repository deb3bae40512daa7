import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import align, correct, graph, intervals, kmers, selection, simulate, variants, windows
from helixframe.streaming import windows as streams

rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def seqs(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "read_id long, seq string")


def test_spectrum_counts_all_words(spark):
    rng = random.Random(1)
    items = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 3, 5, 80, 200)]
    spec = kmers.spectrum(kmers.counted(kmers.kmerized(seqs(spark, items), 5))).collect()
    assert sum(r["kf"] * r["ndk"] for r in spec) == sum(max(0, len(s) - 4) for s in items)


def test_context_bits_match_brute_force(spark):
    rng = random.Random(2)
    items = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(4)]
    want = {}
    for s in items:
        for i in range(len(s) - 4):
            w = s[i : i + 5]
            before, after = s[i - 1] if i else None, s[i + 5] if i + 5 < len(s) else None
            if rc(w) < w:
                w, before, after = rc(w), after and rc(after), before and rc(before)
            n, bits = want.get(w, (0, 0))
            want[w] = (n + 1, bits | (1 << "ACGT".index(before) if before else 0) | (16 << "ACGT".index(after) if after else 0))
    got = {r["kmer"]: (r["kf"], r["bits"]) for r in kmers.context_bits(kmers.with_context(seqs(spark, items), 5)).collect()}
    assert got == want


def test_sweep_covers_every_place_once(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), a := rng.randrange(50), a + rng.randrange(0, 12)) for i in range(60)]
    iv = spark.createDataFrame(rows, "iv long, contig long, start long, stop long")
    depth = {}
    for _, c, a, b in rows:
        for p in range(a, b):
            depth[c, p] = depth.get((c, p), 0) + 1
    got = {}
    for r in intervals.condensed(iv).collect():
        for p in range(r["start"], r["stop"]):
            assert (r["contig"], p) not in got
            got[r["contig"], p] = r["coverage"]
    assert {k: v for k, v in got.items() if v} == depth
    total = {r["contig"]: r["covered"] for r in intervals.total_covered(iv).collect()}
    assert total == {c: sum(k[0] == c for k in depth) for c in {k[0] for k in depth}}
    pairs = {(r["l_iv"], r["r_iv"]) for r in intervals.overlap_join(iv, iv, 5).collect()}
    assert pairs == {(x[0], y[0]) for x in rows for y in rows if x[1] == y[1] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3]}


def spelled(items, k):
    """Unitigs by walking, in plain Python."""
    nodes = {w for s in items for i in range(len(s) - k + 1) for w in (s[i : i + k], rc(s[i : i + k]))}
    nxt = {n: [n[1:] + c for c in "ACGT" if n[1:] + c in nodes] for n in nodes}
    prev = {n: [c + n[:-1] for c in "ACGT" if c + n[:-1] in nodes] for n in nodes}
    link = {n: nxt[n][0] for n in nodes if len(nxt[n]) == 1 and len(prev[nxt[n][0]]) == 1 and nxt[n][0] != n}
    targets, out, seen = set(link.values()), set(), set()
    for start in [n for n in sorted(nodes) if n not in targets] + sorted(nodes):
        if start in seen:
            continue
        path, n = [start], start
        seen.add(start)
        while n in link and link[n] not in seen:
            n = link[n]
            path.append(n)
            seen.add(n)
        out.add(path[0] + "".join(p[-1] for p in path[1:]))
    return out


@pytest.mark.parametrize("items", [["ACGTTGCATGTCGGATTACA", "TTGCATGTCGCCAATCG"], ["ACGGTACGGTACGGT"]])
def test_unitigs_match_walks_and_break_circles(spark, items):
    nodes = graph.oriented_kmers(kmers.kmerized(seqs(spark, items), 5))
    assert {r["seq"] for r in graph.unitigs(nodes).collect()} == spelled(items, 5)


def test_components_and_distances(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (9, 8), (5, 5)], "src long, dst long")
    assert {r["node"]: r["component"] for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 5: 5}
    start = spark.createDataFrame([(1,)], "node long")
    assert {r["node"]: r["steps"] for r in graph.distances(edges, start, 5).collect()} == {1: 0, 2: 1, 3: 2}


def test_spanning_forest_weight(spark):
    rng = random.Random(4)
    rows = [(a, b, rng.randrange(1, 1000)) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.4]
    parent = list(range(12))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = 0
    for a, b, w in sorted(rows, key=lambda r: r[2]):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            want += w
    got = graph.spanning_forest(spark.createDataFrame(rows, "src long, dst long, w long")).agg(F.sum("w")).first()[0]
    assert got == want


def test_affine_score_against_the_full_table():
    def slow(a, b, match=1, mismatch=-2, go=-3, ge=-1):
        n, m = len(a), len(b)
        low = -(10**9)
        h = [[0] * (m + 1) for _ in range(n + 1)]
        e = [[low] * (m + 1) for _ in range(n + 1)]
        f = [[low] * (m + 1) for _ in range(n + 1)]
        best = 0
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                e[i][j] = max(e[i][j - 1] + ge, h[i][j - 1] + go)
                f[i][j] = max(f[i - 1][j] + ge, h[i - 1][j] + go)
                h[i][j] = max(0, h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), e[i][j], f[i][j])
                best = max(best, h[i][j])
        return best

    rng = random.Random(5)
    for _ in range(60):
        a, b = ("".join(rng.choice("AC") for _ in range(rng.randrange(0, 25))) for _ in range(2))
        assert align.affine_score(a, b) == slow(a, b)


def test_search_finds_both_strands(spark):
    target = "ACGTTGCATGTCGGATTACACCGT"
    queries = spark.createDataFrame([(1, target[3:13]), (2, rc(target[8:20])), (3, "AAAAAAAAAA")], "q_id long, seq string")
    targets = spark.createDataFrame([(9, target)], "t_id long, seq string")
    got = {(r["q"], r["pos"], r["rc"]) for r in align.search_both_strands(queries, targets, "q_id", "t_id", 8).collect()}
    assert got == {(1, 4, False), (2, 9, True)}


def test_numbering_dividing_and_sampling(spark):
    rows = spark.range(103).select(F.col("id").alias("k"), (F.col("id") % 7).alias("w"))
    assert sorted(r["new_id"] for r in selection.numbered(rows, ["w", "k"]).collect()) == list(range(103))
    sizes = [r["n"] for r in selection.divided(rows, ["k"], 4).groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()]
    assert sizes == [26, 26, 26, 25]
    assert selection.sample(rows, "k", 10).collect() == selection.sample(rows.repartition(5), "k", 10).collect()


def test_windows_runs_and_peaks(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([3, 3, 5, 5, 5, 1])], "g long, i long, v long")
    assert [(r["v"], r["n"]) for r in windows.runs(rows, ["g"], ["i"], "v").orderBy("run").collect()] == [(3, 2), (5, 3), (1, 1)]
    assert [r["win_min"] for r in windows.centred(rows, ["g"], ["i"], "v", 1).orderBy("i").collect()] == [3, 3, 3, 5, 1, 1]


def test_simulated_reads_come_from_the_genome(spark):
    genome = simulate.random_bases(spark, 300, seed=3)
    whole = "".join(r["base"] for r in genome.orderBy("id").collect())
    reads = simulate.simulated_reads(spark, genome, 20, 30, 0.0).collect()
    assert len(reads) == 20 and all(r["seq"] in whole for r in reads)


def test_consensus_ties_take_the_first_base(spark):
    bases = spark.createDataFrame([(1, 1, "T"), (1, 1, "C"), (1, 2, "G")], "contig long, pos long, base string")
    got = {r["pos"]: (r["base"], r["support"]) for r in variants.consensus(variants.pileup(bases)).collect()}
    assert got == {1: ("C", 1), 2: ("G", 1)}


def test_stream_and_batch_windows_agree(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 05:00:00", "a", 2.0), ("2024-01-02 01:00:00", "b", 4.0), ("2024-01-09 01:00:00", "b", 1.0)], "ts string, event_type string, value double")
    events = events.withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double")
    streams.run_once(streams.windowed(stream, "1 day"), str(tmp_path / "out"), str(tmp_path / "ck"))
    batch = {tuple(r) for r in streams.windowed(events, "1 day").collect()}
    closed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert closed and closed <= batch


def test_frequent_words_link_by_a_star_and_copies_are_one_class(spark):
    word = "ACGTTGCA"
    seqs = [(i, word) for i in range(1, 4)] + [(i, "C" * (i - 3) + word) for i in range(4, 9)] + [(20, None), (21, ""), (22, "AC")]
    rows = spark.createDataFrame(seqs, "read_id long, seq string").withColumn("pos", F.lit("extra"))
    made = {(r.read_id, r.class_id) for r in kmers.classes(rows).collect()}
    assert made == {(1, 1), (2, 1), (3, 1), *((i, i) for i in (4, 5, 6, 7, 8, 20, 21, 22))}
    found = {(r.a, r.b, r.offset, r.n) for r in correct.friends(rows, 8, 3, 1).collect()}
    # The word itself is in six different reads, so it is a star; "CACGTTGC" and what else recurs is in at most five.
    stars = {(a, b) for a, b, _, _ in found if a == 1}
    assert stars == {(1, b) for b in range(4, 9)}
    joined = {frozenset((a, b)) for a, b, _, _ in found}
    whole = correct.friends(rows, 8, 100, 1)
    assert joined <= {frozenset((r.a, r.b)) for r in whole.collect()} and whole.count() == 15
    assert correct.friends(rows.limit(0), 8, 3, 1).count() == 0 and kmers.classes(rows.limit(0)).count() == 0
    pairs = {(r.a, r.b): r.n for r in kmers.shared_pairs(kmers.kmerized(rows, 8), 2).collect()}
    assert {(1, b) for b in range(2, 9)} <= set(pairs)
