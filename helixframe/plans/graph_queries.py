"""Alignment, correction, graph, variant, learning and stream queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import align, graph, learning, packed, simulate, variants
from helixframe.operators.kmers import kmerized
from helixframe.streaming import windows as streams

from .registry import query
from .tables import CONTIGS_SQL, READS_SQL, contigs, kmers_sql, reads, table

K = 11
_REF = f"WITH {CONTIGS_SQL}, f AS (SELECT contig_id, substr(seq, pos, {K}) AS fwd FROM (SELECT contig_id, seq, unnest(range(1, length(seq) - {K} + 2)) AS pos FROM contigs))"
_NODES = _REF + ", nodes AS (SELECT fwd AS node FROM f UNION SELECT reverse(translate(fwd, 'ACGT', 'TGCA')) FROM f), edges AS (SELECT a.node AS src, b.node AS dst FROM nodes a JOIN nodes b ON substr(a.node, 2) = substr(b.node, 1, 10))"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.oriented_kmers(kmerized(contigs(spark, sf_dir), K, "contig_id"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(_nodes(spark, sf_dir))


@query(_NODES + " SELECT src, dst FROM edges")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(_NODES.replace(CONTIGS_SQL, READS_SQL).replace("contig_id", "read_id").replace("FROM contigs)", "FROM reads)") + ", d AS (SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node) SELECT n_out, n_in, count(*) AS n FROM d GROUP BY 1, 2")
def degree_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.adjacency(graph.oriented_kmers(kmerized(reads(spark, sf_dir), K)))).groupBy("n_out", "n_in").agg(F.count(F.lit(1)).alias("n"))


@query()
def unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unitigs(graph.cut(_nodes(spark, sf_dir)))


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT user_id AS a, props AS b FROM events WHERE event_type = 'signup'), n AS (SELECT DISTINCT x.a AS s, y.a AS t FROM e x JOIN e y ON x.b = y.b WHERE x.a <> y.a), "
    "r(node, c) AS (SELECT DISTINCT s, s FROM n UNION SELECT n.t, r.c FROM r JOIN n ON n.s = r.node WHERE r.c < n.t) SELECT node, min(c) AS component FROM r GROUP BY node"
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that share a property value of a signup: each value links its users in a star, not in all pairs."""
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", "props").distinct()
    centre = rows.groupBy("props").agg(F.min("user_id").alias("src"))
    edges = rows.join(centre, "props").select("src", F.col("user_id").alias("dst")).where("src <> dst").distinct()
    return graph.components(edges)


@query(_NODES + ", o AS (SELECT src, count(*) AS n FROM edges GROUP BY src), i AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst) SELECT e.src, e.dst FROM edges e WHERE e.dst NOT IN (SELECT src FROM edges) AND e.dst IN (SELECT dst FROM i WHERE n = 1) AND e.src IN (SELECT src FROM o WHERE n > 1)")
def tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tips(_edges(spark, sf_dir)).select("src", "dst")


_TRANSIT = "t AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, event_id FROM events)"


@query(f"WITH {_TRANSIT} SELECT src, dst, count(*) AS n, min(event_id) AS first_edge FROM t WHERE dst IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between event types as parallel edges: how many, and the one that stays."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    edges = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"), F.col("event_id").alias("eid")).where("dst IS NOT NULL")
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("eid").alias("first_edge")).where("n > 1")


@query(
    _NODES.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", s AS (SELECT DISTINCT substr(seq, 1, 11) AS node FROM contigs WHERE length(seq) >= 11), w(node, steps) AS (SELECT node, 0 FROM s UNION SELECT e.dst, w.steps + 1 FROM w JOIN edges e ON e.src = w.node WHERE w.steps < 5) SELECT node, min(steps)::BIGINT AS steps FROM w GROUP BY node"
)
def k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = contigs(spark, sf_dir).where(F.length("seq") >= K).select(F.left("seq", F.lit(K)).alias("node"))
    found = graph.distances(graph.cut(_edges(spark, sf_dir)), starts, 5)
    return found.select("node", F.col("steps").cast("long").alias("steps"))


@query(_NODES + " SELECT a.node AS node, b.node AS inv FROM nodes a JOIN nodes b ON b.node = reverse(translate(a.node, 'ACGT', 'TGCA'))")
def involution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.involution(_nodes(spark, sf_dir).withColumn("seq", F.col("node")), "node")


@query()
def spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations linked by supplier and customer trade, least total value first."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("src")), "l_suppkey")
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("dst")), "o_custkey")
    trade = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "dst"), "l_orderkey").groupBy("src", "dst").agg(F.round(F.sum("l_extendedprice"), 2).alias("w"))
    return graph.spanning_forest(trade)


_SEEDS = f"WITH {READS_SQL}, {CONTIGS_SQL}, q AS (SELECT contig_id AS q, pos AS q_pos, substr(seq, pos, 15) AS w FROM (SELECT contig_id, seq, unnest(range(1, length(seq) - 13)) AS pos FROM contigs)), t AS (SELECT read_id AS t, pos AS t_pos, substr(seq, pos, 15) AS w FROM (SELECT read_id, seq, unnest(range(1, length(seq) - 13)) AS pos FROM reads)), hits AS (SELECT q, q_pos, t, t_pos, t_pos - q_pos AS \"offset\" FROM q JOIN t USING (w))"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.seed_hits(contigs(spark, sf_dir), reads(spark, sf_dir), 15, "contig_id", "read_id")


@query(_SEEDS + ' SELECT q, t, "offset", count(*) AS n_seeds, min(q_pos) AS q_from, max(q_pos) AS q_to FROM hits GROUP BY 1, 2, 3')
def seed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = align.diagonals(_hits(spark, sf_dir))
    return rows.select("q", "t", F.col("offset").cast("long").alias("offset"), "n_seeds", F.col("q_from").cast("long").alias("q_from"), F.col("q_to").cast("long").alias("q_to"))


_GAPLESS = (
    _SEEDS + ', p AS (SELECT DISTINCT q, t, "offset" AS o FROM hits), g AS (SELECT p.q, p.t, p.o, len(list_filter(range(1, length(c.seq) + 1), lambda i: substr(c.seq, i::BIGINT, 1) <> substr(r.seq, (o + i)::BIGINT, 1)))::BIGINT AS errors '
    "FROM p JOIN contigs c ON c.contig_id = p.q JOIN reads r ON r.read_id = p.t WHERE o >= 0 AND o + length(c.seq) <= length(r.seq))"
)


def _gapless(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = align.gapless(_hits(spark, sf_dir), contigs(spark, sf_dir), reads(spark, sf_dir), "contig_id", "read_id")
    return rows.select("q", "t", F.col("offset").cast("long").alias("offset"), F.col("errors").cast("long").alias("errors"))


@query(_GAPLESS + ", r AS (SELECT *, row_number() OVER w AS k, lead(errors) OVER w AS second FROM g WINDOW w AS (PARTITION BY q ORDER BY errors, t, o)) SELECT q, t, o AS \"offset\", errors, second FROM r WHERE k = 1 AND errors <= 4 AND (second IS NULL OR second - errors > 2)")
def gapless_best_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.unique_best(_gapless(spark, sf_dir))


@query(_GAPLESS + " SELECT least(errors, 20) AS errors, count(*) AS n FROM g GROUP BY 1")
def mismatch_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gapless(spark, sf_dir).groupBy(F.least("errors", F.lit(20)).alias("errors")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {READS_SQL}, {CONTIGS_SQL}, s AS (SELECT contig_id AS q, seq, FALSE AS rc FROM contigs UNION ALL SELECT contig_id, reverse(translate(seq, 'ACGT', 'TGCA')), TRUE FROM contigs) SELECT q, read_id AS t, strpos(r.seq, s.seq)::BIGINT AS pos, rc FROM s JOIN reads r ON contains(r.seq, s.seq) WHERE length(s.seq) >= 15")
def search_both_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First place of each contig or its reverse complement in each read."""
    found = align.search_both_strands(contigs(spark, sf_dir), reads(spark, sf_dir), "contig_id", "read_id", 15)
    return found.groupBy("q", "t", "rc").agg(F.min("pos").cast("long").alias("pos"))


@query()
def sw_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local affine scores of neighbouring contigs (each id with the next one)."""
    rows = contigs(spark, sf_dir)
    nxt = rows.select((F.col("contig_id") - 1).alias("contig_id"), F.col("seq").alias("next_seq"))
    return align.smith_waterman(rows.join(nxt, "contig_id"), "seq", "next_seq").select("contig_id", "score")


_FLANK = 6
_STACK = (
    f"WITH {READS_SQL}, p AS (SELECT read_id, unnest(range(1, length(seq) - 11)) AS pl, seq FROM reads), s AS (SELECT read_id, pl + 6 AS pos, substr(seq, pl::BIGINT, 6) AS l, substr(seq, (pl + 6)::BIGINT, 1) AS base, substr(seq, (pl + 7)::BIGINT, 6) AS r FROM p), "
    "z AS (SELECT *, (ascii(base) * 7 + pos * 13) % 41 AS q FROM s), c AS (SELECT l, r, " + ", ".join(f"sum(CASE WHEN base = '{b}' THEN q ELSE 0 END)::BIGINT AS {b}" for b in "ACGT") + ", count(*) AS depth FROM z GROUP BY l, r)"
)


def _stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.stacks(reads(spark, sf_dir), _FLANK, "read_id")


@query(_STACK + " SELECT l AS \"left\", r AS \"right\", depth, greatest(A, C, G, T) AS best, A + C + G + T - greatest(A, C, G, T) AS rest FROM c WHERE depth >= 2 AND A + C + G + T - greatest(A, C, G, T) > 0 AND greatest(A, C, G, T) >= 1.5 * (A + C + G + T - greatest(A, C, G, T))")
def stack_fishy_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.fishy(variants.stack_columns(_stacks(spark, sf_dir)), 2, 1.5)


@query(
    _STACK + ", j AS (SELECT z.*, greatest(A, C, G, T) AS best, CASE base WHEN 'A' THEN A WHEN 'C' THEN C WHEN 'G' THEN G ELSE T END AS own, CASE greatest(A, C, G, T) WHEN A THEN 'A' WHEN C THEN 'C' WHEN G THEN 'G' ELSE 'T' END AS winner FROM z JOIN c USING (l, r)) "
    "SELECT read_id, pos, base, winner FROM j WHERE winner <> base AND best >= 20 AND best >= 2 * own"
)
def stack_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.recommended(reads(spark, sf_dir), _FLANK, 20, 2)


_BASES = f"WITH {READS_SQL}, b AS (SELECT read_id % 4 AS contig, pos, substr(seq, pos::BIGINT, 1) AS base, read_id FROM (SELECT read_id, seq, unnest(range(1, length(seq) + 1)) AS pos FROM reads))"


def _bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads laid over each other at four places."""
    rows = reads(spark, sf_dir).where(F.length("seq") > 0).select("read_id", F.col("seq").cast("binary").alias("s"), F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("pos"))
    return rows.select((F.col("read_id") % 4).alias("contig"), F.col("pos").cast("long").alias("pos"), F.substr("s", F.col("pos"), F.lit(1)).cast("string").alias("base"), "read_id")


@query(_BASES + " SELECT contig, pos, " + ", ".join(f"count(*) FILTER (WHERE base = '{b}') AS {b}" for b in "ACGT") + ", count(*) AS depth FROM b GROUP BY 1, 2")
def pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.pileup(_bases(spark, sf_dir))


_GENO = (
    _BASES + ", c AS (SELECT contig, pos, " + ", ".join(f"count(*) FILTER (WHERE base = '{b}') AS {b}" for b in "ACGT") + " FROM b GROUP BY 1, 2), r AS (SELECT contig, pos, CASE greatest(A, C, G, T) WHEN A THEN 'A' WHEN C THEN 'C' WHEN G THEN 'G' ELSE 'T' END AS ref FROM c), "
    "e AS (SELECT contig, pos, read_id, base <> ref AS other, pow(10.0, -greatest((ascii(base) * 7 + pos * 13) % 41, 2) / 10.0) AS e FROM b JOIN r USING (contig, pos)), "
    "x AS (SELECT contig, pos, read_id, other, log10(CASE WHEN other THEN e / 3 ELSE 1 - e END) AS a, log10(CASE WHEN other THEN 1 - e ELSE e / 3 END) AS z FROM e)"
)


def _scored(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    bases = _bases(spark, sf_dir)
    ref = variants.consensus(variants.pileup(bases)).select("contig", "pos", F.col("base").alias("ref"))
    rows = bases if rows is None else rows
    return rows.join(ref, ["contig", "pos"]).withColumn("q", (F.ascii("base") * 7 + F.col("pos") * 13) % 41)


@query(_GENO + " SELECT contig, pos, count(*) AS depth, count(*) FILTER (WHERE other) AS n_other, round(sum(log10((pow(10.0, a) + pow(10.0, z)) / 2)) - sum(a), 4) AS het_lod, round(sum(z) - sum(a), 4) AS hom_lod FROM x GROUP BY 1, 2")
def genotype_lod(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = variants.genotype_scores(_scored(spark, sf_dir))
    return g.select("contig", "pos", "depth", "n_other", F.round(F.col("het_ll") - F.col("ref_ll"), 4).alias("het_lod"), F.round(F.col("hom_ll") - F.col("ref_ll"), 4).alias("hom_lod"))


@query(
    _GENO + ", s AS (SELECT contig, pos, read_id % 3 = 0 AS normal, sum(a) AS r, sum(log10((pow(10.0, a) + pow(10.0, z)) / 2)) AS h, sum(z) AS m FROM x GROUP BY 1, 2, 3) "
    "SELECT t.contig, t.pos, round(greatest(t.h, t.m) - t.r, 4) AS lod_t, round(n.r - n.h, 4) AS lod_n FROM s t JOIN s n ON t.contig = n.contig AND t.pos = n.pos AND n.normal AND NOT t.normal WHERE greatest(t.h, t.m) - t.r >= 3 AND n.r - n.h >= 0.3"
)
def somatic_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    normal, tumour = (variants.genotype_scores(rows.where(c)) for c in ("read_id % 3 = 0", "read_id % 3 <> 0"))
    found = variants.somatic(tumour, normal, 3, 0.3)
    return found.select("contig", "pos", F.round("lod_t", 4).alias("lod_t"), F.round("lod_n", 4).alias("lod_n"))


@query(_GENO + ", v AS (SELECT b.base, r.ref FROM b JOIN r USING (contig, pos) WHERE b.base <> r.ref) SELECT count(*) FILTER (WHERE least(base, ref) || greatest(base, ref) IN ('AG', 'CT')) AS ti, count(*) FILTER (WHERE least(base, ref) || greatest(base, ref) NOT IN ('AG', 'CT')) AS tv FROM v")
def titv(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _scored(spark, sf_dir).where("base <> ref")
    ti = variants.is_transition(F.col("ref"), F.col("base"))
    return v.agg(F.count_if(ti).alias("ti"), F.count_if(~ti).alias("tv"))


@query("SELECT l_suppkey, round(log2(((count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'R') + 1.0) / (count(*) FILTER (WHERE l_linestatus = 'F') + 2.0)) / ((count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'R') + 1.0) / (count(*) FILTER (WHERE l_linestatus = 'O') + 2.0))), 6) AS bias FROM lineitem GROUP BY l_suppkey")
def strand_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda s, r: F.count_if((F.col("l_linestatus") == s) & ((F.col("l_returnflag") == "R") == F.lit(r)))
    bias = variants.strand_bias(n("F", False), n("F", True), n("O", False), n("O", True))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(bias, 6).alias("bias"))


@query()
def vq_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.codebook(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 8)


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, count(*) AS n FROM lineitem")
def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.line_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "n")


@query()
def perceptron(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return learning.perceptron(docs.select(F.col("doc_id").alias("id"), "text", F.when(F.col("quality") == 1, 1).otherwise(-1).alias("y")))


_MOD = "2147483647"


@query(f"SELECT i AS id, substr('ACGT', ((((i % {_MOD}) * 48271 + 16) % {_MOD} * 69621 + 7) % {_MOD} % 4 + 1)::BIGINT, 1) AS base FROM (SELECT unnest(range(0, 5000)) AS i)")
def simulate_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.random_bases(spark, 5000, seed=5)


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(streams.windowed(table(spark, sf_dir, "events"), "1 day"))


@query("WITH w AS (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s, event_type, value FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2")
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(streams.windowed(table(spark, sf_dir, "events"), "12 hours", "6 hours"))


def _stamped(rows: DataFrame) -> DataFrame:
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@query("WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def event_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.sessions(table(spark, sf_dir, "events"), "3 hours")
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "total")
