"""Finishing of assemblies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.sequence import reverse_complement
from helixframe.operators import finishing, selection, stats, variants

from .correct_queries import _LAYOUT, _layout
from .graph_queries import _BASES, _SEEDS, _bases, _hits
from .number_queries import library_molecules
from .registry import query
from .tables import CONTIGS_SQL, PAIRS_SQL, contigs, pairs, reads, table

_CHAIN = (
    "edges AS (SELECT c_custkey::BIGINT AS eid, c_custkey::BIGINT AS src, c_custkey::BIGINT + 1 AS dst FROM customer WHERE c_nationkey <> 0 "
    "UNION ALL SELECT -c_custkey, c_custkey, c_custkey + 1 FROM customer WHERE c_nationkey <> 0 AND c_nationkey % 3 = 0 "
    "UNION ALL SELECT c_custkey + 1000000000000, c_custkey, c_custkey + 5 FROM customer WHERE c_nationkey = 1)"
)


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains over neighbouring customers with gaps, bubbles and side ways."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_nationkey").alias("n"))
    on = c.where("n <> 0").selectExpr("k AS eid", "k AS src", "k + 1 AS dst")
    return on.unionAll(c.where("n <> 0 AND n % 3 = 0").selectExpr("-k", "k", "k + 1")).unionAll(c.where("n = 1").selectExpr("k + 1000000000000", "k", "k + 5"))


_LINES = (
    f"WITH RECURSIVE {_CHAIN}, cells AS (SELECT src, dst, count(*) AS n FROM edges GROUP BY 1, 2), mid AS (SELECT a.node, s, e FROM (SELECT dst AS node, min(src) AS s FROM cells GROUP BY 1 HAVING count(*) = 1) a "
    "JOIN (SELECT src AS node, min(dst) AS e FROM cells GROUP BY 1 HAVING count(*) = 1) b USING (node)), "
    "r(hs, he, s, e, pos) AS (SELECT src, dst, src, dst, 0::BIGINT FROM cells WHERE src NOT IN (SELECT node FROM mid) UNION ALL SELECT r.hs, r.he, r.e, m.e, r.pos + 1 FROM r JOIN mid m ON m.node = r.e AND m.s = r.s)"
)


@query(_LINES + " SELECT hs AS line_src, he AS line_dst, pos, s AS src, e AS dst, cells.n AS n_edges FROM r JOIN cells ON cells.src = s AND cells.dst = e")
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's line and place in it."""
    return finishing.lines(_chain(spark, sf_dir)).select(F.col("line.s").alias("line_src"), F.col("line.e").alias("line_dst"), "pos", "src", "dst", "n_edges")


@query(_LINES + " SELECT hs AS line_src, he AS line_dst, count(*) AS n_cells, sum(cells.n)::BIGINT AS n_edges, count(*) FILTER (WHERE cells.n > 1) AS n_bubbles FROM r JOIN cells ON cells.src = s AND cells.dst = e GROUP BY 1, 2")
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("line_src", "line_dst").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n_edges").alias("n_edges"), F.count_if(F.col("n_edges") > 1).alias("n_bubbles"))


@query(
    _LAYOUT + ", b AS (SELECT *, coalesce(sum((gap >= 8)::INT) OVER (PARTITION BY scaffold ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM p) "
    "SELECT scaffold, part::BIGINT AS part, min(place)::BIGINT AS first, max(place)::BIGINT AS last, (sum(len + gap) - arg_max(gap, place))::BIGINT AS size FROM b GROUP BY 1, 2"
)
def line_tigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut into contigs at gaps of 8 or more."""
    rows = finishing.islands(_layout(spark, sf_dir), ["scaffold"], "place", F.col("gap") >= 8)
    size = F.sum(F.col("len") + F.col("gap")) - F.max_by("gap", "place")
    return rows.groupBy("scaffold", "part").agg(F.min("place").cast("long").alias("first"), F.max("place").cast("long").alias("last"), size.alias("size"))


_SPANS = "spans AS (SELECT scaffold, place, place + len % 4 AS last FROM p)"


@query(
    _LAYOUT + f", {_SPANS}, cover AS (SELECT p.scaffold, p.place, (SELECT count(*) FROM spans s WHERE s.scaffold = p.scaffold AND s.place <= p.place AND s.last > p.place) AS n FROM p) "
    "SELECT scaffold, place::BIGINT AS place, coalesce(sum((n < 2)::INT) OVER (PARTITION BY scaffold ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part FROM cover"
)
def scaffolds_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = _layout(spark, sf_dir)
    spans = layout.select("scaffold", F.col("place").alias("first"), (F.col("place") + F.col("len") % 4).alias("last"))
    return finishing.broken(layout, spans, 2).select("scaffold", F.col("place").cast("long").alias("place"), "part")


@query(f"WITH {PAIRS_SQL}, n AS (SELECT id2 AS a, id1 AS b, count(*) AS n_links, floor(avg(sep))::BIGINT AS gap FROM pairs GROUP BY 1, 2 HAVING count(*) >= 2) SELECT pair_id AS scaffold, gap, n_links FROM pairs JOIN n ON a = id2 AND b = id1")
def scaffolds_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are scaffolds of parts; an order's last part is linked back to its first."""
    both = pairs(spark, sf_dir)
    layout = both.select(F.col("pair_id").alias("scaffold"), F.posexplode(F.array("id1", "id2")).alias("place", "contig"))
    return finishing.circular(layout, both.select(F.col("id2").alias("a"), F.col("id1").alias("b"), "sep"), 2)


_BAD = "bad AS (SELECT contig_id, contig_id % 20 AS start, contig_id % 20 + 15 AS stop FROM contigs WHERE contig_id % 3 <> 0 UNION ALL SELECT contig_id, 60, 70 FROM contigs WHERE contig_id % 2 = 0)"


@query(
    f"WITH {CONTIGS_SQL}, {_BAD}, k AS (SELECT contig_id, i, substr(seq, i::BIGINT + 1, 1) AS base FROM (SELECT contig_id, seq, unnest(range(0, length(seq))) AS i FROM contigs) c WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.contig_id = c.contig_id AND i >= start AND i < stop)), "
    "g AS (SELECT *, i - row_number() OVER (PARTITION BY contig_id ORDER BY i) AS island FROM k) SELECT contig_id, min(i)::BIGINT AS start, string_agg(base, '' ORDER BY i) AS seq FROM g GROUP BY contig_id, island HAVING count(*) >= 10"
)
def contaminant_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contigs(spark, sf_dir)
    bad = rows.where("contig_id % 3 <> 0").selectExpr("contig_id", "contig_id % 20 AS start", "contig_id % 20 + 15 AS stop").unionAll(rows.where("contig_id % 2 = 0").selectExpr("contig_id", "60L", "70L"))
    return finishing.without_regions(rows, bad, "contig_id", 10)


@query(f"WITH {CONTIGS_SQL} SELECT contig_id, length(seq) AS size, row_number() OVER (ORDER BY length(seq) DESC, contig_id) - 1 AS new_id FROM contigs WHERE length(seq) >= 100")
def assembly_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs of 100 letters or more, the longest first, numbered anew."""
    rows = contigs(spark, sf_dir).select("contig_id", F.length("seq").cast("long").alias("size")).where("size >= 100")
    return selection.numbered(rows.withColumn("shorter", -F.col("size")), ["shorter", "contig_id"]).select("contig_id", "size", "new_id")


_REPEATS = (
    "WITH t AS (SELECT l_partkey::BIGINT AS p, l_linenumber % 2 AS i, (l_linenumber + (l_quantity > 42)::INT) % 2 AS o FROM lineitem), v AS (SELECT p, count(*) FILTER (WHERE i = 0 AND o = 0) AS x, count(*) FILTER (WHERE i = 1 AND o = 1) AS y, "
    "count(*) FILTER (WHERE i = 0 AND o = 1) AS u, count(*) FILTER (WHERE i = 1 AND o = 0) AS w FROM t GROUP BY p), m AS (SELECT p, least(x, y) >= 5 AND least(x, y) >= 3 * greatest(u, w) AS s, least(u, w) >= 5 AND least(u, w) >= 3 * greatest(x, y) AS c FROM v), "
    "g AS (SELECT p_partkey::BIGINT AS p, coalesce(s, false) AS s, coalesce(c, false) AS c, p_partkey::BIGINT * 10 AS q FROM part LEFT JOIN m ON p = p_partkey) "
    "SELECT q AS eid, q AS src, q + 2 AS dst FROM g UNION ALL SELECT q + 1, q + 1, CASE WHEN s OR c THEN -(2 * (q + 2) + 1) ELSE q + 2 END FROM g UNION ALL SELECT q + 2, q + 2, q + 3 FROM g "
    "UNION ALL SELECT q + 3, CASE WHEN c THEN -(2 * (q + 2) + 2) ELSE q + 3 END, q + 4 FROM g UNION ALL SELECT q + 4, CASE WHEN s THEN -(2 * (q + 2) + 2) ELSE q + 3 END, q + 5 FROM g UNION ALL SELECT -(q + 3), -(2 * (q + 2) + 1), -(2 * (q + 2) + 2) FROM g WHERE s OR c"
)


@query(_REPEATS)
def pull_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeat with two ways in and out per part; order lines say how it is passed."""
    q = F.col("p_partkey").cast("long") * 10
    ends = [(0, 0, 2), (1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 3, 5)]
    edges = table(spark, sf_dir, "part").select(F.explode(F.array(*(F.struct((q + e).alias("eid"), (q + s).alias("src"), (q + d).alias("dst")) for e, s, d in ends))).alias("x")).select("x.*")
    p = F.col("l_partkey").cast("long") * 10
    passed = table(spark, sf_dir, "lineitem").select((p + 2).alias("r"), (p + F.col("l_linenumber") % 2).alias("a"), (p + 3 + (F.col("l_linenumber") + (F.col("l_quantity") > 42).cast("int")) % 2).alias("c"))
    return finishing.pulled_apart(edges, passed.groupBy("a", "r", "c").agg(F.count(F.lit(1)).alias("n")), 5, 3.0)


@query(
    _SEEDS + ', i AS (SELECT q, t, "offset", q_pos, q_pos - row_number() OVER (PARTITION BY q, t, "offset" ORDER BY q_pos) AS island FROM hits) '
    'SELECT q, t, "offset", min(q_pos) AS q_from, count(*) + 14 AS length FROM i GROUP BY q, t, "offset", island'
)
def perfect_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal exact matches of 15 letters or more between contigs and reads."""
    rows = finishing.stretches(_hits(spark, sf_dir), 15)
    return rows.select("q", "t", F.col("offset").cast("long").alias("offset"), F.col("q_from").cast("long").alias("q_from"), "length")


@query()
def pairs_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every read from its two ends, which overlap by a fifth: whether the longest overlap gives the read back."""
    n = F.length("seq")
    first, rest = F.ceil(n * 0.6).cast("int"), F.floor(n * 0.4).cast("int")
    ends = reads(spark, sf_dir).select("read_id", "seq", F.substr("seq", F.lit(1), first).alias("a"), reverse_complement(F.substr("seq", rest + 1, n)).alias("b"))
    joined = finishing.filled_pairs(ends.withColumnRenamed("seq", "whole"), "a", "b", 20)
    return joined.select("read_id", F.length("seq").cast("long").alias("size"), (F.col("seq") == F.col("whole")).alias("restored"))


_PILES = _BASES + ", c AS (SELECT contig, pos, " + ", ".join(f"count(*) FILTER (WHERE base = '{b}') AS {b}" for b in "ACGT") + " FROM b GROUP BY 1, 2), l AS (SELECT contig, pos, list_reverse_sort([A, C, G, T]) AS n, A + C + G + T AS total FROM c)"


@query(
    _PILES + ", k AS (SELECT contig, CASE WHEN n[1] >= 4 AND n[1] >= 0.5 * total AND n[1] >= 1.2 * n[2] THEN 1 WHEN n[1] + n[2] >= 4 AND n[1] + n[2] >= 0.5 * total AND n[2] >= 1.2 * n[3] AND n[2] >= 0.4 * n[1] THEN 2 ELSE 0 END AS haplotypes FROM l) "
    "SELECT contig, haplotypes, count(*) AS n FROM k GROUP BY 1, 2"
)
def polymorphism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of each contig with one, two or no trusted haplotypes."""
    rows = finishing.haplotypes(variants.pileup(_bases(spark, sf_dir)), 4, 0.5, 1.2, 0.4)
    return rows.groupBy("contig", "haplotypes").agg(F.count(F.lit(1)).alias("n"))


@query()
def library_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected distinct molecules per event type at 1 to 10 times the draws."""
    rows = library_molecules(spark, sf_dir).withColumn("x", stats.library_size_column(F.col("n"), F.col("n_distinct")))
    return rows.select("event_type", F.explode(stats.complexity_curve(F.col("x"), F.col("n"), F.col("n_distinct"))).alias("c")).select("event_type", "c.*")
