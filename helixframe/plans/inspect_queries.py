"""Questions to graphs, paths, words and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import inspect, kmers, selection, stats

from .finish_queries import _CHAIN, _LINES, _chain, line_stats, perfect_stretches
from .graph_queries import _SEEDS
from .read_queries import _NET, _net
from .registry import query
from .tables import CONTIGS_SQL, PAIRS_SQL, READS_SQL, contigs, pairs, reads, table


def _n50_sql(rows: str, value: str) -> str:
    """SELECT after ``rows``: a relation z with ``value``."""
    return (
        f"{rows}, o AS (SELECT {value} AS v, sum({value}) OVER (ORDER BY {value} ROWS UNBOUNDED PRECEDING) AS m, sum({value}) OVER () AS total, lead({value}) OVER (ORDER BY {value}) AS nx FROM z) "
        "SELECT CASE WHEN 2 * m = total THEN (v + nx) // 2 ELSE v END::BIGINT AS n50 FROM o WHERE 2 * m >= total ORDER BY m LIMIT 1"
    )


@query(_n50_sql(_LINES + ", z AS (SELECT count(*) AS n_cells FROM r GROUP BY hs, he)", "n_cells"))
def line_n50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.n50(line_stats(spark, sf_dir), "n_cells")


@query(
    _n50_sql(
        _SEEDS + ', z AS (SELECT count(*) + 14 AS size FROM (SELECT q, t, "offset", q_pos - row_number() OVER (PARTITION BY q, t, "offset" ORDER BY q_pos) AS island FROM hits) GROUP BY q, t, "offset", island)', "size"
    )
)
def stretch_n50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.n50(perfect_stretches(spark, sf_dir), "length")


_OTHER = "other AS (SELECT DISTINCT s_nationkey::BIGINT AS src, s_suppkey::BIGINT % 25 AS dst FROM supplier WHERE s_nationkey <> s_suppkey % 25)"


@query(f"WITH {_NET}, {_OTHER} SELECT coalesce(n.src, o.src)::BIGINT AS src, coalesce(n.dst, o.dst)::BIGINT AS dst, CASE WHEN o.src IS NULL THEN 'first' ELSE 'second' END AS side FROM net n FULL JOIN other o ON n.src = o.src AND n.dst = o.dst WHERE n.src IS NULL OR o.src IS NULL")
def graph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("src"), (F.col("s_suppkey").cast("long") % 25).alias("dst")).where("src <> dst")
    return inspect.edge_difference(_net(spark, sf_dir), other)


@query(
    f"WITH {_CHAIN}, n AS (SELECT node, sum(o) AS o, sum(i) AS i FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node) SELECT (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM edges WHERE src = dst) AS n_loops, "
    "count(*) AS n_nodes, count(*) FILTER (WHERE i = 0) AS n_sources, count(*) FILTER (WHERE o = 0) AS n_sinks, max(o)::BIGINT AS most_out, max(i)::BIGINT AS most_in FROM n"
)
def graph_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.summary(_chain(spark, sf_dir))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("path"), (F.col("l_linenumber").cast("long") * 10000000000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("place"), F.col("l_partkey").alias("edge"))


_STEPS = "WITH steps AS (SELECT l_orderkey AS path, l_linenumber::BIGINT * 10000000000 + round(l_extendedprice * 100)::BIGINT AS place, l_partkey AS edge FROM lineitem)"


@query(_STEPS + " SELECT edge, path, min(place) AS first, count(*) AS n FROM steps GROUP BY 1, 2")
def path_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.path_index(_steps(spark, sf_dir))


@query(
    _STEPS + ", s AS (SELECT path, place, edge % 3 AS src, edge // 3 % 3 AS dst, lead(edge % 3) OVER (PARTITION BY path ORDER BY place) AS nx FROM steps) "
    "SELECT path, count(*) AS n_steps, 0::BIGINT AS n_unknown, coalesce(min(place) FILTER (WHERE nx <> dst), -1) AS first_break FROM s GROUP BY path"
)
def path_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where orders stop to be paths over a graph whose edges are the parts (-1: nowhere)."""
    edges = table(spark, sf_dir, "part").selectExpr("p_partkey AS eid", "p_partkey % 3 AS src", "p_partkey div 3 % 3 AS dst")
    return inspect.path_breaks(_steps(spark, sf_dir), edges).fillna(-1, ["first_break"])


@query(f"WITH {READS_SQL}, picks AS (SELECT doc_id AS read_id, doc_id % 50 AS start, doc_id % 50 + 100 AS stop, doc_id % 2 = 1 AS rc FROM labels) SELECT read_id, start, CASE WHEN rc THEN reverse(translate(substr(seq, start + 1, stop - start), 'ACGT', 'TGCA')) ELSE substr(seq, start + 1, stop - start) END AS seq FROM picks JOIN reads USING (read_id)")
def select_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = table(spark, sf_dir, "labels").selectExpr("doc_id AS read_id", "doc_id % 50 AS start", "doc_id % 50 + 100 AS stop", "doc_id % 2 = 1 AS rc")
    return inspect.picked_bases(reads(spark, sf_dir), picks, "read_id")


@query(f"WITH {PAIRS_SQL}, k AS (SELECT doc_id FROM labels WHERE quality = 1) SELECT pair_id, id1, id2 FROM pairs WHERE id1 IN (SELECT doc_id FROM k) AND id2 IN (SELECT doc_id FROM k)")
def subproject_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within the reads of good quality."""
    ids = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("read_id"))
    return inspect.subproject(ids, pairs(spark, sf_dir), "read_id").select("pair_id", "id1", "id2")


@query("WITH c AS (SELECT l_partkey, count(*) AS value FROM lineitem GROUP BY 1), h AS (SELECT value, count(*) AS n FROM c GROUP BY 1), x AS (SELECT *, lead(n) OVER (ORDER BY value) AS nx FROM h) SELECT value, n FROM h WHERE value >= (SELECT min(value) FROM x WHERE n <= nx) ORDER BY n DESC, value LIMIT 1")
def coverage_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage of single copies: the peak behind the first valley."""
    per_part = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("value"))
    return inspect.peak_behind_valley(per_part.groupBy("value").agg(F.count(F.lit(1)).alias("n")))


def _words_sql(source: str, key: str, k: int) -> str:
    return f"(SELECT {key}, pos, substr(seq, pos::BIGINT, {k}) AS w FROM (SELECT {key}, seq, unnest(range(1, length(seq) - {k} + 2)) AS pos FROM {source}))"


_NEAR = "SELECT {0}, substr({0}, 1, i::BIGINT - 1) || b || substr({0}, i::BIGINT + 1) AS near FROM {1}, (SELECT unnest(range(1, {2})) AS i), (SELECT unnest(['A', 'C', 'G', 'T']) AS b) WHERE substr({0}, i::BIGINT, 1) <> b"


@query(f"WITH {CONTIGS_SQL}, s AS (SELECT DISTINCT w AS word FROM {_words_sql('contigs', 'contig_id', 9)}), x AS ({_NEAR.format('word', 's', 10)}) SELECT word, count(*) AS n FROM x WHERE near IN (SELECT word FROM s) GROUP BY word")
def kmer_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = kmers.kmerized(contigs(spark, sf_dir), 9, "contig_id").select(F.col("fwd").alias("word")).distinct()
    return inspect.neighbours(words, 9)


@query(
    f"WITH {READS_SQL}, {CONTIGS_SQL}, l AS (SELECT DISTINCT left(seq, 20) AS word FROM contigs WHERE length(seq) >= 20), f AS (SELECT word, word AS w, false AS rc FROM l UNION ALL SELECT word, reverse(translate(word, 'ACGT', 'TGCA')), true FROM l) "
    f"SELECT word, rc, count(*) AS n, count(DISTINCT read_id) AS n_reads FROM f JOIN {_words_sql('reads', 'read_id', 20)} USING (w) GROUP BY 1, 2"
)
def count_in_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the contigs' beginnings stand in the reads, on both strands."""
    words = contigs(spark, sf_dir).where("length(seq) >= 20").select(F.left("seq", F.lit(20)).alias("word")).distinct()
    return inspect.words_in_reads(words, reads(spark, sf_dir), 20, "read_id")


BARCODES = ("ACGTACGTAC", "TTGACCAATG", "GGATCCTTAA", "CATCATGGAC")


@query(
    f"WITH {READS_SQL}, b AS (SELECT unnest({list(BARCODES)}) AS barcode), x AS ({_NEAR.format('barcode', 'b', 11)}), f AS (SELECT barcode, 0 AS errors, barcode AS w FROM b UNION ALL SELECT barcode, 1, near FROM x) "
    f"SELECT barcode, errors, read_id, pos FROM f JOIN {_words_sql('reads', 'read_id', 10)} USING (w)"
)
def barcode_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.range(1).select(F.explode(F.array(*map(F.lit, BARCODES))).alias("barcode"))
    return inspect.barcodes_found(codes, reads(spark, sf_dir), 10, "read_id").select("barcode", "errors", "read_id", F.col("pos").cast("long").alias("pos"))


@query("WITH l AS (SELECT doc_id, unnest(range(0, len(p))) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) SELECT doc_id, line_no, md5(line) AS line_md5 FROM l WHERE regexp_matches(line, '[0-9]{3}')")
def text_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with three digits in a row."""
    rows = selection.lines(table(spark, sf_dir, "documents"), "doc_id", "text").where(F.col("line").rlike("[0-9]{3}"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("line_md5"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))
