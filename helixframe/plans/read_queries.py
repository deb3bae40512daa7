"""Read preparation, bias, calls, and further graph and interval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import quality
from helixframe.operators import bias, calls, graph, stats
from helixframe.operators import reads as prep

from .registry import query
from .tables import CONTIGS_SQL, INTERVALS_SQL, PAIRS_SQL, READS_SQL, contigs, intervals, pairs, reads, table

# --- read preparation ------------------------------------------------------------


@query(f"WITH {READS_SQL} SELECT read_id, substr(seq, 6, greatest(least(length(seq), 60) - 5, 0)) AS seq FROM reads")
def reads_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.trimmed(reads(spark, sf_dir), 5, 60)


@query(f"WITH {READS_SQL} SELECT read_id, reverse(translate(substr(seq, 4, greatest(length(seq) - 10, 0)), 'ACGT', 'TGCA')) AS seq FROM reads")
def reads_trim_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.trimmed(reads(spark, sf_dir), 3, -7, reverse=True)


@query(f"WITH {CONTIGS_SQL} SELECT contig_id, length(seq) AS n, sum(CASE WHEN i <= contig_id % 200 THEN i % 41 ELSE 0 END)::BIGINT AS total FROM (SELECT contig_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM contigs) GROUP BY contig_id, seq")
def quals_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality lists of any length cut or filled to the length of their sequence."""
    size = (F.col("contig_id") % 200).cast("int")
    quals = F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: i % 41)).otherwise(F.array().cast("array<int>"))
    rows = prep.synced_quals(contigs(spark, sf_dir).where(F.length("seq") > 0).withColumn("quals", quals))
    return rows.select("contig_id", F.size("quals").cast("long").alias("n"), F.aggregate("quals", F.lit(0).cast("long"), lambda s, q: s + q).alias("total"))


_DODGY = (
    f"WITH {READS_SQL}, bad AS (SELECT read_id, 'poly_a' AS reason FROM reads WHERE length(seq) - length(replace(seq, 'A', '')) > 0.4 * length(seq) "
    "UNION ALL SELECT read_id, 'duplicate' FROM (SELECT read_id, min(read_id) OVER (PARTITION BY md5(seq)) AS f FROM reads) WHERE read_id <> f)"
)


@query(_DODGY + " SELECT read_id, reason FROM bad")
def reads_dodgy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.dodgy(reads(spark, sf_dir), most_a=0.4)


@query(_DODGY + f", {PAIRS_SQL} SELECT DISTINCT pair_id FROM (SELECT pair_id, id1 AS read_id FROM pairs UNION ALL SELECT pair_id, id2 FROM pairs) WHERE read_id IN (SELECT read_id FROM bad)")
def pairs_dodgy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that lose a read."""
    return prep.with_partners(prep.dodgy(reads(spark, sf_dir), most_a=0.4), pairs(spark, sf_dir), "read_id")


@query(f"WITH {READS_SQL} SELECT read_id FROM reads WHERE length(seq) - length(replace(seq, 'A', '')) > 0.33 * length(seq)")
def reads_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.noisy(reads(spark, sf_dir), "A", 0.33)


@query(f"WITH {PAIRS_SQL} SELECT id1 AS id, pair_id, id2 AS partner FROM pairs UNION ALL SELECT id2, pair_id, id1 FROM pairs")
def pair_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.partners(pairs(spark, sf_dir))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS id, n_chars, quality FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def join_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return prep.by_place(left, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality"), "id")


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey + (SELECT max(c_custkey) + 1 FROM customer), s_name FROM supplier")
def tables_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return prep.appended(first, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "id")


@query(
    "SELECT l_orderkey AS q, l_partkey AS m, p_size::BIGINT AS t, CASE WHEN p_size % 2 = 1 THEN 2000 + p_size - (l_linenumber * 10 + 50) ELSE p_size * 100 + l_linenumber * 10 END::BIGINT AS start, "
    "CASE WHEN p_size % 2 = 1 THEN 2000 + p_size - l_linenumber * 10 ELSE p_size * 100 + l_linenumber * 10 + 50 END::BIGINT AS stop, (l_suppkey % 2 = 1) <> (p_size % 2 = 1) AS rc FROM lineitem JOIN part ON l_partkey = p_partkey"
)
def placements_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines placed on parts and parts on sizes, carried through to lines on sizes."""
    at = (F.col("l_linenumber") * 10).cast("long")
    inner = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("from"), F.col("l_partkey").alias("to"), at.alias("start"), (at + 50).alias("stop"), (F.col("l_suppkey") % 2 == 1).alias("rc"))
    size = F.col("p_size").cast("long")
    outer = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("from"), size.alias("to"), (size * 100).alias("start"), (size + 2000).alias("stop"), (size % 2 == 1).alias("rc"))
    return prep.composed(inner, outer)


@query(f"WITH {CONTIGS_SQL} SELECT i AS cycle, (ascii(substr(seq, i, 1)) * 7 + i * 13) % 41 AS qual, count(*) AS n FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM contigs) GROUP BY ALL")
def qual_by_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.qual_counts(contigs(spark, sf_dir), quality).select(F.col("cycle").cast("long"), F.col("qual").cast("long"), "n")


@query(f"WITH {READS_SQL} SELECT (ascii(substr(seq, i, 1)) * 7 + i * 13) % 41 AS qual, count(*) AS n FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM reads) GROUP BY ALL")
def quals_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.qual_counts(reads(spark, sf_dir), quality).groupBy(F.col("qual").cast("long").alias("qual")).agg(F.sum("n").alias("n"))


_ALIGNED = "aligned AS (SELECT l_partkey AS q, l_suppkey % 5 AS t, l_orderkey % 1000 AS pos, (l_quantity % 7)::BIGINT AS errors FROM lineitem)"
_UNIQUE = f"{_ALIGNED}, best AS (SELECT q, t, pos, errors FROM (SELECT *, min(errors) OVER (PARTITION BY q) AS least FROM aligned) WHERE errors = least), lone AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY q) AS c FROM best) WHERE c = 1)"


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_partkey").alias("q"), (F.col("l_suppkey") % 5).alias("t"), (F.col("l_orderkey") % 1000).alias("pos"), (F.col("l_quantity") % 7).cast("long").alias("errors"))


@query(f"WITH {_UNIQUE} SELECT q, t, pos, errors FROM lone")
def uniquify_aligns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.unique_best(_aligned(spark, sf_dir))


@query(f"WITH {_UNIQUE}, {PAIRS_SQL} SELECT pair_id, a.t, b.pos - a.pos AS sep FROM pairs p JOIN lone a ON p.id1 = a.q JOIN lone b ON p.id2 = b.q WHERE a.t = b.t AND b.pos - a.pos BETWEEN -300 AND 300")
def uniquify_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.pair_consistent(_aligned(spark, sf_dir), pairs(spark, sf_dir), -300, 300)


# --- bias and coverage -----------------------------------------------------------


@query(f"WITH {READS_SQL} SELECT left(seq, 6) AS prefix, count(*) AS n FROM reads WHERE length(seq) >= 6 GROUP BY 1")
def barcode_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bias.prefixes(reads(spark, sf_dir), 6)


@query(f"WITH {READS_SQL}, {CONTIGS_SQL}, a AS (SELECT left(seq, 4) AS prefix, count(*) AS n FROM reads WHERE length(seq) >= 4 GROUP BY 1), b AS (SELECT left(seq, 4) AS prefix, count(*) AS n FROM contigs WHERE length(seq) >= 4 GROUP BY 1) SELECT prefix, a.n AS n_first, b.n AS n_second FROM a JOIN b USING (prefix)")
def barcodes_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bias.shared_prefixes(reads(spark, sf_dir), contigs(spark, sf_dir), 4)


@query(f"WITH {READS_SQL} SELECT substr(seq, i, 2) AS pair, count(*) AS n FROM (SELECT seq, unnest(range(1, length(seq))) AS i FROM reads) GROUP BY 1")
def dinucleotides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bias.by_dinucleotide(reads(spark, sf_dir))


@query(f"WITH {CONTIGS_SQL} SELECT contig_id, start, length(w) - length(translate(w, 'GC', '')) AS gc FROM (SELECT contig_id, s AS start, substr(seq, s + 1, 50) AS w FROM (SELECT contig_id, seq, unnest(range(0, length(seq) - 49, 25)) AS s FROM contigs))")
def gc_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bias.content_windows(contigs(spark, sf_dir), "contig_id", 50, 25)
    return rows.select("contig_id", F.col("start").cast("long"), F.col("gc").cast("long"))


@query(f"WITH {READS_SQL} SELECT read_id, i AS pos FROM (SELECT read_id, seq, unnest(range(1, length(seq) - 4)) AS i FROM reads) WHERE substr(seq, i, 6) = 'GAATTC'")
def restriction_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bias.sites(reads(spark, sf_dir), "read_id", "GAATTC").select("read_id", F.col("pos").cast("long"))


_STARTS = "s AS (SELECT l_suppkey % 10 AS contig, l_orderkey % 200 AS pos, count(*) AS n FROM lineitem GROUP BY ALL)"


@query(f"WITH {_STARTS} SELECT contig, round(sum(n) / 200, 6) AS mean, round((sum(n * n) / 200 - (sum(n) / 200) ** 2) / (sum(n) / 200), 6) AS ratio FROM s GROUP BY contig")
def start_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("contig"), (F.col("l_orderkey") % 200).alias("pos"))
    found = bias.start_bias(bias.start_counts(placed, ["contig"]), ["contig"], F.max(F.lit(200)))
    return found.select("contig", F.round("mean", 6).alias("mean"), F.round("ratio", 6).alias("ratio"))


@query("SELECT l_suppkey AS contig, count(*) FILTER (l_orderkey % 2 = 0) AS n_first, count(*) FILTER (l_orderkey % 2 = 1) AS n_second, round((count(*) FILTER (l_orderkey % 2 = 0) - count(*) FILTER (l_orderkey % 2 = 1)) / sqrt(count(*)), 6) AS difference FROM lineitem GROUP BY 1")
def uniform_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bias.halves(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "contig"), ["contig"], F.col("l_orderkey") % 2 == 0)
    return rows.select("contig", "n_first", "n_second", F.round("difference", 6).alias("difference"))


@query("WITH h AS (SELECT l_returnflag, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, v, n, round(sum(n) OVER (PARTITION BY l_returnflag ORDER BY v) / sum(n) OVER (PARTITION BY l_returnflag), 9) AS share FROM h")
def coverage_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_quantity").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return bias.percentiles(histogram, "v", "n", ["l_returnflag"]).withColumn("share", F.round("share", 9))


@query("WITH a AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) SELECT round(corr(a.n, b.n), 9) AS r, count(*) AS n_both FROM a JOIN b USING (l_partkey)")
def coverage_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lambda s: table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == s).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return bias.correlation(counts("F"), counts("O"), ["l_partkey"], "n").select(F.round("r", 9).alias("r"), "n_both")


_BASIC = "v AS (SELECT length(text) AS v FROM documents WHERE length(text) > 0)"


@query(f"WITH {_BASIC}, r AS (SELECT v, sum(v) OVER (ORDER BY v DESC) AS c, sum(v) OVER () AS t FROM v) SELECT p AS stat, max(v)::BIGINT AS value FROM r, (SELECT unnest([25, 50, 75, 98]) AS p) WHERE 100 * c >= t * p GROUP BY p")
def basic_nstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths at which the longest make up 25, 50, 75 and 98 % of all."""
    lengths = table(spark, sf_dir, "documents").select(F.length("text").cast("long").alias("v")).where("v > 0")
    return stats.basic_nstats(lengths, "v", (25, 50, 75, 98))


# --- intervals -------------------------------------------------------------------


@query(f"WITH {INTERVALS_SQL} SELECT iv, contig, stop - start AS size, row_number() OVER (PARTITION BY contig ORDER BY stop - start DESC, iv) AS place FROM intervals")
def iv_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("stop") - F.col("start")
    return intervals(spark, sf_dir).select("iv", "contig", size.alias("size"), F.row_number().over(Window.partitionBy("contig").orderBy(size.desc(), "iv")).cast("long").alias("place"))


@query(f"WITH {INTERVALS_SQL}, m AS (SELECT iv, floor(log10(greatest(stop - start, 1)))::BIGINT AS magnitude FROM intervals) SELECT iv, magnitude FROM (SELECT *, row_number() OVER (PARTITION BY magnitude ORDER BY md5(iv::VARCHAR), iv) AS r FROM m) WHERE r <= 5")
def iv_sample_per_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five intervals of each magnitude of length, by the hash of their id."""
    size = F.greatest(F.col("stop") - F.col("start"), F.lit(1))
    rows = intervals(spark, sf_dir).select("iv", F.floor(F.log10(size)).cast("long").alias("magnitude"), F.md5(F.col("iv").cast("string").cast("binary")).alias("h"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("magnitude").orderBy("h", "iv"))).where("r <= 5")
    return ranked.select("iv", "magnitude")


_MASKS = (
    f"{INTERVALS_SQL}, ev AS (SELECT contig, start AS p, CASE WHEN iv % 2 = 0 THEN 1 ELSE 0 END AS a, CASE WHEN iv % 2 = 1 THEN 1 ELSE 0 END AS b FROM intervals WHERE stop > start UNION ALL SELECT contig, stop, CASE WHEN iv % 2 = 0 THEN -1 ELSE 0 END, CASE WHEN iv % 2 = 1 THEN -1 ELSE 0 END FROM intervals WHERE stop > start), "
    "pt AS (SELECT contig, p, sum(a) AS a, sum(b) AS b FROM ev GROUP BY ALL), sw AS (SELECT contig, lead(p) OVER w - p AS n, sum(a) OVER w > 0 AS a, sum(b) OVER w > 0 AS b FROM pt WINDOW w AS (PARTITION BY contig ORDER BY p))"
)


@query(f"WITH {_MASKS} SELECT contig, coalesce(sum(n) FILTER (a AND b), 0)::BIGINT AS n_and, coalesce(sum(n) FILTER (a OR b), 0)::BIGINT AS n_or, coalesce(sum(n) FILTER (a <> b), 0)::BIGINT AS n_xor, coalesce(sum(n) FILTER (a AND NOT b), 0)::BIGINT AS n_minus FROM sw GROUP BY contig")
def iv_mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in both, either, one, and the first only, of two masks of intervals."""
    from helixframe.operators import intervals as ivs

    rows = intervals(spark, sf_dir)
    found = ivs.two_masks(rows.where("iv % 2 = 0"), rows.where("iv % 2 = 1"))
    total = lambda keep: F.coalesce(F.sum(F.when(keep, F.col("stop") - F.col("start"))), F.lit(0)).cast("long")
    a, b = F.col("in_a"), F.col("in_b")
    return found.groupBy("contig").agg(total(a & b).alias("n_and"), total(a | b).alias("n_or"), total(a != b).alias("n_xor"), total(a & ~b).alias("n_minus"))


@query(f"WITH {INTERVALS_SQL}, w AS (SELECT contig, start, stop FROM intervals WHERE iv % 10 = 0 AND stop > start) SELECT iv FROM intervals i WHERE iv % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM w WHERE w.contig = i.contig AND w.start < i.stop AND i.start < w.stop AND i.stop > i.start)")
def iv_off_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that overlap no given window."""
    from helixframe.operators import intervals as ivs

    rows = intervals(spark, sf_dir)
    others = rows.where("iv % 10 <> 0")
    hit = ivs.overlap_join(others, rows.where("iv % 10 = 0"), 3600).select(F.col("l_iv").alias("iv")).distinct()
    return others.join(hit, "iv", "left_anti").select("iv")


# --- calls -----------------------------------------------------------------------

_CALLS = (
    "calls AS (SELECT l_suppkey % 20 AS contig, l_partkey % 300 + 1 AS pos, ['A', 'C', 'G', 'T', 'AC'][(l_orderkey % 5)::INT + 1] AS ref, ['T', 'G', 'GA', 'C', 'T'][(l_linenumber % 5)::INT + 1] AS alt, l_quantity AS qual, l_suppkey % 3 AS region, "
    "CASE l_returnflag WHEN 'A' THEN 'PASS' WHEN 'N' THEN '.' ELSE 'LowQual' END AS filter, l_linenumber % 3 AS gt, l_tax AS p1, l_discount AS p2 FROM lineitem)"
)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (n % 5 + 1).cast("int"))
    state = F.when(F.col("l_returnflag") == "A", "PASS").when(F.col("l_returnflag") == "N", ".").otherwise("LowQual")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("contig"), (F.col("l_partkey") % 300 + 1).alias("pos"), pick(["A", "C", "G", "T", "AC"], F.col("l_orderkey")).alias("ref"), pick(["T", "G", "GA", "C", "T"], F.col("l_linenumber")).alias("alt"),
        F.col("l_quantity").alias("qual"), (F.col("l_suppkey") % 3).alias("region"), state.alias("filter"), (F.col("l_linenumber") % 3).alias("gt"), F.col("l_tax").alias("p1"), F.col("l_discount").alias("p2"),
    )


@query(f"WITH {_CALLS} SELECT contig, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snp' WHEN length(ref) = length(alt) THEN 'mnp' WHEN length(ref) > length(alt) THEN 'deletion' ELSE 'insertion' END AS kind, count(*) AS n, sum(qual) AS qual FROM calls WHERE qual >= 20 AND filter IN ('PASS', '.') GROUP BY ALL")
def calls_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls.passing(_calls(spark, sf_dir), 20)
    return rows.groupBy("contig", calls.kind(F.col("ref"), F.col("alt")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("qual").alias("qual"))


@query(f"WITH {_CALLS}, m AS (SELECT CASE WHEN (p1 > 0 AND p1 < 0.03) OR (p2 > 0 AND p2 < 0.03) THEN CASE WHEN filter IN ('PASS', '.') THEN 'LowProb' ELSE filter || ';LowProb' END ELSE filter END AS filter FROM calls) SELECT filter, count(*) AS n FROM m GROUP BY 1")
def calls_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.marked_by_probability(_calls(spark, sf_dir), ("p1", "p2"), 0.03, "LowProb").groupBy("filter").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CALLS} SELECT contig, pos, ref, alt, region, qual, n_regions FROM (SELECT *, row_number() OVER (PARTITION BY contig, pos, ref, alt ORDER BY qual DESC, region) AS r, count(*) OVER (PARTITION BY contig, pos, ref, alt) AS n_regions FROM calls) WHERE r = 1")
def calls_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.merged_regions(_calls(spark, sf_dir))


@query(f"WITH {_CALLS} SELECT contig, count(*) FILTER (gt = 1) AS n_het, count(*) FILTER (gt > 0) AS n, round(count(*) FILTER (gt = 1) / count(*) FILTER (gt > 0), 9) AS rate FROM calls GROUP BY contig")
def calls_het_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.het_rate(_calls(spark, sf_dir), ["contig"]).withColumn("rate", F.round("rate", 9))


@query(
    "WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, (l_partkey % 3)::BIGINT AS child, (l_suppkey % 3)::BIGINT AS mother, (l_quantity % 3)::BIGINT AS father FROM lineitem) SELECT child, mother, father, count(*) AS n FROM t "
    "WHERE NOT ((mother, father, child) IN ((0,0,0),(0,1,0),(0,1,1),(0,2,1),(1,0,0),(1,0,1),(1,1,0),(1,1,1),(1,1,2),(1,2,1),(1,2,2),(2,0,1),(2,1,1),(2,1,2),(2,2,2))) GROUP BY ALL"
)
def calls_not_mendelian(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 3).alias("child"), (F.col("l_suppkey") % 3).alias("mother"), (F.col("l_quantity") % 3).cast("long").alias("father"))
    return rows.where(calls.not_mendelian(F.col("child"), F.col("mother"), F.col("father"))).groupBy("child", "mother", "father").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH n AS (SELECT l_partkey, count(*) FILTER (l_returnflag <> 'A') AS r, count(*) FILTER (l_returnflag = 'A') AS a FROM lineitem GROUP BY 1), "
    "j AS (SELECT *, r * log10(0.99) + a * log10(0.01) + log10(0.9) AS x, (r + a) * log10(0.5) + log10(0.08) AS y, r * log10(0.01) + a * log10(0.99) + log10(0.02) AS z FROM n), g AS (SELECT *, greatest(x, y, z) AS m FROM j) "
    "SELECT l_partkey, round(10 ** (x - m) / (10 ** (x - m) + 10 ** (y - m) + 10 ** (z - m)), 9) AS p0, round(10 ** (y - m) / (10 ** (x - m) + 10 ** (y - m) + 10 ** (z - m)), 9) AS p1, round(10 ** (z - m) / (10 ** (x - m) + 10 ** (y - m) + 10 ** (z - m)), 9) AS p2 FROM g"
)
def calls_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") != "A").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a"))
    found = calls.genotype_posteriors(F.col("r"), F.col("a"), 0.01, (0.9, 0.08, 0.02))
    return counts.select("l_partkey", *(F.round(p, 9).alias(f"p{i}") for i, p in enumerate(found)))


@query("SELECT l_partkey, round(least(100.0, greatest(0.0, 10 * sum(CASE WHEN l_returnflag = 'A' THEN 0.8 ELSE -0.3 END * l_quantity / 50))), 6) AS altp FROM lineitem GROUP BY 1")
def calls_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    odds = F.when(F.col("l_returnflag") == "A", 0.8).otherwise(-0.3) * F.col("l_quantity") / 50
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(calls.support_phred(odds), 6).alias("altp"))


@query(
    f"WITH {CONTIGS_SQL}, e AS (SELECT contig_id, p AS pos, substr(seq, p, 1) AS ref, CASE WHEN p % 3 = 0 THEN '' WHEN p % 3 = 1 THEN 'NN' ELSE 'N' END AS alt FROM (SELECT contig_id, seq, unnest(range(5, length(seq) + 1, 7)) AS p FROM contigs)), "
    "d AS (SELECT k.contig_id, k.i, CASE WHEN e.pos IS NULL THEN substr(k.seq, k.i, 1) ELSE e.alt END AS s FROM (SELECT contig_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM contigs) k LEFT JOIN e ON e.contig_id = k.contig_id AND e.pos = k.i) "
    "SELECT contig_id, string_agg(s, '' ORDER BY i) AS seq FROM d GROUP BY contig_id"
)
def calls_edit_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions, substitutions and insertions at every seventh place; heterozygous calls change nothing."""
    rows = contigs(spark, sf_dir).where(F.length("seq") > 0)
    pos = F.explode(F.sequence(F.lit(5), F.length("seq"), F.lit(7)))
    made = rows.where(F.length("seq") >= 5).select(F.col("contig_id").alias("contig"), "seq", pos.alias("pos"))
    alt = F.when(F.col("pos") % 3 == 0, "").when(F.col("pos") % 3 == 1, "NN").otherwise("N")
    made = made.select("contig", "pos", F.substr("seq", F.col("pos"), F.lit(1)).alias("ref"), alt.alias("alt"), F.lit(2).alias("gt"))
    het = made.select("contig", (F.col("pos") + 1).alias("pos"), F.lit("A").alias("ref"), F.lit("T").alias("alt"), F.lit(1).alias("gt"))
    return calls.edited_reference(rows, made.union(het), "contig_id")


# --- graphs ----------------------------------------------------------------------

_NET = "net AS (SELECT c_nationkey::BIGINT AS src, (c_custkey % 25)::BIGINT AS dst, min(round(c_acctbal + 1000)) AS weight FROM customer WHERE c_custkey % 25 <> c_nationkey GROUP BY ALL)"


def _net(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("src"), (F.col("c_custkey") % 25).alias("dst"), F.round(F.col("c_acctbal") + 1000).alias("w"))
    return rows.where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("weight"))


@query(
    f"WITH RECURSIVE {_NET}, far AS (SELECT src, dst, weight FROM net WHERE weight >= 0), r(node, distance, hops) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 0 UNION SELECT node, min(distance), hops FROM (SELECT f.dst AS node, r.distance + f.weight AS distance, r.hops + 1 AS hops FROM r JOIN far f ON f.src = r.node WHERE r.hops < 24) GROUP BY node, hops) "
    "SELECT node, min(distance) AS distance FROM r GROUP BY node"
)
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = spark.range(1).select(F.col("id").alias("node"))
    return graph.shortest_paths(_net(spark, sf_dir).where("weight >= 0"), starts)


@query(
    f"WITH RECURSIVE {_NET}, r(node, path) AS (SELECT 0::BIGINT, [0::BIGINT] UNION ALL SELECT n.dst, list_append(r.path, n.dst) FROM r JOIN net n ON n.src = r.node WHERE len(r.path) <= 3 AND NOT list_contains(r.path, n.dst) AND n.dst % 2 = 1) "
    "SELECT array_to_string(path, '>') AS path FROM r WHERE node = 7"
)
def all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple paths of at most three edges from node 0 to node 7 over odd nodes."""
    one = lambda n: spark.range(n, n + 1).select(F.col("id").alias("node"))
    found = graph.paths_between(_net(spark, sf_dir).where("dst % 2 = 1"), one(0), one(7), 3)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


_SHIP = "ship AS (SELECT DISTINCT l_orderkey % 60 * 2 + l_orderkey % 7 // 6 AS a, l_orderkey % 60 * 2 + 1 AS b FROM lineitem UNION SELECT DISTINCT l_orderkey % 60 * 2, (l_orderkey % 60 + 20) % 60 * 2 + l_orderkey % 2 FROM lineitem WHERE l_orderkey % 60 < 50)"


@query(
    f"WITH RECURSIVE {_SHIP}, e AS (SELECT a, b FROM ship WHERE a <> b UNION SELECT b, a FROM ship WHERE a <> b), r(s, node, parity) AS (SELECT a, a, 0 FROM e UNION SELECT r.s, e.b, 1 - r.parity FROM r JOIN e ON e.a = r.node), "
    "odd AS (SELECT DISTINCT s FROM r WHERE s = node AND parity = 1) SELECT DISTINCT component FROM (SELECT s, min(node) AS component FROM r GROUP BY s) WHERE s IN (SELECT s FROM odd)"
)
def odd_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with an odd cycle."""
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    first = rows.select((k % 60 * 2 + F.floor((k % 7) / 6)).cast("long").alias("src"), (k % 60 * 2 + 1).alias("dst"))
    second = rows.where("l_orderkey % 60 < 50").select((k % 60 * 2).alias("src"), ((k % 60 + 20) % 60 * 2 + k % 2).alias("dst"))
    return graph.odd_components(first.union(second).where("src <> dst").distinct())


@query(f"WITH {_NET}, t AS (SELECT DISTINCT s_nationkey::BIGINT AS src, s_suppkey % 9 AS dst FROM supplier) SELECT src, dst FROM net UNION ALL SELECT src + (SELECT max(greatest(src, dst)) + 1 FROM net), dst + (SELECT max(greatest(src, dst)) + 1 FROM net) FROM t")
def graph_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("src"), (F.col("s_suppkey") % 9).alias("dst")).distinct()
    return graph.disjoint_union(_net(spark, sf_dir), other)
