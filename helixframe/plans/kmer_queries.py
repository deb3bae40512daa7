"""K-mer counting, spectra and set comparisons over reads (documents) and contigs (benchmark)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import sequence as seqf
from helixframe.operators import kmers as km
from helixframe.operators import blocks, packed

from .registry import query
from .tables import CONTIGS_SQL, DISTINCT_SQL, READS_SQL, contigs, kmers_sql, reads

K = 11
_READ_KMERS = f"WITH {READS_SQL}, {kmers_sql('reads', 'read_id', K)}"
_BOTH_KMERS = f"WITH {READS_SQL}, {CONTIGS_SQL}, {kmers_sql('reads', 'read_id', K)}, {kmers_sql('contigs', 'contig_id', K, 'ref_kmers')}"
_COUNTS = ", counts AS (SELECT kmer, count(*) AS kf FROM kmers GROUP BY kmer)"


def _kmers(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return km.kmerized(reads(spark, sf_dir), k)


def _ref_kmers(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return km.kmerized(contigs(spark, sf_dir), k, "contig_id")


@query(_READ_KMERS + _COUNTS + " SELECT kf, count(*) AS ndk FROM counts GROUP BY kf")
def kmer_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.spectrum(km.counted(_kmers(spark, sf_dir)))


@query(
    _READ_KMERS.replace("least(fwd, reverse(translate(fwd, 'ACGT', 'TGCA')))", "CASE WHEN substr(fwd, 6, 1) IN ('G', 'T') THEN reverse(translate(fwd, 'ACGT', 'TGCA')) ELSE fwd END")
    + " SELECT kmer, count(*) AS kf FROM kmers GROUP BY kmer HAVING count(*) >= 50"
)
def kmer_count_middle_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.counted(km.kmerized(reads(spark, sf_dir), K, rule="middle"), 50)


@query(_READ_KMERS + " SELECT kmer, count(*) AS kf FROM kmers GROUP BY kmer HAVING count(*) >= 20")
def kmer_count_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.counted(_kmers(spark, sf_dir), 20)


_CONTEXT = (
    _READ_KMERS
    + """, c AS (SELECT kmer, kmer <> fwd AS turned, nullif(CASE WHEN pos > 1 THEN substr(r.seq, (pos - 1)::BIGINT, 1) END, '') AS b, nullif(substr(r.seq, (pos + 11)::BIGINT, 1), '') AS a
    FROM kmers JOIN reads r USING (read_id)),
  x AS (SELECT kmer, CASE WHEN turned THEN translate(a, 'ACGT', 'TGCA') ELSE b END AS p, CASE WHEN turned THEN translate(b, 'ACGT', 'TGCA') ELSE a END AS n FROM c),
  y AS (SELECT kmer, count(*) AS kf, bit_or(CASE WHEN p IS NULL THEN 0 ELSE 1 << (instr('ACGT', p) - 1)::INT END | CASE WHEN n IS NULL THEN 0 ELSE 1 << (instr('ACGT', n) + 3)::INT END) AS bits FROM x GROUP BY kmer)"""
)


@query(_CONTEXT + " SELECT bits::BIGINT AS bits, count(*) AS ndk, sum(kf)::BIGINT AS nk FROM y GROUP BY bits")
def kmer_context_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = km.context_bits(km.with_context(reads(spark, sf_dir), K))
    return bits.groupBy(F.col("bits").cast("long").alias("bits")).agg(F.count(F.lit(1)).alias("ndk"), F.sum("kf").alias("nk"))


@query(_CONTEXT + " SELECT kf, bit_count(bits & 15)::BIGINT AS n_prev, bit_count(bits >> 4)::BIGINT AS n_next, count(*) AS ndk FROM y GROUP BY ALL")
def kmer_affix_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    affix = km.affix_counts(km.with_context(reads(spark, sf_dir), K))
    return affix.groupBy("kf", F.col("n_prev").cast("long").alias("n_prev"), F.col("n_next").cast("long").alias("n_next")).agg(F.count(F.lit(1)).alias("ndk"))


_BI = _BOTH_KMERS + ", bi AS (SELECT kmer, sum(a)::BIGINT AS kf_a, sum(b)::BIGINT AS kf_b FROM (SELECT kmer, 1 AS a, 0 AS b FROM kmers UNION ALL SELECT kmer, 0, 1 FROM ref_kmers) GROUP BY kmer)"


def _bi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.bi_counts(_kmers(spark, sf_dir), _ref_kmers(spark, sf_dir))


@query(_BI + " SELECT kf_a, kf_b, count(*) AS ndk FROM bi GROUP BY kf_a, kf_b")
def kmer_bi_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bi(spark, sf_dir).groupBy("kf_a", "kf_b").agg(F.count(F.lit(1)).alias("ndk"))


@query(_BI + " SELECT least(kf_a, 10) AS in_reads, least(kf_b, 10) AS in_contigs, count(*) AS n_kmers, sum(kf_a)::BIGINT AS read_kmers FROM bi GROUP BY 1, 2")
def kmer_roll_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bi(spark, sf_dir).groupBy(F.least("kf_a", F.lit(10)).alias("in_reads"), F.least("kf_b", F.lit(10)).alias("in_contigs")).agg(F.count(F.lit(1)).alias("n_kmers"), F.sum("kf_a").alias("read_kmers"))


@query(_BI + " SELECT sum(least(kf_a, kf_b))::BIGINT AS covered, sum(kf_b)::BIGINT AS total FROM bi")
def kmer_multiset_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset intersection: least of both counts of each word."""
    return _bi(spark, sf_dir).agg(F.sum(F.least("kf_a", "kf_b")).alias("covered"), F.sum("kf_b").alias("total"))


@query(_BI + " SELECT count(*) FILTER (WHERE kf_a > 0 AND kf_b > 0) AS both, count(*) FILTER (WHERE kf_b = 0) AS only_reads, count(*) FILTER (WHERE kf_a = 0) AS only_contigs FROM bi")
def kmer_table_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bi(spark, sf_dir).agg(
        F.count_if((F.col("kf_a") > 0) & (F.col("kf_b") > 0)).alias("both"), F.count_if(F.col("kf_b") == 0).alias("only_reads"), F.count_if(F.col("kf_a") == 0).alias("only_contigs")
    )


@query(_BOTH_KMERS + " SELECT contig_id, pos::BIGINT AS pos, kmer FROM ref_kmers WHERE kmer NOT IN (SELECT kmer FROM kmers)")
def kmer_set_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of contigs that no read has."""
    own = _kmers(spark, sf_dir).select("kmer").distinct()
    return _ref_kmers(spark, sf_dir).join(own, "kmer", "left_anti").select("contig_id", F.col("pos").cast("long").alias("pos"), "kmer")


@query(_BOTH_KMERS + " SELECT read_id, count(*) AS n_masked FROM kmers WHERE kmer IN (SELECT kmer FROM ref_kmers) GROUP BY read_id")
def kmer_masker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of each read whose word a contig has."""
    mask = _ref_kmers(spark, sf_dir).select("kmer").distinct()
    return _kmers(spark, sf_dir).join(mask, "kmer", "left_semi").groupBy("read_id").agg(F.count(F.lit(1)).alias("n_masked"))


@query(
    _READ_KMERS
    + """, q AS (SELECT kmer, (ascii(substr(r.seq, pos::BIGINT, 1)) * 7 + pos * 13) % 41 AS q FROM kmers JOIN reads r USING (read_id)),
  t AS (SELECT kmer, count(*) AS kf, max(q) AS best FROM q GROUP BY kmer) SELECT kf, best::BIGINT AS best_quality, count(*) AS ndk FROM t GROUP BY kf, best"""
)
def kmer_quality_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring("fwd", 1, 1)
    rows = _kmers(spark, sf_dir).select("kmer", seqf.quality(F.col("pos"), first).alias("q"))
    best = rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("kf"), F.max("q").alias("best"))
    return best.groupBy("kf", F.col("best").cast("long").alias("best_quality")).agg(F.count(F.lit(1)).alias("ndk"))


_PER_READ = _READ_KMERS + _COUNTS + ", per AS (SELECT read_id, count(*) AS n, min(kf) AS min_kf, max(kf) AS max_kf, sum(kf)::BIGINT AS sum_kf FROM kmers JOIN counts USING (kmer) GROUP BY read_id)"


@query(_PER_READ + " SELECT * FROM per")
def kmer_read_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.per_read(reads(spark, sf_dir), K)


@query(_PER_READ + " SELECT read_id FROM per WHERE min_kf >= 2")
def kmer_read_min_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads all of whose words recur."""
    return packed.per_read(reads(spark, sf_dir), K).where("min_kf >= 2").select("read_id")


@query(_READ_KMERS + _COUNTS + " SELECT read_id, count(*) AS n_unique FROM kmers JOIN counts USING (kmer) WHERE kf = 1 GROUP BY read_id")
def kmer_unique_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A word that occurs once has one read, so no join back is needed.
    once = _kmers(spark, sf_dir).groupBy("kmer").agg(F.count(F.lit(1)).alias("kf"), F.min("read_id").alias("read_id")).where("kf = 1")
    return once.groupBy("read_id").agg(F.count(F.lit(1)).alias("n_unique"))


@query(_READ_KMERS + " SELECT kmer, count(*) AS kf FROM kmers GROUP BY kmer ORDER BY kf DESC, kmer LIMIT 100")
def kmer_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.counted(_kmers(spark, sf_dir)).orderBy(F.desc("kf"), "kmer").limit(100)


@query(_READ_KMERS + _COUNTS + " SELECT count(*) AS n_distinct, count(*) FILTER (WHERE kf > 1) AS n_repeated, sum(kf)::BIGINT AS n_total, sum(CASE WHEN kf > 1 THEN kf ELSE 0 END)::BIGINT AS n_in_repeats FROM counts")
def kmer_repeat_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = km.counted(_kmers(spark, sf_dir))
    return counts.agg(F.count(F.lit(1)).alias("n_distinct"), F.count_if(F.col("kf") > 1).alias("n_repeated"), F.sum("kf").alias("n_total"), F.sum(F.when(F.col("kf") > 1, F.col("kf")).otherwise(0)).alias("n_in_repeats"))


@query(
    _READ_KMERS
    + _COUNTS
    + """, spec AS (SELECT kf, count(*) AS ndk FROM counts GROUP BY kf), nk AS (SELECT kf, kf * ndk AS nk, lag(kf * ndk) OVER (ORDER BY kf) AS b, lead(kf * ndk) OVER (ORDER BY kf) AS a FROM spec),
  lo AS (SELECT min(kf) AS kf_min1 FROM nk WHERE b >= nk AND a > nk)
  SELECT kf_min1, arg_max(kf, (nk, -kf)) AS kf_max2, sum(nk)::BIGINT AS nk_above FROM nk, lo WHERE kf > kf_min1 GROUP BY kf_min1"""
)
def kmer_genome_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.spectrum_features(km.spectrum(km.counted(_kmers(spark, sf_dir))))


@query(
    f"WITH {READS_SQL}, {DISTINCT_SQL}, {kmers_sql('distinct_reads', 'read_id', 15)}, own AS (SELECT DISTINCT read_id AS r, kmer FROM kmers) "
    "SELECT x.r AS a, y.r AS b, count(*) AS n FROM own x JOIN own y ON x.kmer = y.kmer AND x.r < y.r GROUP BY 1, 2"
)
def kmer_self_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different reads; ``friend_classes`` gives the members of each."""
    return blocks.common_words(km.representatives(blocks.packed_reads(reads(spark, sf_dir), 15)), 15)


@query(_READ_KMERS + ", n AS (SELECT read_id, count(*) AS n, count(DISTINCT kmer) AS d FROM kmers GROUP BY read_id) SELECT read_id, n, d AS n_distinct FROM n WHERE 2 * d < n")
def kmer_low_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _kmers(spark, sf_dir).groupBy("read_id", "kmer").agg(F.count(F.lit(1)).alias("m"))
    return own.groupBy("read_id").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("n_distinct")).where("2 * n_distinct < n")


@query(
    f"WITH {CONTIGS_SQL}, {kmers_sql('contigs', 'contig_id', K)} SELECT kmer, list_sum(list_transform(range(1, 12), lambda i: (instr('ACGT', substr(kmer, i, 1)) - 1) * (4 ** (11 - i))::BIGINT))::BIGINT AS kmer_id FROM (SELECT DISTINCT kmer FROM kmers)"
)
def kmer_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.numbered(_ref_kmers(spark, sf_dir))


@query(
    f"WITH {CONTIGS_SQL}, p AS (SELECT contig_id, seq, unnest(range(1, length(seq) - 8 + 2)) AS pos FROM contigs) "
    "SELECT substr(seq, pos, 2) || substr(seq, pos + 3, 2) || substr(seq, pos + 6, 2) AS word, count(*) AS n FROM p GROUP BY 1"
)
def kmer_gapped_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contigs(spark, sf_dir).where(F.length("seq") >= 8).select("seq", F.explode(F.sequence(F.lit(1), F.length("seq") - 7)).alias("pos"))
    return rows.groupBy(seqf.shaped_kmer(F.col("seq"), F.col("pos"), "11011011").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query(_READ_KMERS + _COUNTS + " SELECT kmer, kf, read_id, pos::BIGINT AS pos FROM kmers JOIN counts USING (kmer)")
def kmer_with_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its frequency at each of its places."""
    return packed.located(reads(spark, sf_dir), K)
