"""Sequence functions, pairs, selection, set operations and text tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import sequence as seqf
from helixframe.functions import strings
from helixframe.operators import intervals as ivs
from helixframe.operators import pairing, selection

from .registry import query
from .tables import CONTIGS_SQL, PAIRS_SQL, READS_SQL, contigs, pairs, reads, table

_R, _C = f"WITH {READS_SQL} ", f"WITH {CONTIGS_SQL} "


@query(_R + "SELECT read_id, length(seq) - length(translate(seq, 'GC', '')) AS gc, round(100.0 * (length(seq) - length(translate(seq, 'GC', ''))) / length(seq), 6) AS gc_percent FROM reads WHERE length(seq) > 0")
def seq_gc_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).where(F.length("seq") > 0)
    return rows.select("read_id", seqf.gc_count(F.col("seq")).cast("long").alias("gc"), F.round(seqf.gc_percent(F.col("seq")), 6).alias("gc_percent"))


@query(_R + "SELECT read_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc_md5, md5(reverse(seq)) AS rev_md5, seq = reverse(translate(seq, 'ACGT', 'TGCA')) AS palindrome FROM reads")
def seq_revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    return reads(spark, sf_dir).select("read_id", F.md5(seqf.reverse_complement(s)).alias("rc_md5"), F.md5(F.reverse(s)).alias("rev_md5"), seqf.is_palindrome(s).alias("palindrome"))


@query(_R + ", r AS (SELECT unnest(regexp_extract_all(seq, 'A+|C+|G+|T+')) AS run FROM reads) SELECT substr(run, 1, 1) AS base, length(run) AS size, count(*) AS n FROM r GROUP BY 1, 2")
def seq_homopolymer_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).select(F.explode(seqf.runs(F.col("seq"))).alias("run"))
    return rows.groupBy(F.substring("run", 1, 1).alias("base"), F.length("run").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query(_R + "SELECT read_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq, 'AA+', 'AA', 'g'), 'CC+', 'CC', 'g'), 'GG+', 'GG', 'g'), 'TT+', 'TT', 'g')) AS capped, coalesce(list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda x: length(x))), 0)::BIGINT AS longest FROM reads")
def seq_cap_homopolymer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    return reads(spark, sf_dir).select("read_id", F.length(seqf.capped_runs(s, 2)).cast("long").alias("capped"), seqf.longest_run(s).cast("long").alias("longest"))


@query(_R + ", b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS base) SELECT base, sum(length(seq) - length(replace(seq, base, '')))::BIGINT AS n FROM reads, b GROUP BY base")
def seq_base_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = reads(spark, sf_dir).agg(*(F.sum(seqf.count_of(F.col("seq"), b)).alias(b) for b in "ACGT"))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(b).alias("base"), F.col(b).alias("n")) for b in "ACGT"))).alias("x")).select("x.*")


@query(_C + ", f AS (SELECT contig_id, unnest(string_split(replace(seq, 'GATC', '|GATC'), '|')) AS fragment FROM contigs) SELECT contig_id, length(fragment) AS size, count(*) AS n FROM f GROUP BY 1, 2")
def seq_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contigs(spark, sf_dir).select("contig_id", F.explode(seqf.digest(F.col("seq"), "GATC", 0)).alias("fragment"))
    return rows.groupBy("contig_id", F.length("fragment").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query(_C + ", o AS (SELECT contig_id, unnest(regexp_extract_all(seq, 'ATG(?:[ACGT]{3})*?(?:TAA|TAG|TGA)')) AS orf FROM contigs) SELECT contig_id, orf, length(orf) AS size FROM o")
def seq_orf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contigs(spark, sf_dir).select("contig_id", F.explode(seqf.open_frames(F.col("seq"))).alias("orf"))
    return rows.withColumn("size", F.length("orf").cast("long"))


_CODE = "(instr('TCAG', substr(c, {}, 1)) - 1)"
_AMINO = f"substr('{seqf.AMINO_ACIDS}', {_CODE.format(1)} * 16 + {_CODE.format(2)} * 4 + {_CODE.format(3)} + 1, 1)"


@query(_C + f"SELECT contig_id, array_to_string(list_transform(range(0, length(seq) // 3), lambda i: list_transform([substr(seq, i * 3 + 1, 3)], lambda c: {_AMINO})[1]), '') AS protein FROM contigs")
def seq_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contigs(spark, sf_dir).select("contig_id", seqf.translated(F.col("seq")).alias("protein"))


@query(
    _R + ", g AS (SELECT read_id, length(seq)::DOUBLE AS n, (length(seq) - length(translate(seq, 'GC', '')))::DOUBLE AS gc FROM reads WHERE length(seq) > 0) SELECT read_id, "
    "round(CASE WHEN n < 20 THEN 2 * (n - gc) + 4 * gc WHEN n <= 70 THEN 81.5 + 16.6 * log10(0.05) + 41 * gc / n - 600 / n ELSE 81.5 + 16.6 * log10(0.05) + 41 * gc / n - 500 / n END, 6) AS tm FROM g"
)
def seq_tm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).where(F.length("seq") > 0).select("read_id", F.round(seqf.melting_temperature(F.col("seq")), 6).alias("tm"))


@query(
    _C + ", d AS (SELECT contig_id, substr(seq, i::BIGINT, 2) AS w FROM (SELECT contig_id, seq, unnest(range(1, length(seq))) AS i FROM contigs)), n AS (SELECT contig_id, w, count(*) AS n FROM d GROUP BY 1, 2), "
    "p AS (SELECT contig_id, n::DOUBLE / sum(n) OVER (PARTITION BY contig_id) AS p FROM n) SELECT contig_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY contig_id"
)
def seq_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the pairs of neighbouring bases."""
    rows = contigs(spark, sf_dir).select("contig_id", F.explode(seqf.kmer_array(F.col("seq"), 2)).alias("w"))
    n = rows.groupBy("contig_id", "w").agg(F.count(F.lit(1)).alias("n"))
    # sum(p log p) = sum(n log n) / N - log N: one more aggregate instead of a window.
    sums = n.groupBy("contig_id").agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.log2("n")).alias("nlog"))
    return sums.select("contig_id", F.round(F.log2("N") - F.col("nlog") / F.col("N"), 6).alias("entropy"))


@query(_C + "SELECT a.contig_id AS a, b.contig_id AS b, list_max(list_filter(range(3, least(length(a.seq), length(b.seq)) + 1), lambda n: right(a.seq, n) = left(b.seq, n)))::BIGINT AS overlap FROM contigs a JOIN contigs b ON right(a.seq, 3) = substr(b.seq, 1, 3) AND a.contig_id <> b.contig_id")
def seq_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix-prefix overlaps of contigs whose last three bases begin another."""
    left = contigs(spark, sf_dir).select(F.col("contig_id").alias("a"), F.col("seq").alias("sa"), F.right("seq", F.lit(3)).alias("k"))
    right = contigs(spark, sf_dir).select(F.col("contig_id").alias("b"), F.col("seq").alias("sb"), F.left("seq", F.lit(3)).alias("k"))
    both = left.join(right, "k").where("a <> b")
    best = F.array_max(F.filter(F.sequence(F.lit(3), F.least(F.length("sa"), F.length("sb"))), lambda n: F.right(F.col("sa"), n) == F.left(F.col("sb"), n)))
    return both.select("a", "b", best.cast("long").alias("overlap"))


@query(_C + "SELECT contig_id, len(regexp_extract_all(seq, 'CG')) AS n_cpg, md5(replace(seq, 'C', 'T')) AS converted FROM contigs")
def seq_bisulphite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contigs(spark, sf_dir).select("contig_id", F.regexp_count("seq", F.lit("CG")).cast("long").alias("n_cpg"), F.md5(F.translate("seq", "C", "T")).alias("converted"))


_P = f"WITH {PAIRS_SQL} "


@query(_P + "SELECT lib, count(*) AS n_pairs, round(avg(sep), 6) AS mean_sep, round(stddev_pop(sep), 6) AS sd_sep, min(sep) AS least_sep, max(sep) AS most_sep FROM pairs GROUP BY lib")
def pairs_library_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.library_stats(pairs(spark, sf_dir))


@query(_P + "SELECT lib, (floor(sep / 30) * 30)::BIGINT AS from_sep, count(*) AS n FROM pairs GROUP BY 1, 2")
def pairs_sep_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.separation_histogram(pairs(spark, sf_dir), 30).select("lib", F.col("from_sep").cast("long").alias("from_sep"), "n")


@query(_P + ", l AS (SELECT lib, avg(sep) AS m, stddev_pop(sep) AS sd FROM pairs GROUP BY lib) SELECT pair_id, id1, id2, sep FROM pairs JOIN l USING (lib) WHERE abs(sep - m) <= 1.0 * sd")
def pairs_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.valid(pairs(spark, sf_dir), 1.0).select("pair_id", "id1", "id2", "sep")


_BUNDLES = _P + ", bundles AS (SELECT least(id1, id2) AS a, greatest(id1, id2) AS b, count(*) AS links, round(avg(sep), 6) AS sep, round(stddev_pop(sep), 6) AS dev FROM pairs WHERE id1 <> id2 GROUP BY 1, 2 HAVING count(*) >= 2)"


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.link_bundles(pairs(spark, sf_dir), 2)


@query(_BUNDLES + " SELECT * FROM bundles")
def link_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bundles(spark, sf_dir)


@query(
    _BUNDLES + ", x AS (SELECT a AS c, a, b, links FROM bundles UNION ALL SELECT b, a, b, links FROM bundles), r AS (SELECT *, row_number() OVER w AS r, lead(links) OVER w AS second FROM x WINDOW w AS (PARTITION BY c ORDER BY links DESC, a, b)) "
    "SELECT a, b, max(links) AS links FROM r WHERE r = 1 AND (second IS NULL OR links >= 1.0 * second) GROUP BY a, b HAVING count(*) = 2"
)
def scaffold_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.scaffold_edges(_bundles(spark, sf_dir), 1.0)


@query(
    _P + ", s AS (SELECT lib AS contig, least(id1, id2) AS start, greatest(id1, id2) AS stop FROM pairs WHERE id1 <> id2), ev AS (SELECT contig, p, sum(d) AS d FROM (SELECT contig, start AS p, 1 AS d FROM s UNION ALL SELECT contig, stop, -1 FROM s) GROUP BY 1, 2), "
    "c AS (SELECT contig, p AS start, lead(p) OVER w AS stop, sum(d) OVER w AS coverage FROM ev WINDOW w AS (PARTITION BY contig ORDER BY p)) SELECT contig, max(coverage)::BIGINT AS deepest, sum((stop - start) * coverage)::BIGINT AS spanned FROM c WHERE stop IS NOT NULL GROUP BY contig"
)
def physical_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pairs(spark, sf_dir).where("id1 <> id2").select(F.col("lib").alias("contig"), F.least("id1", "id2").alias("start"), F.greatest("id1", "id2").alias("stop"))
    pieces = ivs.condensed(spans)
    return pieces.groupBy("contig").agg(F.max("coverage").alias("deepest"), F.sum((F.col("stop") - F.col("start")) * F.col("coverage")).alias("spanned"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def select_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return selection.by_ids(table(spark, sf_dir, "documents").select("doc_id", "lang"), ids, "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def erase_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.by_ids(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id", keep=False)


@query("SELECT doc_id, length(text) AS size FROM documents WHERE length(text) BETWEEN 500 AND 2000")
def select_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("size")).where("size BETWEEN 500 AND 2000")


@query("SELECT page_id, url FROM pages WHERE NOT contains(url, '1')")
def select_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.by_header(table(spark, sf_dir, "pages").select("page_id", "url"), "url", "1", complement=True)


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE '' END AS text FROM documents")
def select_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.sparse(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), F.col("lang") == "en", "text").drop("lang")


_HASH = "((({0} % 2147483647) * 48271 + 11) % 2147483647 * 69621 + 7) % 2147483647"


@query(f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {_HASH.format('o_orderkey')}, o_orderkey LIMIT 200")
def deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 200)


@query(f"WITH h AS (SELECT doc_id, n_chars, {_HASH.format('doc_id')} AS h FROM documents), s AS (SELECT *, coalesce(sum(n_chars) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM h) SELECT doc_id, n_chars FROM s WHERE b < 100000")
def sample_up_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.sample_up_to(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 100_000)


@query("SELECT o_orderkey, ntile(7) OVER (ORDER BY o_totalprice, o_orderkey) AS part FROM orders")
def divide_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.divided(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 7).select("o_orderkey", "part")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS new_id FROM customer WHERE c_mktsegment <> 'BUILDING'")
def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey", (-F.col("c_acctbal")).alias("k"))
    return selection.numbered(rows, ["k", "c_custkey"]).select("c_custkey", "new_id")


@query(_R + ", c AS (SELECT read_id, seq, unnest(range(0, greatest(ceil(length(seq) / 1000)::BIGINT, 1))) AS chunk FROM reads) SELECT read_id, chunk, md5(substr(seq, (chunk * 1000 + 1)::BIGINT, 1000)) AS digest FROM c")
def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.chunks(reads(spark, sf_dir), "read_id", "seq", 1000).select("read_id", "chunk", F.md5("piece").alias("digest"))


@query(_C + ", p AS (SELECT contig_id, unnest(regexp_split_to_array(seq, 'T{3,}')) AS piece FROM contigs) SELECT contig_id, piece FROM p WHERE piece <> ''")
def break_at_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.broken_at(contigs(spark, sf_dir), "contig_id", "seq", "T", 3).select("contig_id", "piece")


_LINES = "l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))


@query(f"WITH {_LINES} SELECT DISTINCT line FROM l WHERE lang = 'en' AND line NOT IN (SELECT line FROM l WHERE lang = 'de')")
def anti_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    return rows.where("lang = 'en'").select("line").distinct().join(rows.where("lang = 'de'").select("line").distinct(), "line", "left_anti")


@query(f"WITH {_LINES} SELECT line FROM l WHERE lang = 'en' INTERSECT SELECT line FROM l WHERE lang = 'fr'")
def intersect_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    return rows.where("lang = 'en'").select("line").intersect(rows.where("lang = 'fr'").select("line"))


@query("SELECT l_partkey, sum(CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN -1 END)::BIGINT AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_partkey HAVING sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE -1 END) > 0")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    return selection.multiset_difference(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"), ["l_partkey"])


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)")
def symmetric_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return selection.symmetric_difference(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'P'"), ["k"])


@query("SELECT p_partkey, row_number() OVER (ORDER BY split_part(p_name, ' ', 1), p_partkey) AS place FROM part")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by first word of the name, then by the number in the key in numeric order."""
    rows = table(spark, sf_dir, "part").select("p_partkey", strings.natural_key(F.concat(F.substring_index("p_name", " ", 1), F.lit("#"), F.col("p_partkey").cast("string"))).alias("k"))
    rows = rows.withColumn("w", F.substring_index("k", "#", 1))
    return selection.numbered(rows, ["w", "k"], "place").select("p_partkey", (F.col("place") + 1).alias("place"))


@query(_C + "SELECT min(contig_id) AS contig_id, count(*) AS copies FROM contigs GROUP BY least(seq, reverse(translate(seq, 'ACGT', 'TGCA')))")
def dedup_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contigs(spark, sf_dir).groupBy(seqf.canonical(F.col("seq")).alias("c")).agg(F.min("contig_id").alias("contig_id"), F.count(F.lit(1)).alias("copies"))
    return rows.drop("c")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 199 OR o_orderkey IN (7, 1000, 2000) OR o_orderkey = 5")
def parse_int_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(strings.in_int_set(F.col("o_orderkey"), "[100,200)|{7,1000,2000}|5")).select("o_orderkey")


@query("SELECT page_id, split_part(url, '://', 1) AS scheme, CASE WHEN strpos(url, '/') > 0 THEN regexp_extract(url, '([^/]*)$', 1) END AS tail, (length(url) - length(replace(url, '/', '')))::BIGINT AS slashes FROM pages")
def string_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", strings.safe_before(u, "://").alias("scheme"), strings.after_last(u, "/").alias("tail"), strings.overlapping_count(u, "/").cast("long").alias("slashes"))


@query("SELECT conv_id, role, count(*) AS n, sum(len(list_filter(regexp_split_to_array(text, '[ \\t\\n]'), lambda x: x <> '')))::BIGINT AS n_tokens FROM conversations GROUP BY 1, 2")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(strings.tokens(F.col("text")))).alias("n_tokens"))


_NUMBERED = "WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM x))"


@query(_NUMBERED + ", m AS (SELECT *, coalesce(max(CASE WHEN contains(line, 'the') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM l) SELECT doc_id, count(*) AS n_lines FROM m WHERE seen = 0 GROUP BY doc_id")
def text_head_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return selection.until(rows, "doc_id", "the").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    _NUMBERED + ", m AS (SELECT *, max(CASE WHEN contains(line, 'and') THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS a, max(CASE WHEN contains(line, 'is') THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM l) "
    "SELECT doc_id, count(*) AS n_lines FROM m WHERE a IS NOT NULL AND (b IS NULL OR b < a) GROUP BY doc_id"
)
def text_pull_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return selection.between_marks(rows, "doc_id", "and", "is").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query("WITH p AS (SELECT doc_id, list_sort(list_distinct(string_split(text, chr(10)))) AS ls FROM documents) SELECT doc_id, md5(array_to_string(ls, chr(10))) AS digest, len(ls) AS n FROM p")
def text_sort_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.array_distinct(F.split("text", "\n")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat_ws("\n", parts)).alias("digest"), F.size(parts).cast("long").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_distinct, count(*) = count(DISTINCT o_orderkey) AS is_key FROM orders")
def naif_is_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = F.count(F.lit(1)), F.count_distinct("o_orderkey")
    return table(spark, sf_dir, "orders").agg(n.alias("n"), d.alias("n_distinct"), (n == d).alias("is_key"))


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1")
def naif_value_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0")
def naif_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") > 0)).select("c_custkey", "c_name")


@query("SELECT o_orderpriority AS lib, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def library_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup(F.col("o_orderpriority").alias("lib"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN (SELECT l_partkey, l_suppkey, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY 1, 2) x ON l.l_partkey = x.l_partkey AND l.l_suppkey = x.l_suppkey WHERE l.l_orderkey * 10 + l.l_linenumber > f")
def duplicate_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"))
    return pairing.duplicates(rows, ["l_partkey", "l_suppkey"], "rank").select("l_orderkey", "l_linenumber")


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linestatus = 'O'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_size > 25) "
    "SELECT a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b, c.k IS NOT NULL AS in_c, count(*) AS n FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON coalesce(a.k, b.k) = c.k GROUP BY 1, 2, 3")
def compare_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of keys in three sets: one aggregate over tagged rows instead of outer joins."""
    lines = table(spark, sf_dir, "lineitem")
    tagged = (
        lines.where("l_linestatus = 'O'").select(F.col("l_partkey").alias("k"), F.lit(1).alias("bit"))
        .unionAll(lines.where("l_returnflag = 'R'").select("l_partkey", F.lit(2)))
        .unionAll(table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey", F.lit(4)))
    )
    masks = tagged.groupBy("k").agg(F.bit_or("bit").alias("m"))
    has = lambda b: (F.col("m").bitwiseAND(b) != 0)
    return masks.groupBy(has(1).alias("in_a"), has(2).alias("in_b"), has(4).alias("in_c")).agg(F.count(F.lit(1)).alias("n"))
