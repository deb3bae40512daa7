"""Tables and derived views that the queries read.

Texts have no bases in them, so reads are derived: the letters a-z of a text are
mapped onto A, C, G, T in turn.  The same rule is spelled out for SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "".join("ACGT"[i % 4] for i in range(26))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out over all cores where the table has fewer files than that (one row group is one task).

    A table of many files stays as it is, so at scale no shuffle is added.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def bases_of(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, BASES)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, seq"""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("read_id"), bases_of(F.col("text")).alias("seq"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig_id, seq"""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("contig_id"), bases_of(F.col("text")).alias("seq"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iv, contig, start, stop: half-open; an event covers as many seconds as its value."""
    start = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("iv"), F.col("user_id").alias("contig"), start.alias("start"), (start + F.floor(60 * F.col("value"))).alias("stop"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, id1, id2, lib, sep: the first and last line of each order; days between order and last shipping."""
    lines = table(spark, sf_dir, "lineitem")
    ends = lines.groupBy(F.col("l_orderkey").alias("pair_id")).agg(
        F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("id1"), F.max(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("id2"), F.max("l_shipdate").alias("last")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair_id"), F.col("o_orderpriority").alias("lib"), "o_orderdate")
    return ends.join(orders, "pair_id").select("pair_id", "id1", "id2", "lib", F.date_diff(F.to_date("last"), F.to_date("o_orderdate")).cast("long").alias("sep"))


_SEQ = f"translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}')"
READS_SQL = f"reads AS (SELECT doc_id AS read_id, {_SEQ} AS seq FROM documents)"
DISTINCT_SQL = "distinct_reads AS (SELECT min(read_id) AS read_id, seq FROM reads GROUP BY seq)"
CONTIGS_SQL = f"contigs AS (SELECT item_id AS contig_id, {_SEQ} AS seq FROM benchmark)"
INTERVALS_SQL = (
    "intervals AS (SELECT event_id AS iv, user_id AS contig, floor(epoch(ts))::BIGINT AS start, "
    "floor(epoch(ts))::BIGINT + floor(60 * value)::BIGINT AS stop FROM events)"
)
PAIRS_SQL = (
    "pairs AS (SELECT l_orderkey AS pair_id, arg_min(l_partkey, l_linenumber * 100000000 + l_partkey) AS id1, arg_max(l_partkey, l_linenumber * 100000000 + l_partkey) AS id2, o_orderpriority AS lib, "
    "date_diff('day', o_orderdate::DATE, max(l_shipdate)::DATE)::BIGINT AS sep FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "GROUP BY l_orderkey, o_orderpriority, o_orderdate)"
)


def kmers_sql(source: str, key: str, k: int, name: str = "kmers") -> str:
    """Canonical k-mers (least of both strands) of a relation with a ``seq`` column."""
    return (
        f"{name}_f AS (SELECT {key}, pos, substr(seq, pos, {k}) AS fwd FROM (SELECT {key}, seq, unnest(range(1, length(seq) - {k} + 2)) AS pos FROM {source})), "
        f"{name} AS (SELECT {key}, pos, fwd, least(fwd, reverse(translate(fwd, 'ACGT', 'TGCA'))) AS kmer FROM {name}_f)"
    )
