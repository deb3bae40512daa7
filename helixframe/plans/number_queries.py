"""Statistics, windows and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.operators import intervals as ivs
from helixframe.operators import stats, windows

from .registry import query
from .tables import INTERVALS_SQL, intervals, table

_LEN = "v AS (SELECT length(text) AS v FROM documents WHERE length(text) > 0)"


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.length("text").alias("v")).where("v > 0")


@query(
    f"WITH {_LEN}, r AS (SELECT v, sum(v) OVER (ORDER BY v, rn) AS c, sum(v) OVER () AS t, lead(v) OVER (ORDER BY v, rn) AS nx FROM (SELECT v, row_number() OVER (ORDER BY v) AS rn FROM v)), "
    "h AS (SELECT * FROM r WHERE 2 * c >= t ORDER BY c LIMIT 1) SELECT (CASE WHEN 2 * c = t THEN (v + coalesce(nx, v)) // 2 ELSE v END)::BIGINT AS n50 FROM h"
)
def n50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.n50(_lengths(spark, sf_dir), "v")


@query(
    f"WITH {_LEN}, r AS (SELECT v, sum(v) OVER (ORDER BY v DESC) AS c, sum(v) OVER () AS t FROM v) "
    "SELECT i * 10 AS stat, max(v) AS value FROM r, (SELECT unnest(range(1, 10)) AS i) WHERE c >= (t * i * 10) // 100 GROUP BY i"
)
def nstatistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.n_statistics(_lengths(spark, sf_dir), "v")


@query(f"WITH {_LEN} SELECT v AS median FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM v) WHERE i = n // 2")
def median_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.median_upper(_lengths(spark, sf_dir), "v").select(F.col("median").cast("long").alias("median"))


@query("SELECT lang, count(*) AS n, min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 6) AS mean, round(stddev_pop(length(text)), 6) AS sd, sum(length(text))::BIGINT AS total FROM documents GROUP BY lang")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("sd"), F.sum(n).alias("total")
    )


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean FROM lineitem GROUP BY l_returnflag")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag").agg(F.round(stats.weighted_mean(rows, "l_extendedprice", "l_quantity"), 4).alias("mean"))


@query("SELECT CASE WHEN value < 10 THEN 0 ELSE least(20, floor((value - 10) / 25) + 1) END::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1")
def hist_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "events"), "value", 10, 25, 20)


@query(f"WITH {_LEN} SELECT floor(log10(v) + 1e-12)::BIGINT AS magnitude, count(*) AS n FROM v GROUP BY 1")
def hist_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.log_histogram(_lengths(spark, sf_dir), "v")


@query("SELECT p_size, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS pmf, round(sum(count(*)) OVER (ORDER BY p_size)::DOUBLE / sum(count(*)) OVER (), 9) AS cdf FROM part GROUP BY p_size")
def int_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("p_size", "n", F.round(F.col("n") / total, 9).alias("pmf"), F.round(F.sum("n").over(Window.orderBy("p_size")) / total, 9).alias("cdf"))


@query("SELECT o_orderpriority, round(-10 * log10((1.0 + count(*) FILTER (WHERE o_orderstatus = 'P')) / (1.0 + count(*))), 9) AS q FROM orders GROUP BY o_orderpriority")
def qual_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.count_if(F.col("o_orderstatus") == "P")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(stats.quality_score(F.count(F.lit(1)) - wrong, wrong), 9).alias("q"))


@query(
    "WITH s AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY user_id HAVING count(*) > 1 AND stddev_samp(value) > 0) "
    "SELECT round(sum(m / (sd * sd)) / sum(1 / (sd * sd)), 6) AS mean, round(sqrt(1 / sum(1 / (sd * sd))), 6) AS sd FROM s"
)
def combine_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd")).where("sd > 0")
    mean, sd = stats.combined_normal("m", "sd")
    return per.agg(F.round(mean, 6).alias("mean"), F.round(sd, 6).alias("sd"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id * 1000 + floor(value)::BIGINT) AS n_distinct FROM events GROUP BY event_type")
def library_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("user_id") * 1000 + F.floor("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("n_distinct"))


@query()
def library_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules per event type from draws and distinct draws."""
    rows = library_molecules(spark, sf_dir).withColumn("x", stats.library_size_column(F.col("n"), F.col("n_distinct")))
    return rows.select("event_type", "n", "n_distinct", F.round("x", 3).alias("molecules"), stats.complexity_curve(F.col("x"), F.col("n"), F.col("n_distinct"))[9]["yield"].alias("tenfold_yield"))


@query(
    "WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT q.vec_id AS query, v.vec_id AS found, "
    "round(list_sum(list_transform(range(1, 65), lambda i: q.e[i] * v.embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(q.e, lambda x: x * x)) * list_sum(list_transform(v.embedding::DOUBLE[], lambda x: x * x))), 6) AS cos "
    "FROM q, embeddings v WHERE v.vec_id <> q.vec_id) SELECT query, found, cos FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cos DESC, found) AS r FROM p) WHERE r <= 5"
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 50 the five nearest of all vectors: the stated query set meets all rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("e").alias("q"))
    pairs = rows.join(queries, F.col("vec_id") != F.col("query"))
    scored = pairs.select("query", F.col("vec_id").alias("found"), F.round(stats.cosine(F.col("q"), F.col("e")), 6).alias("cos"))
    # One query's scores may be many: each partition keeps its five best before they meet.
    local = Window.partitionBy("query", F.pmod(F.xxhash64("found"), F.lit(64))).orderBy(F.desc("cos"), "found")
    best = scored.withColumn("r", F.row_number().over(local)).where("r <= 5").drop("r")
    return best.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cos"), "found"))).where("r <= 5").drop("r")


@query(
    "SELECT event_id, min(value) OVER w AS win_min, max(value) OVER w AS win_max, round(sum(value) OVER w, 6) AS win_sum, round(avg(value) OVER w, 6) AS win_mean "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
)
def win_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.centred(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 3)
    return rows.select("event_id", "win_min", "win_max", F.round("win_sum", 6).alias("win_sum"), F.round("win_mean", 6).alias("win_mean"))


@query(
    "WITH m AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events) "
    "SELECT user_id, event_type, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts FROM m GROUP BY user_id, event_type, g HAVING count(*) >= 3"
)
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.where("n >= 3").select("user_id", "event_type", "n", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first_ts"))


@query(
    "WITH d AS (SELECT user_id, ts::DATE AS day, round(sum(value), 6) AS v FROM events GROUP BY 1, 2), x AS (SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l, "
    "max(v) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS r FROM d) SELECT user_id, strftime(day, '%Y-%m-%d') AS day, v FROM x WHERE (l IS NULL OR v > l) AND (r IS NULL OR v > r)"
)
def peak_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 6).alias("v"))
    return windows.peaks(daily, ["user_id"], ["day"], "v", 2).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "v")


@query(
    "WITH p AS (SELECT l_partkey, l_suppkey, floor(min(l_extendedprice / l_quantity))::BIGINT AS errors FROM lineitem GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER w AS k, lead(errors) OVER w AS second FROM p WINDOW w AS (PARTITION BY l_partkey ORDER BY errors, l_suppkey)) "
    "SELECT l_partkey, l_suppkey, errors, second FROM r WHERE k = 1 AND errors <= 1500 AND (second IS NULL OR second - errors > 2)"
)
def best_vs_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.floor(F.min(F.col("l_extendedprice") / F.col("l_quantity"))).alias("errors"))
    return windows.best_against_second(offers, ["l_partkey"], "errors", ["l_suppkey"], 1500, 2)


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS running, round(percent_rank() OVER (PARTITION BY user_id ORDER BY value), 9) AS pr FROM events")
def running_and_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id")
    rows = table(spark, sf_dir, "events")
    running = F.sum("value").over(by.orderBy("ts", "event_id"))
    return rows.select("event_id", F.round(running, 6).alias("running"), F.round(F.percent_rank().over(by.orderBy("value")), 9).alias("pr"))


_SWEEP = (
    f"WITH {INTERVALS_SQL}, ev AS (SELECT contig, p, sum(d) AS d FROM (SELECT contig, start AS p, 1 AS d FROM intervals WHERE start < stop UNION ALL SELECT contig, stop, -1 FROM intervals WHERE start < stop) GROUP BY 1, 2), "
    "c AS (SELECT * FROM (SELECT contig, p AS start, lead(p) OVER (PARTITION BY contig ORDER BY p) AS stop, sum(d) OVER (PARTITION BY contig ORDER BY p)::BIGINT AS coverage FROM ev) WHERE stop IS NOT NULL)"
)
_ISLANDS = (
    ", m AS (SELECT *, CASE WHEN start = lag(stop) OVER (PARTITION BY contig ORDER BY start) THEN 0 ELSE 1 END AS fresh FROM c WHERE {}), "
    "i AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY start) AS island FROM m) SELECT contig, min(start) AS start, max(stop) AS stop FROM i GROUP BY contig, island"
)


@query(_SWEEP + " SELECT * FROM c")
def iv_condense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivs.condensed(intervals(spark, sf_dir))


@query(_SWEEP + _ISLANDS.format("coverage >= 2"))
def iv_given_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivs.with_coverage(intervals(spark, sf_dir), 2)


@query(_SWEEP + _ISLANDS.format("coverage = 0"))
def iv_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivs.uncovered(intervals(spark, sf_dir))


@query(_SWEEP + _ISLANDS.format("coverage >= 1"))
def iv_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivs.merged(intervals(spark, sf_dir))


@query(_SWEEP + " SELECT contig, sum(stop - start)::BIGINT AS covered FROM c WHERE coverage > 0 GROUP BY contig")
def iv_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivs.total_covered(intervals(spark, sf_dir))


@query(_SWEEP + " SELECT coverage, sum(stop - start)::BIGINT AS bases FROM c GROUP BY coverage")
def iv_coverage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivs.coverage_histogram(intervals(spark, sf_dir))


@query(f"WITH {INTERVALS_SQL} SELECT a.contig, a.iv AS l_iv, b.iv AS r_iv, least(a.stop, b.stop) - greatest(a.start, b.start) AS shared FROM intervals a JOIN intervals b ON a.contig = b.contig AND a.start < b.stop AND b.start < a.stop AND a.start < a.stop AND b.start < b.stop AND a.iv < b.iv")
def iv_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = intervals(spark, sf_dir)
    pairs = ivs.overlap_join(iv, iv, 16_384).where("l_iv < r_iv")
    return pairs.select("contig", "l_iv", "r_iv", ivs.overlap(F.col("l_start"), F.col("l_stop"), F.col("r_start"), F.col("r_stop")).alias("shared"))


@query(f"WITH {INTERVALS_SQL} SELECT a.contig, a.iv AS p_iv, count(*) AS n FROM intervals a JOIN intervals b ON a.contig = b.contig AND b.start <= a.stop AND a.stop < b.stop GROUP BY 1, 2")
def iv_point_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = intervals(spark, sf_dir)
    points = iv.select("contig", "iv", F.col("stop").alias("at"))
    return ivs.points_in(points, iv, 16_384).groupBy("contig", "p_iv").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {INTERVALS_SQL} SELECT a.contig, a.iv AS a, b.iv AS b FROM intervals a JOIN intervals b ON a.contig = b.contig AND a.iv < b.iv AND abs(a.start - b.start) <= 3600 AND abs(a.stop - b.stop) <= 3600")
def iv_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivs.near_duplicates(intervals(spark, sf_dir), 3600)


@query(
    f"WITH {INTERVALS_SQL}, e AS (SELECT user_id AS contig, floor(epoch(ts))::BIGINT AS at, event_id AS key FROM events WHERE event_type = 'purchase'), f AS (SELECT contig, stop AS at, iv AS value FROM intervals) "
    "SELECT e.contig, e.at, e.key, (SELECT max((f.at, f.value)) FROM f WHERE f.contig = e.contig AND f.at <= e.at)[2] AS value FROM e"
)
def iv_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the interval that ended last at or before it."""
    points = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("contig"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("key"))
    ends = intervals(spark, sf_dir).select("contig", F.col("stop").alias("at"), F.col("iv").alias("value"))
    return ivs.as_of(points, ends, "value")


@query(f"WITH {INTERVALS_SQL} SELECT floor(log10(stop - start) + 1e-12)::BIGINT AS magnitude, count(*) AS n, min(stop - start) AS least, max(stop - start) AS most FROM intervals WHERE stop > start GROUP BY 1")
def iv_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("stop") - F.col("start")
    return intervals(spark, sf_dir).where("stop > start").groupBy(F.floor(F.log10(size) + 1e-12).alias("magnitude")).agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("least"), F.max(size).alias("most"))


@query(f"WITH {INTERVALS_SQL} SELECT contig, iv, lead(start) OVER (PARTITION BY contig ORDER BY start, iv) - stop AS gap FROM intervals")
def iv_neighbour_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(spark, sf_dir).select("contig", "iv", (F.lead("start").over(Window.partitionBy("contig").orderBy("start", "iv")) - F.col("stop")).alias("gap"))
