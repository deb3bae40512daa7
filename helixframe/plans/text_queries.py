"""Strings, arrays, maps, text filters and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import arrays, strings

from .registry import query
from .tables import table


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")


@query("SELECT page_id, starts_with(url, 'https') AS starts, ends_with(url, '/') AS ends, contains(url, '/fr/') AS has FROM pages")
def string_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _pages(spark, sf_dir).select("page_id", url.startswith("https").alias("starts"), url.endswith("/").alias("ends"), url.contains("/fr/").alias("has"))


_CELLS = "cells AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 4 WHEN 0 THEN l_orderkey::VARCHAR WHEN 1 THEN l_returnflag || l_orderkey WHEN 2 THEN '-' || l_suppkey || '.25' ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'True' ELSE 'FALSE' END END AS s FROM lineitem)"


@query(
    f"WITH {_CELLS} SELECT count(*) AS n, count(*) FILTER (regexp_full_match(s, '[+-]?[0-9]+')) AS n_int, count(*) FILTER (regexp_full_match(s, '[+-]?[0-9]+([.][0-9]*)?')) AS n_float, count(*) FILTER (lower(s) IN ('true', 'false')) AS n_bool, "
    "sum(CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN s::BIGINT END)::BIGINT AS ints, round(sum(CASE WHEN regexp_full_match(s, '[+-]?[0-9]+([.][0-9]*)?') THEN s::DOUBLE END), 2) AS floats, count(*) FILTER (lower(s) = 'true') AS trues FROM cells"
)
def string_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, order, sup = F.col("l_linenumber") % 4, F.col("l_orderkey").cast("string"), F.col("l_suppkey")
    s = F.when(n == 0, order).when(n == 1, F.concat("l_returnflag", order)).when(n == 2, F.concat(F.lit("-"), sup.cast("string"), F.lit(".25"))).otherwise(F.when(sup % 2 == 0, "True").otherwise("FALSE"))
    cell = table(spark, sf_dir, "lineitem").select(s.alias("s"))
    c = F.col("s")
    return cell.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(strings.is_int(c)).alias("n_int"), F.count_if(strings.is_float(c)).alias("n_float"), F.count_if(strings.is_bool(c)).alias("n_bool"),
        F.sum(strings.parsed_int(c)).alias("ints"), F.round(F.sum(strings.parsed_float(c)), 2).alias("floats"), F.count_if(strings.parsed_bool(c)).alias("trues"),
    )


@query(
    "SELECT page_id, instr(url, '/') AS first_at, CASE WHEN instr(substr(url, 10), '/') > 0 THEN instr(substr(url, 10), '/') + 9 ELSE 0 END AS from_ten, "
    "CASE WHEN contains(url, '/') THEN length(url) - instr(reverse(url), '/') + 1 ELSE 0 END AS last_at, CASE WHEN regexp_matches(url, '[?&]') THEN length(regexp_extract(url, '^[^?&]*')) + 1 ELSE 0 END AS mark_at FROM pages"
)
def string_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    found = {"first_at": strings.position(url, "/"), "from_ten": strings.position(url, "/", 10), "last_at": strings.position_last(url, "/"), "mark_at": strings.first_of(url, "?&")}
    return _pages(spark, sf_dir).select("page_id", *(c.cast("long").alias(n) for n, c in found.items()))


@query(
    "SELECT p_partkey, substr(p_name, 3, 4) AS cut, left(p_name, 2) || '<>' || substr(p_name, 3) AS inserted, left(p_name, 1) || substr(p_name, 5) AS erased, left(p_name, 2) || '##' || substr(p_name, 6) AS replaced, p_name || '-' || p_type AS appended FROM part"
)
def string_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.substring(s, 3, 4).alias("cut"), strings.inserted(s, 2, "<>").alias("inserted"), strings.erased(s, 1, 3).alias("erased"), strings.replaced_at(s, 2, 3, "##").alias("replaced"), F.concat(s, F.lit("-"), "p_type").alias("appended")
    )


@query("SELECT p_name < lower(p_type) AS below, p_name = lower(p_type) AS same, upper(p_name) AS big, lower(p_type) AS small, count(*) AS n FROM part GROUP BY ALL")
def string_order_and_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = F.lower("p_type")
    rows = table(spark, sf_dir, "part").select((F.col("p_name") < small).alias("below"), (F.col("p_name") == small).alias("same"), F.upper("p_name").alias("big"), small.alias("small"))
    return rows.groupBy("below", "same", "big", "small").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT page_id, CASE WHEN contains(url, 'e') THEN substr(url, 1, instr(url, 'e') - 1) || 'EE' || substr(url, instr(url, 'e') + 1) ELSE url END AS once, replace(url, 'e', 'EE') AS everywhere, regexp_replace(url, '[.][^./]*$', '') || '.txt' AS renamed FROM pages"
)
def string_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _pages(spark, sf_dir).select("page_id", strings.replaced_first(url, "e", "EE").alias("once"), strings.replaced_all(url, "e", "EE").alias("everywhere"), strings.with_extension(url, ".txt").alias("renamed"))


@query("SELECT c_custkey, trim(c_name, 'C#u0') AS both_ends, ltrim(c_name, 'Cus') AS front, rtrim(c_name, '0123456789') AS back FROM customer")
def string_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", strings.trimmed(s, "C#u0").alias("both_ends"), strings.trimmed(s, "Cus", "left").alias("front"), strings.trimmed(s, "0123456789", "right").alias("back"))


@query("SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/(.*)$', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)/(.*)$', 2) AS host, len(regexp_extract_all(url, '[0-9]+'))::BIGINT AS n_numbers FROM pages")
def regex_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = "^(https?)://([^/]+)/(.*)$"
    return _pages(spark, sf_dir).select("page_id", F.regexp_extract("url", pattern, 1).alias("scheme"), F.regexp_extract("url", pattern, 2).alias("host"), F.size(F.regexp_extract_all("url", F.lit("[0-9]+"), F.lit(0))).cast("long").alias("n_numbers"))


@query("SELECT o_orderkey, format('{:,}', floor(o_totalprice * 100)::BIGINT) AS commas FROM orders")
def number_commas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.with_commas(F.floor(F.col("o_totalprice") * 100)).alias("commas"))


_LINES = "lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS n, sum(length(replace(line, 'the ', '')))::BIGINT AS size FROM lines WHERE trim(line) <> '' GROUP BY doc_id")
def text_substitute_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank lines go, a word is substituted in the others."""
    rows = _lines(spark, sf_dir).where(F.trim("line") != "")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(strings.replaced_all(F.col("line"), "the ", ""))).alias("size"))


@query("SELECT doc_id, string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ')[2] AS second, string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ')[4] AS fourth FROM documents WHERE regexp_full_match(text, '[ -~\\n\\t]*')")
def text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of lines by number, of texts in plain characters."""
    parts = F.split(F.regexp_replace(F.trim("text"), r"[ \t\n]+", " "), " ")
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(r"^[ -~\n\t]*$")).select("doc_id", F.get(parts, F.lit(1)).alias("second"), F.get(parts, F.lit(3)).alias("fourth"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> ''))), chr(10)) AS sorted FROM documents")
def text_sort_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different paragraphs (here lines) of a text in order."""
    parts = F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(parts, "\n").alias("sorted"))


@query(f"WITH {_LINES} SELECT doc_id, length(line) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, line) AS place FROM lines")
def text_lines_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("line").cast("long")
    return _lines(spark, sf_dir).select("doc_id", size.alias("size"), F.row_number().over(Window.partitionBy("doc_id").orderBy(size.desc(), "line")).cast("long").alias("place"))


@query("SELECT p_partkey, rpad(p_name, (SELECT max(length(p_name))::INT FROM part), ' ') || '|' || lpad(p_size::VARCHAR, 4, ' ') AS line FROM part")
def text_same_size_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns padded to one width: the width is one scalar, which is broadcast."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    width = rows.agg(F.max(F.length("p_name")).alias("width"))
    return rows.join(F.broadcast(width)).select("p_partkey", F.concat(F.rpad("p_name", F.col("width"), F.lit(" ")), F.lit("|"), F.lpad(F.col("p_size").cast("string"), 4, " ")).alias("line"))


@query("SELECT p_partkey, ((p_size + 3) * power(2, power(2, 2)) - p_size::BIGINT // 3 + 7 // 2 * p_size)::BIGINT AS value FROM part")
def calculator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", strings.calculated("(x + 3) * 2 ^ 2 ^ 2 - x / 3 + 7 / 2 * x", x=F.col("p_size")).alias("value"))


_ORDER_ARRAYS = "o AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS a, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey) AS c FROM lineitem GROUP BY l_orderkey)"


def _order_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(rows.alias("r"))
    return lists.select("k", F.col("r.l_partkey").alias("a"), F.col("r.l_suppkey").alias("b"), F.col("r.l_linenumber").alias("c"))


def _text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


@query(
    f"WITH {_ORDER_ARRAYS} SELECT k, array_to_string(list_reverse(a), ',') AS reversed, list_contains(a, 7) AS has, coalesce(list_position(b, 5), 0)::BIGINT - 1 AS at, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset, list_has_any(a, b) AS meet FROM o"
)
def array_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _order_arrays(spark, sf_dir).select("k", _text(F.reverse(a)).alias("reversed"), F.array_contains(a, 7).alias("has"), arrays.position(b, F.lit(5).cast("long")).alias("at"), arrays.is_subset(a, b).alias("subset"), arrays.meets(a, b).alias("meet"))


@query(
    f"WITH {_ORDER_ARRAYS}, z AS (SELECT k, list_sort(list_transform(range(1, len(a) + 1), lambda i: {{'s': b[i], 'p': a[i]}})) AS z FROM o) "
    "SELECT k, array_to_string(list_transform(z, lambda x: x.s), ',') AS keys, array_to_string(list_transform(z, lambda x: x.p), ',') AS other, array_to_string(list_transform(list_reverse(z), lambda x: x.p), ',') AS down, "
    "array_to_string(list_transform(list_filter(list_zip(z, range(0, len(z))), lambda y: y[2] = 0 OR y[1].s <> z[y[2]].s), lambda y: y[1].p), ',') AS firsts FROM z"
)
def array_sort_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays sorted by the first of them: up, down, and the first of each key."""
    a, b = F.col("a"), F.col("b")
    keys, other = arrays.sorted_together(b, a)
    down = arrays.sorted_together(b, a, descending=True)[1]
    firsts = arrays.sorted_together(b, a, unique=True)[1]
    return _order_arrays(spark, sf_dir).select("k", _text(keys).alias("keys"), _text(other).alias("other"), _text(down).alias("down"), _text(firsts).alias("firsts"))


@query(f"WITH {_ORDER_ARRAYS} SELECT k, len(list_filter(range(1, len(b)), lambda i: b[i] > b[i + 1])) = 0 AS ordered, len(list_filter(range(1, len(c)), lambda i: c[i] >= c[i + 1])) = 0 AS strictly FROM o")
def array_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_arrays(spark, sf_dir).select("k", arrays.is_ordered(F.col("b")).alias("ordered"), arrays.is_ordered(F.col("c"), strictly=True).alias("strictly"))


@query(
    f"WITH {_ORDER_ARRAYS}, m AS (SELECT k, c, list_transform(c, lambda x: x + 1) AS d FROM o), n AS (SELECT *, list_max(list_filter(range(0, least(len(c), len(d)) + 1), lambda i: c[len(c) - i + 1:len(c)] = d[1:i])) AS n FROM m) "
    "SELECT k, n, array_to_string(list_concat(c, d[n + 1:len(d)]), ',') AS joined FROM n"
)
def array_overlap_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_arrays(spark, sf_dir).withColumn("d", F.transform("c", lambda x: x + 1))
    c, d = F.col("c"), F.col("d")
    return rows.select("k", arrays.overlap_size(c, d).cast("long").alias("n"), _text(arrays.overlap_append(c, d)).alias("joined"))


@query(
    "WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT user_id, map_from_entries(list({'k': event_type, 'v': n} ORDER BY event_type)) AS m FROM e GROUP BY user_id) "
    "SELECT user_id, array_to_string(map_keys(m), ',') AS keys, array_to_string(map_values(m), ',') AS counts, list_contains(map_keys(m), 'click') AS has, coalesce(list_extract(map_values(m), list_position(map_keys(m), 'error')), 0)::BIGINT AS errors FROM m"
)
def map_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return maps.select("user_id", F.array_join(F.map_keys("m"), ",").alias("keys"), _text(F.map_values("m")).alias("counts"), F.map_contains_key("m", "click").alias("has"), F.coalesce(F.try_element_at("m", F.lit("error")), F.lit(0)).alias("errors"))


@query("SELECT n, k, m FROM (SELECT unnest(range(0, 8)) AS n), (SELECT unnest(range(0, 8)) AS k), (SELECT unnest(range(0, 128)) AS m) WHERE k <= n AND m < (1 << n) AND bit_count(m) = k")
def combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All subsets of up to seven things by size, as masks."""
    rows = [spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(k).cast("long").alias("k"), F.explode(F.transform(arrays.combinations(n, k), lambda m: m.cast("long"))).alias("m")) for n in range(8) for k in range(n + 1)]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


@query("SELECT p_partkey, bit_count(p_partkey)::BIGINT AS ones, p_partkey << 3 AS up, p_partkey >> 2 AS down, xor(p_partkey, 85) AS flipped, CASE WHEN p_size <= 1 THEN 1 ELSE power(2, ceil(log2(p_size)))::BIGINT END AS power_up, round(1 + 2 * p_size + 0.5 * p_size * p_size, 3) AS poly FROM part")
def bits_and_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.bit_count(x).cast("long").alias("ones"), F.shiftleft(x, 3).alias("up"), F.shiftright(x, 2).alias("down"), x.bitwiseXOR(F.lit(85)).alias("flipped"), arrays.power_of_two_at_least(F.col("p_size")).alias("power_up"), F.round(arrays.polynomial(F.col("p_size"), 1, 2, 0.5), 3).alias("poly")
    )


@query("SELECT user_id, count(*) FILTER (v < p) = 0 AS ordered, count(*) AS n FROM (SELECT user_id, value AS v, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY user_id")
def ordered_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("v"), before.alias("p"))
    return rows.groupBy("user_id").agg((F.count_if(F.col("v") < F.col("p")) == 0).alias("ordered"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, round(sum(value * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 ELSE 86400 END), 2) AS seconds FROM events GROUP BY event_type")
def sum_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with units of time, added up in seconds."""
    unit = F.element_at(F.array(F.lit("s"), F.lit("min"), F.lit("h"), F.lit("d")), (F.col("event_id") % 4 + 1).cast("int"))
    factor = F.when(unit == "s", 1).when(unit == "min", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum(F.col("value") * factor), 2).alias("seconds"))
