"""Text formats of sequence data as DataFrames: readers and writers on Spark's text and CSV sources.

Record formats are split by Spark itself (``lineSep``), so files stay splittable
and nothing is parsed on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the formats below.
SAM_COLUMNS = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string"
VCF_COLUMNS = "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string, format string"
ALIGNMENT_HEAD = "query_id q_start q_end q_len rc target_id t_start t_end t_len n_blocks".split()
AGP_COLUMNS = "object string, obj_from long, obj_to long, part int, kind string, a string, b string, c string, d string"


def _fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: only a ``>`` at the start of a line begins one."""
    rows = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("value"))
    return rows.where("trim(value) <> ''")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name (first word of the header), header, seq (line ends removed)."""
    rows = _fasta_records(spark, path)
    head = F.substring_index("value", "\n", 1)
    body = F.when(F.instr("value", "\n") > 0, F.substr(F.col("value"), F.instr("value", "\n") + 1)).otherwise("")
    return rows.select(F.regexp_extract(F.trim(head), r"^(\S*)", 1).alias("name"), F.rtrim(head).alias("header"), F.regexp_replace(body, r"\s", "").alias("seq"))


def fasta_text(name: Column, seq: Column, width: int = 80) -> Column:
    """A FASTA record as one string."""
    return F.concat(F.lit(">"), name, F.lit("\n"), F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n")))


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", width: int = 80) -> None:
    df.select(fasta_text(F.col(name).cast("string"), F.col(seq), width).alias("value")).write.text(path)


def illegal_bases(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows without a sequence or with characters that are no bases or ambiguity codes."""
    return df.where(F.col(seq).isNull() | ~F.col(seq).rlike("^[ACGTRYSWKMBDHVNacgtryswkmbdhvn]*$"))


def read_fastq(spark: SparkSession, path: str, offset: int = 33) -> DataFrame:
    """name, seq, quals (array of int).

    Four lines make a record.  Lines of a file are read whole (one value per
    file), which keeps their order without a global sort; use one file per lane.
    """
    rows = spark.read.text(path, wholetext=True)
    lines = F.split(F.rtrim("value"), "\r?\n")
    n = F.floor(F.size(lines) / 4).cast("int")
    rows = rows.select(lines.alias("l"), n.alias("n")).where("n > 0").select("l", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    line = lambda k: F.get("l", F.col("i") * 4 + k)
    rows = rows.select(F.regexp_extract(line(0), r"^@(\S*)", 1).alias("name"), line(1).alias("seq"), line(3).alias("q"))
    return rows.select("name", "seq", F.transform(F.split("q", ""), lambda c: F.ascii(c) - offset).alias("quals"))


def fastq_text(name: Column, seq: Column, quals: Column, offset: int = 33) -> Column:
    letters = F.concat_ws("", F.transform(quals, lambda q: F.char(q + offset)))
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), letters)


def write_fastq(df: DataFrame, path: str, offset: int = 33) -> None:
    df.select(fastq_text(F.col("name"), F.col("seq"), F.col("quals"), offset).alias("value")).write.text(path)


def read_quala(spark: SparkSession, path: str) -> DataFrame:
    """name, quals of a FASTA-like file of numbers."""
    rows = _fasta_records(spark, path)
    body = F.trim(F.regexp_replace(F.substr(F.col("value"), F.instr("value", "\n") + 1), r"\s+", " "))
    return rows.select(F.regexp_extract("value", r"^(\S*)", 1).alias("name"), F.transform(F.filter(F.split(body, " "), lambda x: x != ""), lambda x: x.cast("int")).alias("quals"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The eleven fixed columns and ``tags`` (name -> type:value)."""
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f")).where("size(f) >= 11")
    cols = [F.col("f")[i].cast(c.split()[1]).alias(c.split()[0]) for i, c in enumerate(SAM_COLUMNS.split(", "))]
    tag = F.expr("slice(f, 12, greatest(size(f) - 11, 0))")
    pairs = F.transform(tag, lambda t: F.struct(F.substr(t, F.lit(1), F.lit(2)).alias("key"), F.substr(t, F.lit(4)).alias("value")))
    return rows.select(*cols, F.map_from_entries(pairs).alias("tags"))


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """kind, fields (name -> value) of the header lines."""
    rows = spark.read.text(path).where(F.col("value").startswith("@"))
    fields = F.filter(F.split("value", "\t"), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:"))
    return rows.select(F.substring("value", 2, 2).alias("kind"), F.map_from_entries(F.transform(fields, lambda x: F.struct(F.substr(x, F.lit(1), F.lit(2)), F.substr(x, F.lit(4))))).alias("fields"))


def flag(column: Column, bit: int) -> Column:
    return column.bitwiseAND(bit) != 0


def cigar_blocks(cigar: Column) -> Column:
    """Array of (op, len, read_start, ref_start), both starts from 0 relative to the alignment."""
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    parts = F.transform(ops, lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.expr("0").alias("z"), F.substr(x, F.lit(1), F.length(x) - 1).cast("int").alias("len")))
    start = F.struct(F.lit(0).alias("read"), F.lit(0).alias("ref"), F.array().cast("array<struct<op:string,len:int,read_start:int,ref_start:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        on_read, on_ref = p["op"].isin("M", "I", "S", "=", "X"), p["op"].isin("M", "D", "N", "=", "X")
        block = F.struct(p["op"].alias("op"), p["len"].alias("len"), acc["read"].alias("read_start"), acc["ref"].alias("ref_start"))
        return F.struct(
            (acc["read"] + F.when(on_read, p["len"]).otherwise(0)).alias("read"), (acc["ref"] + F.when(on_ref, p["len"]).otherwise(0)).alias("ref"), F.concat(acc["out"], F.array(block)).alias("out")
        )

    return F.aggregate(parts, start, step)["out"]


def sam_coverage(records: DataFrame) -> DataFrame:
    """contig, start, stop of the aligned blocks of mapped records (pos 0 is unmapped; starts from 0)."""
    rows = records.where("pos > 0").select(F.col("rname").alias("contig"), F.col("pos"), F.explode(cigar_blocks(F.col("cigar"))).alias("b")).where("b.op IN ('M', '=', 'X')")
    return rows.select("contig", (F.col("pos") - 1 + F.col("b.ref_start")).alias("start"), (F.col("pos") - 1 + F.col("b.ref_start") + F.col("b.len")).alias("stop"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """The eight fixed columns, info as a map, alts as an array, samples as an array of maps."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).where("size(f) >= 8")
    cols = [F.get("f", F.lit(i)).cast(c.split()[1]).alias(c.split()[0]) for i, c in enumerate(VCF_COLUMNS.split(", "))]
    rows = rows.select(*cols, F.expr("slice(f, 10, greatest(size(f) - 9, 0))").alias("raw"))
    keys = F.split("format", ":")
    samples = F.transform("raw", lambda s: F.map_from_arrays(F.slice(keys, F.lit(1), F.size(F.split(s, ":"))), F.split(s, ":")))
    return rows.select("chrom", "pos", "id", "ref", F.split("alt", ",").alias("alts"), F.expr("try_cast(qual AS double)").alias("qual"), "filter", F.expr("str_to_map(info, ';', '=')").alias("info"), samples.alias("samples"))


def write_vcf(df: DataFrame, path: str) -> None:
    """Header lines, then the calls by place: the part files in turn are one valid file."""
    info = F.array_join(F.transform(F.map_entries("info"), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.coalesce("id", F.lit(".")), "ref", F.array_join("alts", ","), F.coalesce(F.col("qual").cast("string"), F.lit(".")), F.coalesce("filter", F.lit(".")), F.when(F.length(info) > 0, info).otherwise("."))
    names = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"])
    head = df.sparkSession.createDataFrame([(0, "", 0, "##fileformat=VCFv4.2"), (0, "", 1, names)], "part int, chrom string, pos long, value string")
    rows = head.union(df.select(F.lit(1), "chrom", F.col("pos").cast("long"), line))
    order = ["part", "chrom", "pos", "value"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)


def concordance(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, n of calls by place and alleles: one aggregate over tagged rows."""
    key = ["chrom", "pos", "ref", "alt"]
    rows = a.select(*key, F.lit(1).alias("s")).unionByName(b.select(*key, F.lit(2).alias("s")))
    sides = rows.groupBy(*key).agg(F.bit_or("s").alias("s"))
    return sides.groupBy(F.when(F.col("s") == 3, "both").when(F.col("s") == 1, "left").otherwise("right").alias("side")).agg(F.count(F.lit(1)).alias("n"))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated alignment lines that begin with QUERY: ids, places, strand, and blocks (gap, length, errors)."""
    rows = spark.read.text(path).where(F.col("value").startswith("QUERY")).select(F.split("value", "\t").alias("f"))
    cols = [F.col("f")[i + 1].cast("long").alias(c) for i, c in enumerate(ALIGNMENT_HEAD)]
    n = F.col("f")[10].cast("int")
    block = lambda i: F.struct(*(F.get("f", 11 + 3 * i + k).cast("int").alias(c) for k, c in enumerate(("gap", "length", "errors"))))
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), block))
    return rows.select(*cols, blocks.alias("blocks"))


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, stop (half-open, from 0) of lines ``contig:first-last`` (closed, from 1)."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^(.+):(\d+)-(\d+)", 0).alias("v"), "value").where("v <> ''")
    part = lambda i: F.regexp_extract("value", r"^(.+):(\d+)-(\d+)", i)
    return rows.select(part(1).alias("contig"), (part(2).cast("long") - 1).alias("start"), part(3).cast("long").alias("stop"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)")).select(F.split("value", "\t").alias("f")).where("size(f) >= 3")
    return rows.select(F.col("f")[0].alias("contig"), F.col("f")[1].cast("long").alias("start"), F.col("f")[2].cast("long").alias("stop"), F.get("f", F.lit(3)).alias("name"))


def bed_to_intervals(df: DataFrame) -> DataFrame:
    return df.select(F.concat("contig", F.lit(":"), (F.col("start") + 1).cast("string"), F.lit("-"), F.col("stop").cast("string")).alias("value"))


def read_agp(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema=AGP_COLUMNS)


def parsed_efasta(seq: Column) -> Column:
    """A sequence with inline choices ``AC{A,C,}GT`` as an array of arrays of alternatives."""
    parts = F.regexp_extract_all(seq, F.lit(r"(\{[^}]*\}|[^{}]+)"), F.lit(1))
    return F.transform(parts, lambda p: F.when(p.startswith("{"), F.split(F.substr(p, F.lit(2), F.length(p) - 2), ",")).otherwise(F.array(p)))


def flattened_efasta(seq: Column) -> Column:
    """The first alternative of every choice."""
    return F.concat_ws("", F.transform(parsed_efasta(seq), lambda p: p[0]))


def dot_lines(edges: DataFrame, name: str = "g") -> DataFrame:
    """The body of a graph description, one edge per line."""
    return edges.select(F.concat(F.lit('  "'), F.col("src").cast("string"), F.lit('" -> "'), F.col("dst").cast("string"), F.lit('";')).alias("value"))


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """place, value of an ASCII vector file: a count, then the values."""
    rows = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("v"))
    return rows.select(F.posexplode(F.expr("slice(v, 2, cast(v[0] AS int))")).alias("place", "value")).select("place", F.col("value").cast("double").alias("value"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A string table with a header line."""
    return spark.read.csv(path, header=True)


def write_table(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def merged(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Rows of several sets with their origin, ids re-based so that they stay unique: (source, read_id) -> new id by hash-free offset."""
    out = None
    for i, (name, df) in enumerate(sources):
        rows = df.withColumns({"source": F.lit(name), "read_id": F.col("read_id") * len(sources) + i})
        out = rows if out is None else out.unionByName(rows)
    return out
