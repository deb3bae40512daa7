"""K-mer tables: one row per word, counted and joined by Catalyst.

All counting goes through ``groupBy``, so partial aggregation collapses repeats
before the shuffle; the canonical word halves the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import canonical, canonical_by_middle, kmer_code


def _bytes() -> Column:
    """The sequence as bytes: there a substring is one copy, in a string it is a scan from the start."""
    return F.col("seq").cast("binary")


def _at(pos: Column, n: int) -> Column:
    return F.substr(F.col("seq"), pos, F.lit(n)).cast("string")


def kmerized(seqs: DataFrame, k: int, key: str = "read_id", rule: str = "least") -> DataFrame:
    """key, pos (from 1), fwd, kmer (canonical by ``rule``: "least" or "middle")."""
    n = F.length("seq") - (k - 1)
    rows = seqs.where(n > 0).select(key, _bytes().alias("seq"), F.explode(F.sequence(F.lit(1), n)).alias("pos"))
    rows = rows.select(key, "pos", _at(F.col("pos"), k).alias("fwd"))
    return rows.withColumn("kmer", canonical(F.col("fwd")) if rule == "least" else canonical_by_middle(F.col("fwd"), k))


def counted(kmers: DataFrame, least: int = 1) -> DataFrame:
    """kmer, kf: occurrences, of words that occur at least ``least`` times."""
    rows = kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("kf"))
    return rows.where(F.col("kf") >= least) if least > 1 else rows


def spectrum(counts: DataFrame) -> DataFrame:
    """kf, ndk: distinct words of each frequency."""
    return counts.groupBy("kf").agg(F.count(F.lit(1)).alias("ndk"))


def with_context(seqs: DataFrame, k: int, key: str = "read_id") -> DataFrame:
    """Canonical words with the base before and after them on the canonical strand (null at an end)."""
    n = F.length("seq") - (k - 1)
    rows = seqs.where(n > 0).select(key, _bytes().alias("seq"), F.explode(F.sequence(F.lit(1), n)).alias("pos"))
    at = lambda i: F.nullif(_at(i, 1), F.lit(""))
    rows = rows.select(
        key,
        "pos",
        _at(F.col("pos"), k).alias("fwd"),
        F.when(F.col("pos") > 1, at(F.col("pos") - 1)).alias("before"),
        at(F.col("pos") + k).alias("after"),
    )
    rows = rows.withColumn("kmer", canonical(F.col("fwd")))
    turned = F.col("kmer") != F.col("fwd")
    flip = lambda c: F.translate(c, "ACGT", "TGCA")
    return rows.select(
        key,
        "pos",
        "kmer",
        F.when(turned, flip(F.col("after"))).otherwise(F.col("before")).alias("prev"),
        F.when(turned, flip(F.col("before"))).otherwise(F.col("after")).alias("next"),
    )


def context_bits(contexts: DataFrame) -> DataFrame:
    """kmer, kf, bits: bit b for predecessor b, bit 4 + b for successor b (A = 0 to T = 3)."""
    one = lambda c, base: F.when(F.col(c).isNotNull(), F.expr(f"shiftleft(1, instr('ACGT', {c}) - 1 + {base})")).otherwise(0)
    return contexts.groupBy("kmer").agg(F.count(F.lit(1)).alias("kf"), F.bit_or(one("prev", 0).bitwiseOR(one("next", 4))).alias("bits"))


def affix_counts(contexts: DataFrame) -> DataFrame:
    """kmer, kf, n_prev, n_next: distinct bases seen before and after."""
    bits = context_bits(contexts)
    low, high = F.col("bits").bitwiseAND(15), F.shiftright("bits", 4)
    return bits.select("kmer", "kf", F.bit_count(low).alias("n_prev"), F.bit_count(high).alias("n_next"))


def bi_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """kmer, kf_a, kf_b: occurrences in either of two sets."""
    rows = a.select("kmer", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select("kmer", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return rows.groupBy("kmer").agg(F.sum("a").alias("kf_a"), F.sum("b").alias("kf_b"))


def per_read(kmers: DataFrame, key: str = "read_id") -> DataFrame:
    """key, n, min_kf, max_kf, sum_kf over the words of each read.

    A read's repeats of a word are collapsed before the join, and counts come
    from an aggregate, so a frequent word is one row per read that has it.
    """
    own = kmers.groupBy(key, "kmer").agg(F.count(F.lit(1)).alias("m"))
    counts = own.groupBy("kmer").agg(F.sum("m").alias("kf"))
    rows = own.join(counts, "kmer")
    return rows.groupBy(key).agg(F.sum("m").alias("n"), F.min("kf").alias("min_kf"), F.max("kf").alias("max_kf"), F.sum(F.col("m") * F.col("kf")).alias("sum_kf"))


def classes(seqs: DataFrame, key: str = "read_id") -> DataFrame:
    """key, class_id: the least key among equal sequences (a null sequence is alone).

    Only classes of two and more are joined back, dealt out over ``SALTS`` places, so a
    sequence that a third of the rows share is not one task; ids and digests move, not texts.
    """
    rows = seqs.select(key, F.md5(F.col("seq").cast("binary")).alias("digest"))
    least = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = rows.withColumn("salt", _salt(key)).join(_salted(least.drop("n")), ["digest", "salt"], "left")
    return found.select(key, F.coalesce("class_id", key).alias("class_id"))


def representatives(seqs: DataFrame, key: str = "read_id") -> DataFrame:
    """The rows of ``seqs`` with the least key among equal sequences."""
    first = seqs.where("seq IS NOT NULL").groupBy(F.md5(F.col("seq").cast("binary")).alias("digest")).agg(F.min(key).alias(key))
    return seqs.join(first.select(key), key, "left_semi")


SALTS = 8


def _salt(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def with_counts(words: DataFrame, word: str, key: str) -> DataFrame:
    """word, key, pos, n, first: every occurrence, how often its word occurs, and the first (key, pos) of a word that recurs.

    Words that occur once need no partner; the others are dealt out over ``SALTS``
    places, so the occurrences of a frequent word are not one task.
    """
    often = words.groupBy(word).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(key, "pos")).alias("first")).where("n > 1")
    rows = words.select(word, key, "pos").withColumn("salt", _salt(key, "pos"))
    found = rows.join(_salted(often), [word, "salt"], "left")
    return found.select(word, key, "pos", F.coalesce("n", F.lit(1)).alias("n"), "first")


def word_links(words: DataFrame, word: str, most: int, key: str) -> DataFrame:
    """a, p, b, q: pairs of occurrences of one word in two reads, a < b.

    Words in at most ``most`` places give all their pairs.  A word in more places
    gives a star: its first occurrence with every other one.  So no word is left
    out, reads that share any word stay connected, and rows grow with the
    occurrences (``most`` a row at the utmost), not with the square of a word's.
    """
    rows = with_counts(words, word, key).where("n > 1")
    star = rows.where(F.col("n") > most).select(F.col(f"first.{key}").alias("a"), F.col("first.pos").alias("p"), F.col(key).alias("b"), F.col("pos").alias("q"))
    rare = rows.where(F.col("n") <= most)
    left, right = rare.select(word, F.col(key).alias("a"), F.col("pos").alias("p")), rare.select(word, F.col(key).alias("b"), F.col("pos").alias("q"))
    return left.join(right, word).select("a", "p", "b", "q").unionAll(star).where("a < b")


def shared_pairs(kmers: DataFrame, most: int, key: str = "read_id", word: str = "kmer") -> DataFrame:
    """a, b, n: all pairs of reads (a < b) with common words, and how many; the pairs of a word in more than ``most``
    reads are made in ``SALTS`` places."""
    rows = with_counts(kmers.select(key, word).distinct().withColumn("pos", F.lit(0)), word, key).where("n > 1")
    side = lambda rows, name: rows.select(word, F.col(key).alias(name))
    rare, often = rows.where(F.col("n") <= most), rows.where(F.col("n") > most)
    few = side(rare, "a").join(side(rare, "b"), word)
    many = side(often, "a").withColumn("salt", _salt("a")).join(_salted(side(often, "b")), [word, "salt"])
    return few.select("a", "b").unionAll(many.select("a", "b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def numbered(kmers: DataFrame) -> DataFrame:
    """kmer, kmer_id: two-bit codes, a numbering that needs no global sort (k <= 31)."""
    return kmers.select("kmer").distinct().withColumn("kmer_id", kmer_code(F.col("kmer")))


def spectrum_features(spec: DataFrame) -> DataFrame:
    """kf_min1, kf_max2: the first local minimum of kf * ndk and the maximum after it (the table has one row per frequency)."""
    w = Window.orderBy("kf")
    nk = F.col("kf") * F.col("ndk")
    rows = spec.select("kf", nk.alias("nk"), F.lag(nk).over(w).alias("before"), F.lead(nk).over(w).alias("after"))
    low = rows.where("before >= nk AND after > nk").agg(F.min("kf").alias("kf_min1"))
    return rows.join(low, F.col("kf") > F.col("kf_min1")).groupBy("kf_min1").agg(F.max_by("kf", F.struct("nk", -F.col("kf"))).alias("kf_max2"), F.sum("nk").alias("nk_above"))

