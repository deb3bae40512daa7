r"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one bit per failed rule; a policy is a versioned set of rules, applied by a
bitwise AND, and ablations are sums over the distinct masks only.

Measurements: ``n_words``; ``word_chars`` (code points in words); ``n_symbols``
(characters of ``#*$%&|<>``); ``n_lines`` (``\n``-split lines with a word);
``n_dup_lines`` (those equal to an earlier line); ``n_repeat_words`` (words in
five-word windows that occur twice or more in the text).

Defined results: a null or empty text has no words, so all counts are 0 and it
fails the rule ``few_words``; repeated rows are measured each; further columns
are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import small_batches
from .words import covered, filled, inside, text_slices, windows, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rule name -> SQL condition for a failure, over the measurements.  The place in this list is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_phrases": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_phrases"))
STANDARD = Policy("standard-1", tuple(RULES))

_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        texts = filled(batch.column("text"))
        n = len(texts)
        w = words_of(texts)
        doc = w.doc
        total = lambda per_word: np.bincount(doc, per_word, n).astype(np.int64)
        chars = pc.utf8_length(w.distinct).to_numpy(zero_copy_only=False)[w.codes]
        marks = pc.count_substring_regex(w.distinct, f"[{SYMBOLS}]").to_numpy(zero_copy_only=False)[w.codes]

        lines = pc.split_pattern(texts, "\n")
        of_line = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
        coded = lines.flatten().dictionary_encode()
        spoken = pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "").to_numpy(zero_copy_only=False)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        of_line, codes = of_line[spoken[codes]], codes[spoken[codes]]
        n_lines = np.bincount(of_line, minlength=n)
        unequal = np.unique(of_line * len(coded.dictionary) + codes) // max(1, len(coded.dictionary))
        n_dup = n_lines - np.bincount(unequal, minlength=n)

        repeated = np.zeros(len(doc))
        if len(starts := inside(w.bounds, WINDOW)):
            h = windows(w.hashes(), WINDOW)[starts] * np.uint64(2) ^ (doc[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            repeated = covered(len(doc), starts[twice], WINDOW)
        columns = [w.counts, total(chars), total(marks), n_lines, n_dup, total(repeated)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), *(pa.array(c.astype(np.int64)) for c in columns)],
            names=[c.split()[0] for c in _SCHEMA.split(", ")],
        )


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failed`` (a bit per failed rule) of every document."""
    small_batches(docs.sparkSession)
    measured = docs.select("doc_id", "text").mapInArrow(_measured, _SCHEMA)
    bits = [F.when(F.expr(rule), 1 << i).otherwise(0) for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed.cast("long"))


def passes(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(book: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """rule, n_failed (documents that fail it), n_alone (documents that only this rule of the policy rejects)."""
    masks = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in policy.rules)))
    each = masks.select("failed", "n", rules.alias("r")).select("failed", "n", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_alone"),
    )


def verdicts(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    book = ledger(docs)
    return book.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~passes(BASE)).alias("base_failed"),
        (passes(BASE) & passes(policy)).alias("kept"),
        "n_lines",
        "failed",
    )


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT r, i, w[i:i+4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
q AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM p) WHERE c > 1),
x AS (SELECT r, count(DISTINCT i + j) AS n FROM q, (SELECT unnest(range(0, 5)) AS j) GROUP BY r),
m AS (SELECT t.r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda s: length(s))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(x.n, 0)::BIGINT AS n_repeat_words
      FROM t LEFT JOIN x ON x.r = t.r),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END) + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept,
  n_lines, failed::BIGINT AS failed FROM b
"""
