r"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of canonical tokens: numbers (digits or number words)
become ``<num>``, a unit right after a number ``<unit>``, a run of capitalised
words that do not open a sentence one ``<name>``; other words are lower-cased and
stripped of punctuation, words of punctuation alone vanish.  As a capital at the
start of a sentence may or may not be a name, and a title or a text in capitals
has no other words, there are two further forms: one in which capitalised words
that open a sentence are names too, and one without names.  Windows of
``WINDOW`` tokens of documents and benchmark items meet in a hash join.  An item
leaks into a document that holds, in any one form, at least ``PERCENT`` % of its
distinct windows and whose slots are consistent: the values that stand for one value of the item
must agree in at least ``PERCENT`` % of the places, so a re-parameterised
question is caught and an accidental template match is not.

Documents are scanned once and what they hold of the benchmark's windows is
stored.  A bitmap of fixed size (``FILTER_BITS``) over the benchmark's window
hashes drops windows that cannot join before anything is shuffled; it only saves
work, the joins decide.  A window that is common in the benchmark would join all
its documents with all its items, so pairs of a document and an item first meet in
the item's rarest windows: who holds ``PERCENT`` % of an item's windows holds one
of those that are left without the ``PERCENT`` % most common.  Only such pairs are
joined on all their windows.

Defined results: null and empty texts have no windows; an item of fewer than
``WINDOW`` tokens is matched only by a document of exactly those tokens; rows
with the same doc_id (item_id) are one document (item), and null ids match
nothing; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import small_batches, stored
from .words import Words, hashed, inside, mixed, text_slices, windows, words_of

WINDOW = 5
PERCENT = 75
FILTER_BITS = 23

# Number words and unit words.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split()
UNIT_WORDS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces oz pound pounds lb lbs ml l liter liters litre litres gallon gallons cup cups "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "% percent degree degrees celsius fahrenheit kelvin hz khz mhz watt watts volt volts joule joules newton newtons mph kmh "
    "cent cents dollar dollars usd euro euros eur gbp yen $ €"
).split()

NUM, UNIT, NAME = 1, 2, 3
#: Which capitalised words are names: those inside sentences, all, none.  The first form that leaks is reported.
INNER, ALL, PLAIN = FORMS = range(3)
_MARKS = hashed(pa.array(["", "<num>", "<unit>", "<name>"]))
_NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(st|nd|rd|th|%|[a-z]{1,3})?")
_EDGES = " \t.,;:!?\"'()[]{}<>|*#&-_/\\“”‘’«»…$%€"


def _forms(distinct: pa.Array) -> tuple[list[str], np.ndarray]:
    """Normal form of each distinct word, and flags: number, unit word, capitalised, ends a sentence."""
    numbers, units = set(NUMBER_WORDS), set(UNIT_WORDS)
    forms, flags = [], np.zeros((4, len(distinct)), bool)
    for i, word in enumerate(distinct.to_pylist()):
        core = word.strip(_EDGES)
        low = core.lower()
        forms.append(low or (word if word in units else ""))
        if low and (low in numbers or low[0].isdigit() and _NUMBER.fullmatch(low)):
            flags[0, i] = True
        if low in units or word in units:
            flags[1, i] = True
        if core[:1].isupper():
            flags[2, i] = True
        if word[-1] in ".!?:" or word[-1] in "\"')”" and word[-2:-1] in (".", "!", "?"):
            flags[3, i] = True
    return forms, flags


class Tokens:
    """Canonical tokens of the texts of a slice in one form."""

    def __init__(self, w: Words, distinct: tuple[list[str], np.ndarray, np.ndarray], form: int):
        forms, (number, unit, upper, stop), hashes = distinct
        c, doc = w.codes, w.doc
        first = np.zeros(len(c), bool)
        first[w.bounds[:-1][w.counts > 0]] = True
        after = np.concatenate([[False], c[:-1] >= 0]) if len(c) else np.zeros(0, bool)
        before = np.concatenate([[0], c[:-1]]) if len(c) else c
        opens = first | stop[before] if len(c) else first
        is_number = number[c]
        is_unit = unit[c] & ~is_number & after & ~first & number[before] if len(c) else is_number
        name = upper[c] & ~is_number & ~is_unit
        if form == INNER:
            name &= ~opens
        elif form == PLAIN:
            name[:] = False
        again = name & np.concatenate([[False], name[:-1]]) & ~first if len(c) else name
        blank = np.array([f == "" for f in forms], bool)[c] if len(c) else name
        kind = np.where(is_number, NUM, np.where(is_unit, UNIT, np.where(name, NAME, 0)))
        keep = ~again & ~(blank & (kind == 0))
        h = hashes[c]
        h = np.where(kind > 0, _MARKS[kind], h)
        self.form, self.forms, self.codes, self.kind, self.hash = form, forms, c[keep], kind[keep], h[keep]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(w.bounds) - 1))]).astype(np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, start (token of the slice), number of tokens and hash of each window."""
        n = np.diff(self.bounds)
        starts = inside(self.bounds, WINDOW)
        h = [windows(self.hash, WINDOW)[starts]] if len(starts) else [np.zeros(0, np.uint64)]
        at, size = [starts], [np.full(len(starts), WINDOW)]
        for k in range(1, WINDOW):
            whole = self.bounds[:-1][n == k]
            if len(whole):
                at.append(whole)
                size.append(np.full(len(whole), k))
                h.append(mixed(windows(self.hash, k)[whole] + np.uint64(k)))
        at, size, h = np.concatenate(at), np.concatenate(size), np.concatenate(h)
        if self.form:
            h = mixed(h + np.uint64(self.form << 32))
        return np.searchsorted(self.bounds, at, side="right") - 1, at, size, h

    def slots(self, start: int, size: int) -> str:
        """``offset=value`` of the placeholders in a window, joined by a unit separator."""
        return "\x1f".join(f"{j}={self.forms[self.codes[start + j]]}" for j in range(size) if self.kind[start + j])


def tokens(texts: pa.Array) -> Iterator[Tokens]:
    """The canonical tokens in each form."""
    w = words_of(texts)
    forms, flags = _forms(w.distinct)
    hashes = hashed(pa.array(forms, pa.string()))
    for form in FORMS:
        yield Tokens(w, (forms, flags, hashes), form)


_SCHEMA = "form int, h long, id long, pos long, size int, slots string"


def _scanner(id_column: str, bitmap: bytes | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap, np.uint8)
        for batch in text_slices(batches):
            for t in tokens(batch.column("text")):
                doc, at, size, h = t.windows()
                if bits is not None:
                    slot = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    hit = (bits[slot >> 3] >> (slot & 7) & 1).astype(bool)
                    doc, at, size, h = doc[hit], at[hit], size[hit], h[hit]
                slots = [t.slots(a, s) for a, s in zip(at.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), t.form, np.int32)), pa.array(h.view(np.int64)), batch.column(id_column).cast(pa.int64()).take(pa.array(doc)), pa.array(at - t.bounds[doc]), pa.array(size.astype(np.int32)), pa.array(slots, pa.string())],
                    names=["form", "h", "id", "pos", "size", "slots"],
                )

    return scan


def _bitmap(item_windows: DataFrame) -> bytes:
    """A bitmap of 2**FILTER_BITS bits: at most eight partial ones of that size reach the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[(batch.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    for row in item_windows.select("h").coalesce(8).mapInArrow(mark, "bits binary").collect():
        total |= np.frombuffer(row["bits"], np.uint8)
    return total.tobytes()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, n_slots, n_consistent, n_changed for every leaked item."""
    spark = docs.sparkSession
    small_batches(spark)
    items = stored(benchmark.where("item_id IS NOT NULL").select("item_id", "text").mapInArrow(_scanner("item_id", None), _SCHEMA), "template-items")
    found = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_scanner("doc_id", _bitmap(items)), _SCHEMA)
    found = stored(found.select("h", "form", F.col("id").alias("doc_id"), F.col("pos").alias("d_pos"), "size", F.col("slots").alias("d_slots")), "template-windows")
    windows = items.select("form", "h", F.col("id").alias("item_id")).distinct()
    common = windows.groupBy("form", "h").agg(F.count(F.lit(1)).alias("f"))
    own = Window.partitionBy("item_id", "form")
    ranked = windows.join(common, ["form", "h"]).select("*", F.row_number().over(own.orderBy("f", "h")).alias("place"), F.count(F.lit(1)).over(own).alias("n_windows"))
    ranked = stored(ranked, "template-ranked")
    totals = ranked.where("place = 1").select("item_id", "form", "n_windows")
    rare = ranked.where(f"place <= n_windows - ceil({PERCENT} * n_windows / 100) + 1").select("form", "h", "item_id")
    pairs = found.select("form", "h", "doc_id").distinct().join(rare, ["form", "h"]).select("form", "doc_id", "item_id").distinct()
    i = items.select("h", "form", F.col("id").alias("item_id"), F.col("pos").alias("i_pos"), "size", F.col("slots").alias("i_slots"))
    hits = found.join(pairs, ["form", "doc_id"]).join(i, ["form", "item_id", "h", "size"]).select("doc_id", "item_id", "form", "h", "i_pos", "d_pos", "i_slots", "d_slots")
    hits = stored(hits, "template-hits")

    matched = hits.groupBy("doc_id", "item_id", "form").agg(F.count_distinct("h").alias("n_matched")).join(totals, ["item_id", "form"]).where(100 * F.col("n_matched") >= PERCENT * F.col("n_windows"))
    # Each slot of the item with the value that the document has in its place.
    pair = F.explode(F.arrays_zip(F.split("i_slots", "\x1f").alias("i"), F.split("d_slots", "\x1f").alias("d")))
    slots = (
        hits.where("i_slots <> ''")
        .join(matched.select("doc_id", "item_id", "form"), ["doc_id", "item_id", "form"], "left_semi")
        .select("doc_id", "item_id", "form", "i_pos", "d_pos", pair.alias("p"))
        .select("doc_id", "item_id", "form", (F.col("i_pos") + F.substring_index("p.i", "=", 1).cast("long")).alias("place"), (F.col("d_pos") + F.substring_index("p.d", "=", 1).cast("long")).alias("d_place"), F.regexp_replace("p.i", r"^\d+=", "").alias("theirs"), F.regexp_replace("p.d", r"^\d+=", "").alias("ours"))
        .distinct()
    )
    # Each alignment (difference of places) is judged by itself; the one with the most slots counts.
    slots = slots.withColumn("shift", F.col("d_place") - F.col("place"))
    by_value = slots.groupBy("doc_id", "item_id", "form", "shift", "theirs", "ours").agg(F.count(F.lit(1)).alias("n"))
    by_shift = (
        by_value.groupBy("doc_id", "item_id", "form", "shift", "theirs")
        .agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum(F.when(F.col("theirs") != F.col("ours"), F.col("n")).otherwise(0)).alias("changed"))
        .groupBy("doc_id", "item_id", "form", "shift")
        .agg(F.sum("n").alias("n"), F.sum("most").alias("most"), F.sum("changed").alias("changed"))
    )
    best = F.max(F.struct("n", "most", "changed"))
    agreed = by_shift.groupBy("doc_id", "item_id", "form").agg(best.alias("b")).select("doc_id", "item_id", "form", F.col("b.n").alias("n_slots"), F.col("b.most").alias("n_consistent"), F.col("b.changed").alias("n_changed"))
    out = matched.join(agreed, ["doc_id", "item_id", "form"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.where("n_slots IS NULL OR 100 * n_consistent >= %d * n_slots" % PERCENT)
    first = F.min(F.struct("form", "n_windows", "n_matched", "n_slots", "n_consistent", "n_changed"))
    out = out.groupBy("doc_id", "item_id").agg(first.alias("f")).select("doc_id", "item_id", "f.*")
    return out.select("doc_id", "item_id", "n_windows", "n_matched", zero("n_slots"), zero("n_consistent"), zero("n_changed"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no benchmark item leaked."""
    gone = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
