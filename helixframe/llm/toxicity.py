"""Toxicity by maximum-scoring segments.

Learning.  Labelled documents outside the held-out fold are sampled by hash
order, at most ``SAMPLE`` of them (the documented bound; one copy of each text
counts, with the largest label and the least doc_id of its rows).  A word's features are itself and its affixes.  Of all (document,
feature) pairs of a kind each feature has a share among the toxic and a share
among the other documents; it gets the log of their ratio, positive or negative,
under a Dirichlet prior that is neutral between the classes.  This is weighted
by the probability that the feature leans to a class at all (of ``LEANING`` of
them before the counts are seen), the rest of the weight goes to the drift: the
log-odds of the words that do not lean, from the same counts.

Scoring.  A word of two or more documents scores its own log-odds.  One seen in
a single document or never scores the affix that lies furthest beyond ``Z``
standard errors, else the drift, which is at most 0.  The Ruzzo-Tompa scan finds all
maximal scoring segments in one pass over the runs of positive words.  As scores
are log-likelihood ratios, a segment of score S in n words has the expected count
``n * exp(-S)`` by chance (extreme-value law with unit scale), so ``S - ln n``
is comparable over lengths.  A logistic curve over the best and the summed
excess, fitted on a fold of its own, gives the probability.

Defined results: a null or empty text has no hits and scores the least value;
without both classes among the learning rows nothing is toxic (score 0); labels
of null ``toxic`` or ``doc_id`` are left out, repeated labels count once (the
largest value); further columns are ignored; an empty table scores nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import small_batches
from .words import filled, text_slices, words_of

SAMPLE = 20_000
Z = 3.0
PRIOR = 0.5
#: Share of the features that are taken to lean to a class before the counts are seen.
LEANING = 0.01
PREFIXES = (3, 4, 5, 6, 7)
SUFFIXES = (4, 5, 6)
#: A passage is significant if chance makes less than so many as good in the text.
EXPECTED = 0.05
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4

_PUNCTUATION = ".,;:!?\"'()[]{}*#$%&|<>-_"


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _normal(distinct: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(distinct), _PUNCTUATION)


def _features(distinct: pa.Array) -> Iterator[pa.Array]:
    """The word without its punctuation, then its affixes, null where the word is not longer than the affix."""
    word = _normal(distinct)
    size = pc.utf8_length(word)
    yield pc.binary_join_element_wise("=", word, "")
    for k in PREFIXES:
        yield pc.if_else(pc.greater(size, k), pc.binary_join_element_wise("^", pc.utf8_slice_codeunits(word, 0, k), ""), None)
    for k in SUFFIXES:
        yield pc.if_else(pc.greater(size, k), pc.binary_join_element_wise("$", pc.utf8_slice_codeunits(word, -k), ""), None)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class in which a feature occurs, per slice."""
    for batch in text_slices(batches):
        w = words_of(batch.column("text"))
        if not len(w.codes):
            continue
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        used = np.unique(w.doc * len(w.distinct) + w.codes)
        doc, code = used // len(w.distinct), used % len(w.distinct)
        for kind, feature in enumerate(_features(w.distinct)):
            coded = feature.dictionary_encode()
            index = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
            some = index >= 0
            pairs = np.unique(doc[some] * max(1, len(coded.dictionary)) + index[some])
            d, f = pairs // max(1, len(coded.dictionary)), pairs % max(1, len(coded.dictionary))
            n = np.bincount(f, minlength=len(coded.dictionary))
            n1 = np.bincount(f, toxic[d], len(coded.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), coded.dictionary, pa.array(n), pa.array(n1)], names=["kind", "feature", "n", "n1"])


@dataclass
class Model:
    #: For each kind of feature the known ones, their log-odds and their standard scores.
    known: list[tuple[pa.Array, np.ndarray, np.ndarray]] = field(default_factory=list)
    #: Score of a word without a known feature.
    drift: float = 0.0
    #: Bias, weight of the best excess, weight of the log of the summed excess.
    curve: tuple[float, float, float] | None = None

    def _found(self, kind: int, feature: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds, standard score and whether it is known, of each feature."""
        names, odds, z = self.known[kind]
        at = pc.fill_null(pc.index_in(feature.cast(pa.string()), value_set=names, skip_nulls=True), len(names)).to_numpy(zero_copy_only=False)
        return np.append(odds, 0.0)[at], np.append(z, 0.0)[at], at < len(names)

    def hits(self, distinct: pa.Array) -> np.ndarray:
        """The log-odds of each distinct word."""
        if not self.known:
            return np.full(len(distinct), self.drift)
        value, _, own = self._found(0, next(_features(distinct)))
        other = np.flatnonzero(~own)
        best, most = np.full(len(other), self.drift), np.zeros(len(other))
        for kind, feature in enumerate(_features(distinct.take(pa.array(other)))):
            if kind:
                odds, z, _ = self._found(kind, feature)
                better = np.abs(z) > most
                best[better], most[better] = odds[better], np.abs(z[better])
        value[other] = best
        return value


def segments(positions: np.ndarray, scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of hits among words that score the drift."""
    gaps = drift * (np.diff(positions, prepend=-1) - 1)
    return _maximal(positions, positions, scores, gaps)


def _maximal(first: np.ndarray, last: np.ndarray, scores: np.ndarray, gaps: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of runs and the sums before each, by the linear-time scan of Ruzzo and Tompa."""
    done: list[tuple[int, int, float]] = []
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, nearest earlier one with a lesser sum before
    total = 0.0
    for a, b, s, gap in zip(first.tolist(), last.tolist(), scores.tolist(), gaps.tolist(), strict=True):
        left = total + gap
        total = left + s
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            # Joined with j and all between; what lies before j is searched anew.
            a, left = found[j][0], found[j][2]
            del found[j:]
            j -= 1
        if j < 0 and found:
            done += [(x, y, r - l) for x, y, l, r, _ in found]
            found.clear()
        found.append((a, b, left, total, j))
    return done + [(x, y, r - l) for x, y, l, r, _ in found]


def passages(model: Model, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """For each text its number of words and its maximal scoring segments, which begin and end with runs of positive words."""
    w = words_of(texts)
    value = model.hits(w.distinct)[w.codes] if len(w.codes) else np.zeros(0)
    positive = value > 0
    begins = np.zeros(len(value), bool)
    begins[w.bounds[:-1][w.counts > 0]] = True
    first = np.flatnonzero(positive & (begins | ~np.concatenate([[False], positive[:-1]]))) if len(value) else np.zeros(0, np.int64)
    ends = np.concatenate([begins[1:], [True]]) if len(value) else begins
    last = np.flatnonzero(positive & (ends | ~np.concatenate([positive[1:], [False]]))) if len(value) else first
    sums = np.concatenate([[0.0], np.cumsum(value)])
    bounds = np.searchsorted(first, w.bounds)
    for d in range(len(w.bounds) - 1):
        a, b = first[bounds[d] : bounds[d + 1]], last[bounds[d] : bounds[d + 1]]
        gaps = sums[a] - sums[np.concatenate([[w.bounds[d]], b[:-1] + 1])] if len(a) else np.zeros(0)
        yield int(w.bounds[d + 1] - w.bounds[d]), _maximal(a - w.bounds[d], b - w.bounds[d], sums[b + 1] - sums[a], gaps)


def evidence(n: int, found: list[tuple[int, int, float]]) -> tuple[float, float, int]:
    """Best excess over chance, log of the summed excess, number of significant passages."""
    if not found:
        return -math.log(n + 1), 0.0, 0
    excess = [s - math.log(n + 1) for _, _, s in found]
    return max(excess), math.log1p(sum(max(0.0, x) for x in excess)), sum(math.exp(-x) < EXPECTED for x in excess)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.05) -> np.ndarray:
    """Newton's method with a ridge on the weights."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _odds(n: Column, n1: Column, t: Column, t1: Column) -> tuple[Column, Column]:
    """Log-odds and standard score of a feature in n pairs, n1 of them toxic, out of t and t1: the prior adds 2 * PRIOR pairs, dealt out as all pairs are."""
    share = t1 / t
    y1, y0 = n1 + 2 * PRIOR * share, n - n1 + 2 * PRIOR * (1 - share)
    odds = F.log(y1 / share) - F.log(y0 / (1 - share))
    return odds, odds / F.sqrt(1 / y1 + 1 / y0)


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold(F.col("doc_id")) != HELD_OUT)
    # At most SAMPLE rows of two numbers: the bound that allows the broadcast.
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")).select("text", "toxic", fold(F.col("doc_id")).alias("fold"))
    spark = docs.sparkSession
    rows = rows.persist()
    counts = None
    try:
        sizes = {(r["c"], r["toxic"]): r["n"] for r in rows.groupBy((F.col("fold") == CALIBRATION).alias("c"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        n1, n0 = sizes.get((False, 1), 0), sizes.get((False, 0), 0)
        if not n1 or not n0:
            return Model()
        counts = rows.where(F.col("fold") != CALIBRATION).select("text", "toxic").mapInArrow(_counted, "kind int, feature string, n long, n1 long")
        counts = counts.groupBy("kind", "feature").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).persist()
        # One row for each kind of feature.
        sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("t"), F.sum("n1").alias("t1")).collect()}
        if not sums or not 0 < sums[0]["t1"] < sums[0]["t"]:
            return Model()
        odds, z = _odds(F.col("n"), F.col("n1"), F.col("t"), F.col("t1"))
        # Words of a single document are unknown ones; affixes are for them alone.
        table = (
            counts.where("n > 1")
            .join(F.broadcast(spark.createDataFrame([(k, r["t"], r["t1"]) for k, r in sums.items()], "kind int, t long, t1 long")), "kind")
            .select("kind", "feature", "n", "n1", odds.alias("odds"), z.alias("z"))
            .where((F.col("kind") == 0) | (F.abs("z") >= Z))
            .toArrow()
            .combine_chunks()
        )
        kind, n, n1, odds, z = (table[c].to_numpy() for c in ("kind", "n", "n1", "odds", "z"))
        leans = 1 / (1 + (1 - LEANING) / LEANING * np.exp(-np.minimum(z * z / 2, 50.0)))
        model, word, t, t1 = Model(), kind == 0, sums[0]["t"], sums[0]["t1"]
        rest1, rest = t1 - (leans * n1)[word].sum(), t - (leans * n)[word].sum()
        model.drift = min(0.0, math.log((rest1 + PRIOR) / (t1 + PRIOR)) - math.log((rest - rest1 + PRIOR) / (t - t1 + PRIOR)))
        value = leans * odds + (1 - leans) * model.drift
        for k in range(1 + len(PREFIXES) + len(SUFFIXES)):
            own = np.flatnonzero(kind == k)
            model.known.append((table["feature"].take(pa.array(own)).combine_chunks().cast(pa.string()), value[own], z[own]))

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches):
                out = []
                for (n, found), y in zip(passages(model, filled(batch.column("text"))), batch.column("toxic").to_pylist(), strict=True):
                    out.append((y, *evidence(n, found)[:2]))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], (pa.int32(), pa.float64(), pa.float64())[i]) for i in range(3)], names=["toxic", "best", "total"])

        # At most SAMPLE rows of three numbers.
        seen = np.array([tuple(r) for r in rows.where(F.col("fold") == CALIBRATION).select("text", "toxic").mapInArrow(measured, "toxic int, best double, total double").collect()], float).reshape(-1, 3)
        if 0 < seen[:, 0].sum() < len(seen):
            model.curve = tuple(_logistic(seen[:, 1:], seen[:, 0]))
        else:
            model.curve = (-1.0, 0.5, 1.0)
        return model
    finally:
        rows.unpersist()
        if counts is not None:
            counts.unpersist()


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages and the significant passages (word spans) of every document."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, score double, n_passages int, passages string"

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            score, count, spans = [], [], []
            for n, found in passages(model, filled(batch.column("text"))):
                best, total, some = evidence(n, found)
                a, b, c = model.curve or (-math.inf, 0.0, 0.0)
                score.append(1 / (1 + math.exp(-max(-700.0, min(30.0, a + b * best + c * total)))) if model.curve else 0.0)
                count.append(some)
                spans.append(",".join(f"{x}:{y + 1}" for x, y, s in found if (n + 1) * math.exp(-s) < EXPECTED))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(score, pa.float64()), pa.array(count, pa.int32()), pa.array(spans, pa.string())],
                names=["doc_id", "score", "n_passages", "passages"],
            )

    out = docs.select("doc_id", "text").mapInArrow(measured, schema)
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "passages")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, learned(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, in one pass over the texts."""
    model = learned(docs, labels)
    schema = docs.schema

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            keep = []
            for n, found in passages(model, filled(batch.column("text"))):
                best, total, _ = evidence(n, found)
                keep.append(not (model.curve and model.curve[0] + model.curve[1] * best + model.curve[2] * total >= 0))
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(kept, schema)
