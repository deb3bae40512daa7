r"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words of one document.  Every word covered by
a window whose word sequence also starts earlier (smaller doc_id, or the same
document at an earlier start) is removed; windows are judged on the input.

1. Anchors.  Of the ``WINDOW - ANCHOR + 1`` shingles of ``ANCHOR`` words in a
   window the one with the least hash is its anchor, so equal windows have equal
   anchors, and only about one shingle in six is an anchor.  Anchors that occur
   once cannot belong to a repeated window; a count over all documents finds the
   others.
2. Pieces.  The windows that share an anchor occurrence form a piece.  Windows
   that also start earlier within the same slice of documents are settled on the
   spot, word by word; a piece goes on only if it holds the slice's first
   occurrence of a window.  So a passage of which there are thousands of copies
   sends one piece per slice, not one per copy.
3. Automata.  Pieces go to the shard that holds their anchor, about ``SHARD`` of
   them to each.  The shard confirms by hash counts which windows may recur,
   compiles one occurrence of each into an automaton (pyahocorasick, one letter
   a word), and streams every piece through it.  What the automaton reports are
   the occurrences, compared word by word; all but the first go back to their
   documents.
4. Hot anchors.  An anchor with more than ``HOT`` pieces (a phrase shorter than a
   window in very many surroundings) is not gathered in one place: its windows
   are counted by their 128-bit hashes with partial aggregates, which confirm the
   windows that recur and their first places, and each batch of occurrences
   streams through an automaton of the confirmed windows that it meets.
5. Documents drop the covered words.

Words are compared by 32 bits of their hash, 20 in a row and with equal 64-bit
anchors.

Defined results: a null or empty text has no words; a null doc_id counts as the
least long; repeated rows start at the same place, so neither removes the other;
rows of one doc_id with different texts are separate texts of equal rank; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import dropped, released, small_batches, stored
from .words import Words, covered, filled, inside, mixed, text_slices, windows, words_of

WINDOW, ANCHOR = 20, 10
SPREAD = WINDOW - ANCHOR + 1
#: Pieces of one automaton; a shard ends where the anchor changes, and no anchor in it has more than ``HOT`` pieces.
SHARD, HOT = 1_000, 1_000
_FIRST = -(1 << 63)


def _anchored(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of a slice: document, first window, number of windows, anchor (a word of the slice), anchor hash."""
    starts = inside(w.bounds, WINDOW)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    g = windows(w.hashes(), ANCHOR)
    best, at = g[starts].copy(), starts.copy()
    for j in range(1, SPREAD):
        less = g[starts + j] < best
        best[less] = g[starts[less] + j]
        at[less] = starts[less] + j
    doc = w.doc[starts]
    opens = np.ones(len(starts), bool)
    opens[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(opens)
    count = np.diff(np.append(first, len(starts)))
    return doc[first], starts[first], count, at[first], best[first]


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        h, n = np.unique(_anchored(words_of(batch.column("text")))[4], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["anchor", "n"])


def _anchor_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place: first window, 8 bits anchor offset, 8 bits number of windows."""
    for batch in text_slices(batches):
        w = words_of(batch.column("text"))
        doc, first, count, at, h = _anchored(w)
        place = (first - w.bounds[doc]) << 16 | (at - first) << 8 | count
        rows = pa.array(doc)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("doc_id").take(rows), batch.column("tag").take(rows), pa.array(place)], names=["anchor", "doc_id", "tag", "place"])


_DOCUMENT = "doc_id long, tag long, no_id boolean, text string, n_words long, kept_sha256 string, settled binary, pieces array<struct<anchor:long,pos:int,mask:int,words:binary>>"
_PIECE = pa.struct([("anchor", pa.int64()), ("pos", pa.int32()), ("mask", pa.int32()), ("words", pa.binary())])


def _joined(w: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    bounds = np.concatenate([[0], np.cumsum(keep)])[w.bounds].astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), w.distinct.take(pa.array(w.codes[keep]))), " ")


def _digests(texts: pa.Array) -> list[str]:
    return [hashlib.sha256(t).hexdigest() for t in texts.cast(pa.binary()).to_pylist()]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their settled windows and open pieces; documents without candidates are finished here."""
    for batch in text_slices(batches, limit=8 << 20):
        texts = filled(batch.column("text"))
        n = len(texts)
        w = words_of(texts)
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        places = batch.column("places")
        doc = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False))
        place = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        pos, shift, count = place >> 16, place >> 8 & 255, place & 255
        start = pos + w.bounds[doc]

        h = w.hashes() if len(w.codes) else np.zeros(0, np.uint64)
        piece = np.repeat(np.arange(len(doc)), count)
        step = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        at = start[piece] + step
        whole = windows(h, WINDOW)[at] if len(at) else np.zeros(0, np.uint64)
        here_id, here_pos = ids[doc[piece]], pos[piece] + step
        order = np.lexsort((here_pos, here_id, whole))
        lead = np.ones(len(order), bool)
        lead[1:] = whole[order][1:] != whole[order][:-1]
        leader = order[np.flatnonzero(lead)][np.cumsum(lead) - 1] if len(order) else order
        same = np.ones(len(order), bool)
        for j in range(WINDOW):
            same &= w.codes[at[order] + j] == w.codes[at[leader] + j]
        first = np.zeros(len(order), bool)
        first[order] = ~same | (here_id[order] == here_id[leader]) & (here_pos[order] == here_pos[leader])

        mask = np.zeros(len(doc), np.int64)
        np.bitwise_or.at(mask, piece[first], 1 << step[first])
        open_ = np.flatnonzero(mask)
        letters = (h >> np.uint64(32)).astype("<u4").tobytes()
        g = windows(h, ANCHOR)
        spans = [letters[4 * a : 4 * (a + c + WINDOW - 1)] for a, c in zip(start[open_].tolist(), count[open_].tolist(), strict=True)]
        rows = pa.StructArray.from_arrays(
            [pa.array(g[start[open_] + shift[open_]].view(np.int64)), pa.array(pos[open_].astype(np.int32)), pa.array(mask[open_].astype(np.int32)), pa.array(spans, pa.binary())], fields=list(_PIECE)
        )
        bounds = np.searchsorted(doc[open_], np.arange(n + 1)).astype(np.int32)
        settled_at = here_pos[~first].astype("<i4")
        settled_bounds = np.searchsorted(doc[piece][~first], np.arange(n + 1))
        settled = [settled_at[a:b].tobytes() for a, b in zip(settled_bounds[:-1].tolist(), settled_bounds[1:].tolist(), strict=True)]
        candidate = np.bincount(doc, minlength=n) > 0
        plain = pa.array(~candidate)
        kept = _joined(w, np.ones(len(w.codes), bool))
        digests = iter(_digests(kept.filter(plain)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids),
                batch.column("tag"),
                batch.column("no_id"),
                pc.if_else(plain, pa.nulls(n, pa.string()), texts),
                pa.array(w.counts),
                pa.array([None if c else next(digests) for c in candidate.tolist()], pa.string()),
                pa.array(settled, pa.binary()),
                pa.ListArray.from_arrays(pa.array(bounds), rows),
            ],
            names=["doc_id", "tag", "no_id", "text", "n_words", "kept_sha256", "settled", "pieces"],
        )


def _lettered(words: np.ndarray) -> str:
    """One letter for each number; what stands for surrogates in Unicode is left out."""
    return np.where(words < 0xD800, words, words + 0x800).astype("<u4").tobytes().decode("utf-32-le")


def occurrences(text: str, phrases: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(start, number of the phrase) of every occurrence of the different phrases of WINDOW letters, by an automaton."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for number, phrase in enumerate(phrases):
        automaton.add_word(phrase, number)
    automaton.make_automaton()
    hits = np.fromiter((x for hit in automaton.iter(text) for x in hit), np.int64).reshape(-1, 2)
    return hits[:, 0] - WINDOW + 1, hits[:, 1]


def _streamed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, str]:
    """The words of pieces as numbers from 1 and as one text, a 0 after each piece, and the piece of each place."""
    sizes = np.array([len(x) // 4 + 1 for x in words], np.int64)
    _, codes = np.unique(np.frombuffer(b"".join(words), "<u4"), return_inverse=True)
    ends = np.cumsum(sizes) - 1
    stream = np.zeros(int(sizes.sum()), np.int64)
    inner = np.ones(len(stream), bool)
    inner[ends] = False
    stream[inner] = codes + 1
    return stream, np.repeat(np.arange(len(words)), sizes), _lettered(stream)


def located(doc_id: np.ndarray, pos: np.ndarray, mask: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of the windows in these pieces that also start earlier."""
    stream, piece, text = _streamed(words)
    begin = np.searchsorted(piece, np.arange(len(words)))

    def asked(at: np.ndarray) -> np.ndarray:
        offset = at - begin[piece[at]]
        return (offset < SPREAD) & (mask[piece[at]] >> np.minimum(offset, SPREAD) & 1 > 0)

    # Confirm: which windows may start at two places.
    at = np.arange(len(stream) - WINDOW)
    at = at[asked(at)]
    _, lead, times = np.unique(windows(mixed(stream.astype(np.uint64)), WINDOW)[at], return_index=True, return_counts=True)
    phrases = list(dict.fromkeys(text[i : i + WINDOW] for i in at[lead[times > 1]].tolist()))
    if not phrases:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Locate: every occurrence of them in the stream.
    at, number = occurrences(text, phrases)
    kept = asked(at)
    at, number = at[kept], number[kept]
    offset = at - begin[piece[at]]
    here_id, here_pos = doc_id[piece[at]], pos[piece[at]] + offset
    order = np.lexsort((here_pos, here_id, number))
    lead = np.ones(len(order), bool)
    lead[1:] = number[order][1:] != number[order][:-1]
    leader = order[np.flatnonzero(lead)][np.cumsum(lead) - 1]
    late = order[(here_id[order] != here_id[leader]) | (here_pos[order] != here_pos[leader])]
    return piece[at[late]], offset[late]


_LATE = "doc_id long, tag long, pos int, mask int"


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The late windows of pieces that are sorted by anchor."""

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        shard = pa.Table.from_batches(held).combine_chunks()
        doc_id, pos, mask = (shard.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "pos", "mask"))
        piece, offset = located(doc_id, pos, mask, shard.column("words").to_pylist())
        late = np.zeros(shard.num_rows, np.int64)
        np.bitwise_or.at(late, piece, 1 << offset)
        some = np.flatnonzero(late)
        rows = shard.select(["doc_id", "tag", "pos"]).take(pa.array(some)).append_column("mask", pa.array(late[some].astype(np.int32)))
        return rows.combine_chunks().to_batches()[0] if len(some) else pa.RecordBatch.from_pylist([], rows.schema)

    held: list[pa.RecordBatch] = []
    total, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column("anchor").to_numpy()
        opens = np.flatnonzero(np.append([anchor[0] != last], anchor[1:] != anchor[:-1]))
        at = 0
        for cut in opens.tolist():
            if total + cut - at >= SHARD:
                if cut > at:
                    held.append(batch.slice(at, cut - at))
                yield out(held)
                held, total, at = [], 0, cut
        held.append(batch.slice(at))
        total += batch.num_rows - at
        last = anchor[-1]
    if held:
        yield out(held)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of pieces that their slice has not settled, one row each, with 128 bits of a hash."""
    for batch in batches:
        words = batch.column("words").to_pylist()
        mask = batch.column("mask").to_numpy().astype(np.int64)
        piece, offset = np.nonzero(mask[:, None] >> np.arange(SPREAD) & 1)
        rows = pa.array(piece)
        cut = [words[i][4 * j : 4 * (j + WINDOW)] for i, j in zip(piece.tolist(), offset.tolist(), strict=True)]
        keys = np.array([divmod(xxhash.xxh3_128_intdigest(c), 1 << 64) for c in cut], np.uint64).reshape(-1, 2).view(np.int64)
        places = pa.array((batch.column("pos").to_numpy()[piece] + offset).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[:, 0]), pa.array(keys[:, 1]), batch.column("doc_id").take(rows), batch.column("tag").take(rows), places, pa.array(cut, pa.binary())],
            names=["w1", "w2", "doc_id", "tag", "pos", "words"],
        )


def _late_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The late ones among windows that meet the confirmed windows (phrase) and their first places."""
    for batch in batches:
        n = batch.num_rows
        stream, piece, text = _streamed(batch.column("phrase").to_pylist() + batch.column("words").to_pylist())
        begin = np.searchsorted(piece, np.arange(2 * n)).tolist()
        number: dict[str, int] = {}
        for i in range(n):
            number.setdefault(text[begin[i] : begin[i] + WINDOW], i)
        at, hit = occurrences(text, list(number))
        first = np.array(list(number.values()), np.int64)[hit]
        row = piece[at] - n
        first, row = first[row >= 0], row[row >= 0]
        columns = {c: batch.column(c).to_numpy() for c in ("doc_id", "pos", "first_id", "first_pos")}
        late = row[(columns["doc_id"][row] != columns["first_id"][first]) | (columns["pos"][row] != columns["first_pos"][first])]
        rows = batch.select(["doc_id", "tag", "pos"]).take(pa.array(late))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.ones(len(late), np.int32))], names=["doc_id", "tag", "pos", "mask"])


def _cleared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the covered words of candidate documents."""
    for batch in text_slices(batches):
        w = words_of(batch.column("text"))
        starts = []
        late = batch.column("late").to_pylist()
        for d, (settled, pieces) in enumerate(zip(batch.column("settled").to_pylist(), late, strict=True)):
            base = int(w.bounds[d])
            starts.append(np.frombuffer(settled, "<i4").astype(np.int64) + base)
            if pieces:
                pos, mask = np.array([(p["pos"], p["mask"]) for p in pieces], np.int64).T
                i, j = np.nonzero(mask[:, None] >> np.arange(SPREAD) & 1)
                starts.append(pos[i] + j + base)
        keep = ~covered(len(w.codes), np.concatenate(starts), WINDOW) if starts else np.ones(len(w.codes), bool)
        removed = np.bincount(w.doc, ~keep, batch.num_rows).astype(np.int64)
        kept = _joined(w, keep)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("no_id"), pa.array(w.counts), pa.array(removed), pa.array(_digests(kept), pa.string()), kept],
            names=["doc_id", "no_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def _late(pieces: DataFrame, hot: int) -> DataFrame:
    """doc_id, tag, pos, mask of the windows of the pieces that also start earlier."""
    spark = pieces.sparkSession
    often = stored(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("anchor"), "phrase-hot")
    usual = pieces.join(often, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_located, _LATE)
    late = stored(usual, "phrase-late")
    single = stored(pieces.join(often, "anchor", "left_semi").mapInArrow(_single, "w1 long, w2 long, doc_id long, tag long, pos int, words binary"), "phrase-single")
    confirmed = single.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos", "words")).alias("f")).where("n > 1")
    met = single.join(confirmed.select("w1", "w2", F.expr("f.doc_id").alias("first_id"), F.expr("f.pos").alias("first_pos"), F.expr("f.words").alias("phrase")), ["w1", "w2"])
    late_single = stored(met.mapInArrow(_late_single, _LATE), "phrase-late-single")
    dropped(spark, often, single)
    return late.union(late_single)


def _deduplicated(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Documents that lose nothing (without text) and the others with their kept text."""
    spark = docs.sparkSession
    small_batches(spark)
    no_id = F.col("doc_id").isNull()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc_id"), F.xxhash64("text", no_id).alias("tag"), no_id.alias("no_id"), "text")
    counts = rows.select("text").mapInArrow(_anchor_counts, "anchor long, n int")
    recurring = stored(counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "phrase-anchors")
    released(spark)
    places = rows.select("doc_id", "tag", "text").mapInArrow(_anchor_places, "anchor long, doc_id long, tag long, place long").join(recurring, "anchor", "left_semi")
    places = stored(places.groupBy("doc_id", "tag").agg(F.collect_set("place").alias("places")), "phrase-places")
    released(spark)
    table = stored(rows.join(places, ["doc_id", "tag"], "left").mapInArrow(_pieces, _DOCUMENT), "phrase-pieces")
    dropped(spark, recurring, places)
    released(spark)
    pieces = table.where("size(pieces) > 0").select("doc_id", "tag", F.explode("pieces").alias("p")).select("p.anchor", "doc_id", "tag", "p.pos", "p.mask", "p.words")
    late = _late(pieces, hot)
    released(spark)
    late = late.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("pos", "mask")).alias("late"))
    open_ = table.where("text IS NOT NULL").select("doc_id", "tag", "no_id", "text", "settled").join(late, ["doc_id", "tag"], "left")
    cleared = open_.select("doc_id", "no_id", "text", "settled", "late").mapInArrow(_cleared, "doc_id long, no_id boolean, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return table.where("text IS NULL"), cleared


def _id() -> Column:
    return F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id")


def repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    plain, cleared = _deduplicated(docs, hot)
    plain = plain.select(_id(), "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return plain.union(cleared.select(_id(), "n_words", "n_removed", "kept_sha256"))


def kept_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the text that is left, words joined by one space, for documents that repeated passages may touch."""
    return _deduplicated(docs)[1].select(_id(), F.col("kept_text").alias("text"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i+19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
q AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM p) WHERE r > 1),
c AS (SELECT DISTINCT doc_id, i + j AS k FROM q, (SELECT unnest(range(0, 20)) AS j)),
x AS (SELECT doc_id, k, w[k] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
y AS (SELECT x.doc_id, count(*) AS n_words, count(c.k) AS n_removed, string_agg(CASE WHEN c.k IS NULL THEN s END, ' ' ORDER BY x.k) AS kept
      FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.k = x.k GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN y ON y.doc_id = d.doc_id
"""
