"""Near-duplicates by one-permutation MinHash with optimal densification.

Texts are lower-cased (A-Z only); a document's set holds the hashes of its
distinct five-word shingles (the whole sequence if it has fewer words).

1. ``sketched``: one hash of each shingle falls into one of ``BINS`` bins, a bin
   keeps its least hash, and an empty bin borrows from the first filled bin in an
   order of its own (optimal densification).  ``BANDS`` bands of ``ROWS`` bins
   are hashed to bucket numbers.  A similarity of 0.75 is missed with probability
   ``(1 - 0.75**4)**32 < 1e-5``.
2. Documents with the same set (128-bit digest and size) form a class; only the
   class representative, its least doc_id, goes on.  Copies never make pairs.
3. Each bucket sends a star of edges from its least member to the others, so the
   number of candidate pairs is bounded by the number of bucket rows.
4. Candidates are confirmed on the full sets: 100 * common >= 75 * union.
5. The exact rest: a star whose centre is not similar to two similar members must
   lose no link.  Where members of one star are in different components, a better
   centre is chosen and sends a second star (``second_star``).  Members that are
   still apart are compared by what tells them from that centre: the overlap of
   two members follows from the sizes of both differences and of what these
   share, so a prefix filter on the differences leaves only pairs that can meet
   the threshold, and those are tested too (``untested``).
6. Components by hooking to lesser neighbours, pointer jumping and contraction.

Every shuffle key with many rows meets either a combinable aggregate or a join
whose large partitions can be split; the text of a star's centre is dealt out to
``SALTS`` places, and nothing but scalars reaches the driver.

Defined results: a null text or one without words has an empty set and is linked
with nothing; a row with a null doc_id is a component of its own; rows with the
same doc_id are one document, with the text of the least hash where they differ,
and all get its result; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import dropped, released, small_batches, stored
from .words import filled, mixed, text_slices, windows, words_of

SHINGLE = 5
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
PERCENT = 75
#: Places that the text of a star's centre goes to, by a hash of the member.
SALTS = 64


def _orders() -> np.ndarray:
    """For each bin a fixed random order of all bins."""
    names = np.arange(BINS, dtype=np.uint64)
    return np.argsort(mixed(names[:, None] * np.uint64(BINS) + names[None, :] + np.uint64(1 << 32)), axis=1)


_ORDERS = _orders()


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) pairs, distinct and sorted by both."""
    w = words_of(pc.ascii_lower(filled(texts)))
    h = w.hashes() if len(w.codes) else np.zeros(0, np.uint64)
    counts = w.counts
    doc = w.doc
    starts = np.arange(len(h))
    full = starts + SHINGLE <= np.repeat(w.bounds[1:], counts)
    rows = [doc[full]]
    values = [windows(h, SHINGLE)[starts[full]] if full.any() else np.zeros(0, np.uint64)]
    for n in range(1, SHINGLE):  # shorter texts: the whole sequence
        whole = np.flatnonzero(counts == n)
        if len(whole):
            rows.append(whole)
            values.append(mixed(windows(h, n)[w.bounds[whole]] + np.uint64(n)))
    rows, values = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[first], values[first]


def signatures(n: int, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The densified bins of ``n`` documents; documents without shingles get arbitrary ones."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    bins = np.full(n * BINS, empty, np.uint64)
    at = rows * BINS + (values >> np.uint64(57)).astype(np.int64)
    # Rows are sorted by document and hash, hence by bin: the first hash of a bin is its least.
    lead = np.ones(len(at), bool)
    lead[1:] = at[1:] != at[:-1]
    bins[at[lead]] = values[lead]
    bins = bins.reshape(n, BINS)
    filled_ = np.zeros(n * BINS, bool)
    filled_[at[lead]] = True
    filled_ = filled_.reshape(n, BINS)
    some = filled_.any(axis=1)
    d, b = np.nonzero(~filled_ & some[:, None])
    out = bins.copy()
    for j in range(BINS):
        if not len(d):
            break
        source = _ORDERS[b, j]
        hit = filled_[d, source]
        out[d[hit], b[hit]] = bins[d[hit], source[hit]]
        d, b = d[~hit], b[~hit]
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = mixed(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)
    names = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in text_slices(batches):
        n = batch.num_rows
        rows, values = shingles(batch.column("text"))
        size = np.bincount(rows, minlength=n)
        digest = []
        for salt in (1, 2):
            sums = np.zeros(n, np.uint64)
            np.add.at(sums, rows, mixed(values + np.uint64(salt)))
            digest.append(pa.array(sums.view(np.int64)))
        bands = mixed((signatures(n, rows, values).reshape(n, BANDS, ROWS) * factors).sum(axis=2, dtype=np.uint64) + names)
        flat = pa.array(bands.view(np.int64).reshape(-1))
        offsets = pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("tag"), pa.array(size.astype(np.int64)), *digest, pa.ListArray.from_arrays(offsets, flat)],
            names=["doc_id", "tag", "n_shingles", "d1", "d2", "bands"],
        )


def sketched(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).mapInArrow(_sketched, "doc_id long, tag long, n_shingles long, d1 long, d2 long, bands array<long>")


def _set_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Batches of pairs (a, b, text_a, text_b) with the full sets of both; equal neighbours of ``a`` are hashed once."""
    last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
    for batch in text_slices(batches, "text_b", 2 << 20):
        rows, values = shingles(batch.column("text_b"))
        bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        sets = []
        for i, hub in enumerate(batch.column("a").to_pylist()):
            if last[0] != hub:
                last = (hub, shingles(batch.column("text_a").slice(i, 1))[1])
            sets.append((last[1], values[bounds[i] : bounds[i + 1]]))
        yield batch, sets


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, n_a, n_b, common of each pair."""
    for batch, sets in _set_pairs(batches):
        counts = [(len(x), len(y), int(np.isin(y, x, assume_unique=True).sum())) for x, y in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3))], names=["a", "b", "n_a", "n_b", "common"]
        )


def _flat(batch: pa.RecordBatch, own: list[np.ndarray]) -> pa.RecordBatch:
    times = pa.array(np.repeat(np.arange(len(own)), [len(o) for o in own]))
    return pa.RecordBatch.from_arrays([batch.column("a").take(times), batch.column("b").take(times), pa.array(np.concatenate(own).view(np.int64))], names=["a", "b", "s"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, s: the shingles of b that a lacks."""
    for batch, sets in _set_pairs(batches):
        yield _flat(batch, [y[~np.isin(y, x, assume_unique=True)] for x, y in sets])


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, s: the shingles that only one of a and b has."""
    for batch, sets in _set_pairs(batches):
        yield _flat(batch, [np.setxor1d(y, x, assume_unique=True) for x, y in sets])


LINKED = f"common > 0 AND 100 * common >= {PERCENT} * (n_a + n_b - common)"


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    first = salted.select("a", "salt").distinct().join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return salted.join(second, "b").join(first, ["a", "salt"]).select("a", "b", "text_a", "text_b")


def measured(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of both sets and of their intersection."""
    return _with_texts(pairs, texts).mapInArrow(_measured, "a long, b long, n_a long, n_b long, common long")


def _apart(star: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, common, component, hub_component, m: members of stars that are not in one component yet."""
    placed = star.join(labels.select(F.col("node").alias("b"), "component"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    hub = labels.select(F.col("node").alias("a"), F.col("component").alias("hub_component"))
    placed = placed.join(hub, "a", "left").withColumn("hub_component", F.coalesce("hub_component", "a"))
    apart = placed.groupBy("a").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi AND m > 1")
    return placed.join(apart.select("a", "m"), "a")


def second_star(star: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of a better centre and the members of each star that are still apart.

    The first centre is a bucket's least doc_id and may be an edited copy.  What most members add to it belongs to
    the text they were copied from; the member that is made up of the centre's and such shingles is the next centre.
    """
    members = stored(_apart(star, labels), "minhash-apart")
    added = stored(_with_texts(members, texts).mapInArrow(_added, "a long, b long, s long"), "minhash-added")
    usual = added.groupBy("a", "s").agg(F.count(F.lit(1)).alias("f")).join(members.select("a", "m").distinct(), "a").where("2 * f >= m").select("a", "s")
    gain = added.join(usual, ["a", "s"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("gain"))
    score = F.struct((2 * (F.col("common") + F.coalesce("gain", F.lit(0))) - F.col("n_b")).alias("score"), (-F.col("b")).alias("least"))
    centre = members.join(gain, ["a", "b"], "left").groupBy("a").agg(F.max_by("b", score).alias("centre"))
    return members.select("a", "b").join(centre, "a").where("b <> centre").select(F.col("centre").alias("a"), "b").distinct()


def untested(star: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of one star, in different components, that can be linked at all.

    ``star`` has the measured pairs of each centre with its members.  Members x
    and y are linked if they share at least 3/7 * (n_x + n_y) shingles
    (100 * common >= 75 * union).  With D_x, the shingles that only one of x and
    the centre has, they share common_x + common_y - n_a + |D_x & D_y|, hence

    * without a common difference they are linked if the slacks
      7 * common - 3 * n of both come to 7 * n_a.  The member with the largest
      slack then is linked with both: a star from it joins all such pairs;
    * else the differences share at least
      need = ceil(3/7 * (n_x + n_y)) + n_a - common_x - common_y >= 1, so the rarest
      that they share lies among the first |D| - need + 1 of either (prefix filter).

    Nothing that meets the threshold is left out, and copies with edits of their
    own, which share no rare difference, make no pairs.
    """
    members = _apart(star, labels).withColumn("slack", F.expr("7 * common - 3 * n_b")).withColumn("n_d", F.expr("n_a + n_b - 2 * common"))
    members = stored(members, "minhash-apart")
    best = members.groupBy("a").agg(F.max(F.struct("slack", (-F.col("b")).alias("least"), "component")).alias("best"))
    best = best.select("a", F.expr("best.slack").alias("most"), (-F.expr("best.least")).alias("centre"), F.expr("best.component").alias("centre_component"))
    near = members.join(best, "a").where("component <> centre_component AND slack + most >= 7 * n_a").select(F.col("centre").alias("x"), F.col("b").alias("y"))

    differing = stored(_with_texts(members, texts).mapInArrow(_differing, "a long, b long, s long"), "minhash-differing")
    tagged = differing.join(members.select("a", "b", "n_a", "n_b", "n_d", "common", "slack", "component", "hub_component"), ["a", "b"])
    usual = tagged.groupBy("a", "s").agg(F.count(F.lit(1)).alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("f", "s"))
    prefix = tagged.join(usual, ["a", "s"]).withColumn("place", place).join(best.select("a", "most"), "a")
    prefix = prefix.where("lo <> hi AND place <= n_d - ceil((7 * n_a - slack - most) / 7) + 1").select("a", "b", "s", "n_a", "n_b", "n_d", "common", "component", "hub_component", "place")
    left, right = prefix.where("component <> hub_component").alias("x"), prefix.alias("y")
    # A member counts from the side outside the centre's component; two outside members meet once, by component.
    once = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.hub_component")) | (F.col("x.component") < F.col("y.component")))
    need = "ceil(3 * (x.n_b + y.n_b) / 7) + x.n_a - x.common - y.common"
    able = F.expr(f"x.place <= x.n_d - ({need}) + 1 AND y.place <= y.n_d - ({need}) + 1")
    met = left.join(right, (F.col("x.a") == F.col("y.a")) & (F.col("x.s") == F.col("y.s")) & once & able)
    pairs = near.union(met.select(F.col("x.b").alias("x"), F.col("y.b").alias("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the least node that can be reached, for every node of an edge (a, b).

    Each node hooks to its least lesser neighbour, pointers are doubled until they reach roots, and edges are
    contracted to edges between roots, until none is left.  The least node of a component is never hooked.
    """
    spark = edges.sparkSession
    ends = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = stored(edges.select(*ends).where("a < b").distinct(), f"{name}-edges")
    labels = None
    while not edges.isEmpty():
        roots = stored(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), f"{name}-roots")
        while True:
            further = roots.select(F.col("node").alias("root"), F.col("root").alias("further"))
            step = stored(roots.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"{name}-roots")
            dropped(spark, roots)
            roots, moved = step.select("node", "root"), not step.where("moved").isEmpty()
            if not moved:
                break
        to_a, to_b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        between = edges.join(to_b, "b", "left").join(to_a, "a", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        between = stored(between.select(*ends).where("a < b").distinct(), f"{name}-edges")
        dropped(spark, edges)
        edges = between
        if labels is None:
            labels = roots.select("node", F.col("root").alias("component"))
        else:
            moved_on = labels.join(roots.select(F.col("node").alias("component"), "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            labels = stored(moved_on.union(roots), f"{name}-labels")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = labels.select(F.col("component").alias("node"), "component").distinct()
    return stored(labels.union(found), f"{name}-labels")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    spark = docs.sparkSession
    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("tag"))
    key = ["d1", "d2", "n_shingles"]
    rows = stored(sketched(docs), "minhash-sketch")
    # Rows of one doc_id with different texts count with the text of the least hash.
    several = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("tag").alias("own"), F.max("tag").alias("other")).where("own <> other").select("doc_id", "own")
    several = stored(several, "minhash-several")
    sketch = rows.join(several, "doc_id", "left").where("own IS NULL OR own = tag").drop("own")
    classes = sketch.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    classes = stored(classes, "minhash-classes")

    leaders = sketch.join(classes.select(F.col("rep").alias("doc_id"), *key), ["doc_id", *key], "left_semi")
    buckets = stored(leaders.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("bucket")).distinct(), "minhash-buckets")
    hubs = buckets.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "hub")
    shared = stored(buckets.join(hubs, "bucket"), "minhash-shared")
    candidates = stored(shared.where("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "minhash-star")
    needed = named.join(shared.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    own = needed.join(several, "doc_id", "left").where("own IS NULL OR own = tag")
    texts = stored(own.select("doc_id", "text").dropDuplicates(["doc_id"]), "minhash-texts")
    star = stored(measured(candidates, texts), "minhash-measured")
    dropped(spark, buckets, shared, candidates)
    released(spark)
    first = components(star.where(LINKED).select("a", "b"), "minhash-first")
    # The exact rest: members of one star that are still in different components.
    second = stored(second_star(star, first, texts), "minhash-second")
    again = stored(measured(second, texts), "minhash-measured")
    labels = components(_as_edges(first).union(again.where(LINKED).select("a", "b")), "minhash-next")
    pairs = stored(untested(again, labels, texts), "minhash-rest")
    more = stored(measured(pairs, texts).where(LINKED).select("a", "b"), "minhash-more")
    last = components(_as_edges(labels).union(more), "minhash-all")
    dropped(spark, texts, star, second, again, pairs, more, first, labels)

    of_class = classes.join(last.select(F.col("node").alias("rep"), "component"), "rep", "left")
    of_class = of_class.select(*key, F.coalesce("component", "rep").alias("component_id"))
    found = sketch.join(several, "doc_id", "left_semi").select("doc_id", *(F.col(c).alias(f"own_{c}") for c in key)).distinct()
    found = rows.select("doc_id", *key).join(found, "doc_id", "left").select("doc_id", *(F.coalesce(f"own_{c}", c).alias(c) for c in key))
    found = found.join(of_class, key, "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    found = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).otherwise(component).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _as_edges(labels: DataFrame) -> DataFrame:
    return labels.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))


def near_deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that are kept: one of each component."""
    gone = linked(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i+4] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
